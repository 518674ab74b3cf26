from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa

from huntline.llm import quality_classifier as Q
from huntline.llm.queries import QUERIES
from huntline.llm.text import split

MEDIUM = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = QUERIES["op2_quality_classifier"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.98
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_features_by_hand():
    texts = ["aa bb aa bb aa bb", None, "", "é x"]
    words, grams, again = Q.features(split(pa.array(texts)))
    assert np.bincount(words[0], minlength=4).tolist() == [6, 0, 0, 2]
    assert len({*words[1][:6].tolist()}) == 2
    # " aa", "aa " ... and the first without a space before it.
    data = b"aa bb aa bb aa bb"
    inner = [data[i : i + 3] for i in range(len(data) - 2) if data[i + 1] != 0x20]
    assert np.bincount(grams[0], minlength=4)[0] == len(inner)
    assert (again[1] - 2 * (1 << Q.BITS)).tolist() == [0, 0, 1, 1]
    assert again[0].tolist() == [0, 0, 0, 0]


def test_score_is_the_same_alone_and_in_a_batch():
    rng = np.random.default_rng(1)
    model = rng.normal(size=Q.SIZE + 1).astype(np.float32)
    texts = ["one two three", "", "a  b\n\nc", "x" * 5000, "one two three " * 50, "ä ö"]
    together = Q.score(split(pa.array(texts)), model)
    assert np.allclose(together, [Q.score(split(pa.array([t])), model)[0] for t in texts])
    assert math.isclose(together[1], 1 / (1 + math.exp(-float(model[-1]))), rel_tol=1e-6)


def test_odd_rows(spark):
    rows = [(1, "good words here " * 9, 1), (2, "%%% bad %%% " * 9, 0), (None, "x", 1), (3, None, 1), (4, "", 0), (4, "", 0), (5, "y" * 200000, 0)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(5, 1), (6, None)], "doc_id long, label int")
    model = Q.fit(docs, labels)
    got = Q.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert (Q.fit(docs, labels) == model).all()
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.scored(docs, none).collect()} == {0.5}
    assert Q.scored(docs.limit(0), model).count() == 0
