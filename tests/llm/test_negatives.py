"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntline.llm import negatives
from huntline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int"


def brute(rows, n_positives=5, n_negatives=3, low=50, high=95):
    known = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            known.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, v, label in known:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in known)
        positives = [(j, -s) for s, j, m in scored if m == label and j != i][:n_positives]
        for j, p in positives:
            fits = [(k, -s) for s, k, m in scored if m != label and low * p <= -100 * s <= high * p][:n_negatives]
            out += [(i, j, r, k, p, s) for r, (k, s) in enumerate(fits, 1)]
    return sorted(out)


def told(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n=1500, dim=12, seed=5, noise=0.25):
    """Vectors of very different lengths around few directions, so that buckets and stretches prune."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    at = rnd.integers(0, 9, n)
    v = (centres[at] + rnd.normal(size=(n, dim)) * noise / np.sqrt(dim)) * np.exp(rnd.normal(size=n))[:, None]
    return [(i, [float(np.float32(x)) for x in v[i]], int((at[i] + (rnd.random() < 0.3)) % 9)) for i in range(n)]


ODD = [(None, [1.0, 2.0], 1), (50, None, 1), (100, [], 2), (150, [1.0, None], 2), (200, [float("nan"), 1.0], 1), (250, [float("inf"), 1.0], 1), (300, [1.0, 2.0], None),
       (350, [0.0] * 12, 3), (400, [0.5], 4), (401, [1e12, -1e3], 4), (450, [0.25, 0.5, 0.75], 77), (500, [-1.0] * 12, 5), (501, [1.0] * 12, 5)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("bucket_rows", "group_rows", "anchor_rows"), [(32, 128, 7), (200, 500, 1000), (4096, 32768, 4096)])
def test_against_brute_force(spark, bucket_rows, group_rows, anchor_rows):
    rows = clustered() + ODD
    rows += rows[40:60] + rows[50:51]  # repeated rows
    rows += [(i + 10000, v, label) for i, v, label in rows[300:330]]  # ties of different ids
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, bucket_rows=bucket_rows, group_rows=group_rows, anchor_rows=anchor_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert told(got) == want
    assert len(want) > 100


def test_one_vector_for_a_third_of_the_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(3)], i % 4) for i in range(600)]
    assert told(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, bucket_rows=40, group_rows=80)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.7, 0.0], 2)]
    assert told(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows) == [(0, 1, 1, 2, 65536, 45824)]
    assert negatives.hard_negatives(frame(spark, rows), F.col("vec_id") < 0).count() == 0
    assert negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_feasible_values_lose_nothing():
    rnd = np.random.default_rng(1)
    for dim in (2, 3, 8):
        p, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in rnd.normal(size=(2, 4000, dim)))
        cosine = np.einsum("ij,ij->i", p, q)
        some = cosine > 0
        for least in (cosine[some], cosine[some] * 0.7):
            for f in range(dim):
                low, high = negatives.feasible(q[some, f], least)
                assert ((p[some, f] >= low) & (p[some, f] <= high)).all()


def test_stretches_prune(spark):
    """On clustered vectors most rows are no candidates, and nothing that scores is lost."""
    rows = clustered(noise=0.1)
    points = np.floor(256 * np.array([v for _, v, _ in rows]))
    unit, order = negatives.Bucket.lists(points)
    bucket = negatives.Bucket(np.arange(len(rows)), np.zeros(len(rows)), points, unit, order, np.take_along_axis(unit, order, 0), float(np.linalg.norm(points, axis=1).max()))
    sizes = []
    for a in range(0, 300, 10):
        chosen = negatives._candidates(bucket, unit[a], 0.97, negatives.FOCUS)
        if chosen is not None:
            sizes.append(len(chosen))
            assert set(np.flatnonzero(unit @ unit[a] >= 0.97)) <= set(chosen)
    assert len(sizes) > 20 and np.mean(sizes) < 0.2 * len(rows)


def test_query_against_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = [(i, v, (m + 1) % 10 if i is not None and i % 7 == 0 and m is not None else m) for i, v, m in rows]
    assert told(QUERIES["op12_hard_negatives"](spark, small)) == brute(rows)
