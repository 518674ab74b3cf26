from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from huntline.llm import mixing

from . import brute


def test_run_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [d for d in docs if brute.quality(d[1])["fail_bits"] == 0]
    heads = brute.near_components([(k, t) for k, t, _ in docs])
    docs = [d for d in docs if heads[d[0]][1] == d[0]]
    judged = [brute.contamination(t, items) for _, t, _ in docs]
    docs = [d for d, (n, hit, _) in zip(docs, judged, strict=True) if not (hit and 20 * hit >= n)]
    copies = brute.mixture(docs, mixing.TURNS)
    out = corpus_pipeline.run(spark, small).collect()
    want = Counter({k: c for (k, _, _), c in zip(docs, copies, strict=True) if c})
    assert Counter(r.doc_id for r in out) == want and len(want) > 50
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_every_stage_but_the_last_keeps_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).columns == [*docs.columns, "shard", "slot"]


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def odd_rows():
    long_text = " ".join(f"w{i % 977}x{i % 1009}" for i in range(60_000))
    good = [" ".join(f"{a}{i}{chr(97 + i % 26)}" for i in range(80)) for a in ("al", "be", "ga", "de")]
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long_text, "a"), (5, good[0], "a"), (5, good[0], "a"), (6, good[0], "b"), (None, good[1], None), (None, good[2], "c"), (7, good[3], "a")]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, small, number):
    """Null, empty, blank and very long texts, null keys and sources, repeated rows, extra columns with awkward names."""
    extra = "shard string, size long, copies int, hash string, fail_bits string, component_id int, label string, words int, bucket string"
    if number == 4:
        extra = extra.replace("shard string, ", "").replace(", bucket string", "")
    names = [c.split()[0] for c in extra.split(", ")]
    rows = [(k, t, "en", s, len(t or ""), *("7" if " string" in c else 7 for c in extra.split(", "))) for k, t, s in odd_rows()]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    out = corpus_pipeline.STAGES[number][1](spark, docs, small)
    assert out.columns == (docs.columns if number < 4 else [*docs.columns, "shard", "slot"])
    got = out.collect()
    assert all(str(r[c]) == "7" for r in got for c in names)
    texts = Counter((r.doc_id, r.text) for r in got)
    given = Counter((k, t) for k, t, _ in odd_rows())
    if number == 0:
        assert texts == Counter({x: n for x, n in given.items() if brute.quality(x[1])["fail_bits"] == 0}) and texts[5, odd_rows()[4][1]] == 2
    elif number == 1:
        assert sorted(map(str, (t for _, t in texts))) == sorted(set(map(str, (t for _, t in texts)))) and {t for _, t in texts} >= {odd_rows()[i][1] for i in (3, 4, 7, 8, 9)}
    elif number in (2, 4):
        assert texts == given
    else:
        assert set(texts) <= {x for x in given if brute.words(x[1])}
