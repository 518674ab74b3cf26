from __future__ import annotations

import random

import numpy as np
import pytest

from huntline.llm import substring_dedup

from . import brute


def corpus(n=120, seed=3):
    rnd = random.Random(seed)
    shared = [[f"s{j}_{i}" for i in range(rnd.randint(5, 40))] for j in range(6)]
    rows = []
    for i in range(n):
        ws = [f"w{rnd.randint(0, 3)}" for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(ws))
            ws[at:at] = rnd.choice(shared)[: rnd.randint(3, 40)]
        rows.append((rnd.choice([i, i // 2, 7]), rnd.choice([" ", "\n", " \t "]).join(ws)))
    return rows + [(None, rows[0][1]), (None, None), (500, None), (501, ""), (502, " \n "), (-3, rows[1][1]), (503, rows[1][1]), (503, rows[1][1])]


@pytest.mark.parametrize("window,cell,bucket", [(4, 1 << 20, 1 << 20), (4, 900, 700), (12, 2000, 3000), (1, 5000, 1 << 20)])
def test_against_brute_force(spark, window, cell, bucket):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string")
    out = substring_dedup.remove_repeats(docs, window=window, cell_bytes=cell, bucket_bytes=bucket).collect()
    want = sorted((str(k), *w) for (k, _), w in zip(rows, brute.without_repeats(rows, window), strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in out) == want
    for r in out:
        gone = sum(s.end - s.begin for s in r.removed)
        assert gone == r.n_words - len(r.kept.split())
        assert all(a.end < b.begin for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_packing_is_exact():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all()
    assert len(substring_dedup.unpack(substring_dedup.pack(x[:0]))) == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert substring_dedup.remove_repeats(docs).count() == 0


@pytest.mark.parametrize("place", [lambda i: 2**60 + i, lambda i: 2**60 + i // 20, lambda i: (-1) ** i * (2**63 - 1 - i), lambda i: 2**63 - 1])
def test_keys_that_no_double_holds(spark, place):
    """Whole-number keys above 2^53, unique and repeated, that fill many cells."""
    rows = [(place(i), t) for i, (_, t) in enumerate(corpus(90)[:90])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(docs, window=6, cell_bytes=700, bucket_bytes=2000).collect()
    want = sorted((str(k), *w) for (k, _), w in zip(rows, brute.without_repeats(rows, 6), strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in out) == want
