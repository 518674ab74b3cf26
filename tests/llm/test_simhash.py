from __future__ import annotations

import random

import numpy as np
import pytest

from huntline.llm import simhash
from huntline.llm.queries import QUERIES

from . import brute


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = brute.near_components([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, small).collect()}
    assert got == want


def test_every_near_pair_meets_at_a_home_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    xi, xa, xh = simhash.anchors(x)
    yi, ya, _ = simhash.anchors(y)
    assert xh.sum() == 3 * len(x)
    visits = set(zip(yi.tolist(), ya.tolist(), strict=True))
    met = {i for i, a in zip(xi[xh].tolist(), xa[xh].tolist(), strict=True) if (i, a) in visits}
    assert met == set(range(3000))


@pytest.mark.parametrize("residents,visitors", [(4096, 65536), (3, 5)])
def test_links_connect_what_all_pairs_connect(spark, residents, visitors):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    seed = rnd.getrandbits(64)
    for _ in range(150):  # one crowded group
        fps.add(seed ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), residents=residents, visitors=visitors).collect()
    at = {s: i for i, s in enumerate(signed)}
    mine = brute.groups(len(fps), [(at[r.a], at[r.b]) for r in found])
    want = brute.groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert len({*zip(mine, want, strict=True)}) == len(set(mine)) == len(set(want))
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 4 for r in found)
    assert residents < 100 or len(found) < 20 * len(fps)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    rows = [(5, None, "k"), (3, "", "k"), (4, " \t\n", "k"), (7, "One two three four five", None), (6, "one  TWO three\nfour five", "z"), (6, "one  TWO three\nfour five", "z"), (None, long, "q"), (9, long.upper(), "q"), (10, "a", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (7, 6), (6, 6), (None, 9), (9, 9), (10, 10)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 9, 10]
    assert simhash.classes(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
