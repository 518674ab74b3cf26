from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest

from huntline.llm import katz
from huntline.llm.queries import QUERIES
from pyspark.sql import functions as F

from . import brute

BEGIN, END = ("<",), (">",)


class Reference:
    """The same model from dictionaries."""

    def __init__(self, texts, order, cut, least):
        self.order, self.least, self.cut = order, least, cut
        self.counts = {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            s = self.tokens(t)
            for k in range(1, order + 1):
                self.counts[k].update(tuple(s[i - k + 1 : i + 1]) for i in range(k - 1, len(s)))
        self.begins = self.counts[1].get((BEGIN,), 0)
        self.uni = {g: c for g, c in self.counts[1].items() if g != (BEGIN,)}
        self.n = sum(self.uni.values())
        self.d = {}
        for k in range(1, order + 1):
            cc = Counter((self.uni if k == 1 else self.counts[k]).values())
            self.d[k] = katz.good_turing([cc.get(r, 0) for r in range(1, cut + 2)], cut)
        mass = sum(self.disc(1, c) for c in self.uni.values())
        self.total = self.n + (self.n - mass < 1e-9)
        self.unk = 1 - mass / self.total
        self.after = {}
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                if c >= least:
                    self.after.setdefault(g[:-1], []).append(g[-1])
        self.memo = {}

    @staticmethod
    def tokens(text):
        return [BEGIN, *[(w,) for w in brute.words(brute.lower_az(text))], END]

    def disc(self, k, c):
        return c * (self.d[k][c - 1] if 1 <= c <= self.cut else 1)

    def weight(self, h):
        if h not in self.memo:
            taken = sum(self.disc(len(h) + 1, self.counts[len(h) + 1][(*h, w)]) for w in self.after.get(h, []))
            total = self.counts[len(h)].get(h, 0)
            if taken and 1 - taken / total < 1e-9:
                total += 1
            lower = sum(self.p(h[1:], w) for w in self.after.get(h, []))
            self.memo[h] = (total, (1 - taken / total) / max(1 - lower, 1e-12) if taken else 1.0)
        return self.memo[h]

    def p(self, h, w):
        if not h:
            c = self.uni.get((w,), 0)
            return self.disc(1, c) / self.total if c else self.unk
        total, weight = self.weight(h)
        c = self.counts[len(h) + 1].get((*h, w), 0)
        return self.disc(len(h) + 1, c) / total if c >= self.least else weight * self.p(h[1:], w)

    def score(self, text):
        s = self.tokens(text)
        return sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i]), s[i])) for i in range(1, len(s)))

    def base(self, text):
        v = len(self.uni)
        return sum(math.log10((self.uni.get((t,), 0) + 0.1) / (self.n + 0.1 * (v + 1))) for t in self.tokens(text)[1:])


def held(key):
    return zlib.crc32(str(key).encode()) % 10 == 0


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    ref = Reference([r.text for r in docs if not held(r.doc_id)], 2, katz.CUT, katz.LEAST)
    got = {r.doc_id: r for r in QUERIES["op10_katz_backoff"](spark, small).collect()}
    assert len(got) == len(docs)
    for r in docs:
        g, s = got[r.doc_id], ref.tokens(r.text)[1:]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(s), sum((t,) in ref.uni for t in s), ref.n)
        assert math.isclose(g.base_score, ref.base(r.text), rel_tol=1e-9)
        assert math.isclose(g.score, ref.score(r.text), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("order,cell,bucket", [(1, 1 << 20, 1 << 20), (2, 300, 200), (3, 400, 300), (3, 1 << 20, 1 << 20)])
def test_orders_cells_and_buckets(spark, order, cell, bucket):
    import random

    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 40))) for _ in range(80)] + [None, "", "zz zz", "a b a b a b " * 30]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    train = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    got = katz.scored(docs, train, order=order, cell_bytes=cell, bucket_bytes=bucket).collect()
    ref = Reference([t for k, t, _ in rows if k is None or k % 5], order, katz.CUT, katz.LEAST)
    want = sorted((str(k), round(ref.score(t), 6), round(ref.base(t), 6)) for k, t, _ in rows)
    assert sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6)) for r in got) == want
    # After any history the probabilities of all words and of <unk> add up to one.
    for h in [(), (BEGIN,), (("a",),), (("nowhere",),), (("b",), ("a",)), (("a",), ("b",))]:
        if len(h) < order:
            assert math.isclose(sum(ref.p(h, w) for (w,) in ref.uni) + ref.p(h, ("unknown",)), 1, rel_tol=1e-9)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert katz.scored(docs.limit(0), F.lit(True)).count() == 0
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in katz.scored(docs, F.lit(False)).collect()} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}


def test_bigrams_that_occur_once_count(spark, small):
    assert katz.LEAST == 1
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in docs if not held(r.doc_id)]
    ref, cut = Reference(texts, 2, katz.CUT, 1), Reference(texts, 2, katz.CUT, 2)
    got = {r.doc_id: r.score for r in QUERIES["op10_katz_backoff"](spark, small).collect()}
    assert all(math.isclose(got[r.doc_id], ref.score(r.text), rel_tol=1e-9) for r in docs)
    assert any(not math.isclose(ref.score(r.text), cut.score(r.text), rel_tol=1e-3) for r in docs)


def test_discount_of_count_one(spark):
    rows = [(1, "a b a b a b"), (2, "c d"), (3, "a b"), (4, "c d e")]  # "c d" twice, "d e" once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ref = Reference([t for _, t in rows], 2, katz.CUT, 1)
    got = {r.doc_id: r.score for r in katz.scored(docs, F.lit(True)).collect()}
    assert all(math.isclose(got[k], ref.score(t), rel_tol=1e-9) for k, t in rows)
    assert math.isclose(ref.p((("d",),), ("e",)), ref.d[2][0] / 2, rel_tol=1e-9)
