"""The operators that are DataFrame expressions only: rules, mixing, sharding, decontamination."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from huntline.llm import decontamination, mixing, quality_rules, sharding
from huntline.llm.queries import QUERIES

from . import brute

TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c a b c", "x x x x", "l1 w\nl1 w\n\n \nl2", "# ! | é \x00 z\x1cq", "tief weit über " * 30,
         "|".join("ab" for _ in range(60)), "A!! B!! " * 40, "word%d " * 3, " ".join(f"w{i}" for i in range(70)), " ".join(f"v{i % 9000}" for i in range(30000)), "漢字" * 40 + " x"]


def test_rules_against_brute_force(spark):
    docs = spark.createDataFrame([(i % 7 or None, t, "x", 1) for i, t in enumerate(TEXTS + TEXTS[:3])], "doc_id long, text string, fail_bits string, _entry int")
    got = quality_rules.ledger(docs).collect()
    want = [brute.quality(t) for t in TEXTS + TEXTS[:3]]
    key = lambda m: tuple(m[n] for n in [*quality_rules.MEASURES, "fail_bits"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(w["fail_bits"] == 0 for w in want) > 0
    assert quality_rules.keep(docs.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    bits = [0, 0, 1, 3, 16, 17, 32, 98]
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality_rules.ablation(spark.createDataFrame([(b,) for b in bits], "fail_bits long"), "v2").collect()}
    assert set(got) == {r.name for r in quality_rules.RULES}
    for rule in quality_rules.RULES:
        b = 1 << rule.bit
        assert got[rule.name] == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))
    for name in quality_rules.POLICIES:
        m = quality_rules.mask(quality_rules.POLICIES[name])
        df = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
        assert df.filter(quality_rules.passes(name)).count() == sum(x & m == 0 for x in bits)


def mix_rows():
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        source = rnd.choice(["a"] * 8 + ["B", "é", "z", "￿", "\U0001f600", None])
        rows.append((i if i % 50 else None, " ".join(["w"] * int(rnd.paretovariate(0.8) * 10 % 3000)), source))
    return rows + [(5, None, "a"), (6, "", "empty"), (7, " ", "empty"), rows[10], rows[10], (8, "tiny word", "rare")]


def test_mixing_against_brute_force(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, target string, before int")
    got = mixing.plan(docs).collect()
    copies = brute.mixture(rows, mixing.TURNS)
    want = Counter((k, s, len(brute.words(t)), c) for (k, t, s), c in zip(rows, copies, strict=True))
    assert Counter((r.doc_id, r.source, r["size"], r.copies) for r in got) == want
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    goal = brute.targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source]) and 0 <= r.copies <= 3
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(copies)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("source = 'empty'")).count() == 0


def test_taken_words_are_near_their_target(spark):
    got = QUERIES["op7_mixing"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect():
        assert abs(r.t - r.goal) < 0.02 * r.goal


@pytest.mark.parametrize("n", [1, 16, 1000])
def test_shards(spark, n):
    rows = [(i % 300 if i % 11 else None, random.Random(i).choice(["", None, "same text", f"text {i}"]), i) for i in range(500)] + [(7, "same row", 1)] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").withColumn("bucket", F.create_map(F.lit("k"), F.col("doc_id")))
    out = sharding.shard(docs, n, bucket_bytes=3000)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((k, t) for k, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(n))
    sizes = [len(by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard(docs.limit(0), n).count() == 0


def test_shuffle_is_random_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    order = lambda seed: [r.doc_id for r in sharding.external_shuffle(docs, seed=seed, bucket_bytes=20000).orderBy("position").collect()]
    a = order(1)
    assert a == order(1) and a != order(2) and sorted(a) == list(range(2000))
    rising = sum(x < y for x, y in zip(a, a[1:], strict=False))
    assert 900 < rising < 1100  # as in a random order


def test_shard_query_reads_what_was_written(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op9_sharding"](spark, small).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs.items()}
    assert len(got) == len(docs)


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = ["the", "of", "to", *[f"w{i}" for i in range(12)]]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 5, 13, 20, 30]))) for i in range(12)] + [(None, say(15)), (3, say(14)), (50, None), (51, "?!"), (52, "never-seen words here"), (0, "THE")]
    rows = []
    for i in range(60):
        text = say(rnd.randint(0, 60))
        if i % 3 == 0:
            own = rnd.choice(items)[1] or ""
            text = rnd.choice(["", "... "]) + text + ", " + own.upper() + "; " + say(rnd.randint(0, 9))
        rows.append((i if i % 20 else None, text))
    rows += [(70, None), (71, ""), (72, "!?"), (73, items[3][1]), (73, items[3][1]), (74, "x " * 20000 + items[4][1]), (75, "ÀÉ the É")]
    docs = spark.createDataFrame([(k, t, "q", 2) for k, t in rows], "doc_id long, text string, hits string, term int")
    tests = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, term int")
    window = 4
    got = Counter((r.doc, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontamination.verdicts(docs, tests, window=window).collect())
    want = []
    for k, t in rows:
        n, hit, found = brute.contamination(t, items, window)
        want.append((k, n, hit, tuple(found), hit > 0 and 20 * hit >= n))
    assert got == Counter(want)
    clean = decontamination.clean(docs, tests, window=window)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[4])
    assert decontamination.clean(docs.limit(0), tests).count() == 0
    assert decontamination.clean(docs, tests.limit(0)).count() == len(rows)


def test_proximity(spark):
    texts = [(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x beta"), (None, "alpha beta alpha")]
    docs = spark.createDataFrame(texts, "doc long, text string")
    pairs = spark.createDataFrame([(0, "alpha", "beta")], "pair int, term1 string, term2 string")
    index = decontamination.postings(docs, pairs.select(F.explode(F.array("term1", "term2")).alias("term")))
    got = sorted((str(r.doc), r.position1, r.position2) for r in decontamination.proximity(index, pairs, 3).collect())
    assert got == [("1", 0, 3), ("2", 1, 0), ("None", 0, 1), ("None", 2, 1)]


def test_a_repeated_word_costs_a_comparison_for_each_place(spark):
    docs = spark.createDataFrame([(1, "the " * 20_000), (2, "the " * 12), (3, "the " * 13 + "end")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "the " * 400), ("b", "the " * 14), ("c", "end")], "item_id string, text string")
    began = time.monotonic()
    got = {r.doc: (r.n_words, r.n_hit, r["items"]) for r in decontamination.verdicts(docs, items).collect()}
    assert got == {1: (20_000, 20_000, ["a", "b"]), 2: (12, 0, []), 3: (14, 14, ["a", "b", "c"])}
    assert time.monotonic() - began < 30


def test_items_with_their_rarest_terms_near(spark):
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(i, " ".join(words[i * 40:(i + 1) * 40])) for i in range(100)] + [(100, None), (101, "")]
    items = [(f"i{j}", " ".join(rnd.choices(words + ["unseen"], k=rnd.choice([1, 3, 20])))) for j in range(30)]
    counts = Counter(w for _, t in docs for w in (t or "").split())
    want = {}
    for name, text in items:
        rare = sorted((w for w in set(text.split()) if counts[w]), key=lambda w: (counts[w], w))[:2]
        for d, t in docs:
            at = {w: [p for p, x in enumerate((t or "").split()) if x == w] for w in rare}
            if len(rare) == 2 and any(abs(p - q) <= 4 for p in at[rare[0]] for q in at[rare[1]]):
                want.setdefault(d, set()).add(name)
    told = decontamination.verdicts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), slop=4)
    got = {r.doc: set(r.near) for r in told.collect()}
    assert want and got == {d: want.get(d, set()) for d, _ in docs}
