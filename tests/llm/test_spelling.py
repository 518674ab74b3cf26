"""Spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest

from huntline.llm import spelling
from huntline.llm.queries import QUERIES


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_of(words: dict[str, int]) -> dict[str, set[str]]:
    """All words at one edit, found by trying every deletion of every word (no rotations)."""
    by_hole: dict[str, set[str]] = {}
    for w in words:
        for i in range(len(w)):
            by_hole.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= by_hole[w[:i] + "*" + w[i + 1 :]] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def brute(words: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    near = near_of(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def counted(rows) -> dict[str, int]:
    c = Counter()
    for key, text in rows:
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 7:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= 2}


def told(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_words_against_brute_force(spark):
    words = {"kitten": 5, "sitten": 50, "mitten": 50, "kiten": 1, "kittten": 3, "kitttten": 900, "aaaa": 2, "aaa": 40, "aaaaa": 500, "ab": 7, "ba": 7, "a": 80,
             "été": 3, "éte": 30, "ete": 300, "etes": 3000, "abab": 4, "baba": 4, "aba": 4, "bab": 40, "abc": 9, "bcd": 9}
    assert all(one_edit(a, b) for a, found in near_of(words).items() for b in found)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert told(spelling.variants(df)) == brute(words)
    assert spelling.variants(df.limit(0)).count() == 0
    assert told(spelling.variants(df.filter("word = 'ab'"))) == {"ab": (None, "ab", 7, 0, None)}


def test_chain_of_forms(spark):
    words = {"a" * (3 + i): 10**i for i in range(10)}
    got = told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)
    assert {v[1] for v in got.values()} == {"a" * 12}


def test_documents_with_odd_rows(spark):
    long_text = " ".join(f"Wörtlich{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(40000))
    rows = [(1, None), (2, ""), (3, "Example example EXAMPLE exampel"), (None, "example Example"), (3, "Example example EXAMPLE exampel"), (4, long_text), (5, long_text + "퟿×÷ÀÿÞĀ"),
            (6, "example," * 3 + "one-two_three4four")] + [(i, "example resumee" + " exemple examplé résumee" * (i % 40 == 0)) for i in range(10, 130)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string")
    got = told(spelling.spelling_variants(df))
    assert got == brute(counted(rows))
    assert any(v[0] for v in got.values())


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert told(QUERIES["op11_spelling_variants"](spark, small)) == brute(counted(rows))


@pytest.mark.parametrize("word", ["aab", "aaa", "abcabc", "zzyzz"])
def test_each_deletion_counts_once(spark, word):
    words = {word: 1, **{word[:i] + word[i + 1 :]: 1 for i in range(len(word))}}
    assert told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)
