"""Line de-duplication against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from huntline.llm import line_dedup
from huntline.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, at_least=10, least_chars=1, policy="all"):
    """{(key, text): (lines, lines that stay)} with one document for each different row."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    holders = {}
    for doc in docs:
        for line in (doc[1] or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(doc)
    out = {}
    for doc in docs:
        lines = (doc[1] or "").split("\n")
        stay = []
        for i, line in enumerate(lines):
            k = key_of(line)
            common = len(k) >= least_chars and len(holders[k]) >= at_least
            first = all(d == doc for d in holders[k] if before(d, doc)) and all(key_of(x) != k for x in lines[:i])
            if not common or (policy == "later" and first):
                stay.append(i)
        out[doc] = (len(lines), stay)
    return out


def before(a, b):
    return (a[0] is not None, a[0] or 0) <= (b[0] is not None, b[0] or 0)


def rows_of(seed=3, n=300):
    rnd = random.Random(seed)
    lines = ["Common line", "  common LINE\t", "", " \x0b", "É", "é", "x", "\xa0x", "nine", "mid\rdle", *(f"l{i}" for i in range(40))]
    rows = [(i, "\n".join(rnd.choice(lines) if rnd.random() < 0.7 else f"own {i} {j}" for j in range(rnd.randrange(12)))) for i in range(n)]
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, "\n\n\n"), (n + 4, "x\n" * 5000 + "end"), (None, "x\ny"), (None, "x\nz"), rows[5], rows[5], (7, "another text of seven\nx")]


@pytest.mark.parametrize(("at_least", "least_chars", "policy"), [(10, 1, "all"), (2, 3, "all"), (1, 1, "later"), (5, 2, "later")])
def test_against_brute_force(spark, at_least, least_chars, policy):
    rows = rows_of()
    if policy == "later":  # of documents with one key and different texts, the order is by text hash
        rows = [r for r in rows if r[0] not in (None, 7)]
    docs = spark.createDataFrame([(*r, 1, "a", b"k") for r in rows], "doc_id long, text string, at int, body string, keep binary").repartition(7)
    want = brute(rows, at_least, least_chars, policy)
    maps = line_dedup.bitmaps(docs, at_least=at_least, least_chars=least_chars, policy=policy)
    cut = line_dedup.kept(docs, maps, n_lines="lines", n_dropped="gone")
    assert cut.columns == [*docs.columns, "lines", "gone"]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.lines, r.gone, r.at, r.body) for r in cut.collect())
    assert got == sorted((k is not None, k or 0, "\n".join((t or "").split("\n")[i] for i in want[k, t][1]), want[k, t][0], want[k, t][0] - len(want[k, t][1]), 1, "a") for k, t in rows)
    assert any(w[0] > len(w[1]) for w in want.values())
    for r in maps.collect():
        if r.keep is not None:
            assert line_dedup.unpack(r.keep, r.n_lines).sum() == r.n_lines - r.n_dropped


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.kept(docs, line_dedup.bitmaps(docs)).count() == 0


@pytest.mark.parametrize("later", [False, True])
def test_ranges_cut_anywhere(later):
    """Any cut of the sorted rows into ranges and batches gives the same lines."""
    rnd = random.Random(8)
    rows = sorted({(bytes([rnd.choice(b"aaaaabbcdefgh")]), rnd.randrange(60), 0) for _ in range(150)})
    table = pa.RecordBatch.from_pylist([{"hash": h, "doc": d, "body": b, "at": 3, "more": np.array([5], np.int32).tobytes() if d % 2 else None} for h, d, b in rows],
                                       pa.schema([("hash", pa.binary()), ("doc", pa.int64()), ("body", pa.int64()), ("at", pa.int32()), ("more", pa.binary())]))
    at_least = 6
    sizes = {h: sum(r[0] == h for r in rows) for h, _, _ in rows}
    firsts = {h: min(r[1] for r in rows if r[0] == h) for h in sizes}
    lines = lambda h, d, at, more: {(h, d, x) for x in ([at] if at else []) + ([5] if more else [])}
    want = set().union(*(lines(h, d, None if later and d == firsts[h] else 3, d % 2) for h, d, _ in rows if sizes[h] >= at_least))
    for _ in range(200):
        cuts = sorted({0, len(rows), *(rnd.randrange(len(rows)) for _ in range(rnd.randrange(8)))})
        marks = []
        for a, b in zip(cuts, cuts[1:]):
            inner = sorted({a, b, *(rnd.randrange(a, b + 1) for _ in range(rnd.randrange(6)))})
            for out in line_dedup._stream((table.slice(x, y - x) for x, y in zip(inner, inner[1:])), at_least, later):
                marks += out.to_pylist()
        totals = {}
        for m in marks:
            if m["kind"] == line_dedup.SUMMARY:
                totals[m["hash"]] = totals.get(m["hash"], 0) + m["at"]
        edges = [m for m in marks if m["kind"] in (line_dedup.WAITS, line_dedup.FIRST) and totals[m["hash"]] >= at_least]
        got = set().union(*(lines(m["hash"], m["doc"], m["at"], m["more"]) for m in marks if m["kind"] == line_dedup.DROP))
        for m in edges:
            first = min(e["doc"] for e in edges if e["hash"] == m["hash"])
            got |= lines(m["hash"], m["doc"], None if later and m["doc"] == first else m["at"], m["more"])
        assert got == want


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op13_line_dedup"](spark, small).collect()}
    lines = {k: (t or "").split("\n") for k, t in rows}
    assert got == {k: (n, n - len(stay), hashlib.sha256("\n".join(lines[k][i] for i in stay).encode()).hexdigest()) for (k, _), (n, stay) in want.items()}
