"""Lines that many documents share: hashes in ranges, sorted by document and position, first occurrences streamed.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased; keys of fewer than `least_chars` code points never count. A key
found in at least `at_least` documents is common. Policy "all" drops every
line with a common key, policy "later" keeps the first occurrence, which is
the one of the smallest (document, position).

1. Each document gives one row per key it has: 128-bit hash, document, place of
   the first line with it and, packed, those of the others.
2. The rows are partitioned by ranges of (hash, document) and sorted, so a key
   that a third of all documents have lies in many ranges, one after the other.
   A task streams its range with fewer than `at_least` rows in memory: a run
   that reaches that many documents is answered from then on as it passes. Only
   dropped lines are emitted.
3. A run at the edge of a range may go on in the next one. Its documents so far
   are one summary row, its rows (fewer than `at_least`) wait; summed up by
   hash, the summaries settle them. Both tables have a few rows per range.
4. The dropped places of a document become one compressed bitmap. Texts are
   read again only by `kept`, which joins the bitmaps.

A document is its (key column, text): repeated rows are one document and get
the same bitmap. Nothing is sampled but the bounds of the ranges.

Defined results: a null or empty text has one empty line, which stays; a null
key column is a value like any other (rows are then told apart by their text);
an empty table gives empty results; extra columns, whatever their names, are
kept by `kept` and not read by `bitmaps`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import free_name, saved
from .text import pieces

WHITE = b" \t\n\x0b\x0c\r"
AT_LEAST = 10
LEAST_CHARS = 1
POLICIES = ("all", "later")

#: Kinds of the rows that a range answers with.
DROP, WAITS, SUMMARY, FIRST = 0, 1, 2, 3
COLUMNS = ["kind", "hash", "doc", "body", "at", "more"]


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars <= 1 or len(key.decode()) >= least_chars)


def places(text: bytes, least_chars: int) -> dict[bytes, list[int]]:
    """Hash of each key of one text, and the lines that have it."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line_key(line)
        if _long_enough(key, least_chars):
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
    return found


def _keys(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """One row for each key of each text: the first line that has it, and the others packed."""
    for piece in pieces(batches, "text"):
        hashes, at, more, row = [], [], [], []
        for i, text in enumerate(pc.fill_null(piece.column("text"), "").cast(pa.binary()).to_pylist()):
            found = places(text, least_chars)
            hashes += found
            row += [i] * len(found)
            at += [lines[0] for lines in found.values()]
            more += [np.array(lines[1:], np.int32).tobytes() if len(lines) > 1 else None for lines in found.values()]
        of = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), piece.column("doc").take(of), piece.column("body").take(of), pa.array(at, pa.int32()), pa.array(more, pa.binary())], COLUMNS[1:])


def _changes(t: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether each row differs from the row before in one of the columns; the first row does."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for name in names:
        a, b = t.column(name).slice(1), t.column(name).slice(0, max(0, t.num_rows - 1))
        new[1:] |= np.asarray(pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null())))
    return new


class _Range:
    """One sorted range as it streams by; keeps the open run: its rows while they are few, else its first row."""

    def __init__(self, at_least: int, later: bool):
        self.at_least, self.later = at_least, later
        self.rows: pa.RecordBatch | None = None  # the open run: all its rows, or its first row once it is common
        self.documents = 0  # of the open run
        self.last: tuple | None = None  # last row seen
        self.edge = True  # the open run is the first of the range

    @staticmethod
    def _row(t: pa.RecordBatch, i: int) -> tuple:
        return tuple(t.column(n)[i].as_py() for n in ("hash", "doc", "body"))

    @staticmethod
    def _mark(t: pa.RecordBatch, kind: int, at: pa.Array | None = None) -> pa.RecordBatch:
        kinds = pa.array(np.full(t.num_rows, kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, *(t.column(n) for n in ("hash", "doc", "body")), t.column("at") if at is None else at, t.column("more")], COLUMNS)

    def _dropped(self, t: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        """Rows of common keys; under "later" the line at which a key occurs first stays."""
        return self._mark(t, DROP, pc.if_else(pa.array(first), pa.scalar(None, pa.int32()), t.column("at")) if self.later else None)

    def _edge_rows(self) -> Iterator[pa.RecordBatch]:
        """What other ranges must know of the open run."""
        yield self._mark(self.rows.slice(0, 1), SUMMARY, pa.array([self.documents], pa.int32()))
        if self.documents < self.at_least:
            yield self._mark(self.rows, WAITS)
        elif self.later:
            yield self._mark(self.rows.slice(0, 1), FIRST)

    def feed(self, t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        new = _changes(t, ["hash", "doc", "body"])
        new[0] = self._row(t, 0) != self.last  # repeated rows are one document
        self.last = self._row(t, t.num_rows - 1)
        t = t.filter(pa.array(new))
        heads = np.flatnonzero(_changes(t, ["hash"]))
        if t.num_rows and self.rows is not None:
            if t.column("hash")[0].as_py() == self.rows.column("hash")[0].as_py():
                n = int(heads[1]) if len(heads) > 1 else t.num_rows
                if self.documents >= self.at_least:  # common already: answered as it passes
                    yield self._dropped(t.slice(0, n), np.zeros(n, bool))
                    self.documents, t, heads = self.documents + n, t.slice(n), heads[1:] - n
                else:
                    m = self.rows.num_rows
                    t = pa.Table.from_batches([self.rows, t]).combine_chunks().to_batches()[0]
                    heads = np.concatenate([[0], heads[1:] + m])
                    self.rows = None
            if t.num_rows and self.rows is not None:  # the open run ended with the last batch
                if self.edge:
                    yield from self._edge_rows()
                self.edge, self.rows = False, None
        if not t.num_rows:
            return
        sizes = np.diff([*heads, t.num_rows])
        common = np.repeat(sizes >= self.at_least, sizes)
        first = np.zeros(t.num_rows, bool)
        first[heads] = True
        if common.any():
            yield self._dropped(t.filter(pa.array(common)), first[common])
        if self.edge and len(heads) > 1:
            self._open(t.slice(0, int(sizes[0])), int(sizes[0]))
            yield from self._edge_rows()
            self.edge = False
        self._open(t.slice(int(heads[-1])), int(sizes[-1]))

    def _open(self, rows: pa.RecordBatch, documents: int) -> None:
        self.rows, self.documents = rows if documents < self.at_least else rows.slice(0, 1), documents

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows is not None:
            yield from self._edge_rows()


def _stream(batches: Iterator[pa.RecordBatch], at_least: int, later: bool) -> Iterator[pa.RecordBatch]:
    run = _Range(at_least, later)
    for batch in batches:
        yield from run.feed(batch)
    yield from run.end()


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: int = AT_LEAST, least_chars: int = LEAST_CHARS, policy: str = "all") -> DataFrame:
    """(doc, body, at, more): lines to drop, as one row for each common key of a document."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    later = policy == "later"
    kind = docs.schema[key].dataType.simpleString()
    row = f"hash binary, doc {kind}, body long, at int, more binary"
    keys = _documents(docs, key, text).mapInArrow(lambda b: _keys(b, least_chars), row)
    ranges = keys.repartitionByRange("hash", "doc", "body").sortWithinPartitions("hash", "doc", "body")
    marks = saved(ranges.mapInArrow(lambda b: _stream(b, at_least, later), f"kind int, {row}"), "line-marks")
    common = marks.filter(F.col("kind") == SUMMARY).groupBy("hash").agg(F.sum("at").alias("n")).filter(F.col("n") >= at_least).select("hash")
    edges = marks.filter(F.col("kind").isin(WAITS, FIRST)).join(common, "hash", "left_semi")
    if later:
        here = F.struct("doc", "body")
        first = edges.groupBy("hash").agg(F.min(here).alias("first"))
        edges = edges.join(first, "hash").withColumn("at", F.when(here != F.col("first"), F.col("at")))
    columns = ["doc", "body", "at", "more"]
    return marks.filter(F.col("kind") == DROP).select(columns).union(edges.select(columns))


def pack(n_lines: int, gone: np.ndarray) -> bytes:
    """A bit for each line, set if it stays, compressed."""
    keep = np.ones(n_lines, bool)
    keep[gone] = False
    return zstandard.ZstdCompressor(level=3).compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, maps = [], []
        for n, at, more in zip(*(batch.column(c).to_pylist() for c in ("n_lines", "ats", "mores")), strict=True):
            gone = np.unique(np.concatenate([np.array(at, np.int64), *(np.frombuffer(m, np.int32) for m in more)]))
            counts.append(len(gone))
            maps.append(pack(n, gone) if len(gone) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("body"), batch.column("n_lines"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc", "body", "n_lines", "n_dropped", "keep"])


def bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: int = AT_LEAST, least_chars: int = LEAST_CHARS, policy: str = "all") -> DataFrame:
    """(doc, body, n_lines, n_dropped, keep) of each document.

    body is xxhash64 of the text; keep is a compressed bitmap (see `unpack`), null if every line stays.
    """
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))), F.lit(0)) + 1
    none = F.lit(None)
    every = _documents(docs, key, text).select("doc", "body", n_lines.cast("long").alias("n_lines"), none.cast("int").alias("at"), none.cast("binary").alias("more"))
    gone = dropped(docs, key, text, at_least, least_chars, policy).select("doc", "body", none.cast("long").alias("n_lines"), "at", "more")
    by_doc = every.union(gone).groupBy("doc", "body").agg(F.max("n_lines").alias("n_lines"), F.collect_list("at").alias("ats"), F.collect_list("more").alias("mores"))
    kind = docs.schema[key].dataType.simpleString()
    return by_doc.mapInArrow(_bitmaps, f"doc {kind}, body long, n_lines long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch], text: str, n_lines: str, keep: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, text):
        texts = piece.column(text).cast(pa.binary()).to_pylist()
        for i, (n, bitmap) in enumerate(zip(piece.column(n_lines).to_pylist(), piece.column(keep).to_pylist(), strict=True)):
            if bitmap is not None:
                lines = texts[i].split(b"\n")
                texts[i] = b"\n".join([lines[j] for j in np.flatnonzero(unpack(bitmap, n))])
        new = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([new if c == text else piece.column(c) for c in names], names)


def kept(docs: DataFrame, maps: DataFrame, key: str = "doc_id", text: str = "text", n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs with their texts cut to the lines that stay; the counts of the bitmaps as further columns where names are given."""
    doc, body, n, gone, keep = (free_name(docs, s) for s in ("_doc", "_body", "_n_lines", "_n_dropped", "_keep"))
    right = maps.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("n_lines").alias(n), F.col("n_dropped").alias(gone), F.col("keep").alias(keep))
    joined = docs.join(right, F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(body))).drop(doc, body)
    names = [*docs.columns, n, gone, keep]
    cut = joined.select(names).mapInArrow(lambda b: _apply(b, text, n, keep, names), joined.select(names).schema)
    extra = [F.col(old).alias(new) for old, new in ((n, n_lines), (gone, n_dropped)) if new]
    return cut.select(*docs.columns, *extra)
