"""Removal of passages that an earlier document has: Rabin-Karp window hashes, counted over the corpus.

Every window of `window` consecutive words has a 64-bit rolling hash. A window
is a repeat if its hash also starts in a document with a smaller key; the words
covered by repeats, merged into maximal intervals, are removed.

Counting 10^13 windows row by row would cost more than the text itself, so they
travel packed:

1. Documents are dealt into cells of bounded text, which are ranges of the key
   (a key that fills more than one cell is cut by text hash). Each cell sorts
   its hashes, drops repeats (the pre-aggregation), and sends one packed block
   per hash bucket: sorted differences, bytes transposed, about six bytes a
   window after compression. A window of a third of all documents is one entry
   per cell.
2. Each bucket, a range of hashes, merges its blocks. Cells are ordered as
   their keys are, so an entry is a repeat if an earlier cell sent it too. The
   answer is one bit per entry.
3. The cells, read again from the same exchange, take the bits, settle windows
   repeated inside the cell by themselves, and cut the texts.

The number of buckets follows the size of the text, so a bucket's memory is
bounded; a bucket holds each hash at most once per cell. At N windows the
probability that a given window is taken for a repeat wrongly is N / 2^64
(5 in 10^7 at 10^13 windows).

Defined results: a null, empty or blank text has no words and keeps none; a
text shorter than the window loses nothing; rows with a null key lose nothing
and make nobody else lose; rows with equal keys don't count as earlier than
each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, mix64, rolling, split

WINDOW = 50
CELL_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1 << 17
#: Greatest accuracy of the quantiles that bound the cells; beyond it cells differ more in size.
MOST_ACCURATE = 1 << 30
RESULT = "key long, n_words long, removed array<struct<begin:int,end:int>>, kept string"


def window_hashes(ws: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of the texts."""
    ends = np.repeat(ws.first[1:], ws.counts())
    first = np.arange(len(ws))
    first = first[first + window <= ends]
    return first, mix64(rolling(ws.hashes(), first, first + window))


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte: leading zeros stand together and compress away."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(block: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def cells(docs: DataFrame, key: str, text: str, cell_bytes: int) -> tuple[DataFrame, int]:
    """(key, text, cell, part), cells in the order of the keys, and the bytes of text in all.

    The driver holds the cell bounds, one number per cell; the sketch they come from is merged by tasks.
    """
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    volume = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-volume // cell_bytes))
    # Quantiles and comparisons stay whole numbers: keys above 2^53 have no doubles of their own.
    cuts = base.agg(F.percentile_approx("key", [i / n for i in range(1, n)], min(10 * n, MOST_ACCURATE))).first()[0] or [] if n > 1 else []
    parts = {q: cuts.count(q) + 1 for q in set(cuts) if cuts.count(q) > 1} if len(set(cuts)) < len(cuts) else {}
    # Keys that fill several cells get a cell of their own, in parts.
    bounds = np.array(sorted({*cuts, *(q + 1 for q in parts if q < (1 << 63) - 1)}), np.int64)

    def deal(batches):
        for batch in batches:
            at = np.searchsorted(bounds, np.asarray(pc.fill_null(batch.column("key"), 0)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["key", "text", "at"])

    dealt = base.mapInArrow(deal, "key long, text string, at int")
    part = F.lit(0)
    if parts:
        crowded = docs.sparkSession.createDataFrame(list(parts.items()), "crowded long, parts int")
        dealt = dealt.join(F.broadcast(crowded), F.col("key") == F.col("crowded"), "left")
        part = F.coalesce(F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"), F.lit(0))
    return dealt.select("key", "text", F.col("at").cast("int").alias("cell"), part.alias("part")), volume


class Cell:
    """The windows of one cell: unique hashes in order, and for each window its text, place and unique hash."""

    def __init__(self, table: pa.Table, window: int):
        table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")])).combine_chunks()
        self.keys = table.column("key")
        texts = table.column("text")
        self.words = split(texts.chunk(0) if texts.num_chunks else pa.array([], pa.string()))
        first, hashes = window_hashes(self.words, window)
        known = np.asarray(self.keys.is_valid())
        doc = self.words.doc()[first]
        first, hashes, doc = first[known[doc]], hashes[known[doc]], doc[known[doc]]
        number = np.asarray(pc.fill_null(self.keys, 0))
        self.first = first
        self.unique, at, self.entry = np.unique(hashes, return_index=True, return_inverse=True)
        # Texts stand in the order of their keys, so the first window with a hash has the smallest key.
        self.repeated_here = number[doc] > number[doc[at]][self.entry] if len(first) else np.zeros(0, bool)

    def cuts(self, bits: int) -> np.ndarray:
        """Where the buckets of the unique hashes begin and end."""
        tops = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
        return np.concatenate([[0], np.searchsorted(self.unique, tops), [len(self.unique)]])


def _send(key: tuple[pa.Scalar, ...], table: pa.Table, window: int, bits: int) -> pa.Table:
    cell = Cell(table, window)
    cuts = cell.cuts(bits)
    some = np.flatnonzero(np.diff(cuts))
    blocks = [pack(cell.unique[cuts[b] : cuts[b + 1]]) for b in some]
    n = len(some)
    return pa.table({"bucket": pa.array(some, pa.int32()), "cell": pa.array([key[0].as_py()] * n, pa.int32()), "part": pa.array([key[1].as_py()] * n, pa.int32()), "block": pa.array(blocks, pa.binary())})


def _merge(table: pa.Table) -> pa.Table:
    """The blocks of one bucket: per block one bit an entry, set if an earlier cell has it too."""
    table = table.take(pc.sort_indices(table, sort_keys=[("cell", "ascending"), ("part", "ascending")]))
    blocks = [unpack(b) for b in table.column("block").to_pylist()]
    sizes = np.array([len(b) for b in blocks])
    hashes, cell = np.concatenate(blocks), np.repeat(np.asarray(table.column("cell")), sizes)
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], cell[order]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    earliest = c[np.flatnonzero(head)[np.cumsum(head) - 1]]
    flags = np.zeros(len(h), bool)
    flags[order] = c > earliest
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - n : e]).tobytes() if flags[e - n : e].any() else None for e, n in zip(ends, sizes, strict=True)]
    out = pa.table({"cell": table.column("cell"), "part": table.column("part"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
    return out.filter(pc.is_valid(out.column("bits")))


def _cut(table: pa.Table, answers: pa.Table, window: int, bits: int) -> pa.Table:
    cell = Cell(table, window)
    ws, cuts = cell.words, cell.cuts(bits)
    elsewhere = np.zeros(len(cell.unique), bool)
    for bucket, block in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        a, b = cuts[bucket], cuts[bucket + 1]
        elsewhere[a:b] = np.unpackbits(np.frombuffer(block, np.uint8), count=b - a)
    begins = cell.first[cell.repeated_here | elsewhere[cell.entry]] if len(cell.first) else cell.first
    change = np.zeros(len(ws) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    data, starts, ends = ws.joined()
    # Intervals: maximal stretches of removed words, cut where a text ends.
    edge = np.zeros(len(ws) + 1, bool)
    edge[ws.first] = True
    opens = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))) if len(ws) else np.zeros(0, int)
    closes = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1 if len(ws) else np.zeros(0, int)
    of = np.searchsorted(opens, ws.first)
    removed, kept = [], []
    for d in range(len(ws.first) - 1):
        a, b = int(ws.first[d]), int(ws.first[d + 1])
        spans = [(int(x), int(y)) for x, y in zip(opens[of[d] : of[d + 1]], closes[of[d] : of[d + 1]], strict=True)]
        left, at = [], a
        for x, y in [*spans, (b, b)]:
            if x > at:
                left.append(data[starts[at] : ends[x - 1]])
            at = y
        removed.append([{"begin": x - a, "end": y - a} for x, y in spans])
        kept.append(b" ".join(left))
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    return pa.table({"key": cell.keys, "n_words": pa.array(ws.counts(), pa.int64()), "removed": pa.array(removed, spans_type), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, cell_bytes: int = CELL_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_words, removed intervals of words [begin, end), kept words joined by one space) of each document."""
    dealt, volume = cells(docs, key, text, cell_bytes)
    bits = max(0, min(MOST_BUCKETS, -(-volume // bucket_bytes)) - 1).bit_length()
    by_cell = dealt.groupBy("cell", "part")
    sent = by_cell.applyInArrow(lambda k, t: _send(k, t, window, bits), "bucket int, cell int, part int, block binary")
    answers = sent.groupBy("bucket").applyInArrow(_merge, "cell int, part int, bucket int, bits binary")
    cut = by_cell.cogroup(answers.groupBy("cell", "part")).applyInArrow(lambda t, a: _cut(t, a, window, bits), RESULT)
    return cut.withColumnRenamed("key", key)
