"""Near-duplicates by SimHash, with anchor-point covering.

Two fingerprints of 64 bits that differ in four bits or fewer differ in one bit
or none in at least one of three blocks (21, 21 and 22 bits). Each block has
anchors: a covering code, the perfect Hamming code of length 15 on its low bits
and all values of the rest, so that every block value is within one bit of
exactly one anchor, its home. A fingerprint is sent to every anchor within two
bits (covering radius 1, plus 1 for the difference): about 14 of 131,072 for
each block. Whatever differs from x in one bit there meets x at the home of x,
so comparing the residents of an anchor with all its visitors loses no link.

Links are compared per anchor and never listed as pairs of a group: each anchor
gives a spanning forest of what it links. Anchors with many residents or
visitors are cut into cells of bounded size, residents by visitors.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; equal texts have equal fingerprints and link; repeated rows
stay rows; a null key counts only if its component has no other; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import saved
from .components import components
from .text import pieces, split

BLOCKS = ((0, 21), (21, 21), (42, 22))
DISTANCE = 4
#: Residents and visitors of one cell.
RESIDENTS, VISITORS = 4096, 65536


def fingerprint(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text (uint64): lower-cased A-Z, word shingles with repeats, XXH64, strict majority per bit."""
    ws = split(texts, lower=True)
    data, starts, ends = ws.joined()
    n = ws.counts()
    per_doc = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    doc = np.repeat(np.arange(len(n)), per_doc)
    first = ws.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    last = first + np.minimum(n[doc], shingle) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(data[s:e], seed) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True)])
    out = np.zeros((len(n), 8), np.uint8)
    if len(doc):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        some = np.flatnonzero(per_doc)
        ones = np.add.reduceat(bits, (np.cumsum(per_doc) - per_doc)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > per_doc[some, None], axis=1)
    return out.view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """docs with ``fp`` (the fingerprint as a signed long) instead of the text."""
    kept = [c for c in docs.columns if c not in (text, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            fp = pa.array(fingerprint(batch.column(text), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], fp], names=[*kept, "fp"])

    schema = docs.select(*kept).withColumn("fp", F.lit(0).cast("long")).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2^15 values the code words within two bits and their distances (padded with distance 9)."""
    values = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    words, dist = np.zeros((1 << 15, 8), np.int64), np.full((1 << 15, 8), 9)
    inside = syndrome == 0
    words[inside, 0], dist[inside, 0] = values[inside], 0
    out = ~inside
    words[out, 0], dist[out, 0] = values[out] ^ (1 << (syndrome[out] - 1)), 1
    for slot, low in enumerate(range(1, 8), start=1):
        # The pairs of positions i < j with i ^ j = syndrome; low runs through them in turn.
        i = np.array([[p for p in range(1, 16) if p ^ s != 0 and p ^ s <= 15 and p < p ^ s][low - 1] if s else 0 for s in range(16)])[syndrome[out]]
        words[out, slot], dist[out, slot] = values[out] ^ (1 << (i - 1)) ^ (1 << ((i ^ syndrome[out]) - 1)), 2
    return words, dist


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, is home) for every anchor that a fingerprint is sent to."""
    words, dist = _near_codewords()
    index, anchor, home = [], [], []
    for number, (shift, width) in enumerate(BLOCKS):
        block = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        low, high, free = block & 0x7FFF, block >> 15, width - 15
        flips = [(0, 0), *[(1 << i, 1) for i in range(free)], *[(1 << i | 1 << j, 2) for i in range(free) for j in range(i)]]
        for flip, cost in flips:
            at, slot = np.nonzero(dist[low] + cost <= 2)
            index.append(at)
            anchor.append(number << 22 | (high[at] ^ flip) << 15 | words[low[at], slot])
            home.append((slot == 0) if cost == 0 else np.zeros(len(at), bool))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 16384):
            fp = np.asarray(batch.column(0).slice(at, 16384)).view(np.uint64)
            index, anchor, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _link(residents: np.ndarray, visitors: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between residents and visitors: at most one link for each of them."""
    owner = np.full(len(visitors), -1)
    root = list(range(len(residents)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, x in enumerate(residents):
        near = np.flatnonzero(np.bitwise_count(visitors ^ x) <= distance)
        if not len(near) or len(near) == 1 and visitors[near[0]] == x:
            owner[near] = i
            continue
        had = owner[near]
        fresh = near[had < 0]
        owner[fresh] = i
        out += [(int(x), int(y)) for y in visitors[fresh] if y != x]
        for j, at in zip(*np.unique(had, return_index=True), strict=True):
            if j >= 0 and top(int(j)) != top(i):  # two residents with a visitor in common
                root[top(int(j))] = top(i)
                if visitors[near[at]] != x:
                    out.append((int(x), int(visitors[near[at]])))
    return out


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            cell = np.stack([np.asarray(rest.column(c)) for c in ("anchor", "i", "j")])
            cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield from links(rest.slice(0, cuts[-1]), cuts)
                rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from links(rest, np.array([rest.num_rows]))

    def links(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, resident = np.asarray(rows.column("fp")).view(np.uint64), np.asarray(rows.column("resident"))
        out = []
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            if b - a > 2:
                here, part = resident[a:b], fp[a:b]
                out += _link(part[here], part[~here], distance)
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, residents: int = RESIDENTS, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever differs in `distance` bits or fewer (at most four)."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the anchors cover distances up to four")
    sent = saved(fps.select("fp").distinct().mapInArrow(_send, "anchor long, fp long, home boolean"), "anchors")
    crowded = (
        sent.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("v")).filter((F.col("h") > residents) | (F.col("h") > 0) & (F.col("v") > visitors))
        .select("anchor", F.ceil(F.col("h") / residents).cast("int").alias("hs"), F.ceil(F.col("v") / visitors).cast("int").alias("vs"))
    )
    one = F.lit(1)
    cut = sent.join(crowded, "anchor", "left").withColumns({"hs": F.coalesce("hs", one), "vs": F.coalesce("vs", one), "part": F.xxhash64("fp")})
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    as_resident = cut.filter("home").select("anchor", F.pmod("part", F.col("hs")).cast("int").alias("i"), numbers(F.col("vs")).alias("j"), F.lit(True).alias("resident"), "fp")
    as_visitor = cut.select("anchor", numbers(F.col("hs")).alias("i"), F.pmod("part", F.col("vs")).cast("int").alias("j"), F.lit(False).alias("resident"), "fp")
    cells = as_resident.union(as_visitor).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return cells.mapInArrow(_compare(distance), "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id, component_fp) per document: its component's smallest key, and the fingerprint that goes with it."""
    marked = saved(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))), "fingerprints")
    # Null keys last: a null names a component only if there is nothing else.
    rank = lambda k: F.struct(F.col(k).isNull().alias("no"), F.col(k).alias("key"), F.col("fp").alias("fp"))
    fps = marked.groupBy("fp").agg(F.min(rank("key")).alias("least"))
    labels = components(links(marked, distance)).withColumnRenamed("node", "fp")
    named = saved(fps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    heads = named.groupBy("label").agg(F.min("least").alias("head"))
    by_fp = named.join(heads, "label").select("fp", F.col("head.key").alias("component_id"), F.col("head.fp").alias("component_fp"))
    return marked.join(by_fp, "fp").select(F.col("key").alias(key), "fp", "component_id", "component_fp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: a row of its smallest key."""
    heads = classes(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", distance)
    heads = heads.filter(F.col("key").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("component_fp"))).select("key", "fp").distinct()
    rows = fingerprints(docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text")))
    joined = rows.join(heads.withColumnsRenamed({"key": "k", "fp": "f"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("fp") == F.col("f")))
    return joined.dropDuplicates(["k", "f"]).select("row.*")
