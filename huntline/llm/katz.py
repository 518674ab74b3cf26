"""Katz backoff language model: counts over the whole corpus, exactly normalised, evaluated recursively.

P(w | h) of an n-gram hw seen `least` times or more is its Good-Turing
discounted share of h; of any other it is the backoff weight of h times
P(w | h without its first word), down to single words, where words unknown to
the training texts share one <unk> type that gets the discounted mass.

    weight(h) = (1 - sum of the discounted shares of h) / (1 - sum of P(w | shorter h) over the same words)

so the probabilities after each history add up to one. Where nothing of a
history is discounted its total counts one more, and that one goes to the rest.

Rows for single n-grams would outgrow the text, so the corpus is stored as
cells (some megabytes of text each: word dictionary, word numbers), and n-grams
travel between cells and hash buckets as packed sorted blocks:

1. cells send each n-gram they hold once, with its count in training texts;
2. buckets add up and answer with total counts (one cell per n-gram is made its
   owner) and with counts of counts, the only figures the driver collects;
3. for each order, owners send what their n-grams take from each history,
   buckets add up and answer with backoff weights;
4. cells evaluate their texts.

A frequent n-gram is one entry per cell, so no bucket and no task gathers its
occurrences. Cells and answers are tables in the shared folder. n-grams are
known by 64-bit hashes.

Defined results: null, empty and blank texts are the end token alone; rows
with a null key and repeated rows count and are scored like any other; without
training texts every token is <unk> with probability one; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import saved
from .text import mix64, pieces, split

ORDER = 2
CUT = 5  # counts up to this one are discounted
LEAST = 1  # n-grams of two words or more need so many occurrences; 1: all that are seen
CELL_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1 << 16

BEGIN, END = (np.uint64(x) for x in mix64(np.array([0xB0, 0xE0], np.uint64) << np.uint64(48)))

CELLS = "cell long, keys array<long>, train binary, sizes binary, dictionary binary, stream binary"
BLOCKS = "kind int, bucket int, cell long, hashes binary, numbers binary"
ANSWERS = "cell long, kind int, bucket int, numbers binary, owner binary, stats array<long>"
SCORES = "key long, train boolean, n_tokens long, n_known long, base_score double, score double"


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones, so that what is alike stands together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(block: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack(hashes: np.ndarray) -> bytes:
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unpack(block: bytes) -> np.ndarray:
    return np.cumsum(unplanes(block, np.uint64), dtype=np.uint64)


def short(x: np.ndarray) -> bytes:
    """Numbers to nine digits: the five upper bytes."""
    return planes(x)[3 * len(x) :]


def unshort(block: bytes) -> np.ndarray:
    return unplanes(bytes(3 * (len(block) // 5)) + block, np.float64)


def zipped(block: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(block)


def unzipped(block: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(block)


# Cells


def make_cells(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    zip_, number = zstandard.ZstdCompressor(), TaskContext.get().partitionId() << 32
    for batch in pieces(batches, "text", size):
        parts = [(ws.counts(), ws.hashes()) for ws in (split(b.column("text"), lower=True) for b in pieces(iter([batch]), "text", 1 << 18))]
        n, own = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        hashes = np.empty(len(own) + 2 * len(n), np.uint64)
        begins = np.cumsum(n + 2) - n - 2
        hashes[begins], hashes[begins + n + 1] = BEGIN, END
        hashes[np.arange(len(own)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = own
        words, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((words, -counts))  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        train = np.packbits(np.asarray(pc.fill_null(batch.column("train"), False)).astype(bool))
        row = [number, batch.column("key").to_pylist(), train.tobytes(), planes(n.astype(np.uint32)), zip_.compress(pack(words[order])), zip_.compress(planes(rank[inverse]))]
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["cell", "keys", "train", "sizes", "dictionary", "stream"])
        number += 1


@dataclass
class Gram:
    """The distinct n-grams of one length in a cell."""

    hashes: np.ndarray  # sorted
    entry: np.ndarray  # per position the n-gram that ends there, or -1
    first: np.ndarray  # per n-gram a position where it ends
    count: np.ndarray | None = None  # over all training texts
    owner: np.ndarray | None = None
    weight: np.ndarray | None = None  # backoff weight as a history; negative if its total counts one more

    def asked(self, least: int) -> np.ndarray:
        """Those that can have a weight other than one: a rarer history has no n-gram that counts."""
        return np.flatnonzero(self.count >= least)


@dataclass
class Cell:
    keys: list
    train: np.ndarray
    sizes: np.ndarray
    grams: dict[int, Gram] = field(default_factory=dict)

    @classmethod
    def read(cls, row: dict, order: int) -> Cell:
        unzip = zstandard.ZstdDecompressor()
        sizes = unplanes(row["sizes"], np.uint32).astype(np.int64)
        cell = cls(row["keys"], np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(sizes)).astype(bool), sizes)
        words, stream = unpack(unzip.decompress(row["dictionary"])), unplanes(unzip.decompress(row["stream"]), np.uint32)
        begins = np.cumsum(sizes + 2) - sizes - 2
        place = np.arange(len(stream)) - np.repeat(begins, sizes + 2)  # inside the text; 0 is the begin mark
        here = words[stream]
        for k in range(1, order + 1):
            if k > 1:
                with np.errstate(over="ignore"):
                    before = np.concatenate([here[:1], here[:-1]])
                    here = mix64(before * np.uint64(0x9E3779B97F4A7C15) + words[stream] + np.uint64(k))
            at = np.flatnonzero(place >= k - 1)
            unique, first, inverse = np.unique(here[at], return_index=True, return_inverse=True)
            entry = np.full(len(stream), -1)
            entry[at] = inverse
            cell.grams[k] = Gram(unique, entry, at[first])
        return cell

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes + 2)

    def learn(self, answers: pa.Table, bits: int, least: int) -> None:
        """Fills in counts, owners and weights from the answers of the buckets (kind k: counts; -k: weights of histories)."""
        for k, g in self.grams.items():
            g.count, g.owner, g.weight = np.zeros(len(g.hashes)), np.zeros(len(g.hashes), bool), np.ones(len(g.hashes))
            cut = bucket_cuts(g.hashes, bits)
            for row in answers.filter(pc.equal(answers.column("kind"), k)).to_pylist():
                a, b = cut[row["bucket"]], cut[row["bucket"] + 1]
                g.count[a:b] = unplanes(unzipped(row["numbers"]), np.uint64)
                g.owner[a:b] = np.unpackbits(np.frombuffer(row["owner"], np.uint8), count=b - a)
            asked = g.asked(least)
            cut = bucket_cuts(g.hashes[asked], bits)
            for row in answers.filter(pc.equal(answers.column("kind"), -k)).to_pylist():
                g.weight[asked[cut[row["bucket"]] : cut[row["bucket"] + 1]]] = unshort(unzipped(row["numbers"]))

    def probabilities(self, model: Model, upto: int) -> np.ndarray:
        """Of each n-gram of length `upto`, P(last word | the words before), by recursion over the lengths."""
        g = self.grams[upto]
        if upto == 1:
            return model.unigram(g.count)
        histories, shorter = self.grams[upto - 1], self.grams[upto - 1].entry[g.first]
        h = histories.entry[g.first - 1]
        total = histories.count[h] + (histories.weight[h] < 0)
        seen = g.count >= model.least
        share = model.discounted(upto, g.count) / np.maximum(total, 1)
        return np.where(seen, share, np.abs(histories.weight[h]) * self.probabilities(model, upto - 1)[shorter])


@dataclass
class Model:
    """Counts of counts (per length: n_1 .. n_cut+1, sum of counts, number of distinct) and what follows from them."""

    stats: dict[int, list[int]]
    cut: int
    least: int

    def __post_init__(self) -> None:
        self.tokens, self.words = self.stats[1][-2], self.stats[1][-1]
        self.discounts = {k: good_turing(s[: self.cut + 1], self.cut) for k, s in self.stats.items()}
        taken = self.tokens - sum(r * n * (1 - d) for r, n, d in zip(range(1, self.cut + 1), self.stats[1], self.discounts[1], strict=False))
        rest = self.tokens - taken
        self.total = self.tokens + (rest < 1e-9)  # nothing discounted: one more for <unk>
        self.unknown = 1 - taken / self.total

    def discounted(self, k: int, count: np.ndarray) -> np.ndarray:
        d = np.array([1.0, *self.discounts[k], 1.0])
        return count * d[np.minimum(count, self.cut + 1).astype(np.int64)]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounted(1, count) / self.total, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


def good_turing(n: list[int], cut: int) -> list[float]:
    """Katz's discounts of the counts 1..cut from the counts of counts n_1..n_cut+1.

    Where these are too few for a discount between 0 and 1, half an occurrence is taken off.
    """
    out = []
    common = (cut + 1) * n[cut] / n[0] if n[0] else 1.0
    for r in range(1, cut + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


# Blocks


def bucket_cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    tops = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, tops), [len(hashes)]])


def _blocks(kind: int, cell: int, hashes: np.ndarray, numbers: Callable[[int, int], bytes], bits: int) -> pa.Table:
    cut = bucket_cuts(hashes, bits)
    some = np.flatnonzero(np.diff(cut))
    spans = [(cut[b], cut[b + 1]) for b in some]
    n = len(some)
    return pa.table({
        "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array(some, pa.int32()), "cell": pa.array([cell] * n, pa.int64()),
        "hashes": pa.array([pack(hashes[a:b]) for a, b in spans], pa.binary()),
        "numbers": pa.array([zipped(numbers(a, b)) for a, b in spans], pa.binary()),
    })


def send_counts(batches: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            cell = Cell.read(row, order)
            train = cell.in_training()
            for k, g in cell.grams.items():
                use = train & (g.entry >= 0)
                count = np.bincount(g.entry[use], minlength=len(g.hashes)).astype(np.uint64)
                yield from _blocks(k, row["cell"], g.hashes, lambda a, b, c=count: planes(c[a:b]), bits).to_batches()


def _grouped(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's blocks in cell order, their sizes, the order of their hashes and, in that order, the group of equal ones and the hash."""
    table = table.sort_by([("cell", "ascending")])
    hashes = [unpack(b) for b in table.column("hashes").to_pylist()]
    order = np.argsort(np.concatenate(hashes), kind="stable")
    h = np.concatenate(hashes)[order]
    return table, np.array([len(x) for x in hashes]), order, np.cumsum(np.concatenate([[False], h[1:] != h[:-1]])), h


def add_counts(table: pa.Table, cut: int, least: int) -> pa.Table:
    """Total counts for each block of a bucket, owners, and one row of counts of counts (cell -1).

    n-grams of two words or more with fewer than `least` occurrences are answered with 0: nothing is done with them.
    """
    table, sizes, order, group, h = _grouped(table)
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    count = np.concatenate([unplanes(unzipped(b), np.uint64) for b in table.column("numbers").to_pylist()]).astype(np.int64)[order]
    total = np.zeros(group[-1] + 1, np.int64)
    np.add.at(total, group, count)
    answer, owner = np.empty(len(order), np.uint64), np.zeros(len(order), bool)
    told = np.where(total >= (least if kind > 1 else 0), total, 0)
    head = np.concatenate([[True], group[1:] != group[:-1]])
    answer[order] = told[group]
    owner[order] = head & (told[group] > 0)
    ends = np.cumsum(sizes)
    counted = total[h[head] != BEGIN]
    stats = [*np.bincount(np.minimum(counted, cut + 2), minlength=cut + 2)[1 : cut + 2].tolist(), int(counted.sum()), int((counted > 0).sum())]
    n = len(sizes)
    return pa.table({
        "cell": pa.concat_arrays([table.column("cell").combine_chunks(), pa.array([-1], pa.int64())]),
        "kind": pa.array([kind] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "numbers": pa.array([zipped(planes(answer[e - s : e])) for e, s in zip(ends, sizes, strict=True)] + [b""], pa.binary()),
        "owner": pa.array([np.packbits(owner[e - s : e]).tobytes() for e, s in zip(ends, sizes, strict=True)] + [b""], pa.binary()),
        "stats": pa.array([[]] * n + [stats], pa.list_(pa.int64())),
    })


def send_shares(row: pa.Table, answers: pa.Table, k: int, model: Model, order: int, bits: int) -> pa.Table:
    """What the n-grams of length k that this cell owns take from each history: discounted counts, and probabilities after the shorter history."""
    if not row.num_rows:
        return _blocks(-1, 0, np.zeros(0, np.uint64), lambda a, b: b"", 0)
    cell = Cell.read(row.to_pylist()[0], order)
    cell.learn(answers, bits, model.least)
    g, histories = cell.grams[k], cell.grams[k - 1]
    mine = np.flatnonzero(g.owner & (g.count >= model.least))
    at = g.first[mine]
    h, shorter = histories.entry[at - 1], histories.entry[at]
    taken, lower = np.zeros(len(histories.hashes)), np.zeros(len(histories.hashes))
    np.add.at(taken, h, model.discounted(k, g.count[mine]))
    np.add.at(lower, h, cell.probabilities(model, k - 1)[shorter])
    asked = histories.asked(model.least)
    sums = np.stack([taken, lower, histories.count])[:, asked]

    def some(a: int, b: int) -> bytes:
        """Which of the histories get something from here, and for these the three numbers."""
        at = np.flatnonzero(sums[0, a:b])
        return b"".join([np.packbits(sums[0, a:b] != 0).tobytes(), *[planes(x[a:b][at]) for x in sums[:2]], planes(sums[2, a:b][at].astype(np.uint64))])

    return _blocks(-(k - 1), row.column("cell")[0].as_py(), histories.hashes[asked], some, bits)


def add_shares(table: pa.Table) -> pa.Table:
    """Backoff weights of the histories of a bucket, for each block."""
    table, sizes, order, group, _ = _grouped(table)
    place = np.empty(len(order), np.int64)
    place[order] = group
    sums, total, at = np.zeros((2, group[-1] + 1)), np.zeros(group[-1] + 1), 0
    for block, n in zip(map(unzipped, table.column("numbers").to_pylist()), sizes.tolist(), strict=True):
        mask = np.unpackbits(np.frombuffer(block, np.uint8, -(-n // 8)), count=n).astype(bool)
        rest, size, to = block[-(-n // 8) :], 8 * int(mask.sum()), place[at : at + n][mask]
        at += n
        for i in (0, 1):  # a cell has a history once
            sums[i, to] += unplanes(rest[i * size : (i + 1) * size], np.float64)
        total[to] = unplanes(rest[2 * size :], np.uint64)
    left = 1 - sums[0] / np.maximum(total, 1)
    tight = (sums[0] > 0) & (left < 1e-9)  # nothing discounted: the total counts one more
    left = np.where(tight, 1 - sums[0] / (total + 1), left)
    weight = np.where(sums[0] > 0, left / np.maximum(1 - sums[1], 1e-12), 1.0)
    weight = np.where(tight, -weight, weight)
    answer = np.empty(len(order))
    answer[order] = weight[group]
    ends, n = np.cumsum(sizes), len(sizes)
    return pa.table({
        "cell": table.column("cell"), "kind": table.column("kind"), "bucket": table.column("bucket"),
        "numbers": pa.array([zipped(short(answer[e - s : e])) for e, s in zip(ends, sizes, strict=True)], pa.binary()),
        "owner": pa.array([b""] * n, pa.binary()), "stats": pa.array([[]] * n, pa.list_(pa.int64())),
    })


def evaluate(row: pa.Table, answers: pa.Table, model: Model, order: int, bits: int) -> pa.Table:
    """Scores of the texts of a cell."""
    schema = pa.schema([("key", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    if not row.num_rows:
        return schema.empty_table()
    cell = Cell.read(row.to_pylist()[0], order)
    cell.learn(answers, bits, model.least)
    n = len(cell.sizes)
    doc = np.repeat(np.arange(n), cell.sizes + 2)
    begins = np.cumsum(cell.sizes + 2) - cell.sizes - 2
    token = np.ones(len(doc), bool)
    token[begins] = False
    value = np.zeros(len(doc))
    for k in range(1, order + 1):  # the longest history that a position has decides
        g = cell.grams[k]
        at = np.flatnonzero(g.entry >= 0)
        value[at] = cell.probabilities(model, k)[g.entry[at]]
    count = cell.grams[1].count[cell.grams[1].entry]
    add = lambda x: np.bincount(doc[token], weights=x[token], minlength=n)
    value[~token] = 1
    return pa.table([
        pa.array(cell.keys, pa.int64()), pa.array(cell.train), pa.array(cell.sizes + 1, pa.int64()), pa.array(add((count > 0).astype(float)).astype(np.int64)),
        pa.array(add(model.base(count))), pa.array(add(np.log10(value))),
    ], schema=schema)


def scored(docs: DataFrame, train, order: int = ORDER, key: str = "doc_id", text: str = "text", cut: int = CUT, least: int = LEAST, cell_bytes: int = CELL_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of every document; learns from rows where `train` (a column) holds."""
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), train.alias("train"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, min(MOST_BUCKETS, -(-volume // bucket_bytes)) - 1).bit_length()
    cells = saved(texts.mapInArrow(lambda b: make_cells(b, cell_bytes), CELLS), "katz-cells")
    blocks = cells.mapInArrow(lambda b: send_counts(b, order, bits), BLOCKS)
    counts = saved(blocks.groupBy("kind", "bucket").applyInArrow(lambda t: add_counts(t, cut, least), ANSWERS), "katz-counts")
    stats = counts.filter("cell = -1").groupBy("kind").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(cut + 3)]).collect()
    model = Model({k: next(([int(v or 0) for v in r[1:]] for r in stats if r.kind == k), [0] * (cut + 3)) for k in range(1, order + 1)}, cut, least)
    answers = counts.filter("cell >= 0").drop("stats")
    by_cell = cells.groupBy("cell")

    def shares_of(k: int):
        return lambda r, a: send_shares(r, a, k, model, order, bits)

    for k in range(2, order + 1):
        shares = by_cell.cogroup(answers.groupBy("cell")).applyInArrow(shares_of(k), BLOCKS)
        weights = shares.groupBy("kind", "bucket").applyInArrow(add_shares, ANSWERS).drop("stats")
        answers = answers.union(saved(weights, "katz-weights") if k < order else weights)
    out = by_cell.cogroup(answers.groupBy("cell")).applyInArrow(lambda r, a: evaluate(r, a, model, order, bits), SCORES)
    return out.select(F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
