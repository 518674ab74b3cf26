"""Spelling variants: permuterm rotations, sorted, and scanned for words at one edit.

Words are near if they differ by exactly one inserted, deleted or replaced code
point. A word's form is its most frequent near word, if that is `ratio` times as
frequent; its root is the last word that forms lead to.

1. A word w of length m is marked with a terminator and rotated at each of its
   m + 1 places. If the code point at place i was edited, the rotation that puts
   it last is equal up to it: all words that differ from w there begin with
   `w[i+1:] $ w[:i]`, and the word without that code point has this as a whole
   rotation. So each word sends each rotation under its prefix without the last
   code point, and each whole rotation under itself.
2. The rotations are partitioned by ranges and sorted. One prefix is one group:
   at most one whole rotation, and at most one rotation per letter of the
   alphabet, as words are distinct. No group grows with the corpus.
3. A scan keeps the two most frequent members of a group and emits one row for
   each member: how many near words the group has for it, and the best of them.
   Pairs are never listed. A replacement meets in one group only; a deletion out
   of a run of equal letters would meet in several, so only the first letter of
   a run counts there.

Forms are at least `ratio` times as frequent, so a chain of forms is at most
log(largest n, ratio) long, and doubling follows it in a few rounds.

Defined results: a null or empty text has no words; a null key is an empty text
in the hash that damages words; repeated rows count again; an empty table gives
an empty result; extra columns are not read. The terminator is U+0000, which no
word may contain.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import saved, saved_with
from .text import pieces

RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: One in so many distinct runs of a document loses a code point.
DAMAGE = 31
END = "\0"
#: Groups are scanned in stretches of about so many rows.
BATCH = 1 << 14


def damaged(key: str, run: str, one_in: int = DAMAGE) -> str:
    """The run, or for one in so many (key, run) the run without one code point."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % one_in:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _count(batches: Iterator[pa.RecordBatch], least_length: int, one_in: int) -> Iterator[pa.RecordBatch]:
    # Shorter runs can't become words: a run only ever loses code points.
    long_runs = re.compile(f"{RUN}{{{least_length},}}")
    lower = {c: c + 32 for c in range(65, 91)}
    for piece in pieces(batches, "text"):
        found: Counter[str] = Counter()
        for key, text in zip(piece.column("key").to_pylist(), pc.fill_null(piece.column("text"), "").to_pylist(), strict=True):
            for run, n in Counter(long_runs.findall(text.translate(lower) if not text.isascii() else text.lower())).items():
                word = damaged(key or "", run, one_in)
                if len(word) >= least_length:
                    found[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, some of them damaged; counted in tasks before they travel."""
    texts = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counted = texts.mapInArrow(lambda b: _count(b, least_length, one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


ROTATION = "prefix string, last string, word string, n long"


def _rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rotations of marked words; last is the code point after the prefix: empty for a whole rotation, upper plane marks a repeated letter."""
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            part = batch.slice(a, BATCH)
            prefixes, lasts, row = [], [], []
            for r, word in enumerate(part.column("word").to_pylist()):
                m, ring = len(word), (word + END) * 2
                for i in range(m):
                    prefixes.append(ring[i + 1 : i + 1 + m])
                    # A letter equal to the one before it is no deletion of its own.
                    lasts.append(word[i] if i == 0 or word[i] != word[i - 1] else word[i] + END)
                prefixes += [ring[i : i + m + 1] for i in range(m + 1)]
                lasts += [""] * (m + 1)
                row += [r] * (2 * m + 1)
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), pa.array(lasts, pa.string()), part.column("word").take(of), part.column("n").take(of)], ["prefix", "last", "word", "n"])


Member = tuple[str, str, int]  # last, word, n


def _near(group: list[Member]) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, best near word, its n) of each member that has one in this group."""
    whole = [m for m in group if not m[0]]
    edited = [m for m in group if m[0]]
    rank = lambda m: (-m[2], m[1])
    best = sorted(edited, key=rank)[:2]
    for last, word, n in edited:
        others = [m for m in best if m[1] != word][:1]
        count = len(edited) - 1
        if whole and END not in last:
            others.append(whole[0])
            count += 1
        if count:
            _, other, k = min(others, key=rank)
            yield word, count, other, k
    deletable = [m for m in edited if END not in m[0]]
    if whole and deletable:
        _, other, k = min(deletable, key=rank)
        yield whole[0][1], len(deletable), other, k


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one prefix out of a sorted range; those of one member say nothing."""
    prefix, group, found = None, [], []

    def told() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "best", "best_n"])

    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            part = batch.slice(a, BATCH)
            for p, *member in zip(*(part.column(c).to_pylist() for c in ("prefix", "last", "word", "n")), strict=True):
                if p != prefix:
                    if len(group) > 1:
                        found.extend(_near(group))
                    prefix, group = p, []
                group.append(tuple(member))
            yield told()
    if len(group) > 1:
        found.extend(_near(group))
    yield told()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n; distinct) that have near words; of equally frequent ones the smallest is best."""
    rotations = words.mapInArrow(_rotate, ROTATION)
    ranges = rotations.repartitionByRange("prefix").sortWithinPartitions("prefix")
    parts = ranges.mapInArrow(_scan, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    told = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return told.select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.k")).alias("best_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling the steps until no root has a form."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step, seen = saved_with(step, "roots", F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved"))
        at = step.select("word", "root")
        if not seen["moved"]:
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of all words (word, n; distinct)."""
    words = words.select("word", F.col("n").cast("long").alias("n"))
    known = saved(words.join(near_words(words), "word", "left"), "spelling")
    formed = F.col("best_n") >= ratio * F.col("n")
    told = known.select("word", "n", F.when(formed, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
    roots = _roots(told.filter(F.col("form").isNotNull()).select("word", "form"))
    return told.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """`variants` of the vocabulary of docs."""
    return variants(saved(vocabulary(docs, key, text), "vocabulary"), ratio)
