"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of consecutive words, and each different window
is looked for once, whichever items have it. The training text is scanned twice:
once to count how often each test term occurs, and once to store postings (term,
document, position) of the terms that are among the two rarest of some window.
The lists of these two, shifted by their offsets in the window, are intersected;
at each place that remains the window is compared once with the text of the
document, so matches are exact. Common terms are stored only where a window has
nothing rarer. Where proximity is asked for, the two rarest terms of each item
are looked for a few words apart in the same index.

Postings of a frequent term are spread over the documents, never gathered by
term. The side of the test set is broadcast while it has at most
``BROADCAST_ROWS`` rows (counted first); beyond that Spark joins by shuffle and
splits skewed terms.

Defined results: a null, empty or wordless text has no words, no hits and is
clean; a null or wordless item has no windows; a null item_id is named by the
empty string; items repeated with the same id count once; repeated document
rows each get a row; an empty table gives an empty result, an empty test set
no hits; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import let, saved

WINDOW = 13
BROADCAST_ROWS = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pieces(text: Column) -> Column:
    """Array of words (a-z, 0-9 and characters beyond ASCII, A-Z lowered); its first and last elements may be empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN)


def _count(pieces: Column) -> Column:
    empty = lambda at: (F.element_at(pieces, at) == "").cast("int")
    return F.when(F.size(pieces) == 1, 1 - empty(1)).otherwise(F.size(pieces) - empty(1) - empty(-1))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small enough for that."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def items_of(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_key, words) of the items with a word, once for equal ids and words."""
    ws = let(_pieces(F.col(text)), lambda a: F.filter(a, lambda w: w != ""))
    found = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), ws.alias("words")).filter(F.size("words") > 0).distinct()
    return found.withColumn("item_key", F.xxhash64("item", "words"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, text_hash, term, position) of every occurrence of these terms (column ``term``), from (doc, text)."""
    flat = docs.select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode(_pieces(F.col("text"))).alias("position", "term"))
    return flat.join(_small(terms.select("term").distinct()), "term")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the texts of each of these terms that occurs."""
    flat = docs.select(F.explode(_pieces(F.col("text"))).alias("term"))
    return flat.join(_small(terms.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def probes(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram_key, gram, items, term1, off1, term2, off2): each different window once, with the items that have it and its two rarest terms.

    A window with a term that never occurs is left out; one of a single word
    has no second term.
    """
    length = F.least(F.size("words"), F.lit(window))
    begins = F.sequence(F.lit(0), F.size("words") - length)
    windows = items.select("item", F.explode(F.array_distinct(F.transform(begins, lambda s: F.slice("words", s + 1, length)))).alias("gram"))
    grams = windows.groupBy("gram").agg(F.collect_set("item").alias("items")).withColumn("gram_key", F.xxhash64("gram"))
    terms = grams.select("gram_key", "gram", "items", F.posexplode("gram").alias("offset", "term")).join(counts, "term")
    ranked = terms.withColumn("rank", F.row_number().over(W.partitionBy("gram_key", "gram").orderBy("n", "offset")))
    place = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    both = ranked.groupBy("gram_key", "gram").agg(
        F.count(F.lit(1)).alias("known"), F.first("items").alias("items"),
        place(1, "term").alias("term1"), place(1, "offset").alias("off1"), place(2, "term").alias("term2"), place(2, "offset").alias("off2"),
    )
    return both.filter(F.col("known") == F.size("gram")).drop("known")


def rare_pairs(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(pair, item, term1, term2): the two different terms of each item that are rarest in the texts (ties by term), of those that occur."""
    terms = items.select("item_key", "item", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    ranked = terms.withColumn("rank", F.row_number().over(W.partitionBy("item_key").orderBy("n", "term")))
    place = lambda r: F.max(F.when(F.col("rank") == r, F.col("term")))
    both = ranked.filter("rank <= 2").groupBy(F.col("item_key").alias("pair"), "item").agg(place(1).alias("term1"), place(2).alias("term2"))
    return both.filter("term2 is not null")


def candidates(index: DataFrame, probe: DataFrame) -> DataFrame:
    """(doc, text_hash, gram_key, starts): where a window may begin in a document, as both its terms stand there at their offsets."""
    asked = _small(probe.select("gram_key", F.col("term1").alias("term"), "off1", "term2", "off2"))
    first = index.join(asked, "term").withColumn("start", F.col("position") - F.col("off1")).filter("start >= 0")
    alone = first.filter(F.col("term2").isNull())
    wanted = first.filter(F.col("term2").isNotNull()).select("doc", "text_hash", "gram_key", "start", F.col("term2").alias("term"), (F.col("start") + F.col("off2")).alias("position"))
    second = index.withColumnRenamed("doc", "doc2")
    met = wanted.join(second, ["text_hash", "term", "position"]).filter(F.col("doc").eqNullSafe(F.col("doc2")))
    columns = ["doc", "text_hash", "gram_key", "start"]
    return alone.select(columns).union(met.select(columns)).groupBy("doc", "text_hash", "gram_key").agg(F.collect_set("start").alias("starts"))


def _hits(pieces: Column, found: Column) -> Column:
    """Of each window (gram, items, starts) that occurs: its items, its length and where it begins. Each start is compared once."""
    at = lambda c: F.filter(c["starts"], lambda s: F.slice(pieces, s + 1, F.size(c["gram"])) == c["gram"])
    kept = F.transform(found, lambda c: F.struct(c["items"].alias("items"), F.size(c["gram"]).alias("length"), at(c).alias("starts")))
    return F.filter(kept, lambda h: F.size(h["starts"]) > 0)


def _covered(hits: Column) -> Column:
    """Words that lie inside a window that occurs: the union of the stretches, in order of their begins."""
    stretches = F.flatten(F.transform(hits, lambda h: F.transform(h["starts"], lambda s: F.struct(s.alias("begin"), (s + h["length"]).alias("end")))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    more = lambda a, x: F.greatest(x["end"] - F.greatest(x["begin"], a["end"]), F.lit(0)).cast("long")
    return F.aggregate(F.sort_array(stretches), start, lambda a, x: F.struct((a["n"] + more(a, x)).alias("n"), F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["n"])


def matches(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, slop: int | None = None) -> DataFrame:
    """docs (doc, text_hash, kept columns) with ``n_words`` and ``hits``: each window found, with its items, length and begins.

    With ``slop``, also ``near``: the items whose two rarest terms stand at most
    so many words apart somewhere in the document, in either order.
    """
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    tests = saved(items_of(items, item, item_text), "items")
    counts = frequencies(texts, tests.select(F.explode("words").alias("term")))
    counts = counts if slop is None else saved(counts, "counts")
    probe = saved(probes(tests, counts, window), "probes")
    pairs = None if slop is None else saved(rare_pairs(tests, counts), "pairs")
    used = probe.select(F.explode(F.array("term1", "term2")).alias("term"))
    if pairs is not None:
        used = used.union(pairs.select(F.explode(F.array("term1", "term2"))))
    index = saved(postings(texts, used.filter(F.col("term").isNotNull())), "postings")
    found = candidates(index, probe).join(_small(probe.select("gram_key", "gram", "items")), "gram_key")
    told = found.select("text_hash", "doc", F.struct("gram", "items", "starts").alias("found"), F.lit(None).cast("string").alias("near"))
    if pairs is not None:
        close = proximity(index, pairs.drop("item"), slop).select("doc", "text_hash", "pair").distinct().join(_small(pairs.select("pair", "item")), "pair")
        told = told.union(close.select("text_hash", "doc", F.lit(None).cast(told.schema["found"].dataType), "item"))
    per_doc = told.groupBy(F.col("text_hash").alias("hash2"), F.col("doc").alias("doc2")).agg(F.collect_list("found").alias("found"), F.collect_set("near").alias("near"))
    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"), F.struct(*(keep or [])).alias("row") if keep else F.lit(None).alias("row"))
    joined = rows.join(per_doc, (F.col("text_hash") == F.col("hash2")) & F.col("doc").eqNullSafe(F.col("doc2")), "left")
    nothing = F.array().cast("array<struct<items:array<string>,length:int,starts:array<int>>>")
    seen = let(_pieces(F.col("text")), lambda p: F.struct(_count(p).cast("long").alias("n_words"), F.when(F.col("found").isNull(), nothing).otherwise(_hits(p, F.col("found"))).alias("hits")))
    near = [] if slop is None else [F.coalesce("near", F.array().cast("array<string>")).alias("near")]
    return joined.select("doc", "text_hash", "row", *near, seen.alias("seen")).select("doc", "text_hash", "row", *(["near"] if near else []), "seen.*")


def verdicts(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, share: int = 20, **options) -> DataFrame:
    """(doc, row, n_words, n_hit, n_items, items, contaminated): contaminated if a word is hit and hits are 1 in `share` words or more.

    With ``slop``, also ``near`` (see ``matches``), which does not make a document contaminated.
    """
    found = matches(docs, items, keep=keep, **options)
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    near = [c for c in ("near",) if c in found.columns]
    told = found.select("doc", "row", "n_words", *near, F.struct(_covered(F.col("hits")).alias("n_hit"), names.alias("items")).alias("t"))
    n_hit = F.col("t.n_hit")
    return told.select("doc", "row", "n_words", "t.n_hit", F.size("t.items").cast("long").alias("n_items"), "t.items", *near, ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return verdicts(docs, items, keep=docs.columns, **options).filter(~F.col("contaminated")).select("row.*")


def proximity(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(doc, text_hash, pair, position1, position2) where the terms of a pair (pair, term1, term2) lie at most slop words apart.

    Positions are joined by stretches of slop + 1 words, each second position
    standing in its own stretch and both neighbours: an equi-join in proportion to
    the postings.
    """
    stretch = F.floor(F.col("position") / (slop + 1))
    pairs = _small(pairs)
    left = index.join(pairs.withColumnRenamed("term1", "term"), "term").select("doc", "text_hash", "pair", F.col("position").alias("position1"), stretch.alias("stretch"))
    right = index.join(pairs.withColumnRenamed("term2", "term"), "term").select("text_hash", "pair", F.col("doc").alias("doc2"), F.col("position").alias("position2"), F.explode(F.sequence(stretch - 1, stretch + 1)).alias("stretch"))
    apart = F.abs(F.col("position1") - F.col("position2"))
    return left.join(right, ["text_hash", "pair", "stretch"]).filter(F.col("doc").eqNullSafe(F.col("doc2")) & (apart > 0) & (apart <= slop)).select("doc", "text_hash", "pair", "position1", "position2")
