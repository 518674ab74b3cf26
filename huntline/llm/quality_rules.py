"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document. The ledger keeps its measurements and
one bit per failed rule; policies are bit masks over the ledger, so a new
version of a policy, or an ablation, never reads a text again.

Defined results: a null, empty or blank text has no words and measurements of
zero; repeated rows are judged one by one; an empty table gives an empty
ledger; columns that the ledger doesn't know stay as they are unless they bear
the name of one of its own, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SPACE_CLASS, free_name, let, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims"]


@dataclass(frozen=True)
class Rule:
    """fails is a condition on the struct of measurements; bit never changes once it is given."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(3, "long_words", lambda m: m["word_chars"] > 25 * m["n_words"]),
    Rule(4, "symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule(5, "repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule(6, "exclamations", lambda m: 4 * m["n_exclaims"] > m["n_words"]),
)

#: Policy versions: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def _repeated_words(ws: Column, window: int) -> Column:
    """Number of words that lie in a window of so many words found twice or more in the array.

    Windows are sorted by hash, so equal ones are neighbours: n log n for a
    text of n words, however often its windows repeat.
    """
    marked = F.transform(
        F.sequence(F.lit(0), F.size(ws) - window),
        lambda i: F.struct(F.xxhash64(*[F.get(ws, i + k) for k in range(window)]).alias("h"), i.alias("i")),
    )
    same = lambda s, x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
    repeated = let(F.sort_array(marked), lambda s: F.filter(s, lambda x, k: same(s, x, k + 1) | ((k > 0) & same(s, x, F.greatest(k - 1, F.lit(0))))))
    covered = let(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b),
    )
    return F.when(F.size(ws) < window, F.lit(0)).otherwise(covered)


def entry(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the measurements of a text and ``fail_bits`` (bit b set: rule b failed), evaluated once."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(t), lambda ws: F.struct(F.size(ws).alias("n"), _repeated_words(ws, 3).alias("r")))
    by_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("d")))
    raw = F.struct(
        by_words.alias("w"), by_lines.alias("l"),
        (F.char_length(t) - F.regexp_count(t, F.lit(SPACE_CLASS))).alias("c"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).alias("s"), F.regexp_count(t, F.lit("!")).alias("x"),
    )

    def named(x: Column) -> Column:
        values = [x["w"]["n"], x["c"], x["s"], x["l"]["n"], x["l"]["d"], x["w"]["r"], x["x"]]
        return F.struct(*[v.cast("long").alias(n) for n, v in zip(MEASURES, values, strict=True)])

    def judged(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for rule in rules:
            bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(*[m[n].alias(n) for n in MEASURES], bits.alias("fail_bits"))

    return let(let(raw, named), judged)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the measurements and ``fail_bits`` as columns."""
    at = free_name(docs, "_entry")
    marked = docs.withColumn(at, entry(F.col(text), rules))
    return marked.withColumns({n: F.col(at)[n] for n in [*MEASURES, "fail_bits"]}).drop(at)


def mask(names, rules: tuple[Rule, ...] = RULES) -> int:
    """Bit mask of the rules with these names."""
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[n] for n in names)


def passes(policy: str = "v2", bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = "v2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    Documents are first counted by their masked bits (2^rules groups at most),
    so the rest works on a few rows.
    """
    all_bits = mask(POLICIES[policy], rules)
    grouped = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(all_bits).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in rules if r.name in POLICIES[policy]]
    table = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    one = grouped.select("b", "n", table.alias("r")).select("b", "n", "r.*")
    hit, rest = F.col("b").bitwiseAND(F.col("bit")) != 0, F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return one.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    at = free_name(docs, "_entry")
    return docs.withColumn(at, entry(F.col(text))).filter(passes(policy, f"{at}.fail_bits")).drop(at)
