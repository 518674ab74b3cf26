"""Rule catalogue: scoped matching, prefilter derivation, checks, tagging, response targets."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.fields import FIELDS, field
from ..functions.logic import and_, keep_where, or_, true_or_false
from .sequences import SequenceSpec, sequence_match

Predicate = Callable[[DataFrame], Column]
SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Test:
    """A field test kept as data, so that prefilters can be derived from it."""

    field: str
    op: str
    values: tuple[str, ...]

    def column(self, df: DataFrame) -> Column:
        return getattr(P, OPERATORS[self.op])(field(df, self.field), list(self.values))


# Text operators and their functions.
OPERATORS = {"=": "in_", "in": "in_", "~=": "iin", "iin": "iin", "matches": "matches", "imatches": "imatches",
             "contains": "contains", "icontains": "icontains", "startswith": "startswith",
             "istartswith": "istartswith", "endswith": "endswith", "iendswith": "iendswith"}


@dataclass(frozen=True)
class Rule:
    """A simple rule: scope (event names or categories), condition and metadata."""

    id: str
    name: str
    condition: Predicate
    names: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    tests: tuple[Test, ...] = ()
    severity: str = "medium"
    description: str = ""
    output: str = ""
    tags: tuple[str, ...] = ()
    labels: dict = dc_field(default_factory=dict)
    actions: tuple[str, ...] = ()
    version: str = "1.0.0"
    min_engine_version: str = "1.0.0"
    enabled: bool = True
    fields: tuple[str, ...] = ()
    sequence: SequenceSpec | None = None


def scope(rule: Rule) -> Column:
    """Events a rule looks at; a rule without a scope looks at none."""
    parts = []
    if rule.names:
        parts.append(F.col("name").isin(list(rule.names)))
    if rule.categories:
        parts.append(F.col("category").isin(list(rule.categories)))
    return or_(*parts) if parts else F.lit(False)


def full_condition(df: DataFrame, rule: Rule) -> Column:
    return and_(scope(rule), rule.condition(df), *[t.column(df) for t in rule.tests])


def active(rules: list[Rule]) -> list[Rule]:
    return sorted((r for r in rules if r.enabled), key=lambda r: r.id)


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rule metadata as a table; its size is that of the catalogue, not of the data."""
    rows = [(r.id, r.name, r.severity, r.description, r.output, list(r.tags), dict(r.labels), list(r.actions),
             r.version, r.min_engine_version, r.enabled, list(r.names), list(r.categories), list(r.fields)) for r in rules]
    return spark.createDataFrame(rows, (
        "id string, name string, severity string, description string, output string, tags array<string>, "
        "labels map<string,string>, actions array<string>, version string, min_engine_version string, "
        "enabled boolean, names array<string>, categories array<string>, fields array<string>"))


def match_rules(df: DataFrame, rules: list[Rule], match_all: bool = True) -> DataFrame:
    """Events with ``rule_id``: one row per match, or only the first rule by id order.

    The disjunction of all scopes is a plain filter, so it reaches the scan;
    all conditions are evaluated in one pass without a shuffle.
    """
    usable = [r for r in active(rules) if r.sequence is None and (r.names or r.categories)]
    # Joined text rather than a filtered array: the conditions stay in generated code.
    hits = F.split(F.concat_ws(SEPARATOR, *[F.when(full_condition(df, r), F.lit(r.id)) for r in usable]), SEPARATOR)
    scoped = df.where(scope_filter(usable))
    return scoped.withColumn("rule_id", F.explode(hits if match_all else F.slice(hits, 1, 1))).where("rule_id != ''")


def scope_filter(rules: list[Rule]) -> Column:
    """One name list and one category list for a whole catalogue."""
    names = sorted({n for r in rules for n in r.names})
    categories = sorted({c for r in rules for c in r.categories})
    parts = ([F.col("name").isin(names)] if names else []) + ([F.col("category").isin(categories)] if categories else [])
    return keep_where(*parts)


def match_sequences(df: DataFrame, rules: list[Rule], seq: str = "seq", ts: str = "ts", keep: list[str] = ()) -> DataFrame:
    """Matches of all sequence rules with ``rule_id``; rules without bound fields share one pass."""
    usable = [r for r in active(rules) if r.sequence is not None]
    found = sequence_match(df, [r.sequence for r in usable], ts=ts, seq=seq, keep=list(keep))
    ids = F.create_map(*[F.lit(x) for r in usable for x in (r.sequence.name, r.id)])
    return found.withColumn("rule_id", ids[F.col("rule")])


# Events whose volume makes a derived prefilter worthwhile, and the fields it looks at.
PREFILTERED_NAMES = ["RegOpenKey", "OpenProcess", "OpenThread"]
PREFILTER_FIELDS = {"registry.path": "key", "file.path": "path", "file.extension": "extension", "file.name": "base",
                    "evt.arg[exe]": "executable"}


def derive_prefilter(df: DataFrame, rules: list[Rule]) -> Column:
    """True for events some rule could match, judged by the rules' text tests on paths, keys and executables.

    Only the high-volume events are tested, everything else passes. With no
    tests of a kind there is nothing those events could match.
    """
    tests: dict[str, list[Column]] = {kind: [] for kind in PREFILTER_FIELDS.values()}
    for rule in active(rules):
        watched = set(rule.names) & set(PREFILTERED_NAMES + ["CreateFile", "SetFileInformation"])
        if not watched:
            continue
        for test in rule.tests:
            if test.field in PREFILTER_FIELDS:
                insensitive = {"=": "iin", "in": "iin"}.get(test.op, test.op)
                tests[PREFILTER_FIELDS[test.field]].append(Test(test.field, insensitive, test.values).column(df))
    opened = (F.col("name") == "CreateFile") & (field(df, "file.operation") == "OPEN")
    on_file = or_(*tests["path"], *tests["base"], *tests["extension"]) if any(tests[k] for k in ("path", "base", "extension")) else F.lit(False)
    on_key = or_(*tests["key"]) if tests["key"] else F.lit(False)
    on_exe = or_(*tests["executable"]) if tests["executable"] else F.lit(False)
    return true_or_false(F.when(F.col("name") == "RegOpenKey", on_key)
                         .when(F.col("name").isin("OpenProcess", "OpenThread"), on_exe)
                         .when(opened, on_file).otherwise(F.lit(True)))


def tag_events(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule name and labels into the metadata of matched events."""
    dim = rules.select(F.col("id").alias("rule_id"), F.map_concat(
        F.map_filter("labels", lambda k, _: k != "rule.name"), F.create_map(F.lit("rule.name"), F.col("name"))).alias("_tags"))
    tagged = matches.join(dim, "rule_id")
    kept = F.map_filter("meta", lambda k, _: ~F.map_contains_key("_tags", k))
    return tagged.withColumn("meta", F.map_concat(kept, "_tags")).drop("_tags")


def enqueue(df: DataFrame, votes: list[Column], always: bool = False) -> DataFrame:
    """Events some voting listener accepted."""
    return df if always else df.where(or_(*votes) if votes else F.lit(False))


def response_targets(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """alert_id, action and its target: the pids of the match to kill, or the host to isolate."""
    dim = rules.select(F.col("id").alias("rule_id"), F.explode("actions").alias("action"))
    pids = F.array_distinct(F.transform("events", lambda e: e["pid"].cast("string")))
    targets = F.when(F.col("action") == "kill", pids).when(F.col("action") == "isolate", F.array("host"))
    return alerts.join(dim, "rule_id").select("alert_id", "rule_id", "action", F.explode(targets).alias("target"))


def check_rules(rules: DataFrame, catalog: DataFrame, engine_version: str = "1.0.0") -> DataFrame:
    """(rule id, problem, detail) of a rule table against the event catalogue."""
    twice = rules.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"),
                                                                 F.col("count").cast("string").alias("detail"))
    unknown_name = (rules.select("id", F.explode("names").alias("name")).join(catalog.select("name"), "name", "left_anti")
                    .select("id", F.lit("unknown event").alias("problem"), F.col("name").alias("detail")))
    known = catalog.select("category").distinct()
    unknown_category = (rules.select("id", F.explode("categories").alias("category")).join(known, "category", "left_anti")
                        .select("id", F.lit("unknown category").alias("problem"), F.col("category").alias("detail")))
    disabled = rules.where("not enabled").select("id", F.lit("disabled").alias("problem"), F.lit("").alias("detail"))
    unscoped = rules.where("size(names) = 0 and size(categories) = 0").select(
        "id", F.lit("no scope").alias("problem"), F.lit("").alias("detail"))
    number = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    newer = rules.where(number(F.col("min_engine_version")) > number(F.lit(engine_version))).select(
        "id", F.lit("engine too old").alias("problem"), F.col("min_engine_version").alias("detail"))
    old_fields = [name for name, spec in FIELDS.items() if spec.deprecated]
    deprecated = (rules.select("id", F.explode("fields").alias("f")).where(F.col("f").isin(old_fields))
                  .select("id", F.lit("deprecated field").alias("problem"), F.col("f").alias("detail")))
    out = twice
    for part in (unknown_name, unknown_category, disabled, unscoped, newer, deprecated):
        out = out.unionByName(part)
    return out


def used_events(rules: DataFrame) -> DataFrame:
    """(kind, value) of all event names and categories a rule set refers to."""
    names = rules.select(F.lit("event").alias("kind"), F.explode("names").alias("value"))
    categories = rules.select(F.lit("category").alias("kind"), F.explode("categories").alias("value"))
    return names.unionByName(categories).distinct()


def rules_by_tactic(rules: DataFrame) -> DataFrame:
    """(section, name, n): rules per tactic and technique and the total."""
    def per(label: str, section: str) -> DataFrame:
        return rules.groupBy(F.coalesce(F.col("labels")[label], F.lit("")).alias("name")).agg(
            F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    total = rules.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("").alias("name"), "n")
    return per("tactic.name", "tactic").unionByName(per("technique.name", "technique")).unionByName(total)


def rule_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("rule_id").agg(F.count("*").alias("n"))


def candidate_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``candidates``: ids of the enabled rules whose scope holds the event's name or its category, each once, sorted.

    The scopes are two maps of the plan, built once from the catalogue.
    """
    def scoped(part: Callable[[Rule], tuple[str, ...]]) -> Column:
        ids: dict[str, list[str]] = {}
        for rule in rules:
            for value in part(rule) if rule.enabled else ():
                ids.setdefault(value, []).append(rule.id)
        pairs = [x for value, own in ids.items() for x in (F.lit(value), F.array(*map(F.lit, own)))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")

    none = F.array().cast("array<string>")
    by_name = F.coalesce(F.try_element_at(scoped(lambda r: r.names), F.col("name")), none)
    by_category = F.coalesce(F.try_element_at(scoped(lambda r: r.categories), F.col("category")), none)
    return df.withColumn("candidates", F.sort_array(F.array_union(by_name, by_category)))
