"""Alerts from rule matches: text, severity, tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.callstack import hex_address
from ..functions.scalars import strip_markdown
from ..functions.template import interpolate
from ..session import durable
from .enrich import ancestors, enrich_parent, enrich_process, process_ends, process_states
from .rules import Rule

# Spellings of each severity.
SEVERITY_NAMES = {"low": "low", "normal": "low", "medium": "medium", "high": "high", "critical": "critical"}


def severity_from_text(text: Column) -> Column:
    lowered = F.lower(text)
    out = None
    for spelling, name in SEVERITY_NAMES.items():
        out = F.when(lowered == spelling, F.lit(name)) if out is None else out.when(lowered == spelling, F.lit(name))
    return out.otherwise(F.lit("low"))


def severity_from_score(score: Column) -> Column:
    """Score of a content signature; none counts as high."""
    score = F.coalesce(score, F.lit(0))
    return (F.when(score.between(1, 39), F.lit("low")).when(score.between(40, 59), F.lit("medium"))
            .when(score.between(60, 79), F.lit("high")).when(score >= 80, F.lit("critical")).otherwise(F.lit("high")))


def event_value(events: Column, index: int, name: str, arg: str | None) -> Column:
    """Field of the n-th event of a match: a kept column, or one of its parameters."""
    event = F.get(events, F.lit(index))
    if name == "evt.arg" and arg:
        return event["params"][arg]
    return event[name.split(".", 1)[1] if name.startswith("evt.") else name.replace(".", "_")]


def alert_text(template: str, events: Column, value_of=None) -> Column:
    """Rule output with ``%[n.]field[arg]`` tags filled from the events of the match."""
    lookup = value_of or (lambda i, name, arg: event_value(events, i, name, arg))
    return interpolate(template, lookup, F.size(events))


def build_alerts(matches: DataFrame, rules: list[Rule], value_of=None) -> DataFrame:
    """alert_id, rule_id, title, text, severity, tags, labels, description, host and events.

    ``matches`` has rule_id and ``events ARRAY<STRUCT>`` in time order. The
    rule table is a literal of the plan: a few hundred entries known to the driver.
    """
    spark = matches.sparkSession
    from .rules import rules_frame
    # One flat chain: its depth does not grow with the number of rules.
    texts = F
    for rule in rules:
        texts = texts.when(F.col("rule_id") == rule.id, alert_text(rule.output, F.col("events"), value_of))
    texts = F.lit("") if texts is F else texts.otherwise("")
    dim = rules_frame(spark, rules).select(F.col("id").alias("rule_id"), F.col("name").alias("title"), "severity", "tags",
                                           "labels", "description")
    first = F.get("events", F.lit(0))
    has_host = "host" in matches.schema["events"].dataType.elementType.names
    host = first["host"] if has_host else F.lit("")
    # Hosts number their events themselves, so the host is part of the id.
    parts = F.transform("events", lambda e: F.concat_ws(":", *([e["host"]] if has_host else []), e["seq"].cast("string")))
    return matches.join(dim, "rule_id").select(
        F.sha2(F.concat_ws("|", F.array("rule_id"), parts), 256).alias("alert_id"), "rule_id", "title",
        texts.alias("text"), severity_from_text(F.col("severity")).alias("severity"), "tags", "labels", "description",
        host.alias("host"), "events")


def plain_text(alerts: DataFrame) -> DataFrame:
    """Title and text without markup, as shown on a terminal."""
    text = strip_markdown(F.col("text"))
    return alerts.withColumn("text", F.when(text == "", F.col("title")).otherwise(F.concat("title", F.lit("\n\n"), text)))


def alert_verbose(title: Column, text: Column, severity: Column, events: Column, event_lines) -> Column:
    """Long form with the numbered events; ``event_lines(e)`` renders one."""
    head = F.when(F.size(events) > 1, F.lit("System events involved in this alert:\n\n")).otherwise(
        F.lit("System event involved in this alert:\n\n"))
    rows = F.array_join(F.transform(events, lambda e, i: F.concat(
        F.lit("\tEvent #"), (i + 1).cast("string"), F.lit(":\n"), event_lines(e))), "")
    middle = F.when(text == "", F.lit("")).otherwise(F.concat(text, F.lit("\n\n")))
    return F.concat(title, F.lit("\n\n"), middle, F.lit("Severity: "), severity, F.lit("\n\n"), head, rows)


def alert_json(alerts: DataFrame) -> DataFrame:
    """alert_id and the JSON document of the alert; optional parts are left out when empty."""
    kinds = alerts.schema["events"].dataType.elementType
    have = set(kinds.names)
    inner = set(kinds["ps"].dataType.names) if "ps" in have else set()

    def event(e: Column) -> Column:
        parts = [e[c].alias(c) for c in ("name", "category") if c in have]
        parts.append(e["ts"].alias("timestamp"))
        if "params" in have:
            parts.append(e["params"].alias("params"))
        if "callstack" in have:
            parts.append(F.transform(F.reverse(e["callstack"]), lambda f: F.concat(
                hex_address(f["addr"]), F.lit(" "), f["module"], F.lit("!"), f["symbol"])).alias("callstack"))
        if "ps" in have:
            parts.append(process_json(e["ps"], inner).alias("proc"))
        return F.struct(*parts)

    document = F.struct(F.col("rule_id").alias("id"), "title", "severity",
                        F.when(F.col("text") != "", F.col("text")).alias("text"), "description",
                        F.when(F.size("labels") > 0, F.col("labels")).alias("labels"),
                        F.transform("events", event).alias("events"))
    return alerts.select("alert_id", F.to_json(document, {"ignoreNullFields": "true"}).alias("json"))


PROCESS_FACTS = ("cwd", "sid", "username", "domain", "session_id", "integrity_level", "is_wow64", "is_packaged", "is_protected", "ancestors")


def process_json(ps: Column, have: set[str] | None = None) -> Column:
    """Process part of an alert's event; ``have``: fields of ps, if not all of them."""
    has = lambda c: have is None or c in have
    parts = [ps[c].alias(c) for c in ("pid", "ppid", "name", "exe", "cmdline") if has(c)]
    if has("parent"):
        parts += [ps["parent"]["name"].alias("parent_name"), ps["parent"]["cmdline"].alias("parent_cmdline")]
    return F.when(ps.isNotNull(), F.struct(*parts, *[ps[c].alias(c) for c in PROCESS_FACTS if has(c)]))


def with_process(events: DataFrame) -> DataFrame:
    """``ps`` of each event: process state at event time, with its parent's state and the names of its ancestors.

    Parents and ancestors are found once for each process start, then carried by
    the state, so events meet them in one as-of join.
    """
    states, ends = process_states(events), process_ends(events)
    born = durable(enrich_parent(states, ends))
    chains = ancestors(born.select(F.col("ps.uuid").alias("uuid"), F.col("parent.uuid").alias("parent_uuid"), F.col("ps.name").alias("name")))
    whole = born.join(chains.withColumnRenamed("uuid", "_u"), F.col("ps.uuid") == F.col("_u"), "left")
    ps = F.col("ps").withField("parent", F.col("parent")).withField("ancestors", F.coalesce("ancestors", F.array().cast("array<string>")))
    return enrich_process(events, whole.select("host", "pid", "valid_from", "state_seq", ps.alias("ps")), ends)


def unique_pids(alerts: DataFrame) -> DataFrame:
    """Distinct process ids of each match; a process start counts with the started process."""
    pid = lambda e: F.when(e["name"] == "CreateProcess", F.coalesce(
        e["params"]["pid"].try_cast("bigint"), e["pid"])).otherwise(e["pid"])
    return alerts.withColumn("pids", F.sort_array(F.array_distinct(F.transform("events", pid))))
