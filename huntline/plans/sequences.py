"""Sequence matching. The SQL steps a recursive query through each key's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators.reports import partial_breaches, dedup_partials, sort_events
from ..operators.sequences import SequenceSpec, sequence_match, sequence_problems, step
from ..sources.tables import table, telemetry
from .registry import ev_sql, query


def kind(name):
    return lambda df: F.col("event_type") == name


def automaton_sql(source: str, n: int, span_us: int, ordered=True, total=False) -> str:
    """Recursive fold over ``source`` (key, seq, ts, mask, ends); gives key and the matched seqs in time order."""
    since = "a.started" if total else "a.entered"
    new = "CASE WHEN hit = f + 1 THEN f + 1 ELSE 0 END" if ordered else "mask & ~f"
    full = (1 << n) - 1
    return f"""t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq, mask) AS rn FROM (
  SELECT key, seq, epoch_us(ts) AS t, CAST(mask AS INTEGER) AS mask, ends FROM ({source}) WHERE mask <> 0 OR ends)),
a AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS INTEGER) AS filled, CAST(0 AS BIGINT) AS entered, CAST(0 AS BIGINT) AS started, CAST(0 AS BIGINT) AS last,
   CAST([] AS BIGINT[]) AS slots, CAST(NULL AS BIGINT[]) AS found FROM (SELECT DISTINCT key FROM t)
 UNION ALL
 SELECT key, rn, CAST(CASE WHEN nf = {full} THEN 0 ELSE nf END AS INTEGER), CASE WHEN nw <> 0 THEN t ELSE entered END, CASE WHEN f = 0 AND nw <> 0 THEN t ELSE started END,
   CASE WHEN hit <> 0 THEN t ELSE last END, CASE WHEN nf = {full} THEN [] ELSE ns END, CASE WHEN nf = {full} THEN ns END
 FROM (SELECT *, f | nw AS nf, CASE WHEN nw <> 0 THEN list_append(s0, seq) ELSE s0 END AS ns
  FROM (SELECT *, {new} AS nw
   FROM (SELECT *, CASE WHEN f = 0 OR t > last THEN (mask & (2 * f + 1)) & -(mask & (2 * f + 1)) ELSE 0 END AS hit
    FROM (SELECT key, rn, seq, t, mask, entered, started, last, CASE WHEN dead THEN 0 ELSE filled END AS f, CASE WHEN dead THEN [] ELSE slots END AS s0
     FROM (SELECT t.key, t.rn, t.seq, t.t, t.mask, a.entered, a.started, a.last, a.filled, a.slots,
       (a.filled <> 0 AND t.t - {since} > {span_us}) OR t.ends AS dead FROM a JOIN t ON a.key = t.key AND t.rn = a.rn + 1))))))"""


def mask_sql(*conditions: str) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(conditions))


def sequence_sql(source: str, n: int, span_us: int, **options) -> str:
    body = automaton_sql(source, n, span_us, **options)
    return ev_sql("SELECT key, array_to_string(found, ',') AS seqs FROM a WHERE found IS NOT NULL", body).replace("WITH ", "WITH RECURSIVE ", 1)


def seqs(found):
    return found.select("key", F.array_join(F.transform("events", lambda e: e["seq"].cast("string")), ",").alias("seqs"))


HOUR = 3_600_000_000
TYPE = "event_type = '{}'"


def typed(*names):
    return mask_sql(*[TYPE.format(n) for n in names])


def source(key, mask, ends="false"):
    return f"SELECT {key} AS key, seq, ts, {mask} AS mask, {ends} AS ends FROM ev"


TWO = SequenceSpec("error then purchase", [step(kind("error")), step(kind("purchase"))], by="pid", maxspan="12h", long_span=True)


@query("q1_two_step", sequence_sql(source("CAST(pid AS VARCHAR)", typed("error", "purchase")), 2, 12 * HOUR))
def q1(spark, sf):
    return seqs(sequence_match(telemetry(spark, sf), TWO))


FOUR = SequenceSpec("four steps", [step(kind(n)) for n in ("click", "view", "error", "purchase")], by="pid", maxspan="24h", long_span=True)


@query("q1_four_step", sequence_sql(source("CAST(pid AS VARCHAR)", typed("click", "view", "error", "purchase")), 4, 24 * HOUR))
def q1b(spark, sf):
    return seqs(sequence_match(telemetry(spark, sf), FOUR))


@query("q1_overlapping_predicates", sequence_sql(source("host", mask_sql("k > 50", "k > 80 OR event_type = 'view'", "event_type = 'purchase'")), 3, HOUR))
def q1c(spark, sf):
    spec = SequenceSpec("overlap", [step(lambda d: F.col("k") > 50), step(lambda d: (F.col("k") > 80) | (F.col("event_type") == "view")), step(kind("purchase"))],
                        by="host", maxspan="1h")
    return seqs(sequence_match(telemetry(spark, sf), spec))


@query("q1_hot_key_slices", sequence_sql(source("host", typed("error", "purchase", "view")), 3, HOUR))
def q1d(spark, sf):
    # Few keys hold all rows; a low row bound makes every key a hot one.
    spec = SequenceSpec("hot", [step(kind(n)) for n in ("error", "purchase", "view")], by="host", maxspan="1h")
    return seqs(sequence_match(telemetry(spark, sf), spec, rows_per_slice=40))


@query("q2_by_text_without_case", sequence_sql(source("lower(host)", typed("signup", "error")), 2, 4 * HOUR))
def q2(spark, sf):
    df = telemetry(spark, sf).withColumn("label", F.when(F.col("seq") % 2 == 0, F.upper("host")).otherwise(F.col("host")))
    return seqs(sequence_match(df, SequenceSpec("folded", [step(kind("signup")), step(kind("error"))], by="label", maxspan="4h")))


@query("q2_by_compound_key", sequence_sql(source("""'["' || host || '","' || (k % 3) || '"]'""", typed("click", "purchase")), 2, 4 * HOUR))
def q2b(spark, sf):
    df = telemetry(spark, sf).withColumn("third", F.col("k") % 3)
    return seqs(sequence_match(df, SequenceSpec("compound", [step(kind("click")), step(kind("purchase"))], by=("host", "third"), maxspan="4h")))


@query("q3_per_step_keys", sequence_sql(
    "SELECT CAST(ppid AS VARCHAR) AS key, seq, ts, 1 AS mask, false AS ends FROM ev WHERE event_type = 'error' UNION ALL SELECT CAST(pid AS VARCHAR), seq, ts, 2, false FROM ev WHERE event_type = 'purchase'",
    2, 4 * HOUR))
def q3(spark, sf):
    df = telemetry(spark, sf).withColumn("ppid", F.floor(F.col("pid") / 2))
    spec = SequenceSpec("child then parent", [step(kind("error"), by="ppid"), step(kind("purchase"), by="pid")], maxspan="4h")
    return seqs(sequence_match(df, spec))


@query("q4_unconstrained", sequence_sql(source("''", mask_sql("event_type = 'error' AND k > 80", "event_type = 'purchase' AND k > 80")), 2, 2 * HOUR))
def q4(spark, sf):
    def rare(name):
        return lambda df: (F.col("event_type") == name) & (F.col("k") > 80)
    return seqs(sequence_match(telemetry(spark, sf), SequenceSpec("rare pair", [step(rare("error")), step(rare("purchase"))], maxspan="2h")))


_BOUND = ev_sql("SELECT key, found AS seqs FROM a WHERE found IS NOT NULL", f"""
t AS (SELECT CAST(pid AS VARCHAR) AS key, seq, epoch_us(ts) AS t, value, event_type = 'error' AS e, row_number() OVER (PARTITION BY pid ORDER BY ts, seq) AS rn FROM ev WHERE event_type IN ('error', 'purchase')),
a AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS entered, CAST([] AS STRUCT(seq BIGINT, value DOUBLE, t BIGINT)[]) AS pend, CAST(NULL AS VARCHAR) AS found FROM (SELECT DISTINCT key FROM t)
 UNION ALL
 SELECT key, rn, CASE WHEN e AND len(p) = 0 THEN t ELSE entered END, CASE WHEN len(fit) > 0 THEN [] WHEN e THEN list_append(p, {{'seq': seq, 'value': value, 't': t}}) ELSE p END,
  CASE WHEN len(fit) > 0 THEN fit[1].seq || ',' || seq END
 FROM (SELECT *, CASE WHEN e OR len(p) = 0 THEN [] ELSE list_filter(p, lambda x: value > x.value) END AS fit
  FROM (SELECT t.key, t.rn, t.seq, t.t, t.value, t.e, a.entered, CASE WHEN len(a.pend) > 0 AND t.t - a.entered > {24 * HOUR} THEN [] ELSE a.pend END AS p
   FROM a JOIN t ON a.key = t.key AND t.rn = a.rn + 1)))""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("q5_bound_fields", _BOUND)
def q5(spark, sf):
    spec = SequenceSpec("costlier purchase", [
        step(kind("error"), alias="e1"),
        step(kind("purchase"), bound=lambda cur, b: cur["value"] > b["e1"]["value"], uses=["e1"])], by="pid", maxspan="24h", long_span=True)
    return seqs(sequence_match(telemetry(spark, sf), spec, keep=["value"]))


# A row must be younger than the last one that was taken; ties are many among the rows of a host.
SAME_VALUE_SQL = ev_sql("SELECT key, found AS seqs FROM a WHERE found IS NOT NULL", f"""
t AS (SELECT host AS key, seq, epoch_us(ts) AS t, k, event_type = 'error' AS e, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS rn FROM ev WHERE event_type IN ('error', 'purchase')),
a AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS entered, CAST(0 AS BIGINT) AS last, CAST([] AS STRUCT(seq BIGINT, k BIGINT)[]) AS pend, CAST(NULL AS VARCHAR) AS found FROM (SELECT DISTINCT key FROM t)
 UNION ALL
 SELECT key, rn, CASE WHEN e AND len(p) = 0 THEN t ELSE entered END, CASE WHEN e AND young THEN t ELSE last END,
  CASE WHEN len(fit) > 0 THEN [] WHEN e AND young THEN list_append(p, {{'seq': seq, 'k': k}}) ELSE p END, CASE WHEN len(fit) > 0 THEN fit[1].seq || ',' || seq END
 FROM (SELECT *, CASE WHEN e OR NOT young THEN [] ELSE list_filter(p, lambda x: k = x.k) END AS fit
  FROM (SELECT *, len(p) = 0 OR t > last AS young
   FROM (SELECT t.key, t.rn, t.seq, t.t, t.k, t.e, a.entered, a.last, CASE WHEN len(a.pend) > 0 AND t.t - a.entered > {4 * HOUR} THEN [] ELSE a.pend END AS p
    FROM a JOIN t ON a.key = t.key AND t.rn = a.rn + 1))))""").replace("WITH ", "WITH RECURSIVE ", 1)

SAME = SequenceSpec("purchase as in the error", [step(kind("error"), alias="e1"), step(kind("purchase"), same={"k": "e1.k"})], by="host", maxspan="4h")


@query("q5_same_value", SAME_VALUE_SQL)
def q5_same(spark, sf):
    # Few keys hold all rows; a low row bound cuts each one where it pauses.
    return seqs(sequence_match(telemetry(spark, sf), SAME, keep=["k"], rows_per_slice=40))


@query("q6_maxspan_per_step", sequence_sql(source("host", typed("signup", "error", "purchase")), 3, HOUR // 2))
def q6(spark, sf):
    spec = SequenceSpec("steps", [step(kind(n)) for n in ("signup", "error", "purchase")], by="host", maxspan="30m")
    return seqs(sequence_match(telemetry(spark, sf), spec))


@query("q6_maxspan_total", sequence_sql(source("host", typed("signup", "error", "purchase")), 3, HOUR // 2, total=True))
def q6b(spark, sf):
    spec = SequenceSpec("total", [step(kind(n)) for n in ("signup", "error", "purchase")], by="host", maxspan="30m", span="total")
    return seqs(sequence_match(telemetry(spark, sf), spec))


@query("q7_unordered", sequence_sql(source("CAST(pid AS VARCHAR)", mask_sql("event_type = 'error'", "event_type = 'view' AND k > 30", "k > 60")), 3, 12 * HOUR, ordered=False))
def q7(spark, sf):
    spec = SequenceSpec("any order", [step(kind("error")), step(lambda d: (F.col("event_type") == "view") & (F.col("k") > 30)), step(lambda d: F.col("k") > 60)],
                        by="pid", maxspan="12h", long_span=True, ordered=False)
    return seqs(sequence_match(telemetry(spark, sf), spec))


@query("q8_expiry", sequence_sql(source("CAST(pid AS VARCHAR)", typed("error", "purchase"), "event_type = 'signup'"), 2, 24 * HOUR))
def q8(spark, sf):
    spec = SequenceSpec("expiring", [step(kind("error")), step(kind("purchase"))], by="pid", maxspan="24h", long_span=True, expire_when=kind("signup"))
    return seqs(sequence_match(telemetry(spark, sf), spec))


@query("q9_default_lifetime", sequence_sql(source("CAST(pid AS VARCHAR)", typed("view", "click")), 2, 4 * HOUR))
def q9(spark, sf):
    return seqs(sequence_match(telemetry(spark, sf), SequenceSpec("no span", [step(kind("view")), step(kind("click"))], by="pid")))


@query("q10_step_prefilter", ev_sql("SELECT seq, CAST(pid AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS mask FROM ev WHERE event_type IN ('error', 'purchase')"))
def q10(spark, sf):
    tagged = S.tag_rows(telemetry(spark, sf), [TWO], "ts", "seq", [])
    return tagged.select(F.col("item.seq").alias("seq"), "key", F.col("item.mask").alias("mask"))


@query("q11_representative_events", ev_sql("""
SELECT key, f[1] AS first_seq, f[2] AS last_seq, x.event_type AS first_type, y.event_type AS last_type, y.ts AS end_ts FROM (SELECT key, found AS f FROM a WHERE found IS NOT NULL)
 JOIN ev x ON f[1] = x.seq JOIN ev y ON f[2] = y.seq""", automaton_sql(source("CAST(pid AS VARCHAR)", typed("error", "purchase")), 2, 12 * HOUR)).replace("WITH ", "WITH RECURSIVE ", 1))
def q11(spark, sf):
    found = sequence_match(telemetry(spark, sf), TWO, keep=["event_type"])
    first, last = F.get("events", F.lit(0)), F.get("events", F.lit(1))
    return found.select("key", first["seq"].alias("first_seq"), last["seq"].alias("last_seq"), first["event_type"].alias("first_type"),
                        last["event_type"].alias("last_type"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"))


MANY = [SequenceSpec(f"{a} to {b}", [step(kind(a)), step(kind(b))], by="pid", maxspan="4h")
        for a in ("click", "error", "signup") for b in ("purchase", "view")]


def _many_sql():
    parts = []
    for i, spec in enumerate(MANY):
        a, b = spec.name.split(" to ")
        parts.append(f"SELECT '{spec.name}' || '|' || pid AS key, seq, ts, {typed(a, b)} AS mask, false AS ends FROM ev")
    return sequence_sql(" UNION ALL ".join(parts), 2, 4 * HOUR)


@query("q1_many_specs_one_pass", _many_sql())
def q_many(spark, sf):
    return seqs(sequence_match(telemetry(spark, sf), MANY).withColumn("key", F.concat_ws("|", "rule", "key")))


@query("t3_events_in_time_order", """
SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_shipdate, l_linenumber) AS ordered, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def t3(spark, sf):
    # A match holds a handful of events, as an order holds a handful of lines.
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_shipdate", "l_linenumber")).alias("e"))
    return lines.select("l_orderkey", F.array_join(F.transform(sort_events(F.col("e")), lambda e: e["l_linenumber"].cast("string")), ",").alias("ordered"),
                        F.size("e").cast("bigint").alias("n"))


@query("t4_partial_dedup", ev_sql("""
SELECT min(seq) AS seq, name FROM (SELECT *, CASE name WHEN 'ReadFile' THEN CAST(seq % 97 AS VARCHAR) WHEN 'CreateFile' THEN path WHEN 'RegSetValue' THEN key_path WHEN 'Connect' THEN dip || dport END AS pk FROM ev)
 WHERE pk IS NOT NULL GROUP BY host, seq % 3, name, pk, pid UNION ALL SELECT seq, name FROM ev WHERE name = 'CreateProcess'"""))
def t4(spark, sf):
    df = telemetry(spark, sf).withColumn("slot", F.col("seq") % 3)
    return dedup_partials(df, ["host"]).select("seq", "name")


@query("t5_partial_cap", ev_sql("SELECT host, seq % 2 AS slot, count(*) AS pending, count(*) - 100 AS above FROM ev GROUP BY ALL HAVING count(*) > 100"))
def t5(spark, sf):
    # Slots above the bound are reported; their events stay.
    return partial_breaches(telemetry(spark, sf).withColumn("slot", F.col("seq") % 2), ["host", "slot"], 100)


@query("q16_spec_validation", """
SELECT p_partkey, CASE WHEN n < 2 THEN 'a sequence needs at least two steps' WHEN n > 5 THEN 'at most 5 steps are allowed' WHEN h > 4 THEN 'maxspan is above the 4h limit'
 WHEN keyed > 0 AND keyed < n THEN 'either all steps have a key or none' WHEN keyed > 0 AND p_size % 2 = 0 THEN 'a sequence key and step keys exclude each other'
 WHEN p_partkey % 5 > p_partkey % 3 THEN 'reference to an unknown alias' END AS problem
FROM (SELECT *, p_size % 7 AS n, nullif(p_partkey % 6, 0) AS h, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size % 7 - (p_partkey // 2) % 2 END AS keyed FROM part)""")
def q16(spark, sf):
    """Definitions of sequences in a table, each with the first reason why it is not valid."""
    n, at = F.col("p_size") % 7, F.col("p_partkey")
    names = lambda c: F.slice(F.array(*[F.lit(f"e{i}") for i in range(1, 6)]), 1, c.cast("int"))
    specs = table(spark, sf, "part").select(
        at, n.alias("steps"), (F.nullif(at % 6, F.lit(0)) * HOUR).alias("span_us"), F.when(at % 2 == 0, F.lit(0)).otherwise(n - F.floor(at / 2) % 2).alias("keyed_steps"),
        (F.col("p_size") % 2 == 0).alias("has_key"), names(at % 5).alias("used"), names(at % 3).alias("known"))
    return sequence_problems(specs).select("p_partkey", "problem")
