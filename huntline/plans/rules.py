"""Rule catalogue, alerts, detectors, scans and transformers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.params import params_text
from ..functions.predicates import in_
from ..operators import alerts as A
from ..operators import evasion, rules as K, scanning, transforms as R
from ..operators.rules import Rule, Test
from ..operators.sequences import SequenceSpec, step
from ..schema import event_catalog
from ..sources.tables import table, telemetry, wide_telemetry, with_stack
from .registry import ev_sql, json_params, json_text, params_sql, query, st_sql
from .sequences import FOUR, HOUR, TWO, automaton_sql, kind, source, typed


def _rule(number, name, names, condition, sql, **more):
    categories = more.pop("categories", ())
    return Rule(f"r{number:02d}", name, condition, names=names, categories=categories, **more), sql


# Each rule with the same condition in SQL.
SIMPLE = [
    _rule(1, "opened early image", ("CreateFile",), lambda d: field(d, "file.operation") == "OPEN", "name = 'CreateFile' AND disposition = 'OPEN'",
          severity="high", labels={"tactic.name": "Collection", "technique.name": "Data"}, output="%ps.name opened", actions=("kill",)),
    _rule(2, "large read", ("ReadFile",), lambda d: field(d, "file.io.size") > 80, "name = 'ReadFile' AND k > 80",
          labels={"tactic.name": "Collection", "technique.name": "Volume"}),
    _rule(3, "denied start", ("CreateProcess",), lambda d: field(d, "evt.arg[status]") != "Success", "name = 'CreateProcess' AND status <> 'Success'",
          severity="critical", labels={"tactic.name": "Execution"}, actions=("kill", "isolate")),
    _rule(4, "binary value", ("RegSetValue",), lambda d: field(d, "registry.value.type") == "REG_BINARY", "name = 'RegSetValue' AND seq % 3 = 0",
          labels={"tactic.name": "Persistence", "technique.name": "Registry"}),
    _rule(5, "odd port", ("Connect",), lambda d: in_(field(d, "net.dport"), [22, 8080]), "name = 'Connect' AND dport IN (22, 8080)",
          labels={"tactic.name": "Exfiltration", "technique.name": "Channel"}, actions=("isolate",)),
    _rule(6, "any file with k", (), lambda d: F.col("k") >= 90, "category = 'file' AND k >= 90", categories=("file",)),
    _rule(7, "disabled", ("CreateFile",), lambda d: F.lit(True), "false", enabled=False),
    _rule(8, "path pattern", ("CreateFile", "ReadFile"), lambda d: F.lit(True), "category = 'file' AND lower(path) LIKE '%_6.exe'",
          tests=(Test("file.path", "imatches", ("*_6.EXE",)),), severity="low"),
]
RULES = [r for r, _ in SIMPLE]
_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT *, '{r.id}' AS rule_id FROM ev WHERE {sql}" for r, sql in SIMPLE) + ")"


@query("k1_match_all", ev_sql("SELECT seq, rule_id FROM hits", _HITS))
def k1(spark, sf):
    return K.match_rules(telemetry(spark, sf), RULES).select("seq", "rule_id")


@query("k1_first_match", ev_sql("SELECT seq, min(rule_id) AS rule_id FROM hits GROUP BY seq", _HITS))
def k1b(spark, sf):
    return K.match_rules(telemetry(spark, sf), RULES, match_all=False).select("seq", "rule_id")


_SCOPES = "scopes AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r.id}', '{what}', '{value}')" for r in RULES if r.enabled for what, values in (("name", r.names), ("category", r.categories)) for value in values) + ") AS v(id, what, value))"


@query("u2_union_of_rule_candidates", ev_sql("""
SELECT name, category, coalesce(c.ids, '') AS candidates, count(*) AS n FROM ev LEFT JOIN (
  SELECT n.name, n.category, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT name, category FROM ev) n
  JOIN scopes s ON (what = 'name' AND value = n.name) OR (what = 'category' AND value = n.category) GROUP BY ALL) c USING (name, category) GROUP BY ALL""", _SCOPES))
def u2(spark, sf):
    df = K.candidate_rules(telemetry(spark, sf), RULES).withColumn("candidates", F.array_join("candidates", ","))
    return df.groupBy("name", "category", "candidates").agg(F.count("*").alias("n"))


@query("a2_rule_match_counts", ev_sql("SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id", _HITS))
def a2(spark, sf):
    return K.rule_counts(K.match_rules(telemetry(spark, sf), RULES))


SEQ_RULES = [
    Rule("s1", "error then purchase", lambda d: F.lit(True), sequence=TWO, severity="high", tags=("chain",),
         labels={"tactic.name": "Impact"}, output="%1.evt.event_type of %1.evt.pid then %2.evt.event_type worth %2.evt.arg[k], see %3.evt.pid", actions=("kill", "isolate")),
    Rule("s2", "four steps", lambda d: F.lit(True), sequence=FOUR, severity="critical", output="four steps by %evt.pid"),
    Rule("s3", "costlier", lambda d: F.lit(True), output="costlier", sequence=SequenceSpec("costlier", [
        step(kind("signup"), alias="a"), step(kind("error"), bound=lambda cur, b: cur["k"] > b["a"]["k"] + 50, uses=["a"])],
        by="pid", maxspan="24h", long_span=True)),
]
KEEP = ["event_type", "pid", "host", "name", "k", "params"]


@query("k2_sequence_rules", ev_sql("""
SELECT 's1' AS rule_id, array_to_string(found, ',') AS seqs FROM a WHERE found IS NOT NULL UNION ALL SELECT 's2', array_to_string(found, ',') FROM a2 WHERE found IS NOT NULL""",
    automaton_sql(source("CAST(pid AS VARCHAR)", typed("error", "purchase")), 2, 12 * HOUR) + ", " + automaton_sql(
        source("CAST(pid AS VARCHAR)", typed("click", "view", "error", "purchase")), 4, 24 * HOUR).replace("t AS (SELECT *", "t2 AS (SELECT *", 1).replace(
        "a AS (SELECT key,", "a2 AS (SELECT key,", 1).replace("FROM t)", "FROM t2)").replace("FROM a JOIN t ON", "FROM a2 a JOIN t2 t ON")).replace("WITH ", "WITH RECURSIVE ", 1))
def k2(spark, sf):
    found = K.match_sequences(telemetry(spark, sf), SEQ_RULES[:2])
    return found.select("rule_id", F.array_join(F.transform("events", lambda e: e["seq"].cast("string")), ",").alias("seqs"))


@query("k3_tag_events", ev_sql("""
SELECT seq, rule_id, CASE rule_id WHEN 'r01' THEN 'rule.name=opened early image, src=' || event_type || ', tactic.name=Collection, technique.name=Data'
 WHEN 'r02' THEN 'rule.name=large read, src=' || event_type || ', tactic.name=Collection, technique.name=Volume' WHEN 'r03' THEN 'rule.name=denied start, src=' || event_type || ', tactic.name=Execution'
 WHEN 'r04' THEN 'rule.name=binary value, src=' || event_type || ', tactic.name=Persistence, technique.name=Registry'
 WHEN 'r05' THEN 'rule.name=odd port, src=' || event_type || ', tactic.name=Exfiltration, technique.name=Channel'
 WHEN 'r06' THEN 'rule.name=any file with k, src=' || event_type ELSE 'rule.name=path pattern, src=' || event_type END AS meta FROM hits""", _HITS))
def k3(spark, sf):
    tagged = K.tag_events(K.match_rules(telemetry(spark, sf), RULES), K.rules_frame(spark, RULES))
    return tagged.select("seq", "rule_id", params_text(F.col("meta"), "snake", "=").alias("meta"))


def _alerts(spark, sf):
    df = telemetry(spark, sf)
    return A.build_alerts(K.match_sequences(df, SEQ_RULES[:1], keep=KEEP), SEQ_RULES)


_S1 = automaton_sql(source("CAST(pid AS VARCHAR)", typed("error", "purchase")), 2, 12 * HOUR)
_S1_JOIN = "(SELECT key, found AS f FROM a WHERE found IS NOT NULL) JOIN ev x ON f[1] = x.seq JOIN ev y ON f[2] = y.seq"


def _s1_sql(body):
    return ev_sql(body, _S1).replace("WITH ", "WITH RECURSIVE ", 1)


@query("k4_alert_text", _s1_sql(f"""
SELECT 's1' AS rule_id, 'error then purchase' AS title, 'error of ' || x.pid || ' then purchase worth ' || y.k || ', see %3.evt.pid' AS text, 'high' AS severity,
 'chain' AS tags, x.host AS host, x.seq || ',' || y.seq AS seqs FROM {_S1_JOIN}"""))
def k4(spark, sf):
    return _alerts(spark, sf).select("rule_id", "title", "text", "severity", F.array_join("tags", ",").alias("tags"), "host",
                                     F.array_join(F.transform("events", lambda e: e["seq"].cast("string")), ",").alias("seqs"))


# The state of a process as SQL: its last start at or before the event on that host, the parent's at the child's start, and the names of all ancestors.
_PROC = """started AS (SELECT * FROM evp WHERE name = 'CreateProcess'),
 linked AS (SELECT c.*, p.seq AS up FROM started c ASOF LEFT JOIN started p ON c.host = p.host AND c.ppid = p.pid AND c.ts >= p.ts),
 chain AS (SELECT l.seq AS id, p.image AS name, p.up, 1 AS n, [l.seq, p.seq] AS seen FROM linked l JOIN linked p ON l.up = p.seq AND p.seq <> l.seq
  UNION ALL SELECT c.id, p.image, p.up, c.n + 1, list_append(c.seen, p.seq) FROM chain c JOIN linked p ON c.up = p.seq AND NOT list_contains(c.seen, p.seq)),
 older AS (SELECT id, string_agg('"' || name || '"', ',' ORDER BY n) AS names FROM chain GROUP BY id),
 proc AS (SELECT l.*, p.image AS parent_image, p.path AS parent_path, p.k AS parent_k, coalesce(o.names, '') AS ancestors FROM linked l LEFT JOIN linked p ON l.up = p.seq LEFT JOIN older o ON o.id = l.seq),
 whole AS (SELECT e.seq AS id, e.name AS n, e.category AS c, e.ts AS t, e.ps AS params, e.pid AS own, p.* FROM evp e ASOF LEFT JOIN proc p ON e.host = p.host AND e.pid = p.pid AND e.ts >= p.ts)"""


def _event_json(e: str) -> str:
    cmd = lambda path, k: f"""'"\\"' || replace({path}, '\\', '\\\\') || '\\" -k ' || {k} || '"'"""
    proc = f"""CASE WHEN {e}.seq IS NULL THEN '{{"pid":' || {e}.own || '}}' ELSE '{{"pid":' || {e}.pid || ',"ppid":' || {e}.ppid || ',"name":"' || {e}.image || '","exe":' || {json_text(e + '.path')}
 || ',"cmdline":' || {cmd(e + '.path', e + '.k')} || CASE WHEN {e}.parent_image IS NULL THEN '' ELSE ',"parent_name":"' || {e}.parent_image || '","parent_cmdline":' || {cmd(e + '.parent_path', e + '.parent_k')} END
 || ',"username":"user' || ({e}.pid % 9) || '","ancestors":[' || {e}.ancestors || ']}}' END"""
    return f"""'{{"name":"' || {e}.n || '","category":"' || {e}.c || '","timestamp":"' || strftime({e}.t, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","params":' || {json_params(e + '.params')} || ',"proc":' || {proc} || '}}'"""


@query("k4_alert_json", params_sql(f"""
SELECT x.seq AS first_seq, '{{"id":"s1","title":"error then purchase","severity":"high","text":"error of ' || x.pid || ' then purchase worth ' || y.k || ', see %3.evt.pid","description":"","labels":{{"tactic.name":"Impact"}},"events":['
 || {_event_json('v')} || ',' || {_event_json('w')} || ']}}' AS json FROM {_S1_JOIN} JOIN whole v ON v.id = x.seq JOIN whole w ON w.id = y.seq""", _S1 + ", " + _PROC).replace("WITH ", "WITH RECURSIVE ", 1))
def k4b(spark, sf):
    df = A.with_process(telemetry(spark, sf))
    built = A.build_alerts(K.match_sequences(df, SEQ_RULES[:1], keep=[*KEEP, "category", "ps"]), SEQ_RULES)
    built = built.withColumn("alert_id", F.get("events", F.lit(0))["seq"])
    return A.alert_json(built).select(F.col("alert_id").alias("first_seq"), "json")


@query("k4_alert_long_text", _s1_sql(f"""
SELECT x.seq AS first_seq, 'error then purchase' || chr(10) || chr(10) || 'error of ' || x.pid || ' then purchase worth ' || y.k || ', see %3.evt.pid' || chr(10) || chr(10) || 'Severity: high'
 || chr(10) || chr(10) || 'System events involved in this alert:' || chr(10) || chr(10) || chr(9) || 'Event #1:' || chr(10) || 'CreateProcess;' || chr(9) || 'Event #2:' || chr(10) || 'Connect;' AS text FROM {_S1_JOIN}"""))
def k4c(spark, sf):
    text = A.alert_verbose(F.col("title"), F.col("text"), F.col("severity"), F.col("events"), lambda e: F.concat(e["name"], F.lit(";")))
    return _alerts(spark, sf).select(F.get("events", F.lit(0))["seq"].alias("first_seq"), text.alias("text"))


@query("k4_severity", ev_sql("SELECT seq, CASE seq % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'low' END AS severity FROM ev"))
def k4d(spark, sf):
    text = F.get(F.array(*[F.lit(s) for s in ("Normal", "MEDIUM", "high", "Critical", "odd")]), (F.col("seq") % 5).cast("int"))
    return telemetry(spark, sf).select("seq", A.severity_from_text(text).alias("severity"))


@query("a6_unique_pids", _s1_sql(f"SELECT x.seq AS first_seq, CAST(x.pid AS VARCHAR) AS pids FROM {_S1_JOIN}"))
def a6(spark, sf):
    out = A.unique_pids(_alerts(spark, sf))
    return out.select(F.get("events", F.lit(0))["seq"].alias("first_seq"), F.array_join(F.transform("pids", lambda p: p.cast("string")), ",").alias("pids"))


@query("k10_response_targets", _s1_sql(f"""
SELECT x.seq AS first_seq, 'kill' AS action, CAST(x.pid AS VARCHAR) AS target FROM {_S1_JOIN} UNION ALL SELECT x.seq, 'isolate', x.host FROM {_S1_JOIN}"""))
def k10(spark, sf):
    built = _alerts(spark, sf)
    out = K.response_targets(built, K.rules_frame(spark, SEQ_RULES))
    return out.join(built.select("alert_id", F.get("events", F.lit(0))["seq"].alias("first_seq")), "alert_id").select("first_seq", "action", "target")


_CAND = r"""CASE WHEN seq % 8 = 1 AND (k % 4 = 0 OR k % 5 = 0) AND NOT (seq % 50 = 7) THEN 'module' WHEN seq % 8 = 3 AND pid <> 4 AND k % 2 = 0 THEN 'alloc' END"""


@query("k5_scan_candidates", ev_sql(f"SELECT seq, {_CAND} AS trigger, CAST(pid AS VARCHAR) AS target FROM ev WHERE {_CAND} IS NOT NULL"))
def k5(spark, sf):
    return scanning.scan_candidates(wide_telemetry(spark, sf), skip_files=["*\\M7.dll", "*\\m7.SYS"]).select("seq", "trigger", "target")


@query("k5_scan_candidates_files", ev_sql("""
SELECT seq, CASE WHEN name = 'CreateProcess' THEN 'process' WHEN name = 'CreateFile' THEN 'file' ELSE 'registry' END AS trigger,
 CASE WHEN name = 'CreateProcess' THEN CAST(pid AS VARCHAR) WHEN name = 'CreateFile' THEN path ELSE 'd' || k END AS target
FROM ev WHERE name = 'CreateProcess' OR (name = 'CreateFile' AND disposition = 'CREATE') OR (name = 'RegSetValue' AND seq % 3 = 0)"""))
def k5b(spark, sf):
    return scanning.scan_candidates(telemetry(spark, sf)).select("seq", "trigger", "target")


@query("k5_once_per_process", ev_sql(f"""
SELECT min(seq) AS seq, trigger FROM (SELECT *, {_CAND} AS trigger FROM ev) WHERE trigger = 'alloc' GROUP BY host, pid, trigger
UNION ALL SELECT seq, {_CAND} FROM ev WHERE {_CAND} = 'module'"""))
def k5c(spark, sf):
    found = scanning.scan_candidates(wide_telemetry(spark, sf), skip_files=["*\\M7.dll", "*\\m7.SYS"])
    return scanning.once_per_process(found).select("seq", "trigger")


SIGNATURES = [
    {"name": "script", "kind": "text", "patterns": ["<script>", "track("], "require": "all", "score": 85},
    {"name": "list", "kind": "hex", "patterns": ["3c 6c 69 3e 3c 61"], "score": 30},
    {"name": "meta", "kind": "regex", "patterns": ["<meta\\s+charset", "never-there"]},
]


@query("k5_content_scan", """
SELECT page_id, 'script' AS signature, 'critical' AS severity FROM pages WHERE contains(html, '<script>') AND contains(html, 'track(')
UNION ALL SELECT page_id, 'list', 'low' FROM pages WHERE contains(html, '<li><a') UNION ALL SELECT page_id, 'meta', 'high' FROM pages WHERE regexp_matches(html, '<meta\\s+charset')""".replace("\\\\", "\\"))
def k5d(spark, sf):
    files = table(spark, sf, "pages").withColumn("content", F.encode("html", "UTF-8"))
    return scanning.scan_content(files, SIGNATURES, keep=["page_id"])


@query("k5_byte_patterns", r"""
SELECT page_id, 'gap' AS signature, 'critical' AS severity FROM pages WHERE regexp_matches(html, '<l[\s\S]>[\s\S]a')
UNION ALL SELECT page_id, 'no gap', 'low' FROM pages WHERE contains(html, '<title>') OR contains(html, 'never there')""")
def k5e(spark, sf):
    """Byte patterns with and without gaps over whole contents."""
    byte_signatures = [{"name": "gap", "kind": "hex", "patterns": ["3C 6c ?? 3e ?? 61"], "score": 85},
                       {"name": "no gap", "kind": "hex", "patterns": ["3c7469746c653e", "6e 65 76 65 72 20 74 68 65 72 65"], "score": 30}]
    files = table(spark, sf, "pages").withColumn("content", F.encode("html", "UTF-8"))
    return scanning.scan_content(files, byte_signatures, keep=["page_id"])


@query("x25_content_signature_function", "SELECT page_id, 'script' AS signature FROM pages WHERE contains(html, '<script>') AND contains(html, 'track(')")
def x25(spark, sf):
    files = table(spark, sf, "pages").withColumn("content", F.encode("html", "UTF-8"))
    return scanning.scan_content(files, SIGNATURES[:1], keep=["page_id"]).select("page_id", "signature")


_DIRECT = "s[3].module = 'C:\\tmp\\x.dll'"


@query("k6_direct_call", st_sql(f"SELECT seq, {_DIRECT} AS direct FROM st"))
def k6(spark, sf):
    return with_stack(telemetry(spark, sf)).select("seq", evasion.direct_call(F.col("callstack")).alias("direct"))


_INDIRECT = """(seq % 3 = 0 AND NOT (name = 'CreateFile' AND seq % 6 = 0) AND name IN ('CreateFile', 'CreateProcess', 'RegSetValue')
 AND NOT (seq % 100 > 20 AND seq % 100 <= 43))"""


def _stubs(spark):
    return spark.createDataFrame([("CreateFile", 20), ("CreateProcess", 20), ("RegSetValue", 20)], "name string, rva long")


@query("k7_indirect_call", st_sql(f"SELECT seq, {_INDIRECT} AS indirect FROM st"))
def k7(spark, sf):
    return evasion.indirect_call(with_stack(telemetry(spark, sf)), _stubs(spark)).select("seq", F.col("is_indirect").alias("indirect"))


@query("k8_evasion_tags", st_sql(f"""
SELECT seq, (CASE WHEN {_DIRECT} THEN 1 ELSE 0 END) + (CASE WHEN {_INDIRECT} THEN 2 ELSE 0 END) AS evasions,
 CASE WHEN {_DIRECT} THEN 'direct_syscall' WHEN {_INDIRECT} THEN 'indirect_syscall' END AS names FROM st"""))
def k8(spark, sf):
    df = evasion.indirect_call(with_stack(telemetry(spark, sf)).withColumn("evasions", F.lit(0)), _stubs(spark))
    out = evasion.tag_evasions(df, {"direct_syscall": evasion.direct_call(F.col("callstack")), "indirect_syscall": F.col("is_indirect")})
    return out.select("seq", F.col("evasions").cast("bigint").alias("evasions"), F.col("meta")["evasions"].alias("names"))


@query("k9_enqueue", ev_sql("SELECT seq FROM ev WHERE evasions % 2 = 1 OR k > 90"))
def k9(spark, sf):
    return K.enqueue(telemetry(spark, sf), [F.col("evasions").bitwiseAND(1) != 0, F.col("k") > 90]).select("seq")


def _part_rules(spark, sf):
    """A large rule table derived from the parts."""
    part = table(spark, sf, "part")
    kinds = F.array(*[F.lit(n) for n in ("CreateFile", "Connect", "Bogus", "LoadModule")])
    groups = F.array(*[F.lit(n) for n in ("file", "net", "nonsense", "registry", "mem")])
    i = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("p"), F.when(i % 50 == 49, i - 1).otherwise(i).cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.create_map(F.lit("tactic.name"), F.col("p_type"), F.lit("technique.name"), F.col("p_brand")).alias("labels"),
        (i % 17 != 0).alias("enabled"), F.concat_ws(".", F.lit("1"), (i % 4).cast("string"), F.lit("0")).alias("min_engine_version"),
        F.when(i % 9 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.get(kinds, (i % 4).cast("int")))).alias("names"),
        F.when(i % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.get(groups, (i % 5).cast("int")))).alias("categories"),
        F.array(F.when(i % 13 == 0, F.lit("kevt.name")).otherwise(F.lit("evt.name"))).alias("fields"))


_PART_RULES = """pr AS (SELECT 'p' || CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 1 ELSE p_partkey END AS id, p_partkey AS i, p_type, p_brand, p_partkey % 17 <> 0 AS enabled,
 CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE ['CreateFile', 'Connect', 'Bogus', 'LoadModule'][p_partkey % 4 + 1] END AS n,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ['file', 'net', 'nonsense', 'registry', 'mem'][p_partkey % 5 + 1] END AS c FROM part)"""


@query("k11_catalogue_checks", f"""WITH {_PART_RULES}
SELECT id, 'duplicate id' AS problem, CAST(count(*) AS VARCHAR) AS detail FROM pr GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'unknown event', n FROM pr WHERE n = 'Bogus' UNION ALL SELECT id, 'unknown category', c FROM pr WHERE c = 'nonsense'
UNION ALL SELECT id, 'disabled', '' FROM pr WHERE NOT enabled UNION ALL SELECT id, 'no scope', '' FROM pr WHERE n IS NULL AND c IS NULL
UNION ALL SELECT id, 'engine too old', '1.' || (i % 4) || '.0' FROM pr WHERE i % 4 > 1 UNION ALL SELECT id, 'deprecated field', 'kevt.name' FROM pr WHERE i % 13 = 0""")
def k11(spark, sf):
    return K.check_rules(_part_rules(spark, sf), event_catalog(spark), "1.1.0")


@query("a3_rules_by_tactic", """
SELECT 'tactic' AS section, p_type AS name, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'technique', p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'total', '', count(*) FROM part""")
def a3(spark, sf):
    return K.rules_by_tactic(_part_rules(spark, sf))


@query("a8_used_events", f"WITH {_PART_RULES} SELECT DISTINCT 'event' AS kind, n AS value FROM pr WHERE n IS NOT NULL UNION ALL SELECT DISTINCT 'category', c FROM pr WHERE c IS NOT NULL")
def a8(spark, sf):
    return K.used_events(_part_rules(spark, sf))


def _params(df):
    return params_text(F.col("params"), "snake", "=")


def _listed(entries: str) -> str:
    return f"array_to_string(list_transform({entries}, lambda e: e.k || '=' || e.v), ', ')"


_REMOVED = "list_filter(ps, lambda e: e.k NOT IN ('pid', 'file_path'))"
_RENAMED = """list_sort(list_transform(list_filter(ps, lambda e: e.k <> 'pid'),
 lambda e: {'k': CASE e.k WHEN 'k' THEN 'level' WHEN 'status' THEN 'pid' WHEN 'exe' THEN 'an_exe' ELSE e.k END, 'v': e.v}))"""
_REPLACED = r"""list_transform(ps, lambda e: {'k': e.k, 'v': CASE e.k WHEN 'k' THEN replace(e.v, '1', 'one')
 WHEN 'status' THEN replace(replace(e.v, 'Success', 'ok'), 'denied', 'no') WHEN 'file_path' THEN replace(e.v, 'C:\Users\', '%HOME%\') ELSE e.v END})"""
_TRIMMED = """list_transform(ps, lambda e: {'k': e.k, 'v': CASE WHEN e.k = 'status' THEN CASE WHEN e.v = 'Success' THEN 'cess' ELSE 'Access den' END
 WHEN e.k IN ('file_path', 'exe') THEN regexp_replace(e.v, '[.]exe$', '') ELSE e.v END})"""


@query("r1_remove_params", params_sql(f"SELECT seq, {_listed(_REMOVED)} AS p FROM evp"))
def r1(spark, sf):
    df = R.remove_params(telemetry(spark, sf), ["pid", "file_path", "absent"])
    return df.select("seq", _params(df).alias("p"))


@query("r2_rename_params", params_sql(f"SELECT seq, {_listed(_RENAMED)} AS p FROM evp"))
def r2(spark, sf):
    df = R.rename_params(telemetry(spark, sf), [("k", "level"), ("status", "pid"), ("exe", "an_exe"), ("absent", "x")])
    return df.select("seq", _params(df).alias("p"))


@query("r3_replace_params", params_sql(f"SELECT seq, {_listed(_REPLACED)} AS p FROM evp"))
def r3(spark, sf):
    df = R.replace_params(telemetry(spark, sf), [("k", "1", "one"), ("status", "Success", "ok"), ("status", "denied", "no"), ("file_path", "C:\\Users\\", "%HOME%\\")])
    return df.select("seq", _params(df).alias("p"))


@query("r4_trim_params", params_sql(f"SELECT seq, {_listed(_TRIMMED)} AS p FROM evp"))
def r4(spark, sf):
    df = R.trim_params(telemetry(spark, sf), [("status", "Suc")], [("status", "ied"), ("k", "zz"), ("file_path", ".exe"), ("exe", ".exe")])
    return df.select("seq", _params(df).alias("p"))


@query("r5_tags", ev_sql("SELECT seq, 'env=prod, src=' || event_type AS meta FROM ev"))
def r5(spark, sf):
    df = R.add_tags(telemetry(spark, sf), [("env", "prod"), ("none", "%HUNTLINE_UNSET_VARIABLE%"), ("empty", "")])
    return df.select("seq", params_text(F.col("meta"), "snake", "=").alias("meta"))


@query("k2_bound_sequence_rule", ev_sql("SELECT key, found AS seqs FROM b WHERE found IS NOT NULL", f"""
bt AS (SELECT CAST(pid AS VARCHAR) AS key, seq, epoch_us(ts) AS t, k, event_type = 'signup' AS e, row_number() OVER (PARTITION BY pid ORDER BY ts, seq) AS rn FROM ev WHERE event_type IN ('signup', 'error')),
b AS (SELECT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS entered, CAST([] AS STRUCT(seq BIGINT, k BIGINT)[]) AS pend, CAST(NULL AS VARCHAR) AS found FROM (SELECT DISTINCT key FROM bt)
 UNION ALL
 SELECT key, rn, CASE WHEN e AND len(p) = 0 THEN t ELSE entered END, CASE WHEN len(fit) > 0 THEN [] WHEN e THEN list_append(p, {{'seq': seq, 'k': k}}) ELSE p END,
  CASE WHEN len(fit) > 0 THEN fit[1].seq || ',' || seq END
 FROM (SELECT *, CASE WHEN e OR len(p) = 0 THEN [] ELSE list_filter(p, lambda x: k > x.k + 50) END AS fit
  FROM (SELECT bt.key, bt.rn, bt.seq, bt.t, bt.k, bt.e, b.entered, CASE WHEN len(b.pend) > 0 AND bt.t - b.entered > {24 * HOUR} THEN [] ELSE b.pend END AS p
   FROM b JOIN bt ON b.key = bt.key AND bt.rn = b.rn + 1)))""").replace("WITH ", "WITH RECURSIVE ", 1))
def k2b(spark, sf):
    found = K.match_sequences(telemetry(spark, sf), SEQ_RULES[2:], keep=["k"])
    return found.select("key", F.array_join(F.transform("events", lambda e: e["seq"].cast("string")), ",").alias("seqs"))


