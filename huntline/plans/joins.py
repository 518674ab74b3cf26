"""Enrichment joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import map_device_path
from ..operators import asof, enrich, networks
from ..operators.reports import merge_sources
from ..sources.tables import table, telemetry, wide_telemetry
from .registry import ev_sql, query

_OPENS = "o AS (SELECT host, pid, ts, seq, k FROM ev WHERE event_type = 'signup'), c AS (SELECT host, pid, ts, seq FROM ev WHERE event_type = 'error')"


def _of(df, kind, *columns):
    return df.where(F.col("event_type") == kind).select("host", "pid", "ts", "seq", *columns)


@query("j1_process_asof", ev_sql("""
SELECT seq, CASE WHEN cts IS NULL OR cts < ots THEN opened END AS opened FROM (
 SELECT e.seq, o.seq AS opened, o.ts AS ots, c.ts AS cts FROM ev e
 ASOF LEFT JOIN o ON e.host = o.host AND e.pid = o.pid AND e.ts >= o.ts
 ASOF LEFT JOIN c ON e.host = c.host AND e.pid = c.pid AND e.ts > c.ts + INTERVAL 5 SECOND)""", _OPENS))
def j1(spark, sf):
    df = telemetry(spark, sf)
    states = _of(df, "signup").withColumn("opened", F.col("seq"))
    return asof.asof_join(df, states, ["host", "pid"], "ts", ["opened"], close=_of(df, "error"), grace="5s", tie="opened").select("seq", "opened")


@query("j1_process_state", ev_sql("""
SELECT e.seq, e.pid, p.image AS name FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE name = 'CreateProcess') p
 ON e.host = p.host AND e.pid = p.pid AND e.ts >= p.ts"""))
def j1b(spark, sf):
    return enrich.enrich_process(telemetry(spark, sf)).select("seq", F.col("ps.pid").alias("pid"), F.col("ps.name").alias("name"))


@query("j2_parent", ev_sql("""
SELECT seq, CASE WHEN cts IS NULL OR cts < pts THEN parent END AS parent FROM (
 SELECT p.seq, q.seq AS parent, q.ts AS pts, c.ts AS cts FROM (SELECT * FROM ev WHERE name = 'CreateProcess') p
 ASOF LEFT JOIN (SELECT * FROM ev WHERE name = 'CreateProcess') q ON p.host = q.host AND p.ppid = q.pid AND p.ts >= q.ts
 ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'signup') c ON p.host = c.host AND p.ppid = c.pid AND p.ts > c.ts)"""))
def j2(spark, sf):
    df = telemetry(spark, sf)
    states = enrich.process_states(df)
    ps = F.col("ps").withField("id", F.col("state_seq"))
    ends = _of(df, "signup").select("host", "pid", F.col("ts").alias("ended_at"))
    return enrich.enrich_parent(states.withColumn("ps", ps), ends).select(F.col("state_seq").alias("seq"), F.col("parent.id").alias("parent"))


@query("j3_merge_process_state", ev_sql(r"""
SELECT pid, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN lower(regexp_extract(a, '([^\\]*)$', 1)) = lower(regexp_extract(lg, '([^\\]*)$', 1)) THEN lg ELSE a END AS exe,
 integrity FROM (SELECT *, CASE WHEN length(b) > length(a) OR (length(b) = length(a) AND b > a) THEN b ELSE a END AS lg FROM (
  SELECT pid, max(path) FILTER (event_type = 'click') AS a, max('C:\Very\Long\' || path) FILTER (event_type = 'view') AS b, max('L' || (k % 3)) FILTER (event_type = 'view') AS integrity
  FROM ev WHERE event_type IN ('click', 'view') GROUP BY pid))"""))
def j3(spark, sf):
    df = telemetry(spark, sf)
    a = df.where("event_type = 'click'").groupBy("pid").agg(F.max("path").alias("exe"))
    b = df.where("event_type = 'view'").groupBy("pid").agg(
        F.max(F.concat(F.lit("C:\\Very\\Long\\"), F.col("path"))).alias("exe"), F.max(F.concat(F.lit("L"), (F.col("k") % 3).cast("string"))).alias("integrity"))
    return enrich.merge_process_state(a, b, ["pid"]).select("pid", "exe", "integrity")


@query("j4_ancestry", """
WITH RECURSIVE t AS (SELECT DISTINCT user_id AS id FROM events),
 c AS (SELECT id, id // 2 AS up, 1 AS d FROM t WHERE id <> 0 AND id // 2 IN (SELECT id FROM t)
  UNION ALL SELECT id, up // 2, d + 1 FROM c WHERE up <> 0 AND up // 2 IN (SELECT id FROM t))
SELECT t.id AS pid, coalesce(string_agg('u' || up, '<' ORDER BY d), '') AS chain FROM t LEFT JOIN c ON t.id = c.id GROUP BY t.id""")
def j4(spark, sf):
    tree = telemetry(spark, sf).select("pid").distinct().select(
        "pid", F.when(F.col("pid") != 0, F.floor(F.col("pid") / 2)).alias("up"), F.concat(F.lit("u"), F.col("pid").cast("string")).alias("name"))
    return enrich.ancestors(tree, "pid", "up", "name").select("pid", F.array_join("ancestors", "<").alias("chain"))


_FILES = """o AS (SELECT host, seq % 97 AS obj, ts, path FROM ev WHERE event_type = 'click'), c AS (SELECT host, seq % 97 AS obj, ts FROM ev WHERE event_type = 'error'),
h AS (SELECT host, seq % 97 AS obj, ts, 'handle' || k AS path FROM ev WHERE event_type = 'signup')"""


@query("j5_file_path", ev_sql("""
SELECT seq, coalesce(CASE WHEN kc IS NULL OR kc < kt THEN kp END, CASE WHEN oc IS NULL OR oc < ot THEN op END, hp) AS file_path FROM (
 SELECT e.seq, a.path AS kp, a.ts AS kt, ca.ts AS kc, b.path AS op, b.ts AS ot, cb.ts AS oc, h.path AS hp FROM (SELECT *, (seq * 7) % 97 AS fkey, seq % 97 AS fobj FROM ev) e
 ASOF LEFT JOIN o a ON e.host = a.host AND e.fkey = a.obj AND e.ts >= a.ts ASOF LEFT JOIN c ca ON e.host = ca.host AND e.fkey = ca.obj AND e.ts > ca.ts
 ASOF LEFT JOIN o b ON e.host = b.host AND e.fobj = b.obj AND e.ts >= b.ts ASOF LEFT JOIN c cb ON e.host = cb.host AND e.fobj = cb.obj AND e.ts > cb.ts
 ASOF LEFT JOIN h ON e.host = h.host AND e.fobj = h.obj AND e.ts >= h.ts)""", _FILES))
def j5(spark, sf):
    df = telemetry(spark, sf)
    obj = (F.col("seq") % 97).alias("file_object")
    opened = df.where("event_type = 'click'").select("host", obj, "ts", "path", F.lit("file").alias("type"))
    closed = df.where("event_type = 'error'").select("host", obj, "ts")
    handles = df.where("event_type = 'signup'").select("host", obj, "ts", F.concat(F.lit("handle"), F.col("k").cast("string")).alias("path"))
    events = df.select("seq", "host", "ts", (F.col("seq") * 7 % 97).alias("file_key"), obj)
    return enrich.enrich_file_path(events, opened, closed, handles).select("seq", "file_path")


@query("j6_registry_path", ev_sql(r"""
SELECT e.seq, coalesce(CASE WHEN fts IS NULL OR fts < kts THEN 'HKEY_LOCAL_MACHINE' || substr(base_key, 18) || '\Sub\v' || (e.pid % 4) END, hn, 'Sub\v' || (e.pid % 4)) AS key_path FROM (
 SELECT e.seq, e.pid, b.key_path AS base_key, b.ts AS kts, f.ts AS fts, CASE WHEN e.pid % 3 = 0 THEN 'HKLM\H' || e.pid || '\Sub\v' || (e.pid % 4) END AS hn FROM (SELECT * FROM ev WHERE event_type = 'view') e
 ASOF LEFT JOIN (SELECT host, seq % 50 AS kcb, ts, key_path FROM ev WHERE event_type = 'signup') b ON e.host = b.host AND e.seq % 50 = b.kcb AND e.ts >= b.ts
 ASOF LEFT JOIN (SELECT host, seq % 50 AS kcb, ts FROM ev WHERE event_type = 'error') f ON e.host = f.host AND e.seq % 50 = f.kcb AND e.ts > f.ts) e"""))
def j6(spark, sf):
    df = telemetry(spark, sf)
    kcb = (F.col("seq") % 50).alias("kcb")
    relative = F.concat(F.lit("Sub\\v"), (F.col("pid") % 4).cast("string"))
    base = df.where("event_type = 'signup'").select("host", kcb, "ts", F.col("params")["key_path"].alias("base_key"))
    freed = df.where("event_type = 'error'").select("host", kcb, "ts")
    events = df.where("event_type = 'view'").select("seq", "host", "pid", "ts", kcb, relative.alias("relative_key"))
    handles = df.where("pid % 3 = 0").select("host", "pid", F.concat(F.lit("HKLM\\H"), F.col("pid").cast("string"), F.lit("\\"), relative).alias("handle_name"))
    return enrich.enrich_registry_path(events, base, freed, handles).select("seq", "key_path")


SET_VALUE_SQL = """
SELECT l.seq, CASE WHEN m.seq IS NOT NULL THEN m.right_seq END AS right_seq FROM (SELECT * FROM ev WHERE event_type = 'purchase') l LEFT JOIN (
 SELECT right_seq, min_by(seq, (ts, seq)) AS seq FROM (
  SELECT l.seq, l.ts, r.seq AS right_seq, l.pid % 2 = 0 OR r.seq % 2 = l.seq % 2 AS same, epoch_us(l.ts) - epoch_us(r.ts) <= 28800000000 AS fresh
  FROM (SELECT * FROM ev WHERE event_type = 'purchase') l ASOF JOIN (SELECT * FROM ev WHERE event_type = 'signup') r ON l.host = r.host AND l.pid = r.pid AND l.ts >= r.ts
  WHERE l.seq % 2 = r.seq % 2) WHERE fresh GROUP BY right_seq) m ON l.seq = m.seq"""


@query("j7_set_value_pairing", ev_sql(SET_VALUE_SQL))
def j7(spark, sf):
    df = telemetry(spark, sf)
    parity = (F.col("seq") % 2).alias("value_name")
    left = df.where("event_type = 'purchase'").select("host", "pid", "ts", "seq", parity)
    right = df.where("event_type = 'signup'").select("host", "pid", "ts", "seq", parity, F.col("seq").alias("right_seq"))
    return asof.pair_latest(left, right, ["host", "pid"], "ts", "8h", ["right_seq"], same=["value_name"]).select("seq", "right_seq")


@query("j8_callstack_pairing", ev_sql("""
SELECT e.seq, CASE WHEN e.seq % 5 < 3 THEN 'stack' || e.seq END AS stack FROM ev e"""))
def j8(spark, sf):
    df = telemetry(spark, sf)
    late = F.expr("make_dt_interval(0, 0, 0, CAST(seq % 5 AS DECIMAL(18,6)) * 0.2)")
    walks = df.select("host", F.col("seq").alias("stack_id"), (F.col("ts") + late).alias("ts"), F.concat(F.lit("stack"), F.col("seq").cast("string")).alias("callstack"))
    events = df.select("host", "seq", "ts", "name", F.col("seq").alias("stack_id"))
    return enrich.pair_callstack(events, walks).select("seq", F.col("callstack").alias("stack"))


@query("j9_module_range", """
SELECT e.event_id AS seq, p.p_partkey AS module FROM events e LEFT JOIN part p
 ON e.event_id * 37 % 10000 >= p.p_partkey * 50 AND e.event_id * 37 % 10000 < p.p_partkey * 50 + 30""")
def j9(spark, sf):
    df = telemetry(spark, sf).select("seq", F.lit(1).alias("proc"), (F.col("seq") * 37 % 10000).alias("addr"))
    mods = table(spark, sf, "part").select(F.lit(1).alias("proc"), (F.col("p_partkey") * 50).alias("base"), F.lit(30).alias("size"), F.col("p_partkey").alias("module"))
    return asof.range_join(df, mods, ["proc"], "addr", "base", "size", ["module"], slice_width=256).select("seq", "module")


@query("j10_nearest_export", """
SELECT e.seq, coalesce(n.p_partkey, -1) AS export, coalesce(e.rva - n.at, -1) AS off FROM (SELECT event_id AS seq, event_id * 37 % 10000 AS rva, user_id % 3 AS m FROM events) e
 ASOF LEFT JOIN (SELECT p_partkey, p_partkey * 50 + 11 AS at, p_partkey % 3 AS m FROM part) n ON e.m = n.m AND e.rva >= n.at""")
def j10(spark, sf):
    df = telemetry(spark, sf).select("seq", (F.col("seq") * 37 % 10000).alias("rva"), (F.col("pid") % 3).alias("m"))
    exports = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("m"), (F.col("p_partkey") * 50 + 11).alias("at"), F.col("p_partkey").alias("export"),
                                              (F.col("p_partkey") * 50 + 11).alias("at_copy"))
    found = asof.nearest_below_join(df, exports, ["m"], "rva", "at", ["export", "at_copy"], slice_width=512)
    return found.select("seq", F.coalesce("export", F.lit(-1)).alias("export"), F.coalesce(F.col("rva") - F.col("at_copy"), F.lit(-1)).alias("off"))


@query("j10_symbolize", r"""
WITH f AS (SELECT event_id AS seq, user_id % 4 AS proc, 100 + user_id % 2 AS par, event_id * 37 % 10000 AS addr FROM events),
 m AS (SELECT p_partkey % 4 AS proc, p_partkey * 50 AS base, 30 AS size, 'm' || p_partkey AS module FROM part UNION ALL
  SELECT 100 + p_partkey % 2, p_partkey * 50, 45, 'm' || p_partkey FROM part),
 r AS (SELECT f.*, coalesce(a.module, b.module) AS module, coalesce(a.base, b.base) AS base FROM f
  LEFT JOIN m a ON f.proc = a.proc AND f.addr >= a.base AND f.addr < a.base + a.size LEFT JOIN m b ON f.par = b.proc AND f.addr >= b.base AND f.addr < b.base + b.size),
 x AS (SELECT 'm' || p_partkey AS module, 5 AS rva, 'lo' || p_size AS symbol FROM part UNION ALL SELECT 'm' || p_partkey, 20, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'hi' END FROM part)
SELECT r.seq, coalesce(r.module, 'unbacked') AS module, CASE WHEN r.module IS NULL THEN '' WHEN coalesce(x.symbol, '') = '' THEN '?' ELSE x.symbol END AS symbol,
 coalesce(r.addr - r.base - x.rva, 0) AS off FROM r ASOF LEFT JOIN x ON r.module = x.module AND r.addr - r.base >= x.rva""")
def j10b(spark, sf):
    frames = telemetry(spark, sf).select("seq", (F.col("pid") % 4).alias("proc"), (100 + F.col("pid") % 2).alias("par"), (F.col("seq") * 37 % 10000).alias("addr"))
    part = table(spark, sf, "part")
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    own = part.select((F.col("p_partkey") % 4).alias("proc"), (F.col("p_partkey") * 50).alias("base"), F.lit(30).alias("size"), name.alias("path"))
    theirs = part.select((100 + F.col("p_partkey") % 2).alias("proc"), (F.col("p_partkey") * 50).alias("base"), F.lit(45).alias("size"), name.alias("path"))
    low = part.select(name.alias("module"), F.lit(5).cast("bigint").alias("rva"), F.concat(F.lit("lo"), F.col("p_size").cast("string")).alias("symbol"))
    high = part.select(name.alias("module"), F.lit(20).cast("bigint").alias("rva"), F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("hi")).alias("symbol"))
    out = enrich.symbolize(frames, own.unionByName(theirs), low.unionByName(high), parent_key="par", slice_width=512)
    return out.select("seq", "module", "symbol", F.col("offset").alias("off"))


_PORTS = "ports AS (SELECT s_suppkey * 53 % 8081 AS port, CASE WHEN s_suppkey % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS proto, min(s_name) AS service FROM supplier GROUP BY ALL)"


@query("j11_port_names", ev_sql("""
SELECT e.seq, s.service AS sport_name, d.service AS dport_name FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS l4 FROM ev WHERE category = 'net') e
 LEFT JOIN ports s ON e.l4 = s.proto AND e.sport = s.port LEFT JOIN ports d ON e.l4 = d.proto AND e.dport = d.port""", _PORTS))
def j11(spark, sf):
    ports = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") * 53 % 8081).alias("port"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("TCP")).otherwise(
        F.lit("UDP")).alias("proto")).agg(F.min("s_name").alias("service"))
    p = F.col("params")
    df = telemetry(spark, sf).where("category = 'net'").select("seq", "name", p["sport"].cast("bigint").alias("sport"), p["dport"].cast("bigint").alias("dport"),
                                                               F.when(F.col("seq") % 3 == 0, F.lit("UDP")).otherwise(F.lit("TCP")).alias("l4_proto"))
    return enrich.enrich_ports(df, ports).select("seq", "sport_name", "dport_name")


@query("j12_ip_names", ev_sql("""
SELECT e.seq, CASE WHEN epoch_us(e.ts) - epoch_us(s.ts) <= 86400000000 THEN s.n END AS sip_names, CASE WHEN epoch_us(e.ts) - epoch_us(d.ts) <= 86400000000 THEN d.n END AS dip_names
FROM (SELECT *, '10.0.0.' || (seq % 20) AS s, '10.0.0.' || (k % 20) AS d FROM ev WHERE category = 'net') e
 ASOF LEFT JOIN (SELECT host, '10.0.0.' || (seq % 20) AS ip, ts, image AS n FROM ev WHERE event_type = 'view') s ON e.host = s.host AND e.s = s.ip AND e.ts >= s.ts
 ASOF LEFT JOIN (SELECT host, '10.0.0.' || (seq % 20) AS ip, ts, image AS n FROM ev WHERE event_type = 'view') d ON e.host = d.host AND e.d = d.ip AND e.ts >= d.ts"""))
def j12(spark, sf):
    df = telemetry(spark, sf)
    known = df.where("event_type = 'view'").select("host", F.concat(F.lit("10.0.0."), (F.col("seq") % 20).cast("string")).alias("ip"), F.col("ts").alias("valid_from"),
                                                   F.regexp_extract("path", r"([^\\]*)$", 1).alias("names"))
    asked = df.where("category = 'net'").select("seq", "host", "ts", F.concat(F.lit("10.0.0."), (F.col("seq") % 20).cast("string")).alias("sip"),
                                                F.concat(F.lit("10.0.0."), (F.col("k") % 20).cast("string")).alias("dip"))
    return enrich.enrich_names(asked, known, ttl="1d").select("seq", "sip_names", "dip_names")


@query("j13_target_process", ev_sql("""
SELECT e.seq, p.path AS exe, p.image AS name FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE name = 'CreateProcess') p
 ON e.host = p.host AND e.ppid = p.pid AND e.ts >= p.ts"""))
def j13(spark, sf):
    df = telemetry(spark, sf)
    events = df.withColumn("target_pid", F.floor(F.col("pid") / 2))
    found = enrich.enrich_target(events, enrich.process_states(df), enrich.process_ends(df))
    return found.select("seq", F.col("target.exe").alias("exe"), F.col("target.name").alias("name"))


@query("j14_members_asof", ev_sql("""
SELECT e.seq, coalesce(string_agg(DISTINCT m.member, ',' ORDER BY m.member), '') AS members FROM (SELECT * FROM ev WHERE event_type = 'purchase') e LEFT JOIN (
 SELECT host, pid, member, ts AS lo, (SELECT min(n.ts) FROM chg n WHERE n.host = o.host AND n.pid = o.pid AND n.member = o.member AND n.ts > o.ts) AS hi
 FROM chg o WHERE opens) m ON e.host = m.host AND e.pid = m.pid AND m.lo <= e.ts AND (m.hi IS NULL OR e.ts < m.hi) GROUP BY e.seq""",
    "chg AS (SELECT host, pid, ts, 'm' || (k % 4) AS member, event_type = 'click' AS opens FROM ev WHERE event_type IN ('click', 'view'))"))
def j14(spark, sf):
    df = telemetry(spark, sf).withColumn("member", F.concat(F.lit("m"), (F.col("k") % 4).cast("string")))
    opens, closes = df.where("event_type = 'click'"), df.where("event_type = 'view'")
    events = df.where("event_type = 'purchase'").select("seq", "host", "pid", "ts")
    out = enrich.members_asof(events, opens, closes, ["host", "pid"], ["member"])
    return out.select("seq", F.array_join(F.transform("members", lambda m: m["member"]), ",").alias("members"))


@query("j15_signature_trust", ev_sql("""
SELECT w.seq, own OR coalesce(s.s_suppkey % 2 = 0, false) AS trusted, own OR s.s_suppkey IS NOT NULL AS present FROM (
 SELECT *, seq % 8 = 1 AND ((seq % 3 = 0) OR (seq % 3 = 1 AND k % 2 = 0)) AS own FROM ev) w LEFT JOIN supplier s ON w.k = s.s_suppkey WHERE seq % 8 = 1"""))
def j15(spark, sf):
    p = F.col("params")
    df = wide_telemetry(spark, sf).where("name = 'LoadModule'").select("seq", "k", p["signature_type"].alias("signature_type"), p["signature_level"].alias("signature_level"))
    signatures = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(True).alias("exists"), (F.col("s_suppkey") % 2 == 0).alias("trusted"))
    return enrich.signature_trust(df, signatures, ["k"]).select("seq", F.col("signature_trusted").alias("trusted"), F.col("signature_exists").alias("present"))


@query("j16_known_bad_drivers", ev_sql("""
SELECT e.seq, coalesce(a.id, b.id, c.id) AS intel_id FROM (SELECT seq, md5('x' || k) AS h256, md5('y' || (k % 50)) AS h1, lower('M' || (seq % 50) || CASE WHEN seq % 3 = 0 THEN '.sys' ELSE '.dll' END) AS f FROM ev WHERE seq % 8 = 1) e
 LEFT JOIN (SELECT md5('x' || p_partkey) AS h, min(p_partkey) AS id FROM part WHERE p_size < 10 GROUP BY 1) a ON e.h256 = a.h
 LEFT JOIN (SELECT md5('y' || p_partkey) AS h, min(p_partkey) AS id FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY 1) b ON e.h1 = b.h
 LEFT JOIN (SELECT 'm' || p_partkey || '.sys' AS h, min(p_partkey) AS id FROM part WHERE p_size > 20 GROUP BY 1) c ON e.f = c.h"""))
def j16(spark, sf):
    text = lambda c: F.col(c).cast("string")
    df = wide_telemetry(spark, sf).where("name = 'LoadModule'").select(
        "seq", F.col("params")["file_path"].alias("path"), F.md5(F.concat(F.lit("x"), text("k"))).alias("sha256"),
        F.md5(F.concat(F.lit("y"), (F.col("k") % 50).cast("string"))).alias("sha1"))
    size = F.col("p_size")
    drivers = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(size < 10, F.upper(F.md5(F.concat(F.lit("x"), text("p_partkey"))))).alias("sha256"),
        F.when(size.between(10, 20), F.md5(F.concat(F.lit("y"), text("p_partkey")))).alias("sha1"),
        F.when(size > 20, F.concat(F.lit("M"), text("p_partkey"), F.lit(".SYS"))).alias("file_name"))
    return enrich.match_intel(df, drivers).select("seq", "intel_id")


@query("j20_file_metadata", ev_sql("""
SELECT seq, creating AND (dts IS NULL OR dts < mts) AND coalesce(mk % 2 = 0, false) AS is_dll, creating AND (dts IS NULL OR dts < mts) AND coalesce(mk % 3 = 0, false) AS is_exec FROM (
 SELECT e.seq, e.name = 'CreateFile' AND e.disposition = 'CREATE' AND e.status = 'Success' AS creating, m.k AS mk, m.ts AS mts, d.ts AS dts FROM ev e
 ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') m ON e.host = m.host AND 'f' || (e.pid % 50) = 'f' || (m.pid % 50) AND e.ts >= m.ts
 ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') d ON e.host = d.host AND 'f' || (e.pid % 50) = 'f' || (d.pid % 50) AND e.ts > d.ts)"""))
def j20(spark, sf):
    df = telemetry(spark, sf)
    file = F.concat(F.lit("F"), (F.col("pid") % 50).cast("string"))
    events = df.select("seq", "host", "ts", "name", file.alias("file_path"), F.col("params")["create_disposition"].alias("operation"), F.col("params")["status"].alias("status"))
    meta = df.where("event_type = 'view'").select("host", F.lower(file).alias("path"), F.col("ts").alias("valid_from"), (F.col("k") % 2 == 0).alias("is_dll"),
                                                  F.lit(False).alias("is_driver"), (F.col("k") % 3 == 0).alias("is_exec"))
    dropped = df.where("event_type = 'error'").select("host", file.alias("path"), "ts")
    return enrich.enrich_file_meta(events, meta, dropped).select("seq", "is_dll", "is_exec")


@query("j21_code_names", """
SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS decoded FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j21(spark, sf):
    code = F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey"))
    dim = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("text"))
    return enrich.decode_code(table(spark, sf, "customer").withColumn("code", code), "code", dim).select("c_custkey", "decoded")


@query("j22_device_path", ev_sql(r"""
SELECT seq, CASE seq % 5 WHEN 0 THEN 'C:\d\' || image WHEN 1 THEN 'D:\d\' || image WHEN 2 THEN '\Device\HarddiskVolume9\d\' || image WHEN 3 THEN 'C:\Windows\System32\' || image ELSE path END AS path FROM ev"""))
def j22(spark, sf):
    i = F.col("seq") % 5
    image = F.regexp_extract("path", r"([^\\]*)$", 1)
    raw = (F.when(i == 0, F.concat(F.lit("\\Device\\HarddiskVolume1\\d\\"), image)).when(i == 1, F.concat(F.lit("\\Device\\HarddiskVolume2\\d\\"), image))
           .when(i == 2, F.concat(F.lit("\\Device\\HarddiskVolume9\\d\\"), image)).when(i == 3, F.concat(F.lit("\\SystemRoot\\System32\\"), image)).otherwise(F.col("path")))
    devices = {"\\Device\\HarddiskVolume1": "C:", "\\Device\\HarddiskVolume2": "D:"}
    return telemetry(spark, sf).select("seq", map_device_path(raw, devices).alias("path"))


@query("u1_merge_sources", """
SELECT event_id AS id, event_type AS kind, CAST(NULL AS DOUBLE) AS price FROM events UNION ALL SELECT o_orderkey, 'order', o_totalprice FROM orders""")
def u1(spark, sf):
    events = telemetry(spark, sf).select(F.col("seq").alias("id"), F.col("event_type").alias("kind"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("price"))
    return merge_sources(events, orders)


_NETS = """nets AS (SELECT min(o_orderkey) AS name, n, p FROM (SELECT o_orderkey, 24 - o_orderkey % 17 AS p, 167772160 + o_orderkey * 104729 % 262144 AS a,
  (167772160 + o_orderkey * 104729 % 262144) // (1 << (32 - (24 - o_orderkey % 17))) AS n FROM orders) GROUP BY n, p)"""


@query("x1_cidr_table", ev_sql("""
SELECT e.seq, m.name FROM (SELECT seq, 167772160 + (pid % 4) * 65536 + seq // 250 % 250 * 256 + seq % 250 AS a FROM ev WHERE event_type = 'purchase') e LEFT JOIN (
 SELECT seq, arg_max(name, p) AS name FROM (
  SELECT x.seq, nets.name, nets.p FROM (SELECT seq, 167772160 + (pid % 4) * 65536 + seq // 250 % 250 * 256 + seq % 250 AS a FROM ev WHERE event_type = 'purchase') x
  CROSS JOIN (SELECT DISTINCT p FROM nets) l JOIN nets ON nets.p = l.p AND nets.n = x.a // (1 << (32 - l.p))) GROUP BY seq) m ON e.seq = m.seq""", _NETS))
def x1_table(spark, sf):
    """The network of each address out of a table of overlapping networks, one for each order."""
    key = F.col("o_orderkey")
    at = F.lit(167772160) + key * 104729 % 262144
    text = F.concat_ws(".", *[(F.floor(at / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])
    nets = table(spark, sf, "orders").select(F.concat(text, F.lit("/"), (24 - key % 17).cast("string")).alias("network"), key.alias("name"))
    df = telemetry(spark, sf).where("event_type = 'purchase'").select("seq", F.col("params")["dip"].alias("dip"))
    return networks.match_networks(df, "dip", nets).select("seq", F.col("network_name").alias("name"))
