"""Scalar functions over whole texts, urls, names and derived paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, scalars as X
from ..functions.predicates import and_
from ..operators.alerts import alert_text
from ..sources.tables import spread, table, telemetry, wide_telemetry, with_stack
from .registry import ev_sql, query, st_sql


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


_IPNUM = "(CAST(string_split(dip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(dip, '.')[2] AS BIGINT) * 65536 + CAST(string_split(dip, '.')[3] AS BIGINT) * 256 + CAST(string_split(dip, '.')[4] AS BIGINT))"


@query("x1_cidr_contains", ev_sql(f"""
SELECT seq, {_IPNUM} BETWEEN 167837696 AND 167903231 AS one, {_IPNUM} BETWEEN 167772160 AND 167772175 OR {_IPNUM} BETWEEN 167903232 AND 167903743 AS many,
 false AS bad, seq % 2 = 0 AS v6 FROM ev WHERE category = 'net'"""))
def x1(spark, sf):
    dip = F.col("params")["dip"]
    v6 = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("seq") % 65536)))).otherwise(F.lit("2001:db9::1"))
    return telemetry(spark, sf).where("category = 'net'").select(
        "seq", X.cidr_contains(dip, "10.1.0.0/16").alias("one"), X.cidr_contains(dip, "10.0.0.0/28", "10.2.0.0/23", "nonsense").alias("many"),
        X.cidr_contains(dip, "300.1.1.0/8").alias("bad"), X.cidr_contains(v6, "2001:db8::/32").alias("v6"))


@query("x2_md5", "SELECT doc_id, md5(text) AS h FROM documents")
def x2(spark, sf):
    return docs(spark, sf).select("doc_id", X.md5("text").alias("h"))


@query("x3_concat", "SELECT p_partkey, p_name || '-' || p_brand || '-' || p_size AS c FROM part")
def x3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.concat(F.col("p_name"), "-", F.col("p_brand"), "-", F.col("p_size")).alias("c"))


@query("x4_ltrim", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS t FROM pages")
def x4(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.ltrim(F.col("url"), "http://").alias("t"))


@query("x5_rtrim", "SELECT page_id, CASE WHEN ends_with(url, '&ref=x') THEN substr(url, 1, length(url) - 6) ELSE url END AS t FROM pages")
def x5(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.rtrim(F.col("url"), "&ref=x").alias("t"))


@query("x6_lower_x7_upper", "SELECT c_custkey, lower(c_name) AS l, upper(c_name) AS u, lower(c_mktsegment) AS s FROM customer")
def x6(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.lower("c_name").alias("l"), X.upper("c_name").alias("u"), X.lower("c_mktsegment").alias("s"))


@query("x8_replace", "SELECT doc_id, md5(replace(replace(text, 'e', '3'), '3a', '$1.')) AS r FROM documents")
def x8(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.replace(F.col("text"), "e", "3", "3a", "$1.")).alias("r"))


@query("x9_split", "SELECT page_id, len(string_split(url, '.')) AS n, string_split(url, '?')[2] AS q, array_to_string(string_split(url, '/'), '|') AS j FROM pages")
def x9(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.size(X.split(url, ".")).cast("bigint").alias("n"), F.get(X.split(url, "?"), F.lit(1)).alias("q"),
                                            F.array_join(X.split(url, "/"), "|").alias("j"))


@query("x10_length", "SELECT doc_id, length(text) AS n, CAST(len(string_split(text, ' ')) AS BIGINT) AS words FROM documents")
def x10(spark, sf):
    return docs(spark, sf).select("doc_id", X.length(F.col("text")).cast("bigint").alias("n"),
                                  X.length(X.split(F.col("text"), " "), array=True).cast("bigint").alias("words"))


def _byte_index(pos):
    return f"CASE WHEN {pos} > 0 THEN strlen(left(text, ({pos}) - 1)) ELSE -1 END"


_LAST = "CASE WHEN instr(reverse(text), 'el') > 0 THEN length(text) - instr(reverse(text), 'el') - 2 + 2 ELSE 0 END"
_ANY = "coalesce(least(nullif(instr(text, 'q'), 0), nullif(instr(text, 'z'), 0)), 0)"
_LASTANY = "greatest(CASE WHEN instr(reverse(text), 'q') > 0 THEN length(text) - instr(reverse(text), 'q') + 1 ELSE 0 END, CASE WHEN instr(reverse(text), 'z') > 0 THEN length(text) - instr(reverse(text), 'z') + 1 ELSE 0 END)"


@query("x11_indexof", f"""SELECT doc_id, {_byte_index("instr(text, 'le')")} AS first, {_byte_index(_LAST)} AS last, {_byte_index(_ANY)} AS anyof, {_byte_index(_LASTANY)} AS lastany FROM documents""")
def x11(spark, sf):
    text = F.col("text")
    return docs(spark, sf).select("doc_id", *[X.indexof(text, sub, order).cast("bigint").alias(name) for name, sub, order in (
        ("first", "le", "first"), ("last", "le", "last"), ("anyof", "qz", "any"), ("lastany", "qz", "lastany"))])


@query("x12_substr", """
SELECT page_id, CASE WHEN strlen(url) > 3 THEN substr(url, 4) ELSE url END AS tail, CASE WHEN 20 < strlen(url) THEN substr(url, 8, 13) ELSE url END AS mid,
 CASE WHEN 45 < strlen(url) THEN substr(url, 1, 45) ELSE url END AS long_or_whole, url AS whole FROM pages""")
def x12(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.substr(url, 3).alias("tail"), X.substr(url, 7, 20).alias("mid"),
                                            X.substr(url, 0, 45).alias("long_or_whole"), X.substr(url, 9, 4).alias("whole"))


@query("x13_entropy", """
WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch),
 s AS (SELECT doc_id, sum((n / strlen(text)::DOUBLE) * log2(n / strlen(text)::DOUBLE)) AS e FROM c JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(ceil(-round(e, 12)), 0) AS BIGINT) * strlen(text) AS entropy FROM documents d LEFT JOIN s USING (doc_id)""")
def x13(spark, sf):
    return docs(spark, sf).select("doc_id", X.entropy(F.col("text")).alias("entropy"))


@query("x14_regex", r"SELECT doc_id, regexp_matches(text, '[0-9]{3}-[0-9]{4}') OR regexp_matches(text, '(?i)copyright') AS hit, regexp_matches(text, '\w+@\w+\.\w+') AS mail FROM documents")
def x14(spark, sf):
    text = F.col("text")
    return docs(spark, sf).select("doc_id", X.regex(text, "[0-9]{3}-[0-9]{4}", "(?i)copyright", "(unclosed").alias("hit"),
                                  X.regex(text, r"\w+@\w+\.\w+").alias("mail"))


@query("x15_base", ev_sql(r"""
SELECT seq, regexp_extract(path, '([^\\]*)$', 1) AS b, regexp_extract(regexp_extract(path, '([^\\]*)$', 1), '^(.+)\.', 1) AS stem FROM ev"""))
def x15(spark, sf):
    return telemetry(spark, sf).select("seq", X.base(F.col("path")).alias("b"), X.base(F.col("path"), ext=False).alias("stem"))


@query("x15_base_array", st_sql("SELECT seq, array_to_string(list_transform(s, lambda f: f.name), ',') AS names FROM st"))
def x15b(spark, sf):
    df = with_stack(telemetry(spark, sf))
    return df.select("seq", F.array_join(X.base(F.transform("callstack", lambda f: f["module"]), array=True), ",").alias("names"))


@query("x16_dir", ev_sql(r"SELECT seq, 'C:\Users\u' || pid AS d, CASE WHEN category = 'registry' THEN regexp_extract(key_path, '^(.*)\\[^\\]*$', 1) END AS kd FROM ev"))
def x16(spark, sf):
    return telemetry(spark, sf).select("seq", X.dir_(F.col("path")).alias("d"), X.dir_(F.col("params")["key_path"]).alias("kd"))


@query("x17_ext", ev_sql("SELECT seq, '.exe' AS e, 'exe' AS nodot, '' AS none FROM ev"))
def x17(spark, sf):
    p = F.col("path")
    return telemetry(spark, sf).select("seq", X.ext(p).alias("e"), X.ext(p, dot=False).alias("nodot"), X.ext(X.rtrim(p, ".exe")).alias("none"))


@query("x18_is_abs", ev_sql(r"SELECT seq, seq % 3 <> 2 AS a FROM ev"))
def x18(spark, sf):
    p = (F.when(F.col("seq") % 3 == 0, F.col("path")).when(F.col("seq") % 3 == 1, F.concat(F.lit("\\\\srv\\share\\"), F.col("host")))
         .otherwise(F.concat(F.lit("dir\\"), F.col("host"))))
    return telemetry(spark, sf).select("seq", X.is_abs(p).alias("a"))


@query("x19_volume", ev_sql(r"SELECT seq, CASE seq % 3 WHEN 0 THEN 'C:' WHEN 1 THEN '\\srv\share' ELSE '' END AS v FROM ev"))
def x19(spark, sf):
    p = (F.when(F.col("seq") % 3 == 0, F.col("path")).when(F.col("seq") % 3 == 1, F.concat(F.lit("\\\\srv\\share\\"), F.col("host")))
         .otherwise(F.concat(F.lit("dir\\"), F.col("host"))))
    return telemetry(spark, sf).select("seq", X.volume(p).alias("v"))


@query("x20_count", r"""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '' AND lower(w) LIKE 'le%')) AS BIGINT) AS ci,
 CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w LIKE '_e')) AS BIGINT) AS cs FROM documents""")
def x20(spark, sf):
    text = F.col("text")
    return docs(spark, sf).select("doc_id", X.count(text, "LE*").cast("bigint").alias("ci"), X.count(text, "?e", ignore_case=False).cast("bigint").alias("cs"))


@query("x20_count_array", "SELECT p_partkey, CAST(len(list_filter(string_split(p_name, ' '), lambda w: lower(w) LIKE '%r%')) AS BIGINT) AS n FROM part")
def x20b(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.count(F.split("p_name", " "), "*R*", array=True).cast("bigint").alias("n"))


@query("x21_foreach", st_sql("""
SELECT seq, len(list_filter(s, lambda f: f.off > 40 AND NOT f.kernel)) > 0 AS deep, len(list_filter(s, lambda f: contains(f.module, 'u' || pid || '\\'))) > 0 AS own FROM st""".replace("\\\\", "\\")))
def x21(spark, sf):
    df = with_stack(telemetry(spark, sf))
    from ..functions.callstack import in_system_range
    from ..functions.fields import collection
    mine = F.concat(F.lit("u"), F.col("pid").cast("string"), F.lit("\\"))
    frames = collection("thread._callstack")
    return df.select("seq", X.foreach(frames, lambda f: and_(f["offset"] > 40, ~in_system_range(f["addr"]))).alias("deep"),
                     X.foreach(frames, lambda f: f["module"].contains(mine)).alias("own"))


@query("x26_cmdline_split", ev_sql(r"""SELECT seq, '"' || path || '"' AS a0, '-k' AS a1, CAST(k AS VARCHAR) AS a2, CAST(3 AS BIGINT) AS n FROM ev WHERE name = 'CreateProcess'"""))
def x26(spark, sf):
    args = X.cmdline_split(F.col("params")["cmdline"])
    return telemetry(spark, sf).where("name = 'CreateProcess'").select("seq", *[F.get(args, F.lit(i)).alias(f"a{i}") for i in range(3)],
                                                                       F.size(args).cast("bigint").alias("n"))


@query("x27_cmdline_normalize", ev_sql(r"""
SELECT seq, CASE seq % 4 WHEN 0 THEN path || ' -k ' || k WHEN 1 THEN path || ' /a' WHEN 2 THEN 'C:\Windows\System32\svchost.exe -k ' || k ELSE 'C:\Windows\notepad.exe ' || k END AS c,
 CASE seq % 4 WHEN 0 THEN path WHEN 1 THEN path WHEN 2 THEN 'C:\Windows\System32\svchost.exe' ELSE 'C:\Windows\notepad.exe' END AS e FROM ev"""))
def x27(spark, sf):
    i, k = F.col("seq") % 4, F.col("k").cast("string")
    line = (F.when(i == 0, F.concat(F.lit('"'), F.col("path"), F.lit('" -k '), k))
            .when(i == 1, F.concat(F.lit("\\??\\"), F.col("path"), F.lit(" /a")))
            .when(i == 2, F.concat(F.lit("svchost.exe -k "), k)).otherwise(F.concat(F.lit("%SystemRoot%\\notepad.exe "), k)))
    name = F.when(i == 2, F.lit("svchost.exe")).otherwise(F.lit("x.exe"))
    c = X.cmdline_normalize(line, name)
    return telemetry(spark, sf).select("seq", c.alias("c"), X.cmdline_exe(c).alias("e"))


@query("x28_registry_key", ev_sql(r"""
SELECT seq, CASE seq % 3 WHEN 0 THEN 'HKEY_LOCAL_MACHINE' || substr(key_path, 18) WHEN 1 THEN CASE WHEN pid = 7 THEN 'HKEY_CURRENT_USER\Env' ELSE 'HKEY_USERS\S-1-5-' || pid || '\Env' END
 ELSE CASE WHEN pid = 7 THEN 'HKEY_CURRENT_USER\Software\Classes\x' ELSE 'HKEY_USERS\S-1-5-' || pid || '_Classes\x' END END AS key FROM ev"""))
def x28(spark, sf):
    i = F.col("seq") % 3
    user = F.concat(F.lit("\\REGISTRY\\USER\\S-1-5-"), F.col("pid").cast("string"))
    app = F.concat(F.lit("\\REGISTRY\\MACHINE\\Software\\App"), (F.col("seq") % 6).cast("string"), F.lit("\\Run\\v"), (F.col("pid") % 4).cast("string"))
    raw = F.when(i == 0, app).when(i == 1, F.concat(user, F.lit("\\Env"))).otherwise(F.concat(user, F.lit("_Classes\\x")))
    return telemetry(spark, sf).select("seq", X.registry_key(raw, "S-1-5-7").alias("key"))


@query("x29_file_type", ev_sql("SELECT seq, CASE seq % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'directory' WHEN 2 THEN 'file' WHEN 3 THEN 'device' ELSE 'other' END AS t FROM ev"))
def x29(spark, sf):
    i = F.col("seq") % 5
    p = (F.when(i == 0, F.col("path")).when(i == 1, F.lit("C:\\Windows")).when(i == 2, F.lit("\\Device\\HarddiskVolume3\\a.txt"))
         .when(i == 3, F.lit("\\Device\\Afd\\e.p")).otherwise(F.lit("")))
    return telemetry(spark, sf).select("seq", X.file_type(p).alias("t"))


RULE_TEXT = "%evt.name by pid %evt.pid of %1.evt.host saw %evt.arg[k] and %evt.arg[absent], then %2.evt.name"


@query("x30_interpolation", ev_sql("""
SELECT seq, name || ' by pid ' || pid || ' of ' || host || ' saw ' || k || ' and N/A, then %2.evt.name' AS text FROM ev"""))
def x30(spark, sf):
    one = F.array(F.struct("name", "pid", "host", "params"))
    return telemetry(spark, sf).select("seq", alert_text(RULE_TEXT, one).alias("text"))


@query("x31_markdown_strip", ev_sql("SELECT seq, name || ' of ' || host || ' and link' AS text FROM ev"))
def x31(spark, sf):
    md = F.concat(F.lit("**"), F.col("name"), F.lit("** of `"), F.col("host"), F.lit("` and [link](http://x/"), F.col("k").cast("string"), F.lit(")"))
    return telemetry(spark, sf).select("seq", X.strip_markdown(md).alias("text"))


@query("x32_protection_mask", ev_sql("""
SELECT seq, CASE seq % 5 WHEN 0 THEN 'RW' WHEN 1 THEN 'RX' WHEN 2 THEN 'RWX' WHEN 3 THEN '-' ELSE '?' END AS page,
 CASE seq % 3 WHEN 0 THEN 'RX' WHEN 1 THEN 'RWX' ELSE 'RW' END AS view FROM ev"""))
def x32(spark, sf):
    code = F.get(F.array(*[F.lit(v) for v in (0x04, 0x20, 0x40, 0, 77)]), (F.col("seq") % 5).cast("int"))
    view = F.get(F.array(*[F.lit(v) for v in (0x30000, 0x60000, 0x40000)]), (F.col("seq") % 3).cast("int"))
    return telemetry(spark, sf).select("seq", X.protection_mask(code).alias("page"), X.view_protection(view).alias("view"))


DEVICES = {"\\Device\\HarddiskVolume1": "C:", "\\Device\\HarddiskVolume2": "D:"}


@query("x33_handle_name", ev_sql(r"""
SELECT seq, CASE WHEN k % 2 = 0 THEN 'HKEY_USERS\S-1-5-' || pid || '\Env' ELSE CASE seq % 3 WHEN 1 THEN 'C:' WHEN 2 THEN 'D:' ELSE '\Device\HarddiskVolume0' END || '\d\f' || k END AS name
FROM ev WHERE seq % 8 = 2"""))
def x33(spark, sf):
    p = F.col("params")
    return wide_telemetry(spark, sf).where("name = 'CreateHandle'").select("seq", paths.handle_name(p["type_id"], p["handle_name"], DEVICES).alias("name"))


@query("x23_is_minidump", "SELECT doc_id, doc_id % 3 = 0 AS dump FROM documents")
def x23(spark, sf):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("MDMP"), F.col("text"))).otherwise(F.concat(F.lit("~"), F.col("text")))
    return docs(spark, sf).select("doc_id", X.is_minidump(F.encode(body, "UTF-8")).alias("dump"))


@query("x24_glob", ev_sql("SELECT DISTINCT path FROM ev WHERE path LIKE 'C:%click\\__.exe' ESCAPE '\\'".replace("\\\\", "\\")))
def x24(spark, sf):
    from ..operators.scanning import glob
    return glob(telemetry(spark, sf), "C:*click_?.exe")


@query("x22_get_reg_value", ev_sql("""
SELECT e.seq, coalesce(r.data, '') AS data FROM ev e ASOF LEFT JOIN (SELECT host, key_path, ts, 'd' || k AS data FROM ev WHERE category = 'registry') r
 ON e.host = r.host AND e.key_path = r.key_path AND e.ts >= r.ts"""))
def x22(spark, sf):
    from ..operators.enrich import registry_value
    df = telemetry(spark, sf)
    asked = df.select("host", "seq", "ts", F.concat(F.lit("\\REGISTRY\\MACHINE\\Software\\App"), (F.col("seq") % 6).cast("string"), F.lit("\\Run\\v"),
                                                    (F.col("pid") % 4).cast("string")).alias("key_path"))
    written = df.where("name = 'RegSetValue'").select("host", "ts", "seq", F.col("params")["key_path"].alias("key_path"), F.col("params")["data"].alias("data"))
    return registry_value(asked, written).select("seq", "data")
