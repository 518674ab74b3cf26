"""Predicates over events, pages, parts, customers, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.fields import field
from ..functions.macros import macro
from ..operators.rules import Rule, Test, derive_prefilter, scope
from ..sources.tables import spread, table, telemetry, wide_telemetry
from .registry import ev_sql, query

FLAG_NAMES = [("NONE", 0), ("READ", 1), ("WRITE", 2), ("MODIFY", 3), ("EXECUTE", 4), ("DELETE", 8)]


def each(df, key, **tests):
    return df.select(key, *[test.alias(name) for name, test in tests.items()])


@query("f1_and_or", ev_sql("SELECT seq, k > 50 AND category = 'net' AS a, k > 50 OR category = 'net' AS o, false AS with_missing FROM ev"))
def f1(spark, sf):
    df = telemetry(spark, sf)
    missing = F.col("params")["absent"] == "x"
    return each(df, "seq", a=P.and_(F.col("k") > 50, F.col("category") == "net"), o=P.or_(F.col("k") > 50, F.col("category") == "net"),
                with_missing=P.and_(missing, F.lit(True)))


@query("f2_not", ev_sql("SELECT seq, NOT (k > 50) AS n, category NOT IN ('net', 'file') AS not_in, true AS not_missing, NOT (disposition = 'OPEN' AND name = 'CreateFile') AS not_group FROM ev"))
def f2(spark, sf):
    df = telemetry(spark, sf)
    return each(df, "seq", n=P.not_(F.col("k") > 50), not_in=P.not_(P.in_(F.col("category"), ["net", "file"])),
                not_missing=P.not_(F.col("params")["absent"] == "x"), not_group=P.not_(P.eq(field(df, "file.operation"), "OPEN")))


@query("f3_numeric_comparison", ev_sql("""
SELECT seq, k = 40 AS e, k <> 40 AS n, k < 40 AS l, k <= 40 AS le, value > 40.5 AS g, value >= k AS ge, dport > -1 AND category = 'net' OR category <> 'net' AS below_zero FROM ev"""))
def f3(spark, sf):
    df = telemetry(spark, sf)
    k, v = F.col("k"), F.col("value")
    return each(df, "seq", e=P.eq(k, 40), n=P.ne(k, 40), l=P.lt(k, 40), le=P.le(k, 40), g=P.gt(v, 40.5), ge=P.ge(v, k),
                below_zero=P.gt(field(df, "net.dport"), -1))


@query("f3_unsigned_64_bit", ev_sql("SELECT seq, CAST(18446744073709551615::HUGEINT - seq > 18446744073709550000::HUGEINT AS BOOLEAN) AS high FROM ev"))
def f3b(spark, sf):
    top = F.expr("cast('18446744073709551615' as decimal(20,0))") - F.col("seq")
    return each(telemetry(spark, sf), "seq", high=P.gt(top, F.expr("cast('18446744073709550000' as decimal(20,0))")))


@query("f4_type_mismatch", ev_sql("SELECT seq, false AS eq_text, false AS ne_text, k = 7 AS eq_numeric_text, k <> 7 AS ne_numeric_text FROM ev"))
def f4(spark, sf):
    k = F.col("k")
    return each(telemetry(spark, sf), "seq", eq_text=P.num_eq(k, "abc"), ne_text=P.num_ne(k, "abc"),
                eq_numeric_text=P.num_eq(k, "7"), ne_numeric_text=P.num_ne(k, "7"))


@query("f5_flags_decode", ev_sql("""
SELECT seq, CASE WHEN seq % 16 = 0 THEN 'NONE' ELSE array_to_string(list_filter([CASE WHEN seq % 2 = 1 THEN 'READ' END, CASE WHEN (seq // 2) % 2 = 1 THEN 'WRITE' END,
 CASE WHEN (seq // 4) % 2 = 1 THEN 'EXECUTE' END, CASE WHEN (seq // 8) % 2 = 1 THEN 'DELETE' END], lambda x: x IS NOT NULL), '|') END AS names FROM ev"""))
def f5(spark, sf):
    return telemetry(spark, sf).select("seq", P.flags_text(F.col("seq") % 16, FLAG_NAMES).alias("names"))


@query("f6_ieq", "SELECT c_custkey, lower(c_mktsegment) = 'building' AS hit FROM customer")
def f6(spark, sf):
    return each(table(spark, sf, "customer"), "c_custkey", hit=P.ieq(F.col("c_mktsegment"), "Building"))


@query("f7_in_iin", """
SELECT p_partkey, p_type IN ('ECONOMY', 'SMALL') AS i, lower(p_type) IN ('economy', 'small') AS ii, list_has_any(string_split(p_name, ' '), ['red', 'bolt']) AS ia,
 list_has_any(string_split(p_name, ' '), ['ring']) AS iia, p_size IN (5, 11, 28) AS n FROM part""")
def f7(spark, sf):
    part = table(spark, sf, "part")
    words = F.split("p_name", " ")
    return each(part, "p_partkey", i=P.in_(F.col("p_type"), ["ECONOMY", "SMALL"]), ii=P.iin(F.col("p_type"), ["Economy", "small"]),
                ia=P.in_(words, ["red", "bolt"], any_of=True), iia=P.iin(words, ["RING"], any_of=True), n=P.in_(F.col("p_size"), [5, 11, 28]))


def _text_query(name, fn, ifn, sql):
    @query(name, f"""SELECT page_id, {sql('url', ['/fr/', 'ref=x'])} AS c, {sql('lower(url)', ['/fr/', 'example.com'])} AS ic,
 list_bool_or(list_transform(string_split(url, '/'), lambda w: {sql('w', ['th'])})) AS a, list_bool_or(list_transform(string_split(url, '/'), lambda w: {sql('lower(w)', ['example'])})) AS ia FROM pages""")
    def run(spark, sf):
        pages = table(spark, sf, "pages")
        url, parts = F.col("url"), F.split("url", "/")
        return each(pages, "page_id", c=fn(url, ["/fr/", "ref=x"]), ic=ifn(url, ["/FR/", "Example.com"]),
                    a=fn(parts, "th", any_of=True), ia=ifn(parts, ["EXAMPLE"], any_of=True))
    return run


_text_query("f8_contains", P.contains, P.icontains, lambda c, vs: "(" + " OR ".join(f"contains({c}, '{v}')" for v in vs) + ")")
_text_query("f9_startswith", P.startswith, P.istartswith, lambda c, vs: "(" + " OR ".join(f"starts_with({c}, '{v}')" for v in vs) + ")")
_text_query("f10_endswith", P.endswith, P.iendswith, lambda c, vs: "(" + " OR ".join(f"ends_with({c}, '{v}')" for v in vs) + ")")


@query("f11_matches", r"""
SELECT page_id, url LIKE 'http://%.example.com/%' AS m, url LIKE '%/fr/____page%' AS q, lower(url) LIKE '%ref=_' AS im, url LIKE '%page=2%' AS sub, url = 'http://a' OR url LIKE 'http:%' AS anyof,
 list_bool_or(list_transform(string_split(url, '/'), lambda w: w LIKE 'th%.com')) AS arr FROM pages""")
def f11(spark, sf):
    pages = table(spark, sf, "pages")
    url, parts = F.col("url"), F.split("url", "/")
    return each(pages, "page_id", m=P.matches(url, "http://*.example.com/*"), q=P.matches(url, "*/fr/????page*"), im=P.imatches(url, "*REF=?"),
                sub=P.matches(url, "*page=2*"), anyof=P.matches(url, ["http://a", "http:*"]), arr=P.matches(parts, "th*.com", any_of=True))


@query("f12_fuzzy", """
SELECT page_id, url LIKE '%t%e%x%m%e%' AS f, lower(url) LIKE '%p%g%2%' AS i, list_bool_or(list_transform(string_split(url, '/'), lambda w: w LIKE '%x%c%m%')) AS a FROM pages""")
def f12(spark, sf):
    pages = table(spark, sf, "pages")
    url = F.col("url")
    return each(pages, "page_id", f=P.fuzzy(url, "texme"), i=P.ifuzzy(url, "PG2"), a=P.fuzzy(F.split("url", "/"), "xcm", any_of=True))


@query("f13_fuzzynorm", """
SELECT doc_id, strip_accents(text) LIKE '%e%u%x%l%e%' AS f, lower(strip_accents(text)) LIKE '%f%u%r%s%c%h%' AS i FROM documents""")
def f13(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return each(docs, "doc_id", f=P.fuzzynorm(F.col("text"), "éuxle"), i=P.ifuzzynorm(F.col("text"), "FÜRSCH"))


@query("f14_intersects", """
SELECT p_partkey, list_has_all(string_split(p_name, ' '), ['red', 'widget']) AS both_words, list_has_all(string_split(lower(p_name), ' '), ['ring']) AS folded FROM part""")
def f14(spark, sf):
    words = F.split("p_name", " ")
    return each(table(spark, sf, "part"), "p_partkey", both_words=P.intersects(words, ["red", "widget", "red"]), folded=P.iintersects(words, ["RING"]))


@query("f15_any_number", """
SELECT conv_id, bool_or(length(text) > 200) AS gt, bool_or(length(text) >= 37) AS ge FROM conversations GROUP BY conv_id""")
def f15(spark, sf):
    # Turns per conversation are gathered as lengths only.
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.char_length("text")).alias("sizes"))
    return each(turns, "conv_id", gt=P.any_gt(F.col("sizes"), 200), ge=P.any_ge(F.col("sizes"), 37))


@query("f16_ip_equality", ev_sql("""
SELECT seq, category = 'net' AND dip = '10.1.0.5' AS e, category <> 'net' OR dip <> '10.1.0.5' AS n, category = 'net' AND dip IN ('10.1.0.5', '10.2.0.6') AS i,
 seq % 3 = 0 AS v6 FROM ev"""))
def f16(spark, sf):
    df = telemetry(spark, sf)
    dip = field(df, "net.dip")
    v6 = F.when(F.col("seq") % 3 == 0, F.lit("2001:DB8::1")).otherwise(F.lit("2001:db8::2"))
    return each(df, "seq", e=P.ip_eq(dip, "10.1.0.5"), n=P.not_(P.ip_eq(dip, "10.1.0.5")), i=P.ip_in(dip, ["10.1.0.5", "10.2.0.6"]),
                v6=P.ip_eq(v6, "2001:0db8:0:0:0:0:0:1"))


@query("f17_boolean_field", ev_sql("SELECT seq FROM ev WHERE seq % 8 = 1 AND seq % 3 = 0"))
def f17(spark, sf):
    df = wide_telemetry(spark, sf)
    return df.where(field(df, "module.is_driver")).select("seq")


SCOPED = Rule("r1", "scoped", lambda d: F.lit(True), names=("CreateFile", "Connect"), categories=("registry",))
UNSCOPED = Rule("r2", "unscoped", lambda d: F.lit(True))


@query("f18_event_scope", ev_sql("SELECT seq, name IN ('CreateFile', 'Connect') OR category = 'registry' AS scoped, false AS unscoped FROM ev"))
def f18(spark, sf):
    return each(telemetry(spark, sf), "seq", scoped=scope(SCOPED), unscoped=scope(UNSCOPED))


PREFILTER_RULES = [
    Rule("a", "open secrets", lambda d: F.lit(True), names=("CreateFile",), tests=(Test("file.path", "imatches", ("?:\\users\\u1*\\*_3.exe",)),
                                                                               Test("file.name", "iin", ("CLICK_5.EXE",)))),
    Rule("b", "open process", lambda d: F.lit(True), names=("OpenProcess",), tests=(Test("evt.arg[exe]", "icontains", ("_2",)),)),
    Rule("c", "other", lambda d: F.lit(True), names=("ReadFile",), tests=(Test("file.path", "=", ("never",)),)),
]


@query("f19_derived_prefilter", ev_sql(r"""
SELECT seq FROM ev WHERE CASE WHEN name = 'CreateFile' AND disposition = 'OPEN' THEN regexp_matches(lower(path), '^.:\\users\\u1.*\\.*_3\.exe$') OR lower(image) = 'click_5.exe' ELSE true END"""))
def f19(spark, sf):
    df = telemetry(spark, sf)
    return df.where(derive_prefilter(df, PREFILTER_RULES)).select("seq")


@query("f19_derived_prefilter_processes", ev_sql("SELECT seq FROM ev WHERE CASE WHEN seq % 8 IN (6, 7) THEN contains(path, '_2') ELSE true END"))
def f19b(spark, sf):
    df = wide_telemetry(spark, sf)
    return df.where(derive_prefilter(df, PREFILTER_RULES)).select("seq")


@query("f20_exclusion_list", ev_sql("SELECT seq FROM ev WHERE NOT (lower(path) LIKE '%_3.exe' OR lower(path) LIKE '_:%u12%')"))
def f20(spark, sf):
    df = telemetry(spark, sf)
    return df.where(P.not_(P.excluded(F.col("path"), ["*_3.EXE", "?:*U12*"]))).select("seq")


@query("f_macros", ev_sql("""
SELECT seq, name = 'CreateProcess' AS spawn_process, name = 'CreateFile' AND disposition = 'OPEN' AND status = 'Success' AS open_file,
 name = 'CreateFile' AND disposition <> 'OPEN' AND status = 'Success' AS create_file, name = 'RegSetValue' AND status = 'Success' AS modify_registry,
 evasions % 2 = 1 AS direct_syscall, false AS outbound_network, false AS inbound_network FROM ev"""))
def macros(spark, sf):
    df = telemetry(spark, sf)
    return each(df, "seq", **{n: macro(df, n) for n in ("spawn_process", "open_file", "create_file", "modify_registry", "direct_syscall",
                                                        "outbound_network", "inbound_network")})


@query("f_macros_wide", ev_sql("""
SELECT seq, seq % 8 = 1 AND seq % 3 = 0 AS load_driver, seq % 8 = 1 AND seq % 3 <> 0 AS load_dll, seq % 8 = 1 AND k % 4 = 0 AS load_unsigned_module,
 seq % 8 = 1 AND (k % 4 = 0 OR k % 5 = 0) AS load_unsigned_or_untrusted_module, seq % 8 = 0 AND pid <> 4 AND pid <> pid % 3 AS create_remote_thread,
 seq % 8 = 6 AND k % 4 <> 0 AS open_process, seq % 8 = 7 AND k % 4 <> 0 AND pid <> 4 AND pid <> pid % 7 AS open_remote_thread FROM ev"""))
def macros_wide(spark, sf):
    df = wide_telemetry(spark, sf)
    return each(df, "seq", **{n: macro(df, n) for n in ("load_driver", "load_dll", "load_unsigned_module", "load_unsigned_or_untrusted_module",
                                                        "create_remote_thread", "open_process", "open_remote_thread")})
