"""Literal cases of predicates, scalars, paths, stacks and templates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from huntline.durations import micros
from huntline.functions import callstack as cs
from huntline.functions import paths, predicates as P, scalars as X
from huntline.functions.fields import FIELDS, field
from huntline.functions.macros import LISTS, MACROS
from huntline.functions.net import cidr_contains, ipv6_groups
from huntline.functions.template import compile_line, interpolate
from huntline.schema import EVENT


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


WILDCARDS = [
    ("report-????.txt", "report-2031.txt", True), ("report-????.txt", "report-31.txt", False), ("REPORT*", "report-2031.txt", False),
    ("/srv/*/logs/*.gz", "/srv/eu/7/logs/day.gz", True), ("/srv/*/logs/*.gz", "/srv/eu/7/log/day.gz", False), ("key\\*\\value", "key\\a\\b\\value", True),
    ("one|*|three", "one|two|two|three", True), ("(a+)[b]$", "(a+)[b]$", True), ("(a+)[b]$", "aa", False), ("é?*", "éü", True),
    ("*", "", True), ("", "", True), ("?", "", False), ("p?q", "pq", False), ("p**q", "prrq", True), ("p.q", "prq", False), ("*m*n*", "amon\nz", True),
]


@pytest.mark.parametrize("pattern, text, expected", WILDCARDS)
def test_wildcard(spark, pattern, text, expected):
    assert value(spark, P.matches(F.lit(text), pattern)) is expected


def test_scalars(spark):
    path = F.lit("C:\\Windows\\system32\\user32.dll")
    cases = [
        (X.substr(path, 3, 10), "Windows"), (X.substr(path, 3, 400), "C:\\Windows\\system32\\user32.dll"), (X.substr(path, -1), "C:\\Windows\\system32\\user32.dll"),
        (X.indexof(path, "s"), 9), (X.indexof(path, "s", "last"), 21), (X.indexof(path, "zz"), -1), (X.indexof(F.lit("éa"), "a"), 2),
        (X.replace(path, "C:", "D:", "user32", "k"), "D:\\Windows\\system32\\k.dll"), (X.base(path), "user32.dll"), (X.base(path, ext=False), "user32"),
        (X.dir_(path), "C:\\Windows\\system32"), (X.ext(path), ".dll"), (X.ext(path, dot=False), "dll"), (X.volume(path), "C:"),
        (X.volume(F.lit("\\\\host\\share\\a\\b")), "\\\\host\\share"), (X.is_abs(F.lit("C:a")), False), (X.is_abs(F.lit("C:\\a")), True),
        (X.base(F.lit("")), "."), (X.base(F.lit("C:\\")), "\\"), (X.base(F.lit("a/b/")), "b"), (X.base(F.lit("C:x.exe")), "x.exe"), (X.dir_(F.lit("a.txt")), "."),
        (X.dir_(F.lit("C:\\a")), "C:\\"), (X.count(F.lit("a bb A  c"), "A"), 2), (X.count(F.lit("a bb A"), "A", ignore_case=False), 1),
        (X.entropy(F.lit("aaaa")), 0), (X.entropy(F.lit("abab")), 4), (X.entropy(F.lit("")), 0), (X.length(F.lit("éa")), 2),
        (X.concat(F.lit("a"), 1, F.lit("b")), "a1b"), (X.ltrim(F.lit("aab"), "a"), "ab"), (X.rtrim(F.lit("abb"), "b"), "ab"),
        (X.protection_mask(F.lit(0x40)), "RWX"), (X.protection_mask(F.lit(3)), "?"), (X.regex(F.lit("abc"), "(", "b"), True),
        (X.strip_markdown(F.lit("# Title\n**bold** [x](http://y)")), "Title\nbold x"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, expected) in enumerate(cases):
        assert row[i] == expected, (i, row[i], expected)


def test_addresses(spark):
    ip = lambda t: F.lit(t)
    cases = [(cidr_contains(ip("216.58.201.174"), "216.58.201.1/24"), True), (cidr_contains(ip("216.58.201.174"), "216.58.202.1/24", "bad"), False),
             (cidr_contains(ip("2001:db8::1"), "2001:db8::/32"), True), (cidr_contains(ip("2001:db9::1"), "2001:db8::/32"), False),
             (cidr_contains(ip("::1"), "127.0.0.0/8"), False), (P.ip_eq(ip("::1"), "0:0:0:0:0:0:0:1"), True), (cidr_contains(ip("999.1.1.1"), "0.0.0.0/0"), False)]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [*row] == [e for _, e in cases]
    assert value(spark, ipv6_groups(F.lit("fe80::1:2"))) == [0xFE80, 0, 0, 0, 0, 0, 1, 2]


def test_fuzzy_and_flags(spark):
    assert value(spark, P.fuzzy(F.lit("C:\\Windows\\system32"), "CWs32")) is True
    assert value(spark, P.fuzzy(F.lit("abc"), "acb")) is False
    assert value(spark, P.fuzzynorm(F.lit("ârchêr"), "archer")) is True
    table = [("ZERO", 0), ("RW", 3), ("R", 1), ("W", 2), ("X", 4)]
    assert value(spark, P.flags(F.lit(7), table)) == ["RW", "X"]
    assert value(spark, P.flags(F.lit(0), table)) == ["ZERO"]


def test_two_valued_logic(spark):
    nothing = F.lit(None).cast("string")
    assert value(spark, P.not_(P.eq(nothing, "x"))) is True
    assert value(spark, P.or_(nothing == "x", F.lit(True))) is True
    df = spark.createDataFrame([("CreateFile", "file", {"file_path": "C:\\a.exe"})], "name string, category string, params map<string,string>")
    row = df.select((field(df, "ps.name") != "x").alias("a"), field(df, "registry.path").alias("b"), field(df, "file.extension").alias("c"), field(df, "net.dport").alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (True, "", ".exe", 0)


def test_every_field_resolves_on_the_full_schema(spark):
    df = spark.createDataFrame([], EVENT)
    for name in FIELDS:
        df.select(field(df, name).alias("v"))
    assert len(FIELDS) == 315 and len(MACROS) + len(LISTS) == 66
    for predicate in MACROS.values():
        df.where(predicate(df))


def test_registry_and_command_lines(spark):
    cases = [
        (paths.registry_key(F.lit("\\REGISTRY\\MACHINE\\SYSTEM\\Setup")), "HKEY_LOCAL_MACHINE\\SYSTEM\\Setup"),
        (paths.registry_key(F.lit("\\REGISTRY\\MACHINE")), "HKEY_LOCAL_MACHINE"),
        (paths.registry_key(F.lit("\\REGISTRY\\USER\\S-1-5-21\\Env"), "S-1-5-21"), "HKEY_CURRENT_USER\\Env"),
        (paths.registry_key(F.lit("\\REGISTRY\\USER\\S-1-5-21_Classes\\x"), "S-1-5-21"), "HKEY_CURRENT_USER\\Software\\Classes\\x"),
        (paths.registry_key(F.lit("odd")), "odd"),
        (paths.cmdline_split(F.lit('"C:\\a b\\c.exe" -k "x y"')), ['"C:\\a b\\c.exe"', "-k", '"x y"']),
        (paths.cmdline_normalize(F.lit("\\??\\C:\\x.exe a  b"), F.lit("x.exe")), "C:\\x.exe a b"),
        (paths.cmdline_normalize(F.lit("\\SystemRoot\\y.exe"), F.lit("y.exe")), "C:\\Windows\\y.exe"),
        (paths.cmdline_exe(F.lit("C:\\a.EXE b.exe")), "C:\\a.EXE"),
        (paths.map_device_path(F.lit("\\Device\\vmsmb\\VSMB-x\\os\\a"), {}), "C:\\a"),
        (paths.file_type(F.lit("\\Device\\HarddiskVolume3\\a.b")), "file"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, expected) in enumerate(cases):
        assert row[i] == expected, (i, row[i], expected)


def test_call_stacks(spark):
    kernel = 0xFFFFF80000000000
    frames = [(4096, "unbacked", "?"), (5000, "C:\\Windows\\System32\\KERNELBASE.dll", "CreateProcessW"), (6000, "C:\\Windows\\System32\\ntdll.dll", "NtCreateUserProcess"),
              (kernel + 1, "C:\\Windows\\System32\\ntoskrnl.exe", "x"), (kernel + 2, "unbacked", "?")]
    df = spark.createDataFrame([([(1, __import__("decimal").Decimal(a), 0 if i else 7, s, m, __import__("decimal").Decimal(0)) for i, (a, m, s) in enumerate(frames)],)],
                               "s array<struct<pid:bigint,addr:decimal(20,0),offset:bigint,symbol:string,module:string,module_addr:decimal(20,0)>>")
    s = F.col("s")
    row = df.select(cs.summary(s).alias("u"), cs.summary(s, "kernel").alias("k"), cs.detail(s).alias("d"), cs.final_user_frame(s)["module"].alias("f"),
                    cs.final_userspace_frame(s)["symbol"].alias("us"), cs.is_unbacked(s).alias("un"), cs.final_user_frame(F.slice(s, 1, 1)).alias("one")).first()
    assert row.u == "ntdll.dll|KERNELBASE.dll|unbacked"
    assert row.k == "unbacked|ntoskrnl.exe"
    assert row.d.startswith("0xfffff80000000002 ?!?|0xfffff80000000001 C:\\Windows\\System32\\ntoskrnl.exe!x|") and row.d.endswith("|0x1000 unbacked!?+0x7")
    assert row.f == "unbacked" and row.us == "NtCreateUserProcess" and row.un is True and row.one is None


def test_templates(spark):
    with pytest.raises(ValueError, match="not a known tag"):
        compile_line("{{ .Nope }}", lambda t: F.lit("x"))
    with pytest.raises(ValueError, match="empty tag"):
        compile_line("{{ }}", lambda t: F.lit("x"))
    with pytest.raises(ValueError, match="unbalanced"):
        compile_line("{{ .Seq }", lambda t: F.lit("x"))
    line = compile_line("a {{.Seq}}-{{ .Params.x }}!", lambda t: F.lit(t))
    assert value(spark, line) == "a .Seq-.Params.x!"
    text = interpolate("%1.ps.name %ps.pid %2.file.path %3.x %ps.none", lambda i, n, a: F.lit(None) if n == "ps.none" else F.lit(f"<{i}{n}>"), F.lit(2))
    assert value(spark, text) == "<0ps.name> <0ps.pid> <1file.path> %3.x N/A"


def test_durations():
    assert micros("1m30s") == 90_000_000 and micros("500ms") == 500_000 and micros("2d") == 172_800_000_000
    with pytest.raises(ValueError):
        micros("soon")
