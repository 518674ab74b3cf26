"""Content signature scan: which events trigger it and pattern tables over contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import callstack as cs
from ..functions.fields import field
from ..functions.logic import and_, or_, true_or_false
from ..functions.paths import ext
from ..functions.predicates import excluded, matches
from .alerts import severity_from_score

# Page and view protections that make a region worth scanning.
RWX_PAGE, RX_VIEW, RWX_VIEW, MIN_VIEW = 0x40, 0x30000, 0x60000, 4096


def scan_candidates(df: DataFrame, skip_processes: list[str] = (), skip_files: list[str] = ()) -> DataFrame:
    """Events that trigger a scan, with ``trigger`` and ``target`` (a path, a pid or the event's own data)."""
    p = F.col("params")
    number = lambda key: F.expr(f"coalesce(try_cast(params['{key}'] as bigint), 0)")
    path = F.coalesce(p["file_path"], F.lit(""))
    skip_file = excluded(path, skip_files) if skip_files else F.lit(False)
    skip_ps = excluded(field(df, "ps.exe"), skip_processes) if skip_processes else F.lit(False)
    name = F.col("name")
    suffix = F.lower(ext(path))
    image = or_(suffix.isin(".dll", ".sys", ".exe"), p["is_dll"] == "true", p["is_driver"] == "true", p["is_exec"] == "true")
    stream = F.length(path) - F.length(F.substring_index(path, ":", -1)) > 3
    dropped = and_(name == "CreateFile", p["create_disposition"] != "OPEN", ~skip_file, ~skip_ps)
    untrusted = or_(p["signature_exists"] == "false", p["signature_trusted"] == "false")
    unbacked = cs.is_unbacked(F.col("callstack")) if "callstack" in df.columns else F.lit(False)
    protect = number("protection")
    view = and_(protect.bitwiseAND(RX_VIEW) != 0, protect.bitwiseAND(RWX_VIEW) != 0)
    trigger = (F.when(name == "CreateProcess", F.lit("process"))
               .when(and_(name == "LoadModule", ~skip_file, or_(untrusted, unbacked)), F.lit("module"))
               .when(and_(dropped, image), F.lit("file"))
               .when(and_(dropped, stream), F.lit("stream"))
               .when(and_(name == "VirtualAlloc", F.col("pid") != 4, protect == RWX_PAGE), F.lit("alloc"))
               .when(and_(name == "MapViewFile", F.col("pid") != 4, number("view_size") >= MIN_VIEW, view, ~skip_file), F.lit("mmap"))
               .when(and_(name == "RegSetValue", p["value_type"] == "REG_BINARY", F.length(F.coalesce(p["data"], F.lit(""))) > 0,
                          ~skip_ps), F.lit("registry")))
    target = (F.when(F.col("trigger").isin("file", "stream"), path)
              .when((F.col("trigger") == "mmap") & (path != ""), path)
              .when(F.col("trigger") == "registry", p["data"])
              .otherwise(F.coalesce(p["pid"], F.col("pid").cast("string"))))
    return df.withColumn("trigger", trigger).where("trigger is not null").withColumn("target", target)


def once_per_process(hits: DataFrame) -> DataFrame:
    """Allocation and mapping hits count once per host, process and trigger; the others all count."""
    limited = F.col("trigger").isin("alloc", "mmap")
    first = (hits.where(limited).groupBy("host", "pid", "trigger").agg(F.min("seq").alias("seq"))
             .withColumn("_first", F.lit(True)))
    return hits.join(first, ["host", "pid", "trigger", "seq"], "left").where(~limited | F.col("_first")).drop("_first")


def scan_content(files: DataFrame, signatures: list[dict], content: str = "content", keep: list[str] = ("path",)) -> DataFrame:
    """One row per (content, signature) hit with severity.

    A signature is ``{name, kind: text|hex|regex, patterns, require: any|all, score}``.
    The whole content is searched inside Spark expressions, one pass, no shuffle.
    Texts and byte patterns without gaps are looked for in the bytes as they
    are; ``??`` (any byte) makes an expression over one character for each byte.
    """
    def found(sig: dict) -> Column:
        body = F.col(content).cast("binary")
        if sig["kind"] == "hex":
            tests = [_bytes_found(body, pat) for pat in sig["patterns"]]
        elif sig["kind"] == "regex":
            tests = [body.cast("string").rlike(pat) for pat in sig["patterns"]]
        else:
            tests = [F.contains(body, F.lit(pat.encode())) for pat in sig["patterns"]]
        return and_(*tests) if sig.get("require", "any") == "all" else or_(*tests)

    hits = F.filter(F.array(*[F.when(true_or_false(found(s)), F.struct(
        F.lit(s["name"]).alias("signature"), F.lit(s.get("score")).cast("int").alias("score"))) for s in signatures]),
        lambda h: h.isNotNull())
    return (files.select(*keep, F.explode(hits).alias("h"))
            .select(*keep, "h.signature", severity_from_score(F.col("h.score")).alias("severity")))


def _bytes_found(body: Column, pattern: str) -> Column:
    """Whether the bytes of a pattern like ``4d 5a ?? 00`` occur."""
    digits = pattern.replace(" ", "")
    if len(digits) % 2 or not digits:
        raise ValueError(f"a byte pattern has two digits for each byte: {pattern!r}")
    pairs = [digits[i:i + 2] for i in range(0, len(digits), 2)]
    if "??" not in pairs:
        return F.contains(body, F.lit(bytes.fromhex(digits)))
    # Single-byte characters: what is matched is bytes, each place is tried once, nothing is doubled.
    one = lambda pair: "." if pair == "??" else f"\\x{int(pair, 16):02x}"
    return F.decode(body, "ISO-8859-1").rlike("(?s)" + "".join(map(one, pairs)))


def glob(listing: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Paths of a file listing that a wildcard pattern (``*``, ``?``) matches, each once."""
    return listing.where(matches(F.col(path), pattern)).select(path).distinct()
