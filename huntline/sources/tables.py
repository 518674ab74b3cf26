"""Adapter from the generic event table to the canonical event schema.

The table has event_id, ts, user_id, event_type, value and props. Names,
categories, paths and addresses are fixed expressions of those columns, so any
engine can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each event type of the table stands for.
EVENT_TYPES = {"click": ("CreateFile", "file"), "view": ("ReadFile", "file"), "error": ("CreateProcess", "process"),
               "signup": ("RegSetValue", "registry"), "purchase": ("Connect", "net")}
DPORTS = [80, 443, 53, 22, 8080]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows with long texts over all cores when the file has fewer splits than that; a no-op on large inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _choose(values: dict[str, str]) -> Column:
    out = None
    for kind, value in values.items():
        out = F.when(F.col("event_type") == kind, F.lit(value)) if out is None else out.when(F.col("event_type") == kind, F.lit(value))
    return out


def derive(events: DataFrame) -> DataFrame:
    """Canonical columns next to the raw ones; nothing is computed unless it is used."""
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    path = F.concat(F.lit("C:\\Users\\u"), text(u), F.lit("\\"), F.col("event_type"), F.lit("_"), text(i % 7), F.lit(".exe"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    is_file, is_ps, is_reg, is_net = kind.isin("click", "view"), kind == "error", kind == "signup", kind == "purchase"
    dport = F.get(F.array(*[F.lit(p) for p in DPORTS]), (i % 5).cast("int"))
    status = F.when(i % 11 == 0, F.lit("Access denied")).otherwise(F.lit("Success"))
    name = F.concat(kind, F.lit("_"), text(i % 7), F.lit(".exe"))
    params = {
        "k": text(k), "pid": text(u), "status": status,
        "file_path": F.when(is_file, path), "file_object": F.when(is_file, text(i % 97)),
        "create_disposition": F.when(kind == "click", F.when(i % 2 == 0, F.lit("OPEN")).otherwise(F.lit("CREATE"))),
        "io_size": F.when(kind == "view", text(k)),
        "exe": F.when(is_ps, path), "name": F.when(is_ps, name),
        "cmdline": F.when(is_ps, F.concat(F.lit('"'), path, F.lit('" -k '), text(k))),
        "ppid": F.when(is_ps, text(F.floor(u / 2))),
        "real_ppid": F.when(is_ps, text(F.when(i % 5 == 0, F.floor(u / 3)).otherwise(F.floor(u / 2)))),
        "username": F.when(is_ps, F.concat(F.lit("user"), text(u % 9))),
        "key_path": F.when(is_reg, F.concat(F.lit("\\REGISTRY\\MACHINE\\Software\\App"), text(i % 6), F.lit("\\Run\\v"), text(u % 4))),
        "value_type": F.when(is_reg, F.when(i % 3 == 0, F.lit("REG_BINARY")).otherwise(F.lit("REG_SZ"))),
        "data": F.when(is_reg, F.concat(F.lit("d"), text(k))),
        "sip": F.when(is_net, F.concat(F.lit("10."), text(u % 4), F.lit(".0."), text(i % 250))),
        "dip": F.when(is_net, F.concat(F.lit("10."), text(u % 4), F.lit("."), text(F.floor(i / 250) % 250), F.lit("."), text(i % 250))),
        "sport": F.when(is_net, text(1024 + i % 5000)), "dport": F.when(is_net, text(dport)), "size": F.when(is_net, text(k)),
    }
    entries = F.create_map(*[x for name_, value in params.items() for x in (F.lit(name_), value)])
    return events.select(
        i.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), u.alias("pid"), (i % 64).alias("tid"),
        (i % 8).cast("int").alias("cpu"), _choose({t: n for t, (n, _) in EVENT_TYPES.items()}).alias("name"),
        _choose({t: c for t, (_, c) in EVENT_TYPES.items()}).alias("category"),
        F.concat(kind, F.lit(" event")).alias("description"), F.concat(F.lit("host"), text(u % 5)).alias("host"),
        F.map_filter(entries, lambda _, v: v.isNotNull()).alias("params"),
        F.create_map(F.lit("src"), kind).alias("meta"), (i % 4).cast("int").alias("evasions"),
        kind.alias("event_type"), F.col("value"), k.alias("k"), path.alias("path"))


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return derive(table(spark, folder, "events"))


# Further event kinds the table can stand for, by event_id modulo 8.
WIDE_EVENTS = [("CreateThread", "thread"), ("LoadModule", "module"), ("CreateHandle", "handle"), ("VirtualAlloc", "mem"),
               ("QueryDns", "net"), ("SubmitThreadpoolWork", "threadpool"), ("OpenProcess", "process"),
               ("OpenThread", "thread")]


def wide_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """The same events under the event kinds the first adapter does not use."""
    base = derive(table(spark, folder, "events"))
    i, u, k = F.col("seq"), F.col("pid"), F.col("k")
    text = lambda c: c.cast("string")
    at = (i % 8).cast("int")
    name = F.get(F.array(*[F.lit(n) for n, _ in WIDE_EVENTS]), at)
    category = F.get(F.array(*[F.lit(c) for _, c in WIDE_EVENTS]), at)
    params = {
        (0,): {"pid": text(u % 3), "tid": text(i % 64), "start_address": text(i * 4096), "base_prio": text(i % 16), "teb": text(i * 8),
               "start_address_symbol": F.concat(F.lit("f"), text(k)), "start_address_module": F.col("path")},
        (1,): {"pid": text(u), "file_path": F.concat(F.lit("C:\\Windows\\System32\\m"), text(i % 50), F.when(i % 3 == 0, F.lit(".sys")).otherwise(F.lit(".dll"))),
               "base_address": text(i * 65536), "module_size": text(k * 4096), "checksum": text(i % 1000),
               "signature_type": F.when(i % 3 == 0, F.lit("EMBEDDED")).when(i % 3 == 1, F.lit("FILE_VERIFIED")).otherwise(F.lit("NONE")),
               "signature_level": F.when(k % 2 == 0, F.lit("WINDOWS")).otherwise(F.lit("WINDOWS_TCB")), "is_driver": F.when(i % 3 == 0, F.lit("true")).otherwise(F.lit("false")),
               "signature_exists": F.when(k % 4 == 0, F.lit("false")).otherwise(F.lit("true")),
               "signature_trusted": F.when(k % 5 == 0, F.lit("false")).otherwise(F.lit("true"))},
        (2,): {"handle_id": text(k * 4), "handle_object": text(i * 16), "type_id": F.when(k % 2 == 0, F.lit("Key")).otherwise(F.lit("File")),
               "handle_name": F.when(k % 2 == 0, F.concat(F.lit("\\REGISTRY\\USER\\S-1-5-"), text(u), F.lit("\\Env"))).otherwise(
                   F.concat(F.lit("\\Device\\HarddiskVolume"), text(i % 3), F.lit("\\d\\f"), text(k)))},
        (3,): {"base_address": text(i * 4096), "region_size": text(k * 4096), "alloc_type": F.lit("COMMIT"), "protection": F.when(k % 2 == 0, F.lit("64")).otherwise(F.lit("4")),
               "protection_mask": F.when(k % 2 == 0, F.lit("RWX")).otherwise(F.lit("RW")), "page_type": F.lit("PRIVATE"), "target_pid": text(u % 7)},
        (4,): {"name": F.concat(F.lit("n"), text(k), F.lit(".example.com")), "rr": F.lit("A"), "rcode": F.when(k % 3 == 0, F.lit("NXDOMAIN")).otherwise(F.lit("NOERROR")),
               "answers": F.concat(F.lit("10.0.0."), text(k), F.lit(",10.0.1."), text(k))},
        (5,): {"pool_id": text(i * 32), "task_id": text(i * 64), "callback": text(i * 128), "callback_symbol": F.concat(F.lit("cb"), text(k)),
               "callback_module": F.col("path"), "period": text(k)},
        (6, 7): {"pid": text(u % 7), "tid": text(i % 64), "desired_access": text(i % 16), "desired_access_names": F.when(i % 2 == 0, F.lit("READ|WRITE")).otherwise(F.lit("ALL")),
                 "status": F.when(k % 4 == 0, F.lit("Access denied")).otherwise(F.lit("Success")), "exe": F.col("path")},
    }
    # One flat map with literal keys: a lookup by key reduces to that key's value alone.
    cases: dict[str, Column] = {}
    for slots, values in params.items():
        for key, value in values.items():
            hit = at.isin(list(slots))
            cases[key] = cases[key].when(hit, value) if key in cases else F.when(hit, value)
    entries = F.create_map(*[x for key, value in cases.items() for x in (F.lit(key), value)])
    return base.withColumns({"name": name, "category": category, "params": entries})


def with_stack(df: DataFrame) -> DataFrame:
    """A derived call stack of three user frames and, on three of four events, a kernel frame."""
    i = F.col("seq")
    big = lambda c: c.cast("decimal(20,0)")
    kernel = F.expr("cast('18446735277616529408' as decimal(20,0))")

    def frame(addr, offset, symbol, module, base_addr):
        return F.struct(F.col("pid").alias("pid"), big(addr).alias("addr"), offset.cast("bigint").alias("offset"),
                        symbol.alias("symbol"), module.alias("module"), big(base_addr).alias("module_addr"))

    outer = frame(i + 4096, i % 50, F.lit("main"), F.when(i % 9 == 0, F.lit("unbacked")).otherwise(F.col("path")), F.lit(4096))
    middle = frame(i + 140000000, F.lit(0), F.lit("CreateFileW"), F.when(i % 2 == 0, F.lit("C:\\Windows\\System32\\kernelbase.dll")).otherwise(
        F.lit("C:\\Windows\\System32\\user32.dll")), F.lit(140000000))
    inner = frame(i % 100 + 150000000, i % 7, F.when(i % 6 == 0, F.lit("ZwOpenFile")).otherwise(F.lit("NtCreateFile")),
                  F.when(i % 3 == 0, F.lit("C:\\Windows\\System32\\ntdll.dll")).when(i % 3 == 1, F.lit("C:\\Windows\\System32\\win32u.dll"))
                  .otherwise(F.lit("C:\\tmp\\x.dll")), F.lit(150000000))
    top = frame((kernel + i).cast("decimal(20,0)"), F.lit(16), F.lit("?"), F.when(i % 8 == 1, F.lit("unbacked")).otherwise(
        F.lit("C:\\Windows\\System32\\ntoskrnl.exe")), kernel)
    user = F.array(outer, middle, inner)
    return df.withColumn("callstack", F.when(i % 4 == 0, user).otherwise(F.concat(user, F.array(top))))
