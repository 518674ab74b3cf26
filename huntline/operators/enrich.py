"""Enrichment joins: process, file, registry, module, symbol, port, name and metadata lookups.

Events are rows of the canonical schema. Lookup tables carry plain columns
and are joined without hints: Spark broadcasts a side when its measured size
is below the session threshold and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durations import micros
from ..functions.callstack import UNBACKED
from ..functions.paths import base, map_device_path, registry_key
from ..session import durable
from .asof import Source, asof_join, last_at_or_before, lookups, nearest_below_join, pair_latest
from .sweep import pairs_in_order, running_sets

PROCESS_GRACE = "5s"
SET_VALUE_TTL = "2m"
STACK_TTL = "500ms"


# --- processes -------------------------------------------------------------------------------------


def _micro(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def process_uuid(host: Column, pid: Column, start_time: Column) -> Column:
    """Identifier that does not repeat when the system reuses a pid."""
    return F.xxhash64(host, pid, start_time)


def process_states(events: DataFrame) -> DataFrame:
    """One state row per process start: host, pid, valid_from and the ``ps`` struct."""
    p = F.col("params")
    started = events.where(F.col("name").isin("CreateProcess", "ProcessRundown"))
    pid = F.coalesce(F.expr("try_cast(params['pid'] as bigint)"), F.col("pid"))
    return started.select("host", pid.alias("pid"), F.col("ts").alias("valid_from"), F.col("seq").alias("state_seq"), F.struct(
        pid.alias("pid"), F.expr("try_cast(params['ppid'] as bigint)").alias("ppid"), p["name"].alias("name"),
        p["cmdline"].alias("cmdline"), p["exe"].alias("exe"), p["cwd"].alias("cwd"), p["sid"].alias("sid"),
        p["username"].alias("username"), p["domain"].alias("domain"),
        process_uuid(F.col("host"), pid, F.col("ts")).alias("uuid"), F.col("ts").alias("start_time")).alias("ps"))


def process_ends(events: DataFrame) -> DataFrame:
    pid = F.coalesce(F.expr("try_cast(params['pid'] as bigint)"), F.col("pid"))
    return events.where(F.col("name") == "TerminateProcess").select("host", pid.alias("pid"), F.col("ts").alias("ended_at"))


def enrich_process(events: DataFrame, states: DataFrame | None = None, ends: DataFrame | None = None,
                   grace: str = PROCESS_GRACE, key: str = "pid", out: str = "ps") -> DataFrame:
    """State of the event's process at event time; an unknown pid gets a stub with the pid only."""
    states = process_states(events) if states is None else states
    ends = process_ends(events) if ends is None else ends
    left = events if key == "pid" else events.withColumn("_pid", F.col("pid")).withColumn("pid", F.col(key))
    left = left.drop(out)
    found = asof_join(left, states.withColumnRenamed("ps", out), ["host", "pid"], "ts", [out], state_ts="valid_from",
                      close=ends, close_ts="ended_at", grace=grace, tie="state_seq")
    kind = states.schema["ps"].dataType
    stub = F.struct(*[(F.col("pid") if f.name == "pid" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    found = found.withColumn(out, F.coalesce(F.col(out), stub))
    return found if key == "pid" else found.withColumn("pid", F.col("_pid")).drop("_pid")


def enrich_parent(states: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """State rows with ``parent``: the state of ppid at the child's start, NULL when it is gone."""
    children = states.withColumn("_own", F.col("pid")).withColumn("pid", F.col("ps.ppid"))
    parents = states.select("host", "pid", "valid_from", "state_seq", F.col("ps").alias("parent"))
    found = asof_join(children, parents, ["host", "pid"], "valid_from", ["parent"], close=ends, close_ts="ended_at",
                      grace=0, tie="state_seq")
    return found.withColumn("pid", F.col("_own")).drop("_own")


def enrich_target(events: DataFrame, states: DataFrame, ends: DataFrame, target: str = "target_pid") -> DataFrame:
    """exe and name of the process an event acts on, as ``target`` struct."""
    wanted = events.withColumn(target, F.expr(f"try_cast(params['{target}'] as bigint)")) if target not in events.columns else events
    found = enrich_process(wanted, states, ends, key=target, out="target_ps")
    return found.withColumn("target", F.struct(F.col("target_ps.exe").alias("exe"), F.col("target_ps.name").alias("name"))
                            ).drop("target_ps")


def merge_process_state(a: DataFrame, b: DataFrame, keys: list[str] = ("host", "pid", "lifetime")) -> DataFrame:
    """Two providers' view of a process: token facts from whichever has them, the longer path if base names agree."""
    keys = list(keys)
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    facts = [c for c in both.columns if c not in (*keys, "exe", "_side")]
    first_exe = F.min_by("exe", F.when(F.col("exe").isNotNull(), F.col("_side")))
    merged = both.groupBy(*keys).agg(
        first_exe.alias("_first"), F.max_by("exe", F.struct(F.length("exe").alias("l"), F.col("exe").alias("x"))).alias("_longest"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_side"))).alias(c) for c in facts])
    same = F.lower(base(F.col("_first"))) == F.lower(base(F.col("_longest")))
    return merged.select(*keys, F.when(same, F.col("_longest")).otherwise(F.col("_first")).alias("exe"), *facts)


def ancestors(edges: DataFrame, child: str = "uuid", parent: str = "parent_uuid", name: str = "name") -> DataFrame:
    """child and ``ancestors`` (names, nearest first, up to the root).

    Pointer doubling: after k joins every row knows 2^k ancestors, so the rounds
    grow with the logarithm of the deepest chain and no chain is walked row by
    row. Each round is checkpointed (the next one needs it on both sides) and
    the rounds stop once all chains are complete. A chain that enters a cycle
    ends before its first repetition.
    """
    kind = edges.select(F.struct(F.col(child).alias("id"), F.col(name).alias("name")).alias("x")).schema["x"].dataType.simpleString()
    nobody = F.array().cast(f"array<{kind}>")
    names = edges.select(F.col(child).alias("id"), F.col(parent).alias("up"), F.col(name).alias("name"))
    known = names.select(F.col("id").alias("top"), F.lit(0).alias("salt"), F.struct("id", "name").alias("who"))
    first = F.col("who").isNotNull() & (F.col("top") != F.col("id"))
    walk = names.withColumnRenamed("up", "top").withColumn("salt", _spread_nulls("top")).join(known, ["top", "salt"], "left").select(
        "id", F.when(first, F.col("top")).alias("top"), F.when(first, F.array("who")).otherwise(nobody).alias("chain"))
    while True:
        walk = durable(walk)
        if walk.where("top is not null").isEmpty():
            break
        further = walk.select(F.col("id").alias("top"), F.lit(0).alias("salt"), F.col("top").alias("top2"), F.col("chain").alias("chain2"))
        longer = F.concat("chain", F.coalesce("chain2", nobody))
        once = F.filter(F.array_distinct("longer"), lambda x: x["id"] != F.col("id"))
        walk = walk.withColumn("salt", _spread_nulls("top")).join(further, ["top", "salt"], "left").select("id", "top2", longer.alias("longer")).select(
            "id", F.when(F.size(once) == F.size("longer"), F.col("top2")).alias("top"), once.alias("chain"))
    return walk.select(F.col("id").alias(child), F.transform("chain", lambda x: x["name"]).alias("ancestors"))


def _spread_nulls(key: str) -> Column:
    """Second join key that keeps rows without a key from meeting in one partition."""
    return F.when(F.col(key).isNull(), F.pmod(F.hash("id"), F.lit(4096)) + 1).otherwise(F.lit(0))


def members_asof(events: DataFrame, opens: DataFrame, closes: DataFrame, keys: list[str], member: list[str]) -> DataFrame:
    """``members``: the collection elements open at event time (at one time an open row wins over a close row).

    A sweep: events and change points are partitioned by ranges of (key, time)
    and sorted, and each task keeps the running set of the key it is at. What is
    open where a key goes on into the next range is a snapshot, made from one
    row for each member a range changes. There are no event-member or
    interval-bucket rows: the plan holds events, changes and one snapshot for
    each range. A key may hold any share of the rows.
    """
    at = _micro("ts")
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    point = lambda df, opened: df.where(known).select(*keys, F.struct(*member).alias("_member"), at.alias("_pos"), F.lit(opened).alias("_open"))
    changes = point(opens, True).unionByName(point(closes, False)).groupBy(*keys, "_member", "_pos").agg(F.bool_or("_open").alias("_open"))
    rows = changes.withColumn("_tag", F.lit(0)).unionByName(events.select(*keys, at.alias("_pos"), F.lit(1).alias("_tag"), F.struct(*events.columns).alias("_row")), allowMissingColumns=True)
    ranges = durable(rows.repartitionByRange(*keys, "_pos", "_tag").withColumn("_part", F.spark_partition_id()))

    net = ranges.where("_tag = 0").groupBy(*keys, "_member", "_part").agg(F.max_by("_open", "_pos").alias("_open"))
    changed = F.lead("_part").over(Window.partitionBy(*keys, "_member").orderBy("_part"))
    reach = ranges.groupBy(*keys).agg(F.max("_part").alias("_last"))
    open_ends = net.withColumn("_next", changed).where("_open").join(reach, keys).withColumn("_to", F.least(F.coalesce("_next", "_last"), "_last")).where("_part < _to")
    first = F.lit(-(1 << 63)).cast("bigint")
    snapshots = open_ends.select(*keys, "_member", "_open", first.alias("_pos"), F.lit(0).alias("_tag"), F.explode(F.sequence(F.col("_part") + 1, "_to")).alias("_part"))
    together = ranges.unionByName(snapshots, allowMissingColumns=True).repartition("_part").sortWithinPartitions("_part", *keys, "_pos", "_tag")
    kind = T.StructType([together.schema["_row"], T.StructField("members", T.ArrayType(together.schema["_member"].dataType))])
    swept = together.mapInArrow(lambda batches: running_sets(batches, ["_part", *keys]), kind)
    return swept.select("_row.*", F.coalesce(F.sort_array("members"), F.array().cast(kind["members"].dataType)).alias("members"))


# --- files, registry, stacks -----------------------------------------------------------------------


def enrich_file_path(events: DataFrame, opened: DataFrame, closed: DataFrame, handles: DataFrame | None = None) -> DataFrame:
    """``file_path``/``file_type`` by file key, else file object, else handle object.

    ``opened``: host, file_object, ts, path, type; ``closed``: host, file_object, ts;
    ``handles``: host, file_object, ts, path. Events carry file_key and file_object.
    """
    keys, at = ["host", "file_object"], _micro("ts")
    sources = {"file": Source(opened, keys, at, ["path", "type"], ends=closed, ends_at=at)}
    if handles is not None:
        sources["handle"] = Source(handles, keys, at, ["path"])
    out = lookups(events, at, {"_key": ["host", "file_key"], "_object": keys}, sources)
    paths = [F.col(f"{c}.path") for c in ("_key_file", "_object_file", "_object_handle") if c in out.columns]
    return out.select(*events.columns, F.coalesce(*paths).alias("file_path"), F.coalesce("_key_file.type", "_object_file.type").alias("file_type"))


def enrich_registry_path(events: DataFrame, kcbs: DataFrame, freed: DataFrame, handles: DataFrame | None = None,
                         sid: str | None = None) -> DataFrame:
    """``key_path`` from the control block's base key and the event's relative key.

    ``kcbs``: host, kcb, ts, base_key; ``freed``: host, kcb, ts; ``handles``:
    host, pid, handle_name (key handles). Without a control block the handle of
    the process whose name ends with the relative key is taken; the candidates
    meet on pid and last path component, the smallest name wins.
    """
    found = asof_join(events, kcbs, ["host", "kcb"], "ts", ["base_key"], close=freed)
    relative = F.coalesce(F.col("relative_key"), F.lit(""))
    full = F.when(relative == "", F.col("base_key")).otherwise(F.concat(F.col("base_key"), F.lit("\\"), relative))
    out = found.withColumn("key_path", full)
    if handles is not None:
        leaf = F.lower(F.regexp_extract(relative, r"([^\\]+)$", 1))
        names = handles.select("host", "pid", "handle_name",
                               F.lower(F.regexp_extract("handle_name", r"([^\\]+)$", 1)).alias("_leaf")).distinct()
        open_rows = out.where(F.col("key_path").isNull() & (relative != "")).select("host", "pid", "seq", relative.alias("_rel"),
                                                                                  leaf.alias("_leaf"))
        best = (open_rows.join(names, ["host", "pid", "_leaf"])
                .where(F.lower("handle_name").endswith(F.lower("_rel")))
                .groupBy("host", "seq").agg(F.min("handle_name").alias("_by_handle")))
        out = out.join(best, ["host", "seq"], "left").withColumn("key_path", F.coalesce("key_path", "_by_handle")).drop("_by_handle")
    return out.withColumn("key_path", F.coalesce(registry_key(F.col("key_path"), sid), relative))


def registry_value(asked: DataFrame, written: DataFrame) -> DataFrame:
    """``data`` that the host's key_path held at event time, "" if none was written; ``written``: host, key_path, ts, seq, data."""
    found = asof_join(asked, written, ["host", "key_path"], "ts", ["data"], tie="seq")
    return found.withColumn("data", F.coalesce("data", F.lit("")))


def pair_set_value(events: DataFrame, internal: DataFrame, slice_width: str | None = None) -> DataFrame:
    """value_type and data of the newest pending internal write of the process, if it is the same value and fresh."""
    return pair_latest(events, internal, ["host", "pid"], "ts", SET_VALUE_TTL, ["value_type", "data"], same=["value_name"],
                       slice_width=slice_width)


def pair_callstack(events: DataFrame, walks: DataFrame, surrogates: bool = False, within: str = STACK_TTL) -> DataFrame:
    """Stack of the walk with the same host and raw time mark, if it arrives within the bound; one walk per event and one event per walk.

    In time order, each row takes the oldest waiting row of the other side that
    is within the bound; stale walks and events without one do not shift others.
    Rows stream by in sorted order; only those within the bound are held.

    With ``surrogates`` a process start that got no stack takes the one of the
    latest remote thread creation into its parent (``real_ppid``).
    """
    e = events.where("host is not null and stack_id is not null").select(
        "host", "stack_id", F.unix_micros("ts").alias("_t"), F.col("seq").alias("_seq"), F.struct(*events.columns).alias("_event"), F.lit(None).cast("string").alias("_stack"))
    w = walks.where("host is not null and stack_id is not null").select("host", "stack_id", F.unix_micros("ts").alias("_t"), F.col("callstack").alias("_stack"))
    rows = e.unionByName(w, allowMissingColumns=True).repartition("host", "stack_id").sortWithinPartitions("host", "stack_id", "_t", "_seq", "_stack")
    kind = T.StructType([e.schema["_event"], T.StructField("callstack", T.StringType())])
    bound = micros(within)
    found = rows.mapInArrow(lambda batches: pairs_in_order(batches, ["host", "stack_id"], bound), kind).select("_event.*", "callstack")
    out = found.unionByName(events.where("host is null or stack_id is null"), allowMissingColumns=True)
    if not surrogates:
        return out
    donors = out.where((F.col("name") == "CreateThread") & F.col("callstack").isNotNull()).select(
        F.col("host"), F.expr("try_cast(params['pid'] as bigint)").alias("_target"), "ts", F.col("callstack").alias("_donated"))
    asked = out.withColumn("_target", F.expr("try_cast(params['real_ppid'] as bigint)"))
    served = asof_join(asked, donors, ["host", "_target"], "ts", ["_donated"])
    pending = (F.col("name") == "CreateProcess") & F.expr("params['ppid'] != params['real_ppid']") & F.col("callstack").isNull()
    return served.withColumn("callstack", F.when(pending, F.col("_donated")).otherwise(F.col("callstack"))).drop("_target", "_donated")


def symbolize(frames: DataFrame, modules: DataFrame, exports: DataFrame, parent_key: str | None = None,
              slice_width: int | None = None) -> DataFrame:
    """``module``, ``module_addr``, ``symbol`` and ``offset`` per frame address.

    The module of the process holds the address, else one of the parent
    process (``parent_key``), else the frame is unbacked. The symbol is the
    nearest export at or below the offset in the module.
    """
    mods = modules.select("proc", F.col("base").alias("_base"), "size", F.col("path").alias("_path"))
    asked = {"_own": ["proc"]} | ({"_parent": [parent_key]} if parent_key else {})
    out = lookups(frames, F.col("addr"), asked, {"module": Source(mods, ["proc"], F.col("_base"), ["size", "_path"])}, slice_width)
    holds = [F.when(F.col("addr") < F.col(f"{a}_module._from") + F.col(f"{a}_module.size"), F.col(f"{a}_module")) for a in asked]
    out = out.withColumn("_m", F.coalesce(*holds)).select(*frames.columns, F.col("_m._path").alias("module"), F.col("_m._from").alias("module_addr"))
    out = out.withColumn("_rva", (F.col("addr") - F.col("module_addr")).cast("bigint"))
    names = exports.select("module", "rva", F.col("symbol").alias("_sym"), F.col("rva").alias("_srva"))
    out = nearest_below_join(out, names, ["module"], "_rva", "rva", ["_sym", "_srva"], slice_width)
    symbol = F.when(F.col("module").isNull(), F.lit("")).otherwise(
        F.when(F.coalesce(F.col("_sym"), F.lit("")) == "", F.lit("?")).otherwise(F.col("_sym")))
    return out.withColumn("symbol", symbol).withColumn(
        "offset", F.when(F.col("_srva").isNotNull(), F.col("_rva") - F.col("_srva")).otherwise(F.lit(0))).withColumn(
        "module", F.coalesce("module", F.lit(UNBACKED))).drop("_rva", "_sym", "_srva")


# --- dimensions ------------------------------------------------------------------------------------

UDP_NAMES_PARAM = "l4_proto"


def enrich_ports(events: DataFrame, ports: DataFrame) -> DataFrame:
    """sport_name and dport_name by protocol and port; ``ports``: proto, port, service. DNS events are left alone."""
    named = ports.select("proto", "port", "service")
    out = events
    for side in ("sport", "dport"):
        dim = named.select(F.col("proto").alias("_p"), F.col("port").alias("_n"), F.col("service").alias(f"{side}_name"))
        hit = (F.col("l4_proto") == F.col("_p")) & (F.col(side) == F.col("_n")) & ~F.col("name").isin("QueryDns", "ReplyDns")
        out = out.join(dim, hit, "left").drop("_p", "_n")
    return out


def enrich_names(events: DataFrame, ip_names: DataFrame, ttl: str = "30m") -> DataFrame:
    """sip_names and dip_names that the event's host knew at event time; ``ip_names``: host, ip, names, valid_from."""
    at = _micro("ts")
    known = Source(ip_names, ["host", "ip"], _micro("valid_from"), ["names"])
    out = lookups(events, at, {"_sip": ["host", "sip"], "_dip": ["host", "dip"]}, {"name": known})
    fresh = lambda side: F.when(at - F.col(f"_{side}_name._from") <= micros(ttl), F.col(f"_{side}_name.names")).alias(f"{side}_names")
    return out.select(*events.columns, fresh("sip"), fresh("dip"))


def trusted_signature(kind: Column, level: Column) -> Column:
    """Trusted by its own type and level."""
    return F.coalesce(((kind == "EMBEDDED") & level.isin("WINDOWS", "WINDOWS_TCB"))
                      | ((kind == "FILE_VERIFIED") & (level == "WINDOWS")), F.lit(False))


def signature_trust(df: DataFrame, signatures: DataFrame,
                    keys: list[str] = ("path", "size", "checksum", "timestamp")) -> DataFrame:
    """``signature_trusted``: own type and level decide, otherwise the signature table."""
    keys = list(keys)
    known = signatures.select(*keys, F.col("exists").alias("_e"), F.col("trusted").alias("_t"))
    out = df.join(known, keys, "left")
    own = trusted_signature(F.col("signature_type"), F.col("signature_level"))
    return out.withColumn("signature_trusted", own | F.coalesce("_t", F.lit(False))).withColumn(
        "signature_exists", own | F.coalesce("_e", F.lit(False))).drop("_e", "_t")


def match_intel(df: DataFrame, drivers: DataFrame) -> DataFrame:
    """``intel_id`` of a known-bad driver by sha256, else sha1, else file name without case."""
    out = df.withColumn("_file", F.lower(base(F.col("path"))))
    hits = []
    for how, (mine, theirs) in {"h256": ("sha256", "sha256"), "h1": ("sha1", "sha1"), "n": ("_file", "file_name")}.items():
        value = F.lower(F.col(theirs))
        dim = drivers.where(F.coalesce(value, F.lit("")) != "").groupBy(value.alias(f"_{how}")).agg(F.min("id").alias(f"_id_{how}"))
        out = out.join(dim, F.lower(F.col(mine)) == F.col(f"_{how}"), "left").drop(f"_{how}")
        hits.append(f"_id_{how}")
    return out.withColumn("intel_id", F.coalesce(*hits)).drop("_file", *hits)


def enrich_file_meta(events: DataFrame, meta: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """File facts by host and path as of event time, only for successful creating dispositions.

    ``meta``: host, path, valid_from, is_dll, is_driver, is_exec; ``dropped``: host, path, ts of overwrite, delete or rename.
    """
    facts = ["is_dll", "is_driver", "is_exec"]
    keyed = events.withColumn("path", F.lower("file_path"))
    dim = meta.withColumn("path", F.lower("path"))
    gone = None if dropped is None else dropped.withColumn("path", F.lower("path"))
    found = asof_join(keyed, dim, ["host", "path"], "ts", facts, state_ts="valid_from", close=gone, close_ts="ts")
    creating = (F.col("name") == "CreateFile") & (F.col("operation") == "CREATE") & (F.coalesce("status", F.lit("Success")) == "Success")
    return found.select(*events.columns, *[F.coalesce(F.when(creating, F.col(f)), F.lit(False)).alias(f) for f in facts])


def decode_code(df: DataFrame, column: str, dim: DataFrame, out: str = "decoded") -> DataFrame:
    """Code to text through a code table (code, text); an unknown code keeps its number."""
    table = dim.select(F.col("code").alias("_code"), F.col("text").alias("_text"))
    return df.join(table, F.col(column) == F.col("_code"), "left").withColumn(
        out, F.coalesce("_text", F.col(column).cast("string"))).drop("_code", "_text")


__all__ = [name for name in dir() if not name.startswith("_")]
