"""Reports and summaries: keyed counters, statistics, top lists, deltas, sequence-slot helpers."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from ..functions.paths import base


def count_by(df: DataFrame, key: Column | str, every: str, ts: str = "ts", cumulative: bool = False) -> DataFrame:
    """Events per key and interval; ``cumulative`` adds up all earlier intervals.

    The running sum works on the per-interval counts, which are few compared
    with the events behind them.
    """
    key = F.col(key) if isinstance(key, str) else key
    counts = (df.groupBy(F.window(F.col(ts).cast("timestamp"), every).alias("w"), key.alias("key"))
              .agg(F.count("*").alias("n")).select(F.col("w.start").alias("interval_start"), "key", "n"))
    if not cumulative:
        return counts
    so_far = Window.partitionBy("key").orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("n", F.sum("n").over(so_far))


def pipeline_counters(df: DataFrame, known_names: list[str], excluded: Column | None = None,
                      failed: Column | None = None) -> DataFrame:
    """One row: processed, excluded, unknown and failed events and evasions by type."""
    never = F.lit(False)
    return df.agg(
        F.count("*").alias("processed"), F.count_if(excluded if excluded is not None else never).alias("excluded"),
        F.count_if(~F.col("name").isin(known_names)).alias("unknown"),
        F.count_if(failed if failed is not None else never).alias("failed"),
        F.count_if(F.col("evasions").bitwiseAND(1) != 0).alias("direct_syscalls"),
        F.count_if(F.col("evasions").bitwiseAND(2) != 0).alias("indirect_syscalls"))


def capture_stats(df: DataFrame, size: Column) -> DataFrame:
    """Events, bytes, process and handle events of a capture in one pass."""
    return df.agg(F.count("*").alias("events"), F.sum(size).alias("bytes"),
                  F.count_if(F.col("name") == "CreateProcess").alias("processes"),
                  F.count_if(F.col("name") == "CreateHandle").alias("handles"))


def distinct_modules(modules: DataFrame, path: str = "path") -> DataFrame:
    """One module per base name, whichever process holds it; the smallest path stands for the name."""
    return modules.groupBy(base(F.col(path)).alias("name")).agg(F.min(path).alias("path"))


def top(df: DataFrame, by: str, n: int, ties: list[str] = ()) -> DataFrame:
    """Largest rows first; the limit is part of the sort, so only n rows per partition travel."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def sort_rows(df: DataFrame, by: list[str], descending: bool = False) -> DataFrame:
    """All rows in order of some columns (missing values last): a sort over ranges, for reports that are shown whole."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in by])


def sort_events(col: Column) -> Column:
    """Events of a match in time order."""
    return F.sort_array(col)


def with_delta(df: DataFrame, ts: str = "ts", seq: str = "seq", host: str = "host", slice_width: str = "10m") -> DataFrame:
    """``delta_us``: microseconds since the host's previous event, NULL for the first.

    Windows cover one host and time slice; the slice's first row takes the last
    time of the host's previous slice.
    """
    from ..durations import micros
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = df.withColumn("_t", t).withColumn("_s", F.floor(t / micros(slice_width)))
    inside = Window.partitionBy(host, "_s").orderBy("_t", seq)
    near = cut.withColumn("_before", F.lag("_t").over(inside))
    ends = cut.groupBy(host, "_s").agg(F.max("_t").alias("_m"))
    handed = ends.select(host, "_s", F.lag("_m").over(Window.partitionBy(host).orderBy("_s")).alias("_carry"))
    return near.join(handed, [host, "_s"], "left").select(
        *df.columns, (F.col("_t") - F.coalesce("_before", "_carry")).alias("delta_us"))


def partial_key() -> Column:
    """Hash under which events of one sequence slot count as the same; NULL where nothing is ever the same."""
    p, name = F.col("params"), F.col("name")
    pid = F.col("pid").cast("string")
    rules = [
        (["WriteFile", "ReadFile"], ["file_object"]), (["MapViewFile", "UnmapViewFile"], ["view_base"]),
        (["CreateFile"], ["file_path"]), (["OpenProcess"], ["pid", "desired_access"]),
        (["OpenThread"], ["tid", "desired_access"]), (["Accept", "Recv"], ["sip", "sport"]),
        (["Connect", "Send"], ["dip", "dport"]),
        (["RegOpenKey", "RegQueryKey", "RegQueryValue", "RegDeleteKey", "RegDeleteValue", "RegSetValue", "RegCloseKey"], ["key_path"]),
        (["VirtualAlloc", "VirtualFree"], ["base_address"]), (["DuplicateHandle"], ["handle_object", "pid"]),
        (["QueryDns", "ReplyDns"], ["name"]),
    ]
    out = None
    for names, keys in rules:
        value = F.xxhash64(*[F.coalesce(p[k], F.lit("")) for k in keys], pid)
        out = F.when(name.isin(names), value) if out is None else out.when(name.isin(names), value)
    return out


def dedup_partials(df: DataFrame, key: list[str], slot: str = "slot", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """First event per key, slot and partial key; events without a partial key all stay.

    The survivors are found by an aggregation (partial before the shuffle), so
    a group of equal events never meets in one task.
    """
    keyed = df.withColumn("_pk", partial_key())
    first = (keyed.where("_pk is not null").groupBy(*key, slot, "_pk")
             .agg(F.min_by(F.struct(*df.columns), F.struct(ts, seq)).alias("r")).select("r.*"))
    return keyed.where("_pk is null").drop("_pk").unionByName(first)


def partial_breaches(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys and slots with more than ``n`` pending events: how many there are, and how many above the bound. Nothing is dropped."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("pending")).where(F.col("pending") > n).withColumn("above", F.col("pending") - n)


def merge_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def catalogue_order(fields: DataFrame) -> DataFrame:
    """Event types by category, then name, one row per name."""
    return fields.groupBy("name").agg(F.min("category").alias("category")).orderBy("category", "name")


@dataclass(frozen=True)
class Report:
    """Declarative report: filter, key expression, interval, order and page size."""

    key: Column
    where: Callable[[DataFrame], Column] | None = None
    every: str = "1 second"
    cumulative: bool = False
    sort_by: str = "n"
    max_rows: int | None = None
    title: str = ""
    columns: tuple[str, ...] = ("interval_start", "key", "n")

    def run(self, events: DataFrame) -> DataFrame:
        source = events if self.where is None else events.where(self.where(events))
        out = count_by(source.where(self.key.isNotNull() & (self.key != "")), self.key, self.every, cumulative=self.cumulative)
        out = out.select(*self.columns)
        return top(out, self.sort_by, self.max_rows, [c for c in self.columns if c != self.sort_by]) if self.max_rows else out


def watch_files(events: DataFrame) -> DataFrame:
    """(process, path) of files that were created rather than opened."""
    p = F.col("params")
    return events.where((F.col("name") == "CreateFile") & (p["create_disposition"] != "OPEN")).select(
        F.coalesce(F.col("ps.name") if "ps" in events.columns else F.lit(None).cast("string"), F.lit("")).alias("process"),
        p["file_path"].alias("path"))


def program_alerts(rows: DataFrame, title: str, text: Column, severity: str = "medium", tags: list[str] = ()) -> DataFrame:
    """Rows of a report as alerts."""
    return rows.select(F.lit(title).alias("title"), text.alias("text"), F.lit(severity).alias("severity"),
                       F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"))


__all__ = [n for n in dir() if not n.startswith("_")]
