"""Field projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import callstack as cs
from ..functions.fields import field

from ..operators.enrich import ancestors, enrich_parent, enrich_process, process_ends, process_states, process_uuid

from ..sources.events import creation_flags, effective_ids
from ..sources.tables import table, telemetry, wide_telemetry, with_stack
from .registry import ev_sql, query, st_sql


def pick(df, names, *columns):
    """seq and the named fields as columns; dots become underscores, integers are widened."""
    out = [F.col("seq"), *[F.col(c) for c in columns]]
    for name in names:
        value = field(df, name)
        label = name.replace(".", "_").replace("[", "_").replace("]", "")
        out.append((value.cast("bigint") if name in WIDEN else value).alias(label))
    return df.select(*out)


WIDEN = {"evt.cpu", "evt.time.h", "evt.time.m", "evt.time.s", "evt.date.d", "evt.date.m", "evt.date.y", "evt.date.week",
         "evt.nparams", "net.dport", "net.sport", "thread.prio", "file.object", "thread.start_address", "mem.address",
         "module.base", "handle.object", "threadpool.id", "threadpool.callback.address", "thread.teb_address"}


@query("p1_evt_fields", ev_sql("""
SELECT seq, seq AS evt_seq, pid AS evt_pid, tid AS evt_tid, cpu AS evt_cpu, name AS evt_name, category AS evt_category, event_type || ' event' AS evt_desc,
 host AS evt_host, strftime(ts, '%H:%M:%S') AS evt_time, hour(ts) AS evt_time_h, minute(ts) AS evt_time_m, second(ts) AS evt_time_s,
 epoch_us(ts) * 1000 AS evt_time_ns, strftime(ts, '%Y-%m-%d') AS evt_date, day(ts) AS evt_date_d, month(ts) AS evt_date_m, year(ts) AS evt_date_y,
 weekofyear(ts) AS evt_date_week, dayname(ts) AS evt_date_weekday, 'UTC' AS evt_date_tz,
 CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'error' THEN 9 WHEN 'signup' THEN 6 ELSE 8 END AS evt_nparams,
 evasions % 2 = 1 AS evt_is_direct_syscall, evasions >= 2 AS evt_is_indirect_syscall FROM ev"""))
def p1(spark, sf):
    return pick(telemetry(spark, sf), [
        "evt.seq", "evt.pid", "evt.tid", "evt.cpu", "evt.name", "evt.category", "evt.desc", "evt.host", "evt.time", "evt.time.h",
        "evt.time.m", "evt.time.s", "evt.time.ns", "evt.date", "evt.date.d", "evt.date.m", "evt.date.y", "evt.date.week",
        "evt.date.weekday", "evt.date.tz", "evt.nparams", "evt.is_direct_syscall", "evt.is_indirect_syscall"])


@query("p1_kevt_aliases", ev_sql("SELECT seq, pid AS kevt_pid, name AS kevt_name, strftime(ts, '%Y-%m-%d') AS kevt_date FROM ev"))
def p1b(spark, sf):
    return pick(telemetry(spark, sf), ["kevt.pid", "kevt.name", "kevt.date"])


@query("p2_evt_arg", ev_sql("""
SELECT seq, CAST(k AS VARCHAR) AS evt_arg_k, CASE WHEN category = 'process' THEN path ELSE '' END AS evt_arg_exe, '' AS evt_arg_missing FROM ev"""))
def p2(spark, sf):
    return pick(telemetry(spark, sf), ["evt.arg[k]", "evt.arg[exe]", "evt.arg[missing]"])


_PS = "p AS (SELECT host, pid, ts, path, image, k, ppid FROM ev WHERE name = 'CreateProcess')"


def _with_process(spark, sf):
    df = telemetry(spark, sf)
    return enrich_process(df, process_states(df), process_ends(df))


@query("p3_ps_fields", ev_sql("""
SELECT e.seq, e.pid AS ps_pid, coalesce(p.image, '') AS ps_name, coalesce(p.path, '') AS ps_exe,
 coalesce('"' || p.path || '" -k ' || p.k, '') AS ps_cmdline, coalesce(p.ppid, 0) AS ps_ppid,
 CASE WHEN p.pid IS NULL THEN '' ELSE 'user' || (e.pid % 9) END AS ps_username, false AS ps_is_wow64
FROM ev e ASOF LEFT JOIN p ON e.host = p.host AND e.pid = p.pid AND e.ts >= p.ts""", _PS))
def p3(spark, sf):
    df = _with_process(spark, sf)
    # Attributes that no event of this table reports read as their typed zero.
    df = df.withColumn("ps", F.col("ps").withField("is_wow64", F.lit(None).cast("boolean")))
    return pick(df, ["ps.pid", "ps.name", "ps.exe", "ps.cmdline", "ps.ppid", "ps.username", "ps.is_wow64"])


@query("p4_ps_parent_fields", ev_sql("""
SELECT e.seq, coalesce(p.pimage, '') AS ps_parent_name, coalesce(p.ppath, '') AS ps_parent_exe, coalesce(p.parent_pid, 0) AS ps_parent_pid
FROM ev e ASOF LEFT JOIN (SELECT c.host, c.pid, c.ts, q.image AS pimage, q.path AS ppath, q.pid AS parent_pid
  FROM p c ASOF LEFT JOIN p q ON c.host = q.host AND c.ppid = q.pid AND c.ts >= q.ts) p
 ON e.host = p.host AND e.pid = p.pid AND e.ts >= p.ts""", _PS))
def p4(spark, sf):
    df = telemetry(spark, sf)
    states = enrich_parent(process_states(df))
    states = states.withColumn("ps", F.col("ps").withField("parent", F.col("parent"))).drop("parent")
    return pick(enrich_process(df, states, process_ends(df)), ["ps.parent.name", "ps.parent.exe", "ps.parent.pid"])


@query("p5_ps_ancestor", """
WITH RECURSIVE t AS (SELECT DISTINCT user_id AS id FROM events),
 c AS (SELECT id, id // 2 AS up, 1 AS d FROM t WHERE id // 2 IN (SELECT id FROM t) AND id <> 0
  UNION ALL SELECT c.id, up // 2, d + 1 FROM c WHERE up <> 0 AND up // 2 IN (SELECT id FROM t))
SELECT e.event_id AS seq, coalesce(max('u' || up) FILTER (d = 1), '') AS ps_ancestor_0, coalesce(max('u' || up) FILTER (d = 3), '') AS ps_ancestor_2
FROM events e LEFT JOIN c ON e.user_id = c.id GROUP BY e.event_id""")
def p5(spark, sf):
    df = telemetry(spark, sf)
    tree = df.select("pid").distinct().select(
        "pid", F.when(F.col("pid") != 0, F.floor(F.col("pid") / 2)).alias("up"), F.concat(F.lit("u"), F.col("pid").cast("string")).alias("name"))
    chains = ancestors(tree, "pid", "up", "name")
    df = df.join(chains, "pid", "left").withColumn("ps", F.struct(F.col("ancestors")))
    return pick(df, ["ps.ancestor[0]", "ps.ancestor[2]"])


@query("p6_ps_envs", ev_sql("""
SELECT seq, path AS ps_envs_PATH, 'v' || k AS ps_envs_US, '' AS ps_envs_NONE, 'HOST:' || host || ';PATH:' || path || ';USERNAME:v' || k AS all_envs FROM ev"""))
def p6(spark, sf):
    df = telemetry(spark, sf).withColumn("ps", F.struct(F.create_map(
        F.lit("USERNAME"), F.concat(F.lit("v"), F.col("k").cast("string")), F.lit("PATH"), F.col("path"), F.lit("HOST"), F.col("host")).alias("envs")))
    out = pick(df, ["ps.envs[PATH]", "ps.envs[US]", "ps.envs[NONE]"], "ps")
    return out.withColumn("all_envs", F.array_join(field(df, "ps.envs"), ";")).drop("ps")


@query("p7_access_fields", ev_sql("""
SELECT seq, CASE WHEN seq % 8 = 6 THEN CAST(seq % 16 AS VARCHAR) ELSE '' END AS ps_access_mask,
 CASE WHEN seq % 8 = 6 THEN CASE WHEN k % 4 = 0 THEN 'Access denied' ELSE 'Success' END ELSE '' END AS ps_access_status,
 CASE WHEN seq % 8 = 7 THEN CAST(seq % 16 AS VARCHAR) ELSE '' END AS thread_access_mask,
 CASE WHEN seq % 8 = 6 THEN CASE WHEN seq % 2 = 0 THEN 'READ,WRITE' ELSE 'ALL' END ELSE '' END AS mask_names FROM ev"""))
def p7(spark, sf):
    df = wide_telemetry(spark, sf)
    out = pick(df, ["ps.access.mask", "ps.access.status", "thread.access.mask"], "name", "params")
    return out.withColumn("mask_names", F.array_join(field(df, "ps.access.mask.names"), ",")).drop("name", "params")


@query("p8_thread_fields", ev_sql("""
SELECT seq, CASE WHEN seq % 8 = 0 THEN seq * 4096 ELSE 0 END AS thread_start_address, CASE WHEN seq % 8 = 0 THEN seq % 16 ELSE 0 END AS thread_prio,
 CASE WHEN seq % 8 = 0 THEN pid % 3 WHEN seq % 8 = 7 THEN pid % 7 ELSE 0 END AS thread_pid,
 CASE WHEN seq % 8 = 0 THEN 'f' || k ELSE '' END AS thread_start_address_symbol, CASE WHEN seq % 8 = 0 THEN path ELSE '' END AS thread_start_address_module,
 CASE WHEN seq % 8 = 0 THEN seq * 8 ELSE 0 END AS thread_teb_address FROM ev"""))
def p8(spark, sf):
    return pick(wide_telemetry(spark, sf), ["thread.start_address", "thread.prio", "thread.pid", "thread.start_address.symbol",
                                            "thread.start_address.module", "thread.teb_address"])


@query("p9_callstack_arrays", st_sql("""
SELECT seq, array_to_string(list_transform(s, lambda f: f.module), ',') AS modules, array_to_string(list_transform(s, lambda f: f.name || '!' || f.sym), ',') AS symbols,
 array_to_string(list_transform(s, lambda f: lower(to_hex(CAST(f.addr AS UBIGINT)))), ',') AS addresses, s[2].module AS module_1, coalesce(s[4].sym, '') AS symbol_3 FROM st"""))
def p9(spark, sf):
    df = with_stack(telemetry(spark, sf))
    return df.select("seq", *[F.array_join(field(df, f"thread.callstack.{n}"), ",").alias(n) for n in ("modules", "symbols", "addresses")],
                     field(df, "thread.callstack.modules[1]").alias("module_1"), field(df, "thread.callstack.symbols[3]").alias("symbol_3"))


_COLLAPSE = "array_to_string(list_filter({0}, lambda x, i: i = 1 OR {0}[i - 1] <> x), '|')"
_USER_NAMES = "list_transform(list_reverse(list_filter(s, lambda f: NOT f.kernel)), lambda f: f.name)"
_KERNEL_NAMES = "list_transform(list_filter(s, lambda f: f.kernel), lambda f: f.name)"


@query("p10_callstack_summary", st_sql(f"""
SELECT seq, {_COLLAPSE.format('un')} AS user_summary, {_COLLAPSE.format('kn')} AS kernel_summary
FROM (SELECT seq, {_USER_NAMES} AS un, {_KERNEL_NAMES} AS kn FROM st)"""))
def p10(spark, sf):
    df = with_stack(telemetry(spark, sf))
    return df.select("seq", field(df, "thread.callstack.summary").alias("user_summary"),
                     field(df, "thread.callstack.kernel_summary").alias("kernel_summary"))


@query("p11_callstack_detail", st_sql("""
SELECT seq, array_to_string(list_transform(list_reverse(s), lambda f: '0x' || lower(to_hex(CAST(f.addr AS UBIGINT))) || ' ' ||
  CASE WHEN f.kernel AND f.module = 'unbacked' THEN '?' ELSE f.module END || '!' || f.sym || CASE WHEN f.off <> 0 THEN '+0x' || lower(to_hex(f.off)) ELSE '' END), '|') AS detail FROM st"""))
def p11(spark, sf):
    df = with_stack(telemetry(spark, sf))
    return df.select("seq", field(df, "thread.callstack.detail").alias("detail"))


@query("p12_final_user_frame", st_sql("""
SELECT seq, CASE WHEN i < len(s) THEN s[i].module ELSE '' END AS path, CASE WHEN i < len(s) THEN s[i].name ELSE '' END AS name,
 CASE WHEN i < len(s) THEN s[i].sym ELSE '' END AS symbol
FROM (SELECT seq, s, coalesce(list_max(list_filter(range(2, len(s) + 1), lambda j: NOT s[j].kernel AND lower(s[j].name) NOT IN ('ntdll.dll', 'kernel32.dll', 'kernelbase.dll'))), 1) AS i FROM st)"""))
def p12(spark, sf):
    df = with_stack(telemetry(spark, sf))
    return df.select("seq", field(df, "thread.callstack.final_user_module.path").alias("path"),
                     field(df, "thread.callstack.final_user_module.name").alias("name"),
                     field(df, "thread.callstack.final_user_symbol.name").alias("symbol"))


@query("p13_final_frames", st_sql("""
SELECT seq, s[3].name AS userspace_module, s[len(s)].module AS kernel_path, s[len(s)].sym AS kernel_symbol FROM st"""))
def p13(spark, sf):
    df = with_stack(telemetry(spark, sf))
    from ..functions.paths import base
    return df.select("seq", base(cs.final_userspace_frame(F.col("callstack"))["module"]).alias("userspace_module"),
                     field(df, "thread.callstack.final_kernel_module.path").alias("kernel_path"),
                     field(df, "thread.callstack.final_kernel_symbol.name").alias("kernel_symbol"))


@query("p14_callstack_flags", st_sql("""
SELECT seq, seq % 9 = 0 AS is_unbacked, len(list_filter(s, lambda f: f.sym = 'ZwOpenFile')) > 0 AS opens,
 array_to_string(list_transform(s, lambda f: CASE WHEN f.kernel THEN 'kernel' WHEN lower(f.name) IN ('ntdll.dll', 'kernel32.dll', 'kernelbase.dll') THEN 'system' ELSE 'user' END), ',') AS origin FROM st"""))
def p14(spark, sf):
    df = with_stack(telemetry(spark, sf))
    stack = F.col("callstack")
    return df.select("seq", field(df, "thread.callstack.is_unbacked").alias("is_unbacked"), cs.contains_symbol(stack, "ZwOpenFile").alias("opens"),
                     F.array_join(F.transform(stack, cs.provenance), ",").alias("origin"))


@query("p15_file_fields", ev_sql(r"""
SELECT seq, CASE WHEN f THEN path ELSE '' END AS file_path, CASE WHEN f THEN image ELSE '' END AS file_name,
 CASE WHEN f THEN regexp_replace(path, '\.[^.]*$', '') ELSE '' END AS file_path_stem, CASE WHEN f THEN '.exe' ELSE '' END AS file_extension,
 CASE WHEN name = 'CreateFile' THEN disposition ELSE '' END AS file_operation, CASE WHEN name = 'CreateFile' THEN status ELSE '' END AS file_status,
 CASE WHEN name = 'ReadFile' THEN k ELSE 0 END AS file_io_size, CASE WHEN f THEN seq % 97 ELSE 0 END AS file_object,
 CASE WHEN f THEN pid ELSE 0 END AS file_pid, false AS file_is_dll FROM (SELECT *, category = 'file' AS f FROM ev)"""))
def p15(spark, sf):
    return pick(telemetry(spark, sf), ["file.path", "file.name", "file.path.stem", "file.extension", "file.operation", "file.status",
                                       "file.io.size", "file.object", "file.pid", "file.is_dll"])


@query("p16_registry_fields", ev_sql(r"""
SELECT seq, CASE WHEN r THEN key_path ELSE '' END AS registry_path, CASE WHEN r THEN 'Run' ELSE '' END AS registry_key_name,
 CASE WHEN r THEN 'v' || (pid % 4) ELSE '' END AS registry_value, CASE WHEN r THEN CASE WHEN seq % 3 = 0 THEN 'REG_BINARY' ELSE 'REG_SZ' END ELSE '' END AS registry_value_type,
 CASE WHEN r THEN 'd' || k ELSE '' END AS registry_data, CASE WHEN r THEN status ELSE '' END AS registry_status
FROM (SELECT *, category = 'registry' AS r FROM ev)"""))
def p16(spark, sf):
    return pick(telemetry(spark, sf), ["registry.path", "registry.key.name", "registry.value", "registry.value.type",
                                       "registry.data", "registry.status"])


@query("p17_net_fields", ev_sql("""
SELECT seq, CASE WHEN n THEN sip ELSE '' END AS net_sip, CASE WHEN n THEN dip ELSE '' END AS net_dip, CASE WHEN n THEN sport ELSE 0 END AS net_sport,
 CASE WHEN n THEN dport ELSE 0 END AS net_dport, CASE WHEN n THEN k ELSE 0 END AS net_size, '' AS net_l4_proto FROM (SELECT *, category = 'net' AS n FROM ev)"""))
def p17(spark, sf):
    return pick(telemetry(spark, sf), ["net.sip", "net.dip", "net.sport", "net.dport", "net.size", "net.l4.proto"])


@query("p18_module_fields", ev_sql(r"""
SELECT seq, CASE WHEN m THEN mp ELSE '' END AS module_path, CASE WHEN m THEN regexp_extract(mp, '([^\\]*)$', 1) ELSE '' END AS module_name,
 CASE WHEN m THEN regexp_extract(mp, '([^\\]*)$', 1) ELSE '' END AS dll_name, CASE WHEN m THEN mp ELSE '' END AS image_path,
 CASE WHEN m THEN regexp_replace(mp, '\.[^.]*$', '') ELSE '' END AS module_path_stem, CASE WHEN m THEN seq * 65536 ELSE 0 END AS module_base,
 CASE WHEN m THEN k * 4096 ELSE 0 END AS module_size, CASE WHEN m THEN seq % 1000 ELSE 0 END AS module_checksum, m AND seq % 3 = 0 AS module_is_driver,
 CASE WHEN m THEN CASE seq % 3 WHEN 0 THEN 'EMBEDDED' WHEN 1 THEN 'FILE_VERIFIED' ELSE 'NONE' END ELSE '' END AS image_signature_type,
 m AND k % 4 <> 0 AS module_signature_exists, m AND k % 5 <> 0 AS dll_signature_trusted
FROM (SELECT *, seq % 8 = 1 AS m, 'C:\Windows\System32\m' || (seq % 50) || CASE WHEN seq % 3 = 0 THEN '.sys' ELSE '.dll' END AS mp FROM ev)"""))
def p18(spark, sf):
    return pick(wide_telemetry(spark, sf), ["module.path", "module.name", "dll.name", "image.path", "module.path.stem", "module.base", "module.size",
                                            "module.checksum", "module.is_driver", "image.signature.type", "module.signature.exists", "dll.signature.trusted"])


@query("p19_other_fields", ev_sql(r"""
SELECT seq, CASE WHEN seq % 8 = 2 THEN k * 4 ELSE 0 END AS handle_id, CASE WHEN seq % 8 = 2 THEN CASE WHEN k % 2 = 0 THEN 'Key' ELSE 'File' END ELSE '' END AS handle_type,
 CASE WHEN seq % 8 = 2 THEN seq * 16 ELSE 0 END AS handle_object, CASE WHEN seq % 8 = 3 THEN seq * 4096 ELSE 0 END AS mem_address, CASE WHEN seq % 8 = 3 THEN k * 4096 ELSE 0 END AS mem_size,
 CASE WHEN seq % 8 = 3 THEN CASE WHEN k % 2 = 0 THEN 'RWX' ELSE 'RW' END ELSE '' END AS mem_protection_mask, CASE WHEN seq % 8 = 4 THEN 'n' || k || '.example.com' ELSE '' END AS dns_name,
 CASE WHEN seq % 8 = 4 THEN CASE WHEN k % 3 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END ELSE '' END AS dns_rcode,
 CASE WHEN seq % 8 = 5 THEN seq * 32 ELSE 0 END AS threadpool_id, CASE WHEN seq % 8 = 5 THEN 'cb' || k ELSE '' END AS threadpool_callback_symbol,
 CASE WHEN seq % 8 = 5 THEN k ELSE 0 END AS threadpool_timer_period, CASE WHEN seq % 8 = 4 THEN '10.0.0.' || k || '+10.0.1.' || k ELSE '' END AS answers FROM ev"""))
def p19(spark, sf):
    df = wide_telemetry(spark, sf)
    out = pick(df, ["handle.id", "handle.type", "handle.object", "mem.address", "mem.size", "mem.protection.mask", "dns.name", "dns.rcode",
                    "threadpool.id", "threadpool.callback.symbol", "threadpool.timer.period"], "name", "params")
    return out.withColumn("answers", F.array_join(field(df, "dns.answers"), "+")).drop("name", "params")


@query("p20_pe_fields", """
SELECT p_partkey AS seq, p_size AS pe_nsections, p_brand AS pe_company, p_type AS pe_description, p_type = 'ECONOMY' AS pe_is_dll,
 p_size > 25 AS pe_is_signed, '' AS pe_product, replace(p_name, ' ', ',') AS symbols FROM part""")
def p20(spark, sf):
    part = table(spark, sf, "part")
    kinds = F.struct(
        F.col("p_size").cast("int").alias("nsections"), F.split("p_name", " ").alias("symbols"),
        F.create_map(F.lit("CompanyName"), F.col("p_brand"), F.lit("FileDescription"), F.col("p_type")).alias("resources"),
        (F.col("p_type") == "ECONOMY").alias("is_dll"), F.struct((F.col("p_size") > 25).alias("exists")).alias("signature"))
    df = part.select(F.col("p_partkey").alias("seq"), kinds.alias("pe"))
    return df.select("seq", field(df, "pe.nsections").cast("bigint").alias("pe_nsections"), field(df, "pe.company").alias("pe_company"),
                     field(df, "pe.description").alias("pe_description"), field(df, "pe.is_dll").alias("pe_is_dll"),
                     field(df, "pe.is_signed").alias("pe_is_signed"), field(df, "pe.product").alias("pe_product"),
                     F.array_join(field(df, "pe.symbols"), ",").alias("symbols"))


@query("p21_category_gate", ev_sql("""
SELECT category, count(*) FILTER (category = 'file') AS with_file, count(*) FILTER (category = 'registry') AS with_key,
 count(*) FILTER (category = 'net') AS with_port FROM ev GROUP BY category"""))
def p21(spark, sf):
    df = telemetry(spark, sf)
    return df.groupBy("category").agg(
        F.count_if(field(df, "file.path") != "").alias("with_file"), F.count_if(field(df, "registry.path") != "").alias("with_key"),
        F.count_if(field(df, "net.dport") != 0).alias("with_port"))


@query("p22_effective_ids", ev_sql("""
SELECT seq, CASE WHEN seq % 8 = 1 AND raw = 4294967295 THEN pid ELSE raw END AS pid, tid FROM
 (SELECT *, CASE WHEN seq % 3 = 0 THEN 4294967295 ELSE pid END AS raw FROM ev)"""))
def p22(spark, sf):
    df = wide_telemetry(spark, sf)
    df = df.withColumn("pid", F.when(F.col("seq") % 3 == 0, F.lit(4294967295)).otherwise(F.col("pid")))
    return effective_ids(df).select("seq", "pid", "tid")


@query("p22_effective_ids_header", ev_sql("""
SELECT seq, CASE WHEN category IN ('process', 'net') THEN pid ELSE -1 END AS pid, tid FROM ev"""))
def p22b(spark, sf):
    return effective_ids(telemetry(spark, sf).withColumn("pid", F.lit(-1).cast("bigint"))).select("seq", "pid", "tid")


@query("p23_process_uuid", ev_sql("""
SELECT host, pid, count(*) AS starts, count(DISTINCT ts) AS ids FROM ev WHERE name = 'CreateProcess' GROUP BY host, pid"""))
def p23(spark, sf):
    df = telemetry(spark, sf).where("name = 'CreateProcess'")
    return df.withColumn("uuid", process_uuid(F.col("host"), F.col("pid"), F.col("ts"))).groupBy("host", "pid").agg(
        F.count("*").alias("starts"), F.countDistinct("uuid").alias("ids"))


@query("p24_creation_flags", ev_sql("""
SELECT seq, false AS is_remote_thread, name = 'CreateProcess' AND ppid <> real_ppid AS is_surrogate,
 CASE WHEN name = 'CreateProcess' THEN real_ppid ELSE pid END AS stack_pid FROM ev"""))
def p24(spark, sf):
    return creation_flags(telemetry(spark, sf)).select("seq", "is_remote_thread", "is_surrogate", "stack_pid")


@query("p24_remote_threads", ev_sql("SELECT seq, seq % 8 = 0 AND pid <> pid % 3 AS is_remote_thread FROM ev"))
def p24b(spark, sf):
    return creation_flags(wide_telemetry(spark, sf)).select("seq", "is_remote_thread")


