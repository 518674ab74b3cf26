"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The adapter's columns in SQL.
EV = r"""
ev AS (
  SELECT event_id AS seq, ts, user_id AS pid, event_id % 64 AS tid, event_id % 8 AS cpu, event_type, value,
    CASE event_type WHEN 'click' THEN 'CreateFile' WHEN 'view' THEN 'ReadFile' WHEN 'error' THEN 'CreateProcess'
      WHEN 'signup' THEN 'RegSetValue' ELSE 'Connect' END AS name,
    CASE event_type WHEN 'click' THEN 'file' WHEN 'view' THEN 'file' WHEN 'error' THEN 'process'
      WHEN 'signup' THEN 'registry' ELSE 'net' END AS category,
    'host' || (user_id % 5) AS host, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 4 AS evasions,
    'C:\Users\u' || user_id || '\' || event_type || '_' || (event_id % 7) || '.exe' AS path,
    event_type || '_' || (event_id % 7) || '.exe' AS image,
    CASE WHEN event_id % 11 = 0 THEN 'Access denied' ELSE 'Success' END AS status,
    '\REGISTRY\MACHINE\Software\App' || (event_id % 6) || '\Run\v' || (user_id % 4) AS key_path,
    '10.' || (user_id % 4) || '.0.' || (event_id % 250) AS sip,
    '10.' || (user_id % 4) || '.' || (event_id // 250 % 250) || '.' || (event_id % 250) AS dip,
    1024 + event_id % 5000 AS sport,
    CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 ELSE 8080 END AS dport,
    CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'CREATE' END AS disposition,
    user_id // 2 AS ppid, CASE WHEN event_id % 5 = 0 THEN user_id // 3 ELSE user_id // 2 END AS real_ppid
  FROM events)"""

# The derived call stacks in SQL; addresses as HUGEINT.
STACK = EV + r""",
fr AS (
  SELECT *, list_concat([
    {'addr': CAST(seq + 4096 AS HUGEINT), 'off': seq % 50, 'sym': 'main', 'module': CASE WHEN seq % 9 = 0 THEN 'unbacked' ELSE path END, 'base': CAST(4096 AS HUGEINT)},
    {'addr': CAST(seq + 140000000 AS HUGEINT), 'off': 0, 'sym': 'CreateFileW', 'module': CASE WHEN seq % 2 = 0 THEN 'C:\Windows\System32\kernelbase.dll' ELSE 'C:\Windows\System32\user32.dll' END, 'base': CAST(140000000 AS HUGEINT)},
    {'addr': CAST(seq % 100 + 150000000 AS HUGEINT), 'off': seq % 7, 'sym': CASE WHEN seq % 6 = 0 THEN 'ZwOpenFile' ELSE 'NtCreateFile' END,
     'module': CASE seq % 3 WHEN 0 THEN 'C:\Windows\System32\ntdll.dll' WHEN 1 THEN 'C:\Windows\System32\win32u.dll' ELSE 'C:\tmp\x.dll' END, 'base': CAST(150000000 AS HUGEINT)}],
    CASE WHEN seq % 4 = 0 THEN [] ELSE [
    {'addr': 18446735277616529408::HUGEINT + seq, 'off': 16, 'sym': '?', 'module': CASE WHEN seq % 8 = 1 THEN 'unbacked' ELSE 'C:\Windows\System32\ntoskrnl.exe' END, 'base': 18446735277616529408::HUGEINT}] END) AS fs
  FROM ev),
st AS (SELECT *, list_transform(fs, lambda f: {'addr': f.addr, 'off': f.off, 'sym': f.sym, 'module': f.module, 'base': f.base,
    'kernel': f.addr >= 18446735277616529408::HUGEINT AND f.addr < 18446744073709551615::HUGEINT,
    'name': regexp_extract(f.module, '([^\\]*)$', 1)}) AS s FROM fr)"""


# All parameters of the adapter's events, as a list of key and value in key order.
PARAMS = EV + r""",
evp AS (SELECT *, list_filter([
    {'k': 'cmdline', 'v': CASE WHEN event_type = 'error' THEN '"' || path || '" -k ' || k END},
    {'k': 'create_disposition', 'v': CASE WHEN event_type = 'click' THEN disposition END},
    {'k': 'data', 'v': CASE WHEN event_type = 'signup' THEN 'd' || k END},
    {'k': 'dip', 'v': CASE WHEN event_type = 'purchase' THEN dip END},
    {'k': 'dport', 'v': CASE WHEN event_type = 'purchase' THEN CAST(dport AS VARCHAR) END},
    {'k': 'exe', 'v': CASE WHEN event_type = 'error' THEN path END},
    {'k': 'file_object', 'v': CASE WHEN category = 'file' THEN CAST(seq % 97 AS VARCHAR) END},
    {'k': 'file_path', 'v': CASE WHEN category = 'file' THEN path END},
    {'k': 'io_size', 'v': CASE WHEN event_type = 'view' THEN CAST(k AS VARCHAR) END},
    {'k': 'k', 'v': CAST(k AS VARCHAR)},
    {'k': 'key_path', 'v': CASE WHEN event_type = 'signup' THEN key_path END},
    {'k': 'name', 'v': CASE WHEN event_type = 'error' THEN image END},
    {'k': 'pid', 'v': CAST(pid AS VARCHAR)},
    {'k': 'ppid', 'v': CASE WHEN event_type = 'error' THEN CAST(ppid AS VARCHAR) END},
    {'k': 'real_ppid', 'v': CASE WHEN event_type = 'error' THEN CAST(real_ppid AS VARCHAR) END},
    {'k': 'sip', 'v': CASE WHEN event_type = 'purchase' THEN sip END},
    {'k': 'size', 'v': CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END},
    {'k': 'sport', 'v': CASE WHEN event_type = 'purchase' THEN CAST(sport AS VARCHAR) END},
    {'k': 'status', 'v': status},
    {'k': 'username', 'v': CASE WHEN event_type = 'error' THEN 'user' || (pid % 9) END},
    {'k': 'value_type', 'v': CASE WHEN event_type = 'signup' THEN CASE WHEN seq % 3 = 0 THEN 'REG_BINARY' ELSE 'REG_SZ' END END}],
  lambda e: e.v IS NOT NULL) AS ps FROM ev)"""


def params_sql(body: str, ctes: str = "") -> str:
    """SQL over evp: the adapter's columns and ps, the events' parameters."""
    return f"WITH {PARAMS.strip()}{', ' + ctes if ctes else ''} {body}"


def json_text(value: str) -> str:
    """SQL of a JSON string."""
    return f"""'"' || replace(replace({value}, '\\', '\\\\'), '"', '\\"') || '"'"""


def json_params(entries: str) -> str:
    """SQL of the JSON object of a list of parameters."""
    return f"""'{{' || array_to_string(list_transform({entries}, lambda e: '"' || e.k || '":' || {json_text('e.v')}), ',') || '}}'"""


def query(name: str, sql: str | None = None):
    """Register a query, with SQL when it can be expressed."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def ev_sql(body: str, ctes: str = "") -> str:
    return f"WITH {EV.strip()}{', ' + ctes if ctes else ''} {body}"


def st_sql(body: str) -> str:
    return f"WITH {STACK.strip()} {body}"


def scratch(spark: SparkSession, what: str) -> str:
    """New folder below the shared checkpoint folder for a query that writes and reads back."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile
        root = tempfile.mkdtemp(prefix="huntline-")
    return f"{root}/huntline-{what}-{uuid.uuid4().hex}"
