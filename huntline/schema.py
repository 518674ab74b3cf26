"""Canonical event schema and the event catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
ADDRESS = T.DecimalType(20, 0)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


MODULE = struct(path=S, base=ADDRESS, size=L, checksum=L, default_base=ADDRESS)
THREAD = struct(tid=L, start_address=ADDRESS, start_module=S, start_symbol=S, ustack_base=ADDRESS,
                ustack_limit=ADDRESS, kstack_base=ADDRESS, kstack_limit=ADDRESS, base_prio=I, io_prio=I, page_prio=I)
MMAP = struct(file=S, base=ADDRESS, size=L, type=S, protection=L)
HANDLE = struct(id=L, object=ADDRESS, type=S, name=S)
FRAME = struct(pid=L, addr=ADDRESS, offset=L, symbol=S, module=S, module_addr=ADDRESS)
SIGNATURE = struct(exists=B, trusted=B, serial=S, subject=S, issuer=S,
                   after=T.TimestampType(), before=T.TimestampType())
SECTION = struct(name=S, size=L, entropy=T.DoubleType(), md5=S)
PE = struct(nsections=I, nsymbols=L, base=ADDRESS, entrypoint=ADDRESS, symbols=T.ArrayType(S), imports=T.ArrayType(S),
            resources=T.MapType(S, S), imphash=S, anomalies=T.ArrayType(S), sections=T.ArrayType(SECTION), is_dll=B,
            is_driver=B, is_exec=B, is_dotnet=B, is_modified=B, signature=SIGNATURE)

_PROCESS = dict(pid=L, ppid=L, name=S, cmdline=S, exe=S, cwd=S, sid=S, args=T.ArrayType(S), session_id=I, domain=S,
                username=S, envs=T.MapType(S, S), dtb=ADDRESS, uuid=L, integrity_level=S, is_elevated=B,
                elevation_type=S, is_wow64=B, is_packaged=B, is_protected=B, start_time=T.TimestampType(),
                handles=T.ArrayType(HANDLE))
PARENT = struct(**_PROCESS)
PROCESS = struct(**_PROCESS, modules=T.ArrayType(MODULE), threads=T.ArrayType(THREAD), mmaps=T.ArrayType(MMAP),
                 ancestors=T.ArrayType(S), parent=PARENT, signature=SIGNATURE, pe=PE)

EVENT = struct(seq=L, ts=T.TimestampType(), pid=L, tid=L, cpu=I, name=S, category=S, description=S, host=S,
               params=T.MapType(S, S), meta=T.MapType(S, S), evasions=I, ps=PROCESS, callstack=T.ArrayType(FRAME))

# Event names by category, with the provider that reports them.
EVENT_NAMES = {
    "process": ["CreateProcess", "TerminateProcess", "OpenProcess"],
    "thread": ["CreateThread", "TerminateThread", "OpenThread", "SetThreadContext"],
    "file": ["ReadFile", "WriteFile", "CreateFile", "CloseFile", "DeleteFile", "RenameFile", "SetFileInformation",
             "EnumDirectory", "MapViewFile", "UnmapViewFile"],
    "registry": ["RegCreateKey", "RegOpenKey", "RegCloseKey", "RegSetValue", "RegQueryValue", "RegQueryKey",
                 "RegDeleteKey", "RegDeleteValue"],
    "net": ["Accept", "Send", "Recv", "Connect", "Disconnect", "Reconnect", "Retransmit", "QueryDns", "ReplyDns"],
    "module": ["LoadModule", "UnloadModule"],
    "handle": ["CreateHandle", "CloseHandle", "DuplicateHandle"],
    "mem": ["VirtualAlloc", "VirtualFree"],
    "object": ["CreateSymbolicLinkObject"],
    "threadpool": ["SubmitThreadpoolWork", "SubmitThreadpoolCallback", "SetThreadpoolTimer"],
}
SECURITY_PROVIDER_NAMES = ["OpenProcess", "OpenThread", "SetThreadContext", "QueryDns", "ReplyDns",
                           "CreateSymbolicLinkObject", "SubmitThreadpoolWork", "SubmitThreadpoolCallback",
                           "SetThreadpoolTimer"]
STATE_NAMES = ["ProcessRundown", "ThreadRundown", "ModuleRundown", "FileRundown", "MapFileRundown", "RegKCBRundown",
               "RegCreateKCB", "RegDeleteKCB", "FileOpEnd", "StackWalk", "CreateProcessInternal",
               "ProcessRundownInternal", "LoadModuleInternal", "RegSetValueInternal"]
DNS_NAMES = ["QueryDns", "ReplyDns"]
CATEGORIES = ["registry", "file", "net", "process", "thread", "module", "handle", "driver", "mem", "object",
              "threadpool", "other", "unknown"]


def event_catalog(spark: SparkSession) -> DataFrame:
    """name, category, subcategory, source and the state-only mark of every known event."""
    rows = [(name, category, "dns" if name in DNS_NAMES else "",
             "security" if name in SECURITY_PROVIDER_NAMES else "system", False)
            for category, names in EVENT_NAMES.items() for name in names]
    rows += [(name, "other", "", "system", True) for name in STATE_NAMES]
    return spark.createDataFrame(rows, "name string, category string, subcategory string, source string, is_state boolean")
