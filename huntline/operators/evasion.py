"""Direct and indirect system call detectors over call stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import callstack as cs
from ..functions.logic import or_, true_or_false
from ..functions.paths import base

# Modules that may host the last user frame of a regular system call.
CALL_MODULES = ["ntdll.dll", "win32.dll", "win32u.dll", "wow64win.dll", "wow64cpu.dll"]
# System call stub expected per event, and the stub's length in bytes.
SYSCALL_STUBS = {
    "CreateProcess": "NtCreateUserProcess", "CreateThread": "NtCreateThreadEx", "TerminateThread": "NtTerminateThread",
    "RegCreateKey": "NtCreateKey", "RegDeleteKey": "NtDeleteKey", "RegSetValue": "NtSetValueKey",
    "RegDeleteValue": "NtDeleteValueKey", "SetThreadContext": "NtSetContextThread", "OpenProcess": "NtOpenProcess",
    "OpenThread": "NtOpenThread", "VirtualAlloc": "NtAllocateVirtualMemory", "CreateFile": "NtCreateFile",
    "DeleteFile": "NtDeleteFile", "RenameFile": "NtSetInformationFile",
    "CreateSymbolicLinkObject": "NtCreateSymbolicLinkObject",
}
STUB_LENGTH = 23
# Fixed values: (event, last user symbols, symbols of which one must be in the stack) known to be harmless.
HARMLESS = [
    ("CreateProcess", ["ZwDeviceIoControlFile"], ["AttachConsole"]),
    ("CreateThread", ["ZwSetInformationWorkerFactory", "ZwReleaseWorkerFactoryWorker"], []),
    ("OpenThread", ["ZwAlpcOpenSenderThread"], []),
    ("OpenProcess", ["ZwAlpcOpenSenderProcess"], []),
    ("CreateFile", ["ZwOpenFile", "NtOpenFile", "ZwQueryAttributesFile", "ZwQueryFullAttributesFile",
                    "ZwQueryInformationByName", "ZwQuerySystemInformation"], []),
    ("DeleteFile", ["ZwSetInformationFile"], ["DeleteFileA", "DeleteFileW"]),
    ("RegCreateKey", ["ZwDeviceIoControlFile"], ["DllUnregisterServer"]),
]
EVASIONS = {"direct_syscall": 1, "indirect_syscall": 2}


def _last_user(stack: Column) -> Column:
    return cs.final_userspace_frame(stack)


def direct_call(stack: Column) -> Column:
    """The last user frame is backed by a module that does not issue system calls."""
    frame = _last_user(stack)
    module = F.lower(base(frame["module"]))
    return true_or_false(frame.isNotNull() & ~cs.is_unbacked_frame(frame) & ~module.isin(CALL_MODULES))


def indirect_call(df: DataFrame, stub_offsets: DataFrame) -> DataFrame:
    """``is_indirect``: the last user frame is in the loader module but outside the stub of this event.

    ``stub_offsets``: name, rva; at most one row per event name.
    """
    out = df.join(stub_offsets.select("name", F.col("rva").alias("_rva")), "name", "left")
    stack = F.col("callstack")
    frame = _last_user(stack)
    harmless = or_(*[
        (F.col("name") == event) & frame["symbol"].isin(symbols)
        & (or_(*[cs.contains_symbol(stack, s) for s in inside]) if inside else F.lit(True))
        for event, symbols, inside in HARMLESS])
    at = (frame["addr"] - frame["module_addr"]).cast("bigint")
    outside = ~((at > F.col("_rva")) & (at <= F.col("_rva") + STUB_LENGTH))
    hit = (frame.isNotNull() & ~cs.is_unbacked_frame(frame) & (F.lower(base(frame["module"])) == "ntdll.dll")
           & ~harmless & F.col("_rva").isNotNull() & outside)
    return out.withColumn("is_indirect", true_or_false(hit)).drop("_rva")


def tag_evasions(df: DataFrame, detected: dict[str, Column]) -> DataFrame:
    """Set the evasion bits and list the names under ``meta['evasions']``."""
    bits = F.col("evasions")
    for name, hit in detected.items():
        bits = bits.bitwiseOR(F.when(true_or_false(hit), F.lit(EVASIONS[name])).otherwise(F.lit(0)))
    names = F.filter(F.array(*[F.when(true_or_false(hit), F.lit(name)) for name, hit in detected.items()]),
                     lambda n: n.isNotNull())
    earlier = F.col("meta")["evasions"]
    listed = F.array_join(F.concat(F.when(earlier.isNotNull(), F.array(earlier)).otherwise(
        F.expr("cast(array() as array<string>)")), names), ",")
    meta = F.when(F.size(names) > 0, F.map_concat(F.map_filter("meta", lambda k, _: k != "evasions"),
                                                  F.create_map(F.lit("evasions"), listed))).otherwise(F.col("meta"))
    return df.withColumn("meta", meta).withColumn("evasions", bits)
