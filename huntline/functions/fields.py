"""Field catalogue: dotted field names to columns over the canonical event schema.

A field that does not apply to an event (wrong category, missing parameter,
no process) evaluates to the zero of its type, so predicates stay two-valued.
Families that repeat the same data under other names are derived by rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DNS_NAMES
from . import callstack as cs
from . import params as ps_
from .logic import or_zero, zero
from .paths import base, dir_, ext


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    needs: tuple[str, ...]
    build: Callable[[str | None], Column]
    gate: Callable[[], Column] | None = None
    deprecated: bool = False


FIELDS: dict[str, Field] = {}
NUMERIC = {"long": "bigint", "int": "int", "double": "double", "address": "decimal(20,0)", "bool": "boolean"}


def _add(name, kind, needs, build, gate=None, deprecated=False):
    FIELDS[name] = Field(name, kind, tuple(needs), build, gate, deprecated)


def _param(key: str, kind: str) -> Callable[[str | None], Column]:
    def build(_arg):
        value = F.col("params")[key]
        if kind == "strings":
            return F.when(value != "", F.split(value, r"[|,]\s*"))
        return F.expr(f"try_cast(params['{key}'] as {NUMERIC[kind]})") if kind in NUMERIC else value
    return build


def _category(name: str):
    return lambda: F.col("category") == name


def _named(*names: str):
    return lambda: F.col("name").isin(*names)


# --- evt.* and its deprecated spelling -----------------------------------------------------------

_EVT = {
    "seq": ("long", ["seq"], lambda _: F.col("seq")),
    "pid": ("long", ["pid"], lambda _: F.col("pid")),
    "tid": ("long", ["tid"], lambda _: F.col("tid")),
    "cpu": ("int", ["cpu"], lambda _: F.col("cpu")),
    "name": ("string", ["name"], lambda _: F.col("name")),
    "category": ("string", ["category"], lambda _: F.col("category")),
    "desc": ("string", ["description"], lambda _: F.col("description")),
    "host": ("string", ["host"], lambda _: F.col("host")),
    "time": ("string", ["ts"], lambda _: F.date_format("ts", "HH:mm:ss")),
    "time.h": ("int", ["ts"], lambda _: F.hour("ts")),
    "time.m": ("int", ["ts"], lambda _: F.minute("ts")),
    "time.s": ("int", ["ts"], lambda _: F.second("ts")),
    "time.ns": ("long", ["ts"], lambda _: F.unix_micros("ts") * 1000),
    "date": ("string", ["ts"], lambda _: F.date_format("ts", "yyyy-MM-dd")),
    "date.d": ("int", ["ts"], lambda _: F.dayofmonth("ts")),
    "date.m": ("int", ["ts"], lambda _: F.month("ts")),
    "date.y": ("int", ["ts"], lambda _: F.year("ts")),
    "date.tz": ("string", [], lambda _: F.current_timezone()),
    "date.week": ("int", ["ts"], lambda _: F.weekofyear("ts")),
    "date.weekday": ("string", ["ts"], lambda _: F.date_format("ts", "EEEE")),
    "nparams": ("int", ["params"], lambda _: F.size("params")),
    "arg": ("string", ["params"], lambda arg: F.col("params")[arg]),
    "is_direct_syscall": ("bool", ["evasions"], lambda _: F.col("evasions").bitwiseAND(1) != 0),
    "is_indirect_syscall": ("bool", ["evasions"], lambda _: F.col("evasions").bitwiseAND(2) != 0),
}
for _name, (_kind, _needs, _build) in _EVT.items():
    _add(f"evt.{_name}", _kind, _needs, _build)
    if not _name.startswith("is_"):
        _add(f"kevt.{_name}", _kind, _needs, _build, deprecated=True)

# --- ps.* and ps.parent.* ------------------------------------------------------------------------

_PROCESS = {
    "pid": ("long", "pid"), "name": ("string", "name"), "comm": ("string", "cmdline"), "cmdline": ("string", "cmdline"),
    "exe": ("string", "exe"), "args": ("strings", "args"), "cwd": ("string", "cwd"), "sid": ("string", "sid"),
    "sessionid": ("int", "session_id"), "domain": ("string", "domain"), "username": ("string", "username"),
    "dtb": ("address", "dtb"), "uuid": ("long", "uuid"), "is_wow64": ("bool", "is_wow64"),
    "is_packaged": ("bool", "is_packaged"), "is_protected": ("bool", "is_protected"),
    "token.integrity_level": ("string", "integrity_level"), "token.is_elevated": ("bool", "is_elevated"),
    "token.elevation_type": ("string", "elevation_type"),
}
for _prefix, _path in (("ps", "ps"), ("ps.parent", "ps.parent")):
    for _name, (_kind, _leaf) in _PROCESS.items():
        _add(f"{_prefix}.{_name}", _kind, ["ps"], lambda _a, c=f"{_path}.{_leaf}": F.col(c))
    _add(f"{_prefix}.envs", "strings", ["ps"],
         lambda a, c=f"{_path}.envs": ps_.env_value(F.col(c), a) if a else ps_.env_list(F.col(c)))
    _add(f"{_prefix}.handles", "strings", ["ps"],
         lambda _a, c=f"{_path}.handles": F.transform(F.col(c), lambda h: h["name"]))
    _add(f"{_prefix}.handle.types", "strings", ["ps"],
         lambda _a, c=f"{_path}.handles": F.array_distinct(F.transform(F.col(c), lambda h: h["type"])))
_add("ps.ppid", "long", ["ps"], lambda _: F.col("ps.ppid"))
_add("ps.modules", "strings", ["ps"], lambda _: F.transform("ps.modules", lambda m: base(m["path"])))
_add("ps.ancestor", "strings", ["ps"],
     lambda a: F.get(F.col("ps.ancestors"), F.lit(int(a))) if a else F.col("ps.ancestors"))
for _name, _kind in {"exists": "bool", "trusted": "bool", "serial": "string", "subject": "string", "issuer": "string",
                     "after": "time", "before": "time"}.items():
    _add(f"ps.signature.{_name}", _kind, ["ps"], lambda _a, c=f"ps.signature.{_name}": F.col(c))
for _object, _event in (("ps", "OpenProcess"), ("thread", "OpenThread")):
    _add(f"{_object}.access.mask", "string", ["name", "params"], _param("desired_access", "string"), _named(_event))
    _add(f"{_object}.access.mask.names", "strings", ["name", "params"], _param("desired_access_names", "strings"),
         _named(_event))
    _add(f"{_object}.access.status", "string", ["name", "params"], _param("status", "string"), _named(_event))

# --- pe.* and ps.pe.* ----------------------------------------------------------------------------

_PE = {
    "nsections": ("int", "nsections"), "nsymbols": ("long", "nsymbols"), "address.base": ("address", "base"),
    "address.entrypoint": ("address", "entrypoint"), "symbols": ("strings", "symbols"),
    "imports": ("strings", "imports"), "imphash": ("string", "imphash"), "is_dotnet": ("bool", "is_dotnet"),
    "anomalies": ("strings", "anomalies"), "is_modified": ("bool", "is_modified"),
}
_PE_VERSION = {"company": "CompanyName", "copyright": "LegalCopyright", "description": "FileDescription",
               "file.name": "OriginalFilename", "file.version": "FileVersion", "product": "ProductName",
               "product.version": "ProductVersion"}
for _prefix, _path, _needs in (("pe", "pe", "pe"), ("ps.pe", "ps.pe", "ps")):
    for _name, (_kind, _leaf) in _PE.items():
        _add(f"{_prefix}.{_name}", _kind, [_needs], lambda _a, c=f"{_path}.{_leaf}": F.col(c))
    for _name, _key in _PE_VERSION.items():
        _add(f"{_prefix}.{_name}", "string", [_needs], lambda _a, c=f"{_path}.resources", k=_key: F.col(c)[k])
    _add(f"{_prefix}.resources", "map", [_needs],
         lambda a, c=f"{_path}.resources": F.coalesce(F.col(c)[a], F.lit("")) if a else F.col(c))
for _name in ("is_dll", "is_driver", "is_exec"):
    _add(f"pe.{_name}", "bool", ["pe"], lambda _a, c=f"pe.{_name}": F.col(c))
for _name, _leaf in {"is_signed": "exists", "is_trusted": "trusted"}.items():
    _add(f"pe.{_name}", "bool", ["pe"], lambda _a, c=f"pe.signature.{_leaf}": F.col(c))
for _name in ("serial", "subject", "issuer", "after", "before"):
    _add(f"pe.cert.{_name}", "time" if _name in ("after", "before") else "string", ["pe"],
         lambda _a, c=f"pe.signature.{_name}": F.col(c))

# --- thread.* ------------------------------------------------------------------------------------

for _name, (_kind, _key) in {
    "prio": ("int", "base_prio"), "io.prio": ("int", "io_prio"), "page.prio": ("int", "page_prio"),
    "kstack.base": ("address", "kstack"), "kstack.limit": ("address", "kstack_limit"),
    "ustack.base": ("address", "ustack"), "ustack.limit": ("address", "ustack_limit"),
    "entrypoint": ("address", "start_address"), "start_address": ("address", "start_address"), "pid": ("long", "pid"),
    "teb_address": ("address", "teb"),
}.items():
    _add(f"thread.{_name}", _kind, ["category", "params"], _param(_key, _kind), _category("thread"))
for _name in ("symbol", "module"):
    _add(f"thread.start_address.{_name}", "string", ["name", "params"], _param(f"start_address_{_name}", "string"),
         _named("CreateThread"))


def _stack(kind, build):
    return (kind, ["callstack"], build)


_S = lambda: F.col("callstack")
for _name, (_kind, _needs, _build) in {
    "summary": _stack("string", lambda _: cs.summary(_S(), "user")),
    "kernel_summary": _stack("string", lambda _: cs.summary(_S(), "kernel")),
    "detail": _stack("string", lambda _: cs.detail(_S())),
    "modules": _stack("strings", lambda a: F.get(_S(), F.lit(int(a)))["module"] if a else cs.modules(_S())),
    "symbols": _stack("strings", lambda a: F.get(_S(), F.lit(int(a)))["symbol"] if a else cs.symbols(_S())),
    "addresses": _stack("strings", lambda _: cs.addresses(_S())),
    "is_unbacked": _stack("bool", lambda _: cs.is_unbacked(_S())),
    "final_user_module.name": _stack("string", lambda _: base(cs.final_user_frame(_S())["module"])),
    "final_user_module.path": _stack("string", lambda _: cs.final_user_frame(_S())["module"]),
    "final_user_symbol.name": _stack("string", lambda _: cs.final_user_frame(_S())["symbol"]),
    "final_kernel_module.name": _stack("string", lambda _: base(cs.final_kernel_frame(_S())["module"])),
    "final_kernel_module.path": _stack("string", lambda _: cs.final_kernel_frame(_S())["module"]),
    "final_kernel_symbol.name": _stack("string", lambda _: cs.final_kernel_frame(_S())["symbol"]),
}.items():
    _add(f"thread.callstack.{_name}", _kind, _needs, _build)
# Per-frame memory facts are sampled on the host; they arrive as columns of the frames' owner.
for _name in ("allocation_sizes", "protections", "callsite_leading_assembly", "callsite_trailing_assembly"):
    _kind = "longs" if _name == "allocation_sizes" else "strings"
    _add(f"thread.callstack.{_name}", _kind, ["stack_facts"], lambda _a, c=f"stack_facts.{_name}": F.col(c))
for _name in ("exists", "trusted", "issuer", "subject"):
    _add(f"thread.callstack.final_user_module.signature.{_name}", "bool" if _name in ("exists", "trusted") else "string",
         ["stack_signature"], lambda _a, c=f"stack_signature.{_name}": F.col(c))

# --- module.*, dll.*, image.* --------------------------------------------------------------------

_MODULE_PARAMS = {"base": ("address", "base_address"), "checksum": ("long", "checksum"), "size": ("long", "module_size"),
                  "default_address": ("address", "default_address"), "pid": ("long", "pid"),
                  "signature.type": ("string", "signature_type"), "signature.level": ("string", "signature_level")}
_CERT = {"serial": ("string", "cert_serial"), "subject": ("string", "cert_subject"), "issuer": ("string", "cert_issuer"),
         "after": ("time", "cert_not_after"), "before": ("time", "cert_not_before")}
_MODULE = _category("module")


def _time_param(key: str):
    return lambda _a: F.expr(f"try_cast(params['{key}'] as timestamp)")


for _prefix in ("module", "dll", "image"):
    _rename = {"base": "base.address", "default_address": "default.address"} if _prefix == "image" else {}
    _skip = {"checksum", "default_address"} if _prefix == "dll" else set()
    _add(f"{_prefix}.path", "string", ["category", "params"], _param("file_path", "string"), _MODULE)
    _add(f"{_prefix}.name", "string", ["category", "params"], lambda _a: base(F.col("params")["file_path"]), _MODULE)
    if _prefix != "image":
        _add(f"{_prefix}.path.stem", "string", ["category", "params"],
             lambda _a: F.regexp_replace(F.col("params")["file_path"], r"\.[^.]*$", ""), _MODULE)
        for _name in ("exists", "trusted"):
            _add(f"{_prefix}.signature.{_name}", "bool", ["category", "params"], _param(f"signature_{_name}", "bool"), _MODULE)
    for _name, (_kind, _key) in _MODULE_PARAMS.items():
        if _name not in _skip:
            _add(f"{_prefix}.{_rename.get(_name, _name)}", _kind, ["category", "params"], _param(_key, _kind), _MODULE)
    for _name, (_kind, _key) in _CERT.items():
        _add(f"{_prefix}.{'cert' if _prefix == 'image' else 'signature'}.{_name}", _kind, ["category", "params"],
             _time_param(_key) if _kind == "time" else _param(_key, _kind), _MODULE)
    for _name in ("is_dll", "is_driver", "is_exec", "is_dotnet"):
        _full = f"{_prefix}.pe.is_dotnet" if _name == "is_dotnet" and _prefix != "image" else f"{_prefix}.{_name}"
        if _prefix != "dll" or _name == "is_dotnet":
            _add(_full, "bool", ["name", "params"], _param(_name, "bool"), _named("LoadModule"))

# --- file.*, registry.*, net.*, handle.*, mem.*, dns.*, threadpool.* ------------------------------

_FILE = _category("file")


def _class_info(code: str, kind: str = "long"):
    def build(_arg):
        info = F.expr("try_cast(params['extra_info'] as bigint)")
        return F.when(F.col("params")["class"] == code, info > 0 if kind == "bool" else info)
    return build


for _name, (_kind, _build) in {
    "object": ("address", _param("file_object", "address")), "path": ("string", _param("file_path", "string")),
    "path.stem": ("string", lambda _: F.regexp_replace(F.col("params")["file_path"], r"\.[^.]*$", "")),
    "name": ("string", lambda _: base(F.col("params")["file_path"])),
    "extension": ("string", lambda _: ext(F.col("params")["file_path"])),
    "operation": ("string", _param("create_disposition", "string")), "share.mask": ("string", _param("share_mask", "string")),
    "share_mode": ("string", _param("share_mask", "string")), "io.size": ("long", _param("io_size", "long")),
    "offset": ("address", _param("offset", "address")), "type": ("string", _param("type", "string")),
    "attributes": ("strings", _param("attributes", "strings")),
    "view.base": ("address", _param("view_base", "address")), "view.size": ("long", _param("view_size", "long")),
    "view.type": ("string", _param("section_type", "string")), "view.protection": ("string", _param("protection", "string")),
    "pid": ("long", _param("pid", "long")), "key": ("address", _param("file_key", "address")),
    "info_class": ("string", _param("class", "string")),
    "info.allocation_size": ("long", _class_info("Allocation")), "info.eof_size": ("long", _class_info("EOF")),
    "info.is_disposition_delete_file": ("bool", _class_info("Disposition", "bool")),
    "is_dll": ("bool", _param("is_dll", "bool")), "is_driver": ("bool", _param("is_driver", "bool")),
    "is_exec": ("bool", _param("is_exec", "bool")),
}.items():
    _add(f"file.{_name}", _kind, ["category", "params"], _build, _FILE)
_add("file.status", "string", ["name", "params"], _param("status", "string"), _named("CreateFile"))

_REG = _category("registry")
_KEY = lambda: F.col("params")["key_path"]
for _name, (_kind, _build) in {
    "path": ("string", _param("key_path", "string")),
    "key.name": ("string", lambda _: F.when(F.col("name") == "RegSetValue", base(dir_(_KEY()))).otherwise(base(_KEY()))),
    "kcb": ("address", _param("kcb", "address")),
    "value": ("string", lambda _: F.when(F.col("name") == "RegSetValue", base(_KEY()))),
    "value.type": ("string", _param("value_type", "string")), "data": ("string", _param("data", "string")),
    "status": ("string", _param("status", "string")),
}.items():
    _add(f"registry.{_name}", _kind, ["category", "name", "params"], _build, _REG)

for _name, (_kind, _key) in {
    "dip": ("string", "dip"), "sip": ("string", "sip"), "dport": ("int", "dport"), "sport": ("int", "sport"),
    "dport.name": ("string", "dport_name"), "sport.name": ("string", "sport_name"), "l4.proto": ("string", "l4_proto"),
    "size": ("long", "size"), "sip.names": ("strings", "sip_names"), "dip.names": ("strings", "dip_names"),
}.items():
    _add(f"net.{_name}", _kind, ["category", "name", "params"], _param(_key, _kind),
         lambda: (F.col("category") == "net") & ~F.col("name").isin(DNS_NAMES))
for _name, (_kind, _key) in {"id": ("long", "handle_id"), "object": ("address", "handle_object"),
                             "name": ("string", "handle_name"), "type": ("string", "type_id")}.items():
    _add(f"handle.{_name}", _kind, ["category", "params"], _param(_key, _kind), _category("handle"))
for _name, (_kind, _key) in {"address": ("address", "base_address"), "size": ("long", "region_size"),
                             "alloc": ("string", "alloc_type"), "type": ("string", "page_type"),
                             "protection": ("string", "protection"), "protection.mask": ("string", "protection_mask")}.items():
    _add(f"mem.{_name}", _kind, ["category", "params"], _param(_key, _kind), _category("mem"))
for _name, (_kind, _key) in {"name": ("string", "name"), "rr": ("string", "rr"), "options": ("strings", "options"),
                             "rcode": ("string", "rcode"), "answers": ("strings", "answers")}.items():
    _add(f"dns.{_name}", _kind, ["name", "params"], _param(_key, _kind), _named(*DNS_NAMES))
for _name, (_kind, _key) in {
    "id": ("address", "pool_id"), "task.id": ("address", "task_id"), "callback.address": ("address", "callback"),
    "callback.symbol": ("string", "callback_symbol"), "callback.module": ("string", "callback_module"),
    "callback.context": ("address", "context"), "callback.context.rip": ("address", "context_rip"),
    "callback.context.rip.symbol": ("string", "context_rip_symbol"),
    "callback.context.rip.module": ("string", "context_rip_module"), "subprocess_tag": ("address", "subprocess_tag"),
    "timer.duetime": ("long", "duetime"), "timer.subqueue": ("address", "subqueue"), "timer.address": ("address", "timer"),
    "timer.period": ("long", "period"), "timer.window": ("long", "window"), "timer.is_absolute": ("bool", "absolute"),
}.items():
    _add(f"threadpool.{_name}", _kind, ["category", "params"], _param(_key, _kind), _category("threadpool"))

# --- collections for foreach() --------------------------------------------------------------------

COLLECTIONS = {"ps._modules": "ps.modules", "ps._threads": "ps.threads", "ps._mmaps": "ps.mmaps",
               "ps._ancestors": "ps.ancestors", "ps.pe._sections": "ps.pe.sections",
               "thread._callstack": "callstack", "pe._sections": "pe.sections"}


def collection(name: str) -> Column:
    """Array column behind a pseudo-collection, for use with ``foreach``."""
    return F.col(COLLECTIONS[name])


def _scalar_kind(spec: Field, arg: str | None) -> str:
    if arg is None:
        return spec.kind
    return "string" if spec.kind in ("strings", "map") else spec.kind


def field(df: DataFrame, name: str, arg: str | None = None) -> Column:
    """Column of a field; ``ps.envs[PATH]`` and ``field(df, "ps.envs", "PATH")`` are the same."""
    found = re.match(r"^([^\[]+)\[(.*)\]$", name)
    if found:
        name, arg = found.groups()
    spec = FIELDS.get(name)
    if spec is None:
        raise ValueError(f"unknown field {name!r}")
    kind = _scalar_kind(spec, arg)
    if any(column not in df.columns for column in spec.needs):
        return zero(kind)
    value = spec.build(arg)
    if spec.gate is not None:
        value = F.when(spec.gate(), value)
    return or_zero(value, kind)


def catalogue() -> list[tuple[str, str, bool]]:
    """(name, kind, deprecated) of all fields by name."""
    return sorted((f.name, f.kind, f.deprecated) for f in FIELDS.values())


def required_columns(names: list[str]) -> set[str]:
    """Event columns a set of fields needs; tells which enrichment joins a plan can leave out."""
    return {column for name in names for column in FIELDS[name.split("[")[0]].needs}
