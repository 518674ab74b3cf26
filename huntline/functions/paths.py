"""Windows path, command line and registry key functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



_VOLUME = r"^([A-Za-z]:|[\\/]{2}[^\\/.][^\\/]*[\\/][^\\/]+)"


def volume(path: Column) -> Column:
    """Drive (``C:``) or share (``\\\\host\\share``) part, "" when there is none."""
    return F.regexp_extract(path, _VOLUME, 1)


def _base_name(path: Column) -> Column:
    """Last element; ordinary paths take the plain split, odd shapes the exact rules."""
    rest = F.regexp_replace(path, _VOLUME, "")
    trimmed = F.regexp_replace(rest, r"[\\/]+$", "")
    exact = (F.when(path == "", F.lit("."))
             .when((trimmed == "") & (rest != ""), F.lit("\\"))
             .when(trimmed == "", F.lit("."))
             .otherwise(F.regexp_extract(trimmed, r"([^\\/]*)$", 1)))
    name = F.substring_index(path, "\\", -1)
    plain = (name != "") & ~name.contains("/") & ~name.contains(":") & ~path.startswith("\\\\")
    return F.when(plain, name).otherwise(exact)


def _stem(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\."), F.regexp_extract(name, r"(?s)^(.+)\.", 1)).otherwise(name)


def base(path: Column, ext: bool = True, array: bool = False) -> Column:
    """Last path element; ``ext=False`` also cuts the extension."""
    one = (lambda p: _base_name(p)) if ext else (lambda p: _stem(_base_name(p)))
    return F.transform(path, one) if array else one(path)


def _clean(path: Column) -> Column:
    """Backslash form with repeated separators folded and no trailing separator."""
    return F.regexp_replace(F.regexp_replace(path, r"/", r"\\"), r"(?<=.)\\+", r"\\")


def _dir_name(path: Column) -> Column:
    vol = F.regexp_replace(volume(path), r"/", r"\\")
    rest = _clean(F.regexp_replace(path, _VOLUME, ""))
    parent = F.regexp_extract(rest, r"^(.*)\\[^\\]*$", 1)
    body = (F.when(rest.rlike(r"^\\[^\\]*$"), F.lit("\\"))
            .when(~rest.contains("\\"), F.lit("."))
            .otherwise(parent))
    unc = vol.startswith("\\\\") & (body == ".")
    return F.when(unc, vol).otherwise(F.concat(vol, body))


def dir_(path: Column, array: bool = False) -> Column:
    return F.transform(path, _dir_name) if array else _dir_name(path)


def ext(path: Column, dot: bool = True) -> Column:
    """Extension of the last element with or without the dot, "" when absent."""
    found = F.regexp_extract(path, r"(\.[^.\\/]*)$", 1)
    return found if dot else F.regexp_replace(found, r"^\.", "")


def is_abs(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^([A-Za-z]:[\\/]|[\\/]{2}[^\\/.][^\\/]*[\\/][^\\/]+)"), F.lit(False))


# System processes whose command line may lack the directory.
SYSTEM_PROCESSES = ["dwm.exe", "wininit.exe", "winlogon.exe", "fontdrvhost.exe", "sihost.exe", "taskhostw.exe",
                    "dashost.exe", "ctfmon.exe", "svchost.exe", "csrss.exe", "services.exe", "audiodg.exe",
                    "kernel32.dll"]
# Native registry roots and the hive they stand for.
HIVE_PREFIXES = [
    ("HKEY_LOCAL_MACHINE", ["\\REGISTRY\\MACHINE", "\\Registry\\Machine", "\\Registry\\MACHINE",
                            "\\registry\\machine"]),
    ("HKEY_CLASSES_ROOT", ["\\REGISTRY\\MACHINE\\SOFTWARE\\CLASSES", "\\Registry\\Machine\\Software\\Classes",
                           "\\REGISTRY\\COMROOT\\CLASSES"]),
    ("HKEY_USERS", ["\\REGISTRY\\USER", "\\Registry\\User"]),
]
CMDLINE_TOKEN = r'("[^"]+?"\S*|\S+)'


def cmdline_split(cmdline: Column) -> Column:
    """Arguments; a double-quoted run counts as one."""
    return F.regexp_extract_all(cmdline, F.lit(CMDLINE_TOKEN), F.lit(1))


def cmdline_clean(cmdline: Column) -> Column:
    """Unquote the executable or drop its native path prefix; the rest is re-joined by single spaces."""
    args = cmdline_split(cmdline)
    exe = F.coalesce(F.get(args, F.lit(0)), F.lit(""))
    tail = F.slice(args, 2, F.greatest(F.size(args) - 1, F.lit(0)))

    def rejoin(head: Column) -> Column:
        return F.array_join(F.concat(F.array(head), tail), " ")

    quoted = exe.startswith('"') & exe.endswith('"') & (F.length(exe) > 1)
    native = (F.length(exe) > 4) & ((F.substring(exe, 2, 2) == "??") | (F.substring(exe, 3, 2) == "?\\"))
    return (F.when(quoted, rejoin(F.substring(exe, F.lit(2), F.length(exe) - 2)))
            .when(native, rejoin(F.substring(exe, F.lit(5), F.length(exe))))
            .otherwise(cmdline))


def expand_system_root(text: Column, system_root: str = "C:\\Windows") -> Column:
    return F.regexp_replace(text, r"%SystemRoot%|^\\SystemRoot|%systemroot%", system_root.replace("\\", "\\\\"))


def cmdline_normalize(cmdline: Column, name: Column, system_root: str = "C:\\Windows") -> Column:
    text = expand_system_root(cmdline_clean(cmdline), system_root)
    missing = ~text.rlike(r"^[a-zA-Z]:\\") & name.isin(SYSTEM_PROCESSES)
    return F.when(missing, F.concat(F.lit(system_root + "\\System32\\"), text)).otherwise(text)


def cmdline_exe(cmdline: Column) -> Column:
    """Everything up to the first ``.exe``, "" when there is none."""
    at = F.instr(F.lower(cmdline), ".exe")
    return F.when(at > 1, F.substring(cmdline, F.lit(1), at + 3)).otherwise(F.lit(""))


def _after(path: Column, prefix: str) -> Column:
    return F.when(F.length(path) > len(prefix), F.substring(path, F.lit(len(prefix) + 2), F.length(path))
                  ).otherwise(F.lit(""))


def registry_key(path: Column, sid: str | None = None) -> Column:
    """Native key name as ``HKEY_…\\subkey``; keys of ``sid`` become the current user's."""
    out = None
    for hive, prefixes in HIVE_PREFIXES:
        for prefix in prefixes:
            sub = _after(path, prefix)
            key = _join(F.lit(hive), sub) if hive != "HKEY_USERS" else _user_key(sub, sid)
            out = F.when(path.startswith(prefix), key) if out is None else out.when(path.startswith(prefix), key)
    return out.otherwise(path)


def _join(root: Column, sub: Column) -> Column:
    return F.when(sub == "", root).otherwise(F.concat(root, F.lit("\\"), sub))


def _user_key(sub: Column, sid: str | None) -> Column:
    users = _join(F.lit("HKEY_USERS"), sub)
    if not sid:
        return users
    owner = F.split_part(sub, F.lit("\\"), F.lit(1))
    rest = F.when(sub.contains("\\"), F.substring(sub, F.instr(sub, "\\") + 1, F.length(sub))).otherwise(F.lit(""))
    mine = F.lit("HKEY_CURRENT_USER")
    return (F.when(owner == sid + "_Classes", _join(mine, F.concat(F.lit("Software\\Classes\\"), rest)))
            .when((owner == sid) & rest.contains("_Classes"),
                  _join(mine, F.regexp_replace(rest, "^(.*?)_Classes", r"$1Software\\Classes")))
            .when(owner == sid, _join(mine, rest))
            .otherwise(users))


def file_type(path: Column) -> Column:
    """Rough kind of a file object by its name."""
    return (F.when(path == "", F.lit("other"))
            .when(ext(path) == "", F.lit("directory"))
            .when(~path.startswith("\\Device"), F.lit("file"))
            .when(path.startswith("\\Device\\HarddiskVolume"), F.lit("file"))
            .otherwise(F.lit("device")))


def device_prefix(path: Column) -> Column:
    """``\\Device\\Name`` part of a device path, the whole text if nothing follows."""
    return F.regexp_extract(path, r"^(\\[^\\]*\\[^\\]*)", 1)


def map_device_path(path: Column, devices: dict[str, str], system_root: str = "C:\\Windows") -> Column:
    """Device prefix to drive letter; ``devices`` is the host's short drive table."""
    prefix = device_prefix(path)
    def tail(start) -> Column:
        return F.substring(path, start if isinstance(start, Column) else F.lit(start), F.length(path))

    sandbox = (prefix == "\\Device\\vmsmb") & path.contains("os")
    out = F.when(sandbox, F.concat(F.lit("C:"), tail(F.instr(path, "os") + 2)))
    for device, drive in devices.items():
        out = out.when(prefix == device, F.concat(F.lit(drive), tail(len(device) + 1)))
    rooted = path.startswith("\\SystemRoot") | path.startswith("\\SYSTEMROOT")
    return out.when(rooted, F.concat(F.lit(system_root), tail(12))).otherwise(path)


def handle_name(kind: Column, name: Column, devices: dict[str, str], sid: str | None = None) -> Column:
    """Object name of a handle by its type: keys as hives, files as drive paths."""
    return (F.when(kind == "Key", registry_key(name, sid))
            .when(kind == "File", map_device_path(name, devices))
            .otherwise(name))
