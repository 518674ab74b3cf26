"""Driver-side templates turned into column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags an output line may use.
LINE_TAGS = [".Seq", ".Timestamp", ".Pid", ".Ppid", ".Pexe", ".Pcmd", ".Pname", ".Cwd", ".Exe", ".Cmd", ".Tid", ".Sid",
             ".Process", ".Category", ".Description", ".CPU", ".Type", ".Params", ".Meta", ".Host", ".PE", ".Callstack"]
_FIELD_TAG = re.compile(r"%([1-9]?)\.?([a-z0-9A-Z\[\]._]+)")


def compile_line(template: str, resolve) -> Column:
    """``{{ .Tag }}`` template to a column; ``resolve(tag)`` gives the column of a tag.

    Unknown, empty and unbalanced tags are errors raised on the driver.
    """
    if template.count("{{") != template.count("}}"):
        raise ValueError(f"unbalanced tags in {template!r}")
    pieces = re.split(r"\{\{(.*?)\}\}", template)
    if len(pieces) < 3:
        raise ValueError(f"no tags in {template!r}")
    parts = []
    for position, piece in enumerate(pieces):
        if position % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
            continue
        tag = piece.strip()
        if not tag:
            raise ValueError(f"empty tag at position {position // 2 + 1}")
        if tag not in LINE_TAGS and not tag.startswith(".Params."):
            raise ValueError(f"{tag} is not a known tag; known tags: {' '.join(sorted(LINE_TAGS))}")
        parts.append(F.coalesce(resolve(tag).cast("string"), F.lit("")))
    return F.concat(*parts)


def interpolate(text: str, value_of, count: Column) -> Column:
    """``%[n.]field[arg]`` tags to the field of the n-th event.

    ``value_of(index, name, arg)`` gives the value column. A tag whose event
    does not exist stays as written, a missing value becomes ``N/A``.
    """
    out = F.lit(text)
    for tag in dict.fromkeys(m.group(0) for m in _FIELD_TAG.finditer(text)):
        index, body = _FIELD_TAG.match(tag).groups()
        nth = int(index or 1) - 1
        name, arg = body, None
        if "[" in body and body.find("[") < body.find("]"):
            name, arg = body[:body.index("[")], body[body.index("[") + 1:body.index("]")]
        value = F.coalesce(value_of(nth, name, arg).cast("string"), F.lit("N/A"))
        out = F.when(count > nth, F.replace(out, F.lit(tag), value)).otherwise(out)
    return out


# Date parts of a sink name pattern.
DATE_PARTS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH"}


def target_name(ts: Column, pattern: str) -> Column:
    """Sink or index name with the UTC date parts of the event time filled in."""
    parts = [piece for piece in re.split("(" + "|".join(DATE_PARTS) + ")", pattern) if piece]
    return F.concat(*[F.date_format(ts, DATE_PARTS[p]) if p in DATE_PARTS else F.lit(p) for p in parts])
