"""Byte patterns, and replay with the state of the capture."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from huntline.operators.scanning import scan_content
from huntline.sources.capture import replay_with_state, write_capture


def test_byte_patterns_against_a_loop(spark):
    rnd = random.Random(3)
    bodies = [bytes(rnd.choices([0, 10, 13, 65, 128, 200, 255], k=rnd.randrange(60))) for _ in range(80)] + [b"", None]
    patterns = [[rnd.choice([0, 10, 13, 65, 128, 200, 255, None]) for _ in range(rnd.randrange(1, 5))] for _ in range(30)]
    text = lambda p: " ".join("??" if b is None else f"{b:02X}" for b in p)
    has = lambda body, p: any(all(b is None or body[i + j] == b for j, b in enumerate(p)) for i in range(len(body) - len(p) + 1))
    want = sorted((i, f"s{n}") for i, body in enumerate(bodies) for n, p in enumerate(patterns) if body is not None and has(body, p))
    df = spark.createDataFrame(list(enumerate(bodies)), "path int, content binary")
    got = scan_content(df, [{"name": f"s{n}", "kind": "hex", "patterns": [text(p)]} for n, p in enumerate(patterns)])
    assert sorted((r.path, r.signature) for r in got.collect()) == want
    with pytest.raises(ValueError, match="two digits"):
        scan_content(df, [{"name": "odd", "kind": "hex", "patterns": ["4d 5"]}])


def test_replay_brings_back_processes_and_paths(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [
        ("a", 1, at(0), "ProcessRundown", "process", 7, {"pid": "7", "name": "x.exe"}), ("a", 2, at(1), "ReadFile", "file", 7, {"file_object": "5"}),
        ("a", 3, at(2), "CreateFile", "file", 7, {"file_object": "5", "file_path": "new"}), ("a", 4, at(3), "ReadFile", "file", 7, {"file_object": "5"}),
        ("a", 5, at(4), "CloseFile", "file", 7, {"file_object": "5"}), ("a", 6, at(5), "ReadFile", "file", 8, {"file_object": "6"}),
        ("b", 7, at(6), "ReadFile", "file", 7, {"file_object": "5"}), ("b", 8, at(7), "ReadFile", "file", None, None)]
    df = spark.createDataFrame(rows, "host string, seq long, ts timestamp, name string, category string, pid long, params map<string,string>")
    df = df.selectExpr("*", "1 AS tid", "0 AS cpu", "'' AS description", "map('k', 'v') AS meta")
    handles = spark.createDataFrame([("a", 5, "old"), ("b", 9, "else")], "host string, file_object long, path string")
    write_capture(df, handles, str(tmp_path))
    got = {r.seq: ((r.params or {}).get("file_path"), r.ps.name) for r in replay_with_state(spark, str(tmp_path), where=lambda d: d["name"] == "ReadFile").collect()}
    assert got == {2: ("old", "x.exe"), 4: ("new", "x.exe"), 6: (None, None), 7: (None, None), 8: (None, None)}
