"""Pairing over sorted rows: any cut into batches, the same pairs as the stream's rule."""

from __future__ import annotations

import random

import pyarrow as pa

from huntline.operators.sweep import pairs_in_order
from huntline.streaming.pairing import LEFT, RIGHT, meet_oldest

KIND = pa.struct([("seq", pa.int64()), ("params", pa.map_(pa.string(), pa.string()))])
SCHEMA = pa.schema([("host", pa.string()), ("_t", pa.int64()), ("_event", KIND), ("_stack", pa.string())])


def test_any_cut_gives_the_pairs_of_the_rule():
    rnd = random.Random(11)
    for _ in range(150):
        rows, want = [], set()
        for host in "ab":
            own = sorted((rnd.randrange(50), rnd.choice([RIGHT, LEFT]), i, None, f"{host}{i}") for i in range(rnd.randrange(1, 25)))
            waiting, out = meet_oldest([], own, 6)
            want |= set(out) | {(w[4], None) for w in waiting if w[1] == LEFT}
            for t, side, i, _, name in own:
                event = {"seq": i, "params": [("n", name)]} if side == LEFT else None
                rows.append({"host": host, "_t": t, "_event": event, "_stack": None if side == LEFT else name})
        whole = pa.RecordBatch.from_pylist(rows, SCHEMA)
        cuts = sorted({0, len(rows), *(rnd.randrange(len(rows) + 1) for _ in range(rnd.randrange(6)))})
        batches = [whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        if rnd.random() < 0.3:
            batches.insert(rnd.randrange(len(batches) + 1), whole.slice(0, 0))
        got = [(r["_event"]["params"][0][1], r["callstack"]) for out in pairs_in_order(iter(batches), ["host"], 6) for r in out.to_pylist()]
        assert set(got) == want and len(got) == len(want)
