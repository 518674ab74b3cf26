"""Tables of overlapping networks against brute force."""

from __future__ import annotations

import ipaddress
import random

import pytest

from huntline.operators.networks import match_networks


def brute(addresses, nets):
    known = []
    for text, name in nets:
        try:
            known.append((ipaddress.ip_network(text, strict=False), name))
        except ValueError:
            continue
    out = []
    for i, a in addresses:
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            out.append((i, None))
            continue
        fits = [(-n.prefixlen, name) for n, name in known if n.version == ip.version and ip in n]
        out.append((i, min(fits)[1] if fits else None))
    return sorted(out)


@pytest.mark.parametrize("rows_per_slice", [None, 60])
def test_against_brute_force(spark, rows_per_slice):
    rnd = random.Random(7)
    four = lambda: f"10.{rnd.randrange(2)}.{rnd.choice([0, 1, 127, 128, 255])}.{rnd.choice([0, 1, 63, 64, 127, 128, 254, 255])}"
    six = lambda: f"2001:db8:{rnd.choice(['0', '1', 'ffff'])}::{rnd.choice(['0', '1', '8000', 'ffff'])}:{rnd.choice(['0', '1', 'ffff'])}"
    nets = [(f"{four()}/{rnd.randrange(8, 33)}", f"a{i:03}") for i in range(150)] + [(f"{six()}/{rnd.choice([20, 32, 40, 48, 64, 65, 96, 112, 127, 128])}", f"b{i:03}") for i in range(80)]
    nets += [("255.255.255.0/24", "last"), ("ffff::/16", "last6"), ("nonsense", "x"), ("10.0.0.0/33", "y"), ("300.1.1.1/8", "z"), ("10.1.2.3", "bare"), (nets[0][0], "a000again")]
    addresses = [four() for _ in range(200)] + [six() for _ in range(150)] + ["255.255.255.255", "255.255.254.255", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8.8.8.8", "::1", "", "no", "0.0.0.0"]
    rows = list(enumerate(addresses))
    df = spark.createDataFrame(rows, "seq long, ip string").repartition(4)
    table = spark.createDataFrame(nets, "network string, name string")
    got = sorted((r.seq, r.network_name) for r in match_networks(df, "ip", table, rows_per_slice=rows_per_slice).collect())
    assert got == brute(rows, nets)
    assert len({n for _, n in got}) > 40


def test_everything_and_nothing(spark):
    df = spark.createDataFrame([(1, "1.2.3.4"), (2, "9::9"), (3, None)], "seq long, ip string")
    whole = spark.createDataFrame([("0.0.0.0/0", "all4"), ("::/0", "all6"), ("1.0.0.0/8", "one")], "network string, name string")
    assert sorted((r.seq, r.network_name) for r in match_networks(df, "ip", whole).collect()) == [(1, "one"), (2, "all6"), (3, None)]
    assert [r.network_name for r in match_networks(df, "ip", whole.limit(0)).collect()] == [None] * 3
