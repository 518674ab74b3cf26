"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from itertools import combinations

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def fingerprint(text, k=4):
    ws = words(lower_az(text))
    shingles = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, links):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[top(a)] = top(b)
    return [top(i) for i in range(n)]


def near_components(rows, distance=4):
    """rows: (id, text) -> {id: (fingerprint, smallest id of the component)}."""
    fps = [fingerprint(t) for _, t in rows]
    tops = groups(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= distance])
    least = {}
    for (key, _), t in zip(rows, tops, strict=True):
        least[t] = min(key, least.get(t, key))
    return {key: (fp, least[t]) for (key, _), fp, t in zip(rows, fps, tops, strict=True)}


def without_repeats(rows, window):
    """rows: (key, text) -> per row (n_words, kept words): words covered by a window that starts in a row with a smaller key go."""
    first = {}
    split = [words(t) for _, t in rows]
    for (key, _), ws in zip(rows, split, strict=True):
        if key is not None:
            for i in range(len(ws) - window + 1):
                g = tuple(ws[i : i + window])
                first[g] = min(key, first.get(g, key))
    out = []
    for (key, _), ws in zip(rows, split, strict=True):
        gone = set()
        if key is not None:
            for i in range(len(ws) - window + 1):
                if first[tuple(ws[i : i + window])] < key:
                    gone.update(range(i, i + window))
        out.append((len(ws), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def quality(text):
    """Measurements and failed rule bits of a text."""
    t = text or ""
    ws = words(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 5000 else covered_fast(grams)
    lines = [x for x in t.split("\n") if words(x)]
    m = {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_exclaims": t.count("!"),
    }
    fails = [m["n_words"] < 50, 2 * m["n_repeat_words"] > m["n_words"], m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 25 * m["n_words"],
             4 * m["n_symbols"] > m["n_words"], 2 * m["n_dup_lines"] > m["n_lines"], 4 * m["n_exclaims"] > m["n_words"]]
    return m | {"fail_bits": sum(1 << b for b, f in enumerate(fails) if f)}


def covered_fast(grams):
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, window=13):
    """(n_words, n_hit, sorted ids of items with a window in the text)."""
    ws = BENCH_WORD.findall(lower_az(text))
    hit, found = set(), set()
    for item, other in items:
        bs = BENCH_WORD.findall(lower_az(other))
        n = min(len(bs), window)
        for i in range(len(bs) - n + 1) if n else ():
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == bs[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(ws), len(hit), sorted(found)


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: target} by sharing again what is above, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, free = {}, set(order)
    while free:
        rest, total = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / total for s in free}
        for s in over:
            fixed[s] = float(cap * sizes[s])
            free.discard(s)
    return fixed


def spark_hash(*values):
    """Spark's xxhash64 of numbers (int: 4 bytes; ("long", n): 8 bytes) and strings, nulls skipped."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else v[1].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def mixture(rows, turns, seed=17, cells=64, large=100, cap=3):
    """rows: (key, text, source) -> copies: large documents first, then the others, each by one walk along a line."""
    sizes = [len(words(t)) for _, t, _ in rows]
    total = {}
    for (_, _, s), n in zip(rows, sizes, strict=True):
        total[s] = total.get(s, 0) + n
    goal, copies = targets(total), [0] * len(rows)
    for source in total:
        line = []
        for i, (key, _, s) in enumerate(rows):
            if s == source:
                half = max(0, sizes[i].bit_length() - 4)
                h = spark_hash(seed, None if key is None else ("long", key), ("long", sizes[i]))
                line.append(((half * 16 + (sizes[i] >> half), h % cells, sizes[i], h, key is not None, key or 0), i))
        line.sort()
        least = {}
        for (c, *_), i in line:
            least[c] = min(sizes[i], least.get(c, sizes[i]))
        big = [i for (c, *_), i in line if least[c] * large > goal[source]]
        rest = [i for (c, *_), i in line if least[c] * large <= goal[source]]
        start = spark_hash(seed, "null" if source is None else f"={source}")
        rate = goal[source] / total[source] if total[source] else 0.0
        took = walk(big, sizes, rate, rate * sum(sizes[i] for i in big), start, turns)
        left, room = goal[source] - sum(c * sizes[i] for i, c in took.items()), sum(sizes[i] for i in rest)
        took |= walk(rest, sizes, min(max(left / room, 0.0), float(cap)) if room else 0.0, left, start, turns)
        for i, c in took.items():
            copies[i] = c
    return copies


def walk(line, sizes, rate, goal, start, turns):
    best = None
    for turn in range(turns):
        u = (start + (turn << 30) // turns) % (1 << 30) / (1 << 30)
        took = {i: math.floor(u + (k + 1) * rate) - math.floor(u + k * rate) for k, i in enumerate(line)}
        off = abs(sum(c * sizes[i] for i, c in took.items()) - goal)
        if best is None or off < best[0]:
            best = off, took
    return best[1]
