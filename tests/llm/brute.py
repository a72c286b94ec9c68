"""Plain versions of the operators' results, on lists."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def line_dedup(rows, least=40, docs=5):
    """[(id, text)] -> [(id, n_lines, n_dropped, kept)]"""
    holders, key = defaultdict(set), lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                holders[key(x)].add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text):
    w = [x.translate(ASCII_LOWER) for x in WORD.findall(text or "")]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near(rows, distance=4):
    """[(id, text)] -> [(id, hex fingerprint, component)]"""
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                group[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def similar(rows, least=0.8):
    """[(id, text)] -> the smallest id of each group that pairs of similar texts join"""
    sets = [frozenset(shingles(t)) for _, t in rows]
    holders, group = defaultdict(list), list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, s in enumerate(sets):
        for g in s or {None}:
            holders[g].append(i)
    for members in holders.values():
        for n, i in enumerate(members):
            for j in members[:n]:
                if find(i) != find(j) and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= round(10 * least) * len(sets[i] | sets[j])):
                    group[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i, (d, _) in enumerate(rows):
        out[find(i)] = min(d, out.get(find(i), d))
    return list(out.values())


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: size} -> {source: target}"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left, total = {}, set(order), share * sum(sizes.values())
    while True:
        room = total - sum(fixed.values())
        t = {s: room * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if t[s] > most * sizes[s]]
        if not over:
            return fixed | t
        for s in over:
            fixed[s] = most * sizes[s]
            left.discard(s)
        if not left:
            return fixed


def pieces(rows, encode, window=2048):
    """Checks of a packing are on its pieces; here: id -> the ids it must hold."""
    return [(i, np.array([*encode(t or ""), 1], "<u4")) for i, t in rows]


def secrets(text):
    """{kind: [(start, end)]} by plain scanning."""
    t = text or ""
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    names = names.replace("_?", "_?")
    out = {"assign": [m.span() for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]}
    out["access"] = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out["hex"] = [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return out


def shingles(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def counted(x):
    return Counter(map(str, x))


def crc(x):
    return zlib.crc32(x)
