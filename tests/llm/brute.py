"""Plain Python versions of the contracts, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_rules(text):
    w = WORD.findall(text or "")
    t = text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def mix_targets(sizes: dict):
    """source -> size, to source -> target, by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free}
        above = [s for s in free if target[s] > 2 * sizes[s]]
        if not above:
            return fixed | target
        for s in above:
            fixed[s] = 2.0 * sizes[s]
        if len(fixed) == len(names):
            return fixed


def base_secrets(text):
    t = text or ""
    rules = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(rules) for m in p.finditer(t) if len(m[g]) >= n]
    found.sort()
    return Counter(x[2] for x in found), ",".join(f"{name}:{a}:{b}" for a, _, name, b in found)


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near_classes(rows, threshold=0.8):
    """(doc_id, text) rows -> [(doc_id, class, links)], by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    common = Counter()
    for group in index.values():
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                common[group[a], group[b]] += 1
    for (i, j), c in common.items():
        if c >= threshold * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [(d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
