"""Plain versions of the operators' contracts, for small tables of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


def repeats(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                mask[i : i + n] = True
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out.append((d, len(b), int(mask.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    return out


def components(rows, k, percent=80):
    """(doc_id, set size, smallest id reachable)."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    inverted, parent = defaultdict(list), list(range(len(rows)))
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in inverted[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def contamination(rows, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, named = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])] - {None}
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)))
    return out


def unigram(rows):
    """(doc_id, held out, tokens, known, N, base score)."""
    count = Counter()
    for d, t in rows:
        if fold(d) != 1:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        w = [*words(t), None]
        out.append((d, fold(d) == 1, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


PII = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def pii(t):
    def ok(k, x):
        d = re.sub("[^0-9]", "", x)
        if k == 1:
            return all(int(p) <= 255 for p in x.split("."))
        if k == 2:
            return 12 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return k != 3 or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PII) for m in re.finditer(p, t or "") if ok(k, m[0]))


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
