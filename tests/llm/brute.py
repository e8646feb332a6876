"""Plain versions of what the operators must return, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def raw(values):
    return np.array(values, "<u4").tobytes()


def shards(docs, path, end=2):
    t, out, start = library(path), [], 0
    for k, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = [*ids(t, text), end]
        out.append((k, start, len(x), zlib.crc32(raw(x))))
        start += len(x)
    return out


def round_trip(docs, path):
    t, out = library(path), []
    for k, text in docs:
        x = ids(t, text)
        out.append((k, len(x), hashlib.sha256(raw(x)).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    return out


def measures(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def base_failed(n, repeat):
    return n < 50 or 100 * repeat > 50 * n


def binomial(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def repeats(docs, width=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(docs, words, strict=True):
        hit = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                hit.update(range(i, i + width))
        out.append((k, len(w), len(hit), " ".join(x for i, x in enumerate(w) if i not in hit)))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def joined(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def similar(docs, n, num, den=100):
    """(key, size, component) with non-null keys."""
    sets = [(k, shingles(t, n)) for k, t in docs]
    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter()
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                shared[a, b] += 1
    links = [(sets[a][0], sets[b][0]) for (a, b), c in shared.items() if den * c >= num * (len(sets[a][1]) + len(sets[b][1]) - c)]
    to = joined({k for k, _ in sets}, links)
    return [(k, len(s), to[k]) for k, s in sets]


def vectors(rows, least=0.9):
    ok = [v is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    unit = np.array([np.array(v, float) / np.linalg.norm(np.array(v, float)) if f else np.zeros(1) for (_, v), f in zip(rows, ok, strict=True) if f])
    at = [i for i, f in enumerate(ok) if f]
    hit = unit @ unit.T >= least if len(at) else np.zeros((0, 0), bool)
    n, links = [0] * len(rows), []
    for x, i in enumerate(at):
        for y in np.flatnonzero(hit[x]):
            if x != y:
                n[i] += 1
                links.append((rows[i][0], rows[at[y]][0]))
    to = joined({k for k, _ in rows}, links)
    return [(k, c, to[k], to[k] == k) for (k, _), c in zip(rows, n, strict=True)]


def pages(rows):
    body = [(k, (h or "").encode()) for k, h in rows]
    last = {}
    for k, b in body:
        last[b] = max(last.get(b, k), k)
    return [(k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == k else "revisit", None if last[b] == k else last[b]) for k, b in body]
