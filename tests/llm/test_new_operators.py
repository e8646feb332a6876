"""License scan, periodic runs and fill-in-the-middle against plain versions, on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpusgauge.llm import infill, licenses, periods, queries

from .brute import WORD, lower
from .test_operators import corpus, frame, none, same  # noqa: F401


def all_runs(w):
    """Every run by its definition: stretches equal to themselves at a lag, the smallest lag of each."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(w):
    gone = {i for s, n, q in all_runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_rows(seed=3):
    r, rows = random.Random(seed), []
    for k in range(80):
        words = []
        while len(words) < r.randint(0, 300):
            block = [f"w{r.randrange(r.choice([1, 2, 3, 60]))}" for _ in range(r.randint(1, r.choice([3, 10, 30])))]
            times = r.randint(1, r.choice([2, 5, 9]))
            words += (block * times)[: len(block) * times - r.randint(0, len(block) - 1)]
        rows.append((k, r.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(500, " ".join(["x", "y z"] * 4000)), (501, "a" * 5000), (None, "b " * 7), (502, "c " * 5), (3, "d " * 6), (3, "d " * 6)]


def test_runs_of_numbers():
    """Many short texts at once, and a long period that only the larger scales can find."""
    r = np.random.default_rng(1)
    block = r.integers(0, 50, 700)
    texts = [np.tile(block, 5)[:3300], np.zeros(0, int), r.integers(0, 2, 900), np.tile(block[:33], 4), np.tile(block[:33], 4)[:-1]]
    lengths = np.array([len(t) for t in texts])
    ids = np.concatenate([np.append(t, 10_000 + i) for i, t in enumerate(texts)])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    want = [(s + starts[i], n, q) for i, t in enumerate(texts) for s, n, q in all_runs(t.tolist())]
    assert sorted(map(tuple, periods.find_runs(ids, lengths).tolist())) == sorted(want) and (0, 3300, 700) in want


def test_periods(spark, none):  # noqa: F811
    rows = corpus() + periodic_rows()
    out = periods.collapse_runs(frame(spark, rows), "doc_id", "text").collect()
    same([(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in out], [(k, len(w := WORD.findall(t or "")), tuple(all_runs(w)), collapsed(w)) for k, t in rows])
    clash = frame(spark, rows).withColumnsRenamed({"lang": "runs", "source": "collapsed", "ids": "key"})
    assert periods.collapse_runs(clash, "doc_id", "text").count() == len(rows)
    assert periods.collapse_runs(none, "doc_id", "text").count() == 0


def test_periods_query(spark, tmp_path):
    """The whole query, with the periods it plants."""
    rows = [x for x in corpus() + periodic_rows() if x[0] is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for k, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(k).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        runs = all_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((k, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w).encode()).hexdigest()))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    same(queries.op12_periodic_runs(spark, str(tmp_path)).select(*columns).collect(), want)
    assert planted > 3


def plain_infill(key, text, seed=7, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_rows():
    r = random.Random(4)
    parts = ["\n", "\n\n", "<P", "P>", "<", ">", "über", "漢字\n", "a b\n", "\r\n", "<S", "M>", "<<"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for k in range(200)]
    long = "".join(f"line {i} <\n" for i in range(4000))
    return rows + [(900, "x<M>y\n" * 9), (901, long), (902, "é" * 50_000), (903, long), (903, long), (None, "a\nb\nc"), (None, None), (904, "\n"), *corpus()]


@pytest.mark.parametrize("size", [7, 1 << 18])
def test_infill(spark, none, monkeypatch, size):  # noqa: F811
    """Outputs and digests of texts cut into pieces so small that marks and letters are split, and into usual ones."""
    rows = infill_rows() if size > 7 else [x for x in infill_rows() if len(x[1] or "") < 400]
    monkeypatch.setattr(infill, "PIECE_BYTES", size)
    docs = frame(spark, rows).withColumnsRenamed({"lang": "place", "source": "data", "ids": "form"})
    pieces = infill.pieces(docs, "doc_id", "text", rate=90)
    want = [(k, *plain_infill(k, t or "", rate=90), t or "") for k, t in rows]
    same(infill.texts(pieces).collect(), [(w[0], w[2], w[5]) for w in want])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    same(infill.digests(pieces).collect(), [(*w[:5], sha(w[5]), sha(w[6])) for w in want])
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    empty = infill.pieces(none, "doc_id", "text")
    assert infill.digests(empty).count() == 0 and infill.texts(empty).count() == 0


def test_restoring_reads_only_the_output():
    """Marks that the pieces cut, and texts that look like half a mark."""
    for form, out, want in [("psm", "<P>a<<P<S><S<M>M>", "a<<PM><S"), ("spm", "<S><P><M>", ""), ("plain", "<S", "<S")]:
        for size in (1, 2, 3, 5, 100):
            back, got = infill._Back(form), []
            for i in range(0, len(out), size):
                got += back.feed(out[i : i + size].encode())
            got += back.feed(b"", last=True)
            assert b"".join(d for _, d in sorted(got)).decode() == want


def plain_licenses(text, notices=licenses.NOTICES):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = pattern.findall(lower(text))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 0.0
    for label, notice in notices:
        t, votes = pattern.findall(lower(notice)), {}
        for j in range(len(t) - 2):
            for i in range(len(w) - 2):
                if w[i : i + 3] == t[j : j + 3]:
                    votes[i - j] = votes.get(i - j, 0) + 1
        for at in votes:
            near = range(at, at + licenses.SLACK + 1)
            share = sum(any(0 <= j + d < len(w) and w[j + d] == x for d in near) for j, x in enumerate(t)) / len(t)
            if sum(votes.get(d, 0) for d in near) >= licenses.VOTES * max(1, len(t) - 2) and share >= licenses.WORDS:
                labels.add(label)
                score = max(score, share)
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return len(w), len(places), first, last, ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def license_rows():
    r, rows = random.Random(9), []
    for k in range(150):
        words = [f"v{r.randrange(40)}" for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            notice = r.choice(licenses.NOTICES)[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                at = r.randrange(len(notice))
                notice[at : at + r.randint(0, 1)] = r.choice([[], ["zz"], ["zz", "yy"]])
                notice = notice or ["x"]
            words[(at := r.randint(0, len(words))) : at] = notice
        rows.append((k, r.choice([" ", "\n"]).join(words).upper() if r.random() < 0.2 else " ".join(words)))
    odd = ["MIT License", "mit-license.apache_license", "the GNU general\npublic  license", "mit license " * 2000, "Released under the MIT License. " * 1500, "über License", "MIT"]
    return rows + list(enumerate(odd, 700)) + [(None, odd[0]), (None, odd[4]), (705, None), (3, rows[3][1]), (3, rows[3][1]), (3, rows[4][1])]


@pytest.mark.parametrize("sent", [licenses.SENT_ROWS, 0])
def test_licenses(spark, none, monkeypatch, sent):  # noqa: F811
    monkeypatch.setattr(licenses, "SENT_ROWS", sent)
    rows = license_rows() + corpus()[:40]
    docs = frame(spark, rows).withColumnsRenamed({"lang": "grams", "source": "h1", "ids": "labels", "id": "key"})
    want = [(k, *plain_licenses(t)) for k, t in rows]
    same(licenses.scan_licenses(docs, "doc_id", "text").collect(), want)
    assert {"bsd", "mpl", "reserved", "cc-by-nc"} <= set(",".join(w[6] for w in want).split(","))
    assert licenses.scan_licenses(none, "doc_id", "text").count() == 0


def test_notices_of_few_words(spark):
    rows = [(1, "some all rights reserved by us"), (2, "short one")]
    out = licenses.scan_licenses(frame(spark, rows), "doc_id", "text", (("x", "All rights reserved"), ("y", "short one"))).collect()
    same([(r["doc_id"], r["labels"], r["score"]) for r in out], [(1, "x", 1.0), (2, "", 0.0)])
