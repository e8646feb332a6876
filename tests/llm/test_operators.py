"""Every operator against its plain version, on odd inputs: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import bpe, components, embeddings, jaccard, mph, packing, quality, queries, shards, substrings, token_counts, toxicity, warc
from corpusgauge.llm.queries import BYTE_BPE, WORD_BPE, vocabulary
from corpusgauge.llm.shared import new_folder

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, id string, score string"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["The", "the,", "über", "漢字", "#x", "don't", "a"]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = [None, "", " ", "one", "two words", "  \n\t ", "x" * 9000, "hot " * 300, passage, passage]
    for _ in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 400))]
        if r.random() < 0.3:
            words[r.randint(0, len(words)) : 0] = passage.split()
        texts.append(("\n" if r.random() < 0.1 else " ").join(words))
        if r.random() < 0.3:
            twin = words[:]
            for _ in range(r.randint(0, 3)):
                twin[r.randrange(len(twin))] = "edit%d" % r.randint(0, 9)
            texts.append(" ".join(twin))
    texts.append(" ".join(r.choice(vocab) for _ in range(9000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[-2], rows[8]]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en" if (k or 0) % 3 else None, "s", None, "i", "j", "k") for k, t in rows], SCHEMA).repartition(3)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_round_trip(docs, rows, none, spark):
    path = vocabulary(BYTE_BPE)
    plain = docs.select("doc_id", "text")
    out = bpe.decode(bpe.encode(plain, "text", path, leaf_chars=500), "ids", path).collect()
    want = {k: brute.ids(brute.library(path), t) for k, t in rows}
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]] and r["decoded"] == (r["text"] or "")
    assert bpe.encode(none.drop("ids"), "text", path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, "text", path)


def test_join_of_unsplit_text():
    enc, r = bpe.encoder(vocabulary(BYTE_BPE)), random.Random(4)
    for text in ["the" * 900, "".join(r.choice("abcdeth'") for _ in range(4000)), "漢字é" * 300, "x " * 900, "<|endoftext|>" * 40, "  \n" * 200]:
        for size in (97, 1000):
            parts = [text[i : i + size] for i in range(0, len(text), size)]
            joined = bpe.join_tree(enc, [(p.encode(), np.frombuffer(enc.encode(p), "<u4")) for p in parts])
            assert joined.tobytes() == enc.whole(text)


def test_packing(docs, rows, none):
    path, size = vocabulary(BYTE_BPE), 256
    out = packing.pack_documents(docs, "doc_id", "text", path, size=size, open_bins=8).collect()
    pieces, bins = Counter(), {}
    for r in out:
        assert 4 * r["length"] == len(r["ids"]) and r["length"] <= size
        pieces[r["doc_id"], r["piece"], r["start"], zlib.crc32(r["ids"])] += 1
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    t, want, total = brute.library(path), Counter(), 0
    for k, text in rows:
        ids = [*brute.ids(t, text), 2]
        total += len(ids)
        first = len(ids) % size or size
        for n, a in enumerate([0, *range(first, len(ids), size)]):
            want[k, n, a, zlib.crc32(brute.raw(ids[a : first if not n else a + size]))] += 1
    assert pieces == want
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= 1.25 * total / size + 1
    assert packing.pack_documents(none, "doc_id", "text", path).count() == 0


def test_fullest_bin_closes_first():
    fit = packing.BestFit(10, 2)
    assert fit.add("a", 6) is None and fit.add("b", 7) is None
    assert fit.add("c", 8) == ["b"] and fit.add("d", 4) == ["a", "d"]
    assert list(fit.rest()) == [(2, ["c"])]


def test_shards(spark, docs, rows, none):
    folder, path = new_folder(spark, "shards"), vocabulary(WORD_BPE)
    rows = [*rows, (None, "no key"), (-5, "below")]
    shards.write_shards(frame(spark, rows), "doc_id", "text", path, folder)
    out = shards.read_shards(spark, folder).collect()
    sizes, crc = Counter(), Counter()
    for r in out:
        crc[r["key"], r["n_tokens"], zlib.crc32(r["ids"])] += 1
        sizes[r["start"]] += r["n_tokens"]
    want = brute.shards(rows, path)
    assert crc == Counter((k, n, c) for k, _, n, c in want) and set(sizes) == {s for _, s, _, _ in want}
    asked = spark.createDataFrame([(3,), (-5,), (10**12,), (None,), (8,)], "doc_id long")
    found = shards.lookup(asked, "doc_id", folder).collect()
    same([(r["key"], zlib.crc32(r["ids"])) for r in found], [(k, c) for k, _, _, c in want if k in (3, -5, 8)])
    empty = new_folder(spark, "shards")
    shards.write_shards(none, "doc_id", "text", path, empty)
    assert shards.read_shards(spark, empty).count() == 0


def test_normalized_words_with_marks(spark):
    """Lower-casing and composing may end a word in a combining mark, which stays with the punctuation after it."""
    words = ["AL\u0130", "al\u0130", "\u0130", "\u0958", "\u0915\u095f", "\ufb2a", "\u05d0\ufb35", "\ufb1d", "STRASSE", "stra\u00dfe", "\u00fcber", "\u6f22\u5b57", "e\u0301", "\u01c5", "\u1e9e", "\u039f\u03a3"]
    texts = [f"{w}{m} the {w}{m}" for w in words for m in ".,;:!?"] + [" ".join(w + m for w in words for m in (".", "?!", ""))]
    for name in (WORD_BPE, BYTE_BPE):
        path, t = vocabulary(name), brute.library(vocabulary(name))
        enc = bpe.PieceEncoder(path)
        assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in texts] == [brute.ids(t, x) for x in texts]
    folder, rows = new_folder(spark, "shards"), list(enumerate(texts))
    shards.write_shards(frame(spark, rows), "doc_id", "text", vocabulary(WORD_BPE), folder)
    got = [(r["key"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in shards.read_shards(spark, folder).collect()]
    same(got, brute.shards(rows, vocabulary(WORD_BPE)))


def test_texts_by_their_merges():
    """Texts of many scripts, blanks and marks: the same ids as the library's, whether the short way takes them or not."""
    r = random.Random(7)
    latin = [chr(c) for c in range(33, 0x250) if chr(c).isprintable()]
    blanks = [" ", " ", " ", "\n", "  ", "\t", "\r\n", " \n ", "\x0b", "\xa0", "\x1c", "\u3000"]
    texts = ["", " ", "\n\n", "don't we'll I'M it's 'tis 's", "<|endoftext|>", "a<|endoftext|>b", "x_y __ _", "1234 12a3 ²³ ½", "ALİ. ẞ ŉ ǅ Ⱥ", "e\u0301 \ufb01 漢字 क़", "\x01 a\x01b", "\ufe00"]
    for k in range(1500):
        letters = latin if k % 3 else list("etaoinshrdluETA.,'1")
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 9))]
        texts.append("".join(w + r.choice(blanks[:8] if k % 5 else blanks) for w in words))
    for name in (WORD_BPE, BYTE_BPE):
        t, enc = brute.library(vocabulary(name)), bpe.PieceEncoder(vocabulary(name))
        assert sum(enc.merges(x) is not None for x in texts) > 500
        assert all(np.frombuffer(enc.encode(x), "<u4").tolist() == brute.ids(t, x) for x in texts)
    tokens = [x.replace("</w>", "") for x in brute.library(vocabulary(WORD_BPE)).get_vocab()]
    t, enc = brute.library(vocabulary(WORD_BPE)), bpe.PieceEncoder(vocabulary(WORD_BPE))
    assert all(np.frombuffer(enc.encode(x), "<u4").tolist() == brute.ids(t, x) for x in tokens)


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 40, 5000, replace=False)
    index = mph.PerfectHash.from_bytes(mph.PerfectHash.build(keys).to_bytes())
    assert sorted(index.places(keys)) == list(range(5000))


def test_quality(spark, rows, docs, none):
    rows = [*rows, *((1000 + i, ("bad$ " if i % 5 == 0 else "good ") + " ".join(f"v{j * 7 + i}{'$' if i % 5 == 0 else ''}" for j in range(60))) for i in range(900))]
    labels = spark.createDataFrame([(k, int(k % 5 != 0), None) for k, _ in rows if k >= 1000] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    table = frame(spark, rows)
    out = quality.judge(table, labels).collect()
    want = []
    for k, t in rows:
        m = brute.measures(t)
        want.append((k, *m, brute.base_failed(m[0], m[4])))
    same([tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out], want)
    kept = {r["doc_id"]: r["kept"] for r in out if r["doc_id"] >= 1000 and r["lang"] == "en"}
    assert all(v == (k % 5 != 0) for k, v in kept.items())
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert quality.judge(none, labels).count() == 0
    unlabelled = quality.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)


def test_binomial(spark):
    cases = [(0, 50), (3, 400), (7, 900), (0, 1), (12, 600)]
    got = spark.createDataFrame(cases, "k long, n long")
    for r in got.select("k", "n", quality.binomial_below(got["k"], got["n"], 0.02).alias("p")).collect():
        want = brute.binomial(r["k"], r["n"], 0.02) if r["k"] < r["n"] * 0.02 else 1.0
        assert abs(r["p"] - want) < 1e-9


def test_rollup(spark):
    rollup = token_counts.Rollup(spark, new_folder(spark, "rollup"))
    schema = "source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    assert rollup.totals().count() == 0
    first = spark.createDataFrame([("a", "en", "t", None, 5), ("a", "en", "t", None, 7), (None, None, "t", None, 1), ("b", "en", "t", None, 2)], schema)
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    assert rollup.commit("2", spark.createDataFrame([("a", "en", "t", 5, 9), ("b", "en", "t", 2, None), ("a", "en", "t", None, None)], schema))
    same(rollup.totals().collect(), [("a", "en", "t", 2, 16), (None, None, "t", 1, 1)])


def test_rollup_compaction(spark):
    """Totals and idempotence before, after and in the middle of compactions; names that are no paths."""
    rollup = token_counts.Rollup(spark, new_folder(spark, "rollup"))
    schema = "source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    change = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert rollup.compact() == 0
    names = ["day/1", "day 2=x%", "../day3", "täg 4", "5*[a]{b}"]
    for i, name in enumerate(names):
        assert rollup.commit(name, change(("a", "en", "t", None, 10 + i), (None, None, "t", None, 1)))
    want = [("a", "en", "t", 5, 60), (None, None, "t", 5, 5)]
    same(rollup.totals().collect(), want)
    assert rollup.batches() == sorted(names) and rollup.compact() == 5 and rollup.batches() == [] and rollup.compact() == 0
    same(rollup.totals().collect(), want)
    assert not any(rollup.commit(name, change(("a", "en", "t", None, 99))) for name in names)
    assert rollup.commit("6", change(("a", "en", "t", 10, None), (None, None, "t", 1, None), ("b", "de", "t", None, 3)))
    want = [("a", "en", "t", 4, 50), (None, None, "t", 4, 4), ("b", "de", "t", 1, 3)]
    same(rollup.totals().collect(), want)
    # a compaction that broke off after its totals, and one that broke off before it removed what it took in
    rollup.totals().write.parquet(f"{rollup.folder}/base=1/totals")
    same(rollup.totals().collect(), want)
    kept = spark.read.parquet(f"{rollup.folder}/{rollup._place('6')}").collect()
    assert rollup.compact() == 1
    spark.createDataFrame(kept, "source string, lang string, tokenizer string, n_docs long, n_tokens long").write.parquet(f"{rollup.folder}/{rollup._place('6')}")
    same(rollup.totals().collect(), want)
    assert rollup.batches() == [] and not rollup.commit("6", change(("b", "de", "t", None, 3)))
    assert rollup.commit("7", change(("b", "de", "t", 3, None), ("a", "en", "t", 11, 12))) and rollup.compact() == 1
    same(rollup.totals().collect(), [("a", "en", "t", 4, 51), (None, None, "t", 4, 4)])
    for name in ("", "x" * 101):
        with pytest.raises(ValueError):
            rollup.commit(name, change())


def test_rollup_query(spark, rows, docs, tmp_path):
    """The whole query against counts by the library: a third moved from the byte to the word vocabulary, a third revised by one."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    old, new = (brute.library(vocabulary(x)) for x in (BYTE_BPE, WORD_BPE))
    want = Counter()
    for k, text in rows:
        moved = k % 3 == 0
        group = ("s", "en" if k % 3 else None, "word_bpe_49k" if moved else "byte_bpe_50k")
        n = len(brute.ids(new if moved else old, text or "")) + (k % 3 == 1)
        want[group, "docs"] += 1
        want[group, "tokens"] += n
    got = queries.op5_token_rollup(spark, str(tmp_path)).select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()
    same(got, [(*g, want[g, "docs"], want[g, "tokens"]) for g in {g for g, _ in want}])


def test_toxicity(spark, none):
    r = random.Random(2)
    words = ["n%s" % "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, marks = [], {}
    for i in range(1500):
        text = [r.choice(words) for _ in range(60)]
        insult, group = r.random() < 0.5, r.random() < 0.5
        text += ["nasty"] * insult + ["folk"] * group
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        marks[i] = int(insult and group)
    rows += [(5000, None), (5001, ""), (None, "nasty folk")]
    labels = spark.createDataFrame([(k, 1, v) for k, v in marks.items()] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows).drop("score")
    out = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), "score").collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 for x in out)
    tested = [(x["score"] >= 0.5) == bool(marks[x["doc_id"]]) for x in out if x["h"] and x["doc_id"] in marks]
    assert np.mean(tested) > 0.95  # neither word tells alone: only their pair does
    assert toxicity.score(none.drop("score"), toxicity.train(none, labels)).count() == 0


@pytest.mark.parametrize("width", [1, 4, 35])
def test_substrings(rows, docs, none, width):
    same(substrings.dedup(docs, "doc_id", "text", width).collect(), brute.repeats(rows, width))
    assert substrings.dedup(none, "doc_id", "text", width).count() == 0
    cut = substrings.cut_repeated(docs, "doc_id", "text", width)
    want = Counter((k, left if gone else t) for (k, t), (_, _, gone, left) in zip(rows, brute.repeats(rows, width), strict=True))
    assert cut.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in cut.collect()) == want


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(rows, docs, none, n, num):
    same(jaccard.similar_classes(docs, "doc_id", "text", n, num).collect(), brute.similar(rows, n, num))
    assert jaccard.similar_classes(none, "doc_id", "text", n, num).count() == 0


def test_jaccard_of_a_crowd(spark):
    r = random.Random(5)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(300):
        words = base[:]
        for _ in range(r.randint(0, 8)):
            words[r.randrange(len(words))] = "e%d" % r.randint(0, 10**6)
        rows.append((i, " ".join(words)))
    r.shuffle(rows)
    same(jaccard.similar_classes(frame(spark, rows), "doc_id", "text", 3, 90).collect(), brute.similar(rows, 3, 90))


def spread_families(seed=6, n=60):
    """Families of two near copies; in each of their lists stands a smaller key that is only nearly similar. Keys are far apart."""
    r, rows, common = random.Random(seed), [], ["c%d" % i for i in range(12)]
    for f in range(n):
        base = ["f%dw%d" % (f, i) for i in range(200)]
        texts = [base[:-12] + common, common + base[12:], base, [*base[:100], "c0", *base[101:]]]
        rows += zip(sorted(r.sample(range(5000, 10**12), 4)), map(" ".join, texts), strict=True)
    r.shuffle(rows)
    return rows


def test_jaccard_of_spread_keys(spark):
    rows = spread_families()
    want = brute.similar(rows, 3, 90)
    assert sum(k != c for k, _, c in want) == 60
    same(jaccard.similar_classes(frame(spark, rows), "doc_id", "text", 3, 90).collect(), want)


def test_overlaps_from_relations():
    """What sets of one hub share, from their differences from it, equals what they share themselves."""
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 1 << 60, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(40, len(base)), replace=False), r.integers(0, 1 << 60, r.integers(0, 9)).astype(np.uint64)])) for _ in range(40)] + [base]
    lacks = [np.flatnonzero(~np.isin(base, s)).astype("<u4").tobytes() for s in sets]
    adds = [np.setdiff1d(s, base).tobytes() for s in sets]
    relations = jaccard.Relations(np.zeros(len(sets)), np.full(len(sets), len(base)), np.array(lacks, object), np.array(adds, object))
    for i in range(len(sets)):
        others = np.array([j for j in range(len(sets)) if j != i])
        assert relations.shared(i, others).tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in others]


def test_jaccard_of_a_crowd_just_under_the_threshold(spark):
    """Sets that differ from one base by five words each: linked to it, and to each other only where differences fall together."""
    r = random.Random(11)
    base = ["b%d" % i for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = base[:]
        for k in sorted(r.sample(range(5, 290), 9)):
            words[k] = "e%d" % r.randint(0, 10**6)
        rows.append((i * 1000, " ".join(words)))
    got = jaccard.similar_classes(frame(spark, rows), "doc_id", "text", 3, 90).collect()
    same(got, brute.similar(rows, 3, 90))
    assert len({x["component_id"] for x in got}) > 50


def test_no_text_moves_for_sets_that_sketches_tell_apart(spark, monkeypatch):
    """Long texts of which any two share one passage meet in lists; sizes, places and 16 classes do not part them."""
    r, n, moved, stored = random.Random(3), 16, {}, jaccard.stored
    blocks = {(i, j): " ".join("w%d" % r.randrange(10**9) for _ in range(200)) for i in range(n) for j in range(i)}
    rows = [(i, " ".join(blocks[max(i, j), min(i, j)] for j in range(n) if j != i)) for i in range(n)]

    def counted(df, name):
        out = stored(df, name)
        moved[name] = moved.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    got = jaccard.similar_classes(frame(spark, rows), "doc_id", "text", 3, 90).collect()
    same(got, brute.similar(rows, 3, 90))
    assert moved["postings"] > 0 and moved["texts"] == 0


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 64, r.integers(1, 400), dtype=np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.random()], r.integers(0, 1 << 64, r.integers(1, 200), dtype=np.uint64)]))
        one, two = jaccard.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).to_pylist()
        assert jaccard.sketches_apart(one, two) <= len(np.setxor1d(x, y))
        assert jaccard.sketches_apart(one, one) == 0


def test_rows_without_a_key_of_their_own(spark):
    """Null and repeated ids link no texts; a row goes only for a similar one that stays."""
    r = random.Random(8)
    text = lambda: " ".join("v%d" % r.randrange(10**6) for _ in range(150))
    near, far, top = text(), [text() for _ in range(6)], (1 << 63) - 1
    rows = [(10, near), (None, near + " end"), (None, far[0]), (None, far[1]), (None, far[1]), (None, None), (20, far[2]), (20, far[3]), (20, far[2] + " end"), (5, far[4]), (20, far[4] + " end"), (top, far[5])]
    docs = frame(spark, rows)
    want = [(k, 148 + t.endswith(" end") if t else 0, {near[:9]: 10, far[2][:9]: 20, far[3][:9]: 20, far[4][:9]: 5, far[5][:9]: top}.get((t or "")[:9])) for k, t in rows]
    same(jaccard.similar_classes(docs, "doc_id", "text", 3, 90).collect(), want)
    classes = jaccard.similar_classes(docs, "doc_id", "text", 3, 90, keep_digest=True)
    kept = [(x["doc_id"], x["text"]) for x in jaccard.keep_one(docs, classes, "doc_id", "text").collect()]
    assert len(kept) == 8 and sum(k == 20 and t.startswith(far[2]) for k, t in kept) == 1
    same([x for x in kept if not (x[0] == 20 and x[1].startswith(far[2]))], [(10, near), (None, far[0]), (None, far[1]), (None, None), (20, far[3]), (5, far[4]), (top, far[5])])


def test_lists_need_their_columns():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"token": [1, 1], "group": [2, 3]})
    with pytest.raises(ValueError):
        list(jaccard._lists(lambda *x: None, ["token", "low8"])([batch]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 400)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    near = base[rng.integers(0, 40, 200)] + 0.12 * rng.normal(size=(200, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:3]]))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None, *[0.0] * 14]), (904, [float("inf"), *[0.0] * 15])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    read = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    same(embeddings.near_duplicates(table, "vec_id", "embedding").collect(), brute.vectors(read))
    assert embeddings.near_duplicates(table.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize(("rows", "most", "element"), [(8, 3, "float"), (16, 2048, "double")])
def test_embeddings_of_many_blocks(spark, monkeypatch, rows, most, element):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", rows)
    monkeypatch.setattr(embeddings, "MAX_INTERVALS", most)
    monkeypatch.setattr(embeddings, "LEAST_INTERVALS", 6)
    monkeypatch.setattr(embeddings, "LEFT_BLOCKS", 3)
    monkeypatch.setattr(embeddings, "RIGHT_BLOCKS", 5)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 8))
    near = base[rng.integers(0, 30, 100)] + 0.2 * rng.normal(size=(100, 8))
    values = [*base, *near, *[base[0]] * 40, *[2.0 * base[1]] * 5, *[base[2] + 0.1 * rng.normal(size=8) for _ in range(40)]]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], f"vec_id long, embedding array<{element}>").union(
        spark.createDataFrame([(None, [float(x) for x in base[3]]), (None, [1.0, *[0.0] * 7]), (7, [0.0, 1.0, *[0.0] * 6]), (7, [float(x) for x in base[4]])], f"vec_id long, embedding array<{element}>")
    )
    read = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    key = [k for k, _ in read]
    got = embeddings.near_duplicates(table, "vec_id", "embedding").collect()
    want = brute.vectors([(i, v) for i, (_, v) in enumerate(read)])
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"]) for r in got) == sorted((key[i] is None, key[i] or 0, n) for i, n, *_ in want)
    least = {to: min((key[i] for i, _, t, _ in want if t == to and key[i] is not None), default=None) for _, _, to, _ in want}
    assert Counter((r["vec_id"], r["component_id"]) for r in got) == Counter((key[i], least[to]) for i, _, to, _ in want)


def test_embeddings_copy_no_vector_per_pair(spark, monkeypatch):
    """Evenly spread vectors: every two blocks may hold links, and what is shuffled or written must not grow with their pairs."""
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16, raising=False)
    monkeypatch.setattr(embeddings, "INTERVAL_ROWS", 16, raising=False)
    plans, real = {}, embeddings.stored

    def stored(df, name):
        plans[name] = df
        return real(df, name)

    monkeypatch.setattr(embeddings, "stored", stored)
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(160, 32)))], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(table, "vec_id", "embedding").where("kept").count() == 160
    assert "parquet" not in plans["links"]._jdf.queryExecution().optimizedPlan().toString().lower()


def test_interval_pairs():
    rng = np.random.default_rng(5)
    low = np.sort(rng.normal(size=(40, 1)), axis=0)
    high = low + 0.01
    want = [(i, j) for i in range(40) for j in range(i, 40) if i == j or low[j, 0] - high[i, 0] <= 0.2]
    assert embeddings.interval_pairs(low, high, 0.2) == want


@pytest.mark.parametrize("gzip", [True, False])
def test_warc(spark, gzip):
    rows = [(1, "u", "<p>one</p>"), (2, "u b\r\nX: y", "<p>one</p>"), (3, None, None), (4, "v", ""), (5, "w", "é" * 5000), (6, "w", "WARC/1.1\r\n\r\n"), (6, "w", "WARC/1.1\r\n\r\n")]
    folder = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "page_id", "url", "html", folder, gzip)
    same(warc.page_digests(warc.read_archives(spark, folder)).collect(), brute.pages([(k, h) for k, _, h in rows]))
    none = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html", none, gzip)
    assert warc.read_archives(spark, none).count() == 0


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_of_long_urls(spark, gzip):
    rows = [(1, "u", "<p>one</p>"), (2, "v" * 100_000, "<p>one</p>"), (3, " " * 40_000, "<p>three</p>"), (4, "w", "<p>four</p>")]
    folder = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "page_id", "url", "html", folder, gzip)
    records = warc.read_archives(spark, folder)
    same(warc.page_digests(records).collect(), brute.pages([(k, h) for k, _, h in rows]))
    assert {(r["kind"], r["page_key"], len(r["url"] or "")) for r in records.collect()} == {("record", "1", 1), ("record", "2", 100_000), ("record", "3", 120_000), ("record", "4", 1)}


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.file, self.read_bytes, self.largest = io.BytesIO(data), 0, 0

    def read(self, n):
        out = self.file.read(n)
        self.read_bytes, self.largest = self.read_bytes + len(out), max(self.largest, len(out))
        return out

    def seek(self, at):
        return self.file.seek(at)

    def tell(self):
        return self.file.tell()


def test_a_damaged_length_costs_little():
    """A record that claims the rest of a large file, or more: all others are found, nothing is read twice, and little is held."""
    records = [warc._record("response", str(i), "u", b"<p>%d</p>" % i * 900, None) for i in range(800)]
    size = str(records[3].split(b"Content-Length: ")[1].split(b"\r\n")[0], "ascii")
    whole = sum(map(len, records))
    for claim in (whole // 2, whole * 3, int(size) + 7):
        bad = records[:]
        bad[3] = bad[3].replace(f"Content-Length: {size}".encode(), f"Content-Length: {claim}".encode())
        file = Counted(b"".join(bad))
        out = list(warc.salvage(file, False))
        assert [h["x-page-key"] for _, _, h, _, _ in out if h] == [str(i) for i in range(800) if i != 3]
        assert [(a, why) for a, _, h, _, why in out if h is None] == [(sum(map(len, records[:3])), "length")]
        assert file.read_bytes < whole + 100_000 and file.largest <= 1 << 17


def test_gaps_are_an_error_unless_allowed(spark, tmp_path):
    records = [warc._record("response", str(i), "u", b"<p>%d</p>" % i, None) for i in range(3)]
    (tmp_path / "x.warc").write_bytes(records[0] + b"junk" + records[1][:-9] + records[2])
    found = warc.read_archives(spark, str(tmp_path), ["x.warc"])
    assert {r["page_id"] for r in warc.page_digests(found).collect()} == {0, 2}
    with pytest.raises(ValueError, match="gaps"):
        warc.page_digests(found, gaps=False)


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage(tmp_path, gzip):
    records = [warc._record("response", str(i), "u", b"<p>%d</p>" % i * 50, None) for i in range(6)]
    parts = [warc._member(x) if gzip else x for x in records]
    starts = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    for i in (1, 4):  # two damaged records, and a file that ends too early
        data[starts[i] + len(parts[i]) // 2] ^= 0xFF
    data = bytes(data[: starts[5] + len(parts[5]) - 9])
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f:
        out = list(warc.salvage(f, gzip))
    assert [h["x-page-key"] for _, _, h, _, _ in out if h] == ["0", "2", "3"]
    assert [(a, b) for a, b, h, _, _ in out if h is None] == [(starts[1], starts[2]), (starts[4], len(data))]
