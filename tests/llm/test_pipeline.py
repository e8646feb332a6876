"""The pipeline on a small table: planted cases are caught, clean documents stay."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import corpus_pipeline
from corpusgauge.llm import quality, toxicity
from corpusgauge.llm.queries import BYTE_BPE, vocabulary
from corpusgauge.llm.shared import new_folder

from . import brute


def test_stages(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghijklmno") for _ in range(6)) for _ in range(3000)]
    text = lambda n=120: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = [(i, text()) for i in range(700)]
    toxic = [(1000 + i, f"{text(60)} nastyword {text(60)}") for i in range(200)]
    copies = [(2000 + i, rows[i][1]) for i in range(20)] + [(2100, rows[30][1] + " end")]
    shared = [(3000 + i, f"{text(60)} {passage} {text(60)}") for i in range(3)]
    odd = [(4000, None), (4001, ""), (4002, "short")]
    folder = new_folder(spark, "tables")
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows + toxic + copies + shared + odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 1000)) for k, _ in rows + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = new_folder(spark, "stage")
        out.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = {x["doc_id"]: x for x in at.collect()}
    clean = {k for k, _ in rows}
    assert clean <= set(seen["toxicity"]) and not {k for k, _ in toxic} & set(seen["toxicity"])
    assert clean <= set(seen["quality rules"]) and not {4000, 4001, 4002} & set(seen["quality rules"])
    assert set(seen["n-gram Jaccard join"]) == clean | {k for k, _ in shared}
    cut = seen["substring dedup"]
    assert all(len(cut[k]["text"].split()) == 120 for k, _ in shared) and all(cut[k]["text"] == t for k, t in rows)
    assert set(seen["best-fit packing"]) == set(cut)
    assert corpus_pipeline.run(spark, folder).count() == at.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, docs, folder):
    """What each stage leaves, as rows of the tables in between."""
    out, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, "stage")
        stage(spark, at, folder).write.parquet(path)
        at = spark.read.parquet(path)
        out[name] = at
    return out


def test_chain_equals_plain_versions(spark):
    """Every row of every stage, with the model and the cutoffs that the operators learned from that stage's input."""
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghijklmno") for _ in range(5)) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(50)
    rows = [(i, text(r.randint(40, 160))) for i in range(500)]
    rows += [(600 + i, f"{text(50)} slur {text(50)}") for i in range(120)]
    rows += [(800 + i, " ".join(f"v{r.randrange(900)}{'$' if i % 3 == 0 else ''}" for _ in range(90))) for i in range(500)]
    rows += [(1400 + i, f"{text(40)} {passage} {text(30)}") for i in range(6)]
    for i in range(60):  # near copies around the threshold
        words = rows[i][1].split()
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = "changed%d" % r.randrange(50)
        rows.append((1500 + i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "slur"), (2003, text(1200))]
    r.shuffle(rows)
    folder = new_folder(spark, "tables")
    table = spark.createDataFrame([(k, t, "en" if k % 2 else "de", "s", len(t or "")) for k, t in rows], SCHEMA)
    table.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(k, int(not (800 <= k < 1300 and "$" in t)), int(600 <= k < 720)) for k, t in rows if t], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stages(spark, docs, folder)
    plain = lambda df: sorted((x["doc_id"], x["text"]) for x in df.collect())

    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    left = sorted(((k, t) for k, t in rows if scorer.scores([t])[0] < 0.5), key=lambda x: x[0])
    assert [k for k, _ in plain(got["toxicity"])] == [k for k, _ in left] and len(left) < len(rows) - 100

    judged = {x["doc_id"]: x["kept"] for x in quality.judge(got["toxicity"], labels).collect()}
    base = {k: brute.base_failed(m[0], m[4]) for k, t in left for m in [brute.measures(t)]}
    dollars = {k for k, t in left if 800 <= k < 1300 and "$" in t}
    assert all(judged[k] == (not base[k] and k not in dollars) for k, _ in left)  # the cutoffs take the planted rows and no other
    left = [(k, t) for k, t in left if judged[k]]
    assert plain(got["quality rules"]) == left

    classes = {k: c for k, _, c in brute.similar(left, 5, 80)}
    left = [(k, t) for k, t in left if classes[k] == k]
    assert plain(got["n-gram Jaccard join"]) == left and 10 < sum(k >= 1500 for k, _ in left) < 60

    left = [(k, kept if gone else t) for (k, t), (_, _, gone, kept) in zip(left, brute.repeats(left, 35), strict=True)]
    assert plain(got["substring dedup"]) == left

    t, want = brute.library(vocabulary(BYTE_BPE)), Counter()
    for k, text_ in left:
        ids = [*brute.ids(t, text_), 2]
        first = len(ids) % 1024 or 1024
        for n, a in enumerate([0, *range(first, len(ids), 1024)]):
            want[k, n, a, zlib.crc32(brute.raw(ids[a : first if not n else a + 1024]))] += 1
    packed = got["best-fit packing"].collect()
    assert Counter((x["doc_id"], x["piece"], x["start"], x["ids_crc32"]) for x in packed) == want
    assert Counter((x["doc_id"], x["piece"], x["ids_crc32"]) for x in corpus_pipeline.run(spark, folder).collect()) == Counter((k, n, c) for k, n, _, c in want.elements())


def test_odd_columns_and_rows(spark):
    """Columns named like the stages' own, null and repeated ids, equal rows, and an empty table."""
    names = ["_score", "_id", "_digest", "_key", "_th", "_runs", "_rows", "id", "key", "kept", "_stratum", "_h", "_text", "_label", "_class"]
    r = random.Random(2)
    text = " ".join("w%d" % r.randrange(5000) for _ in range(90))
    other = " ".join("x%d" % r.randrange(5000) for _ in range(90))
    rows = [(1, text), (1, other), (None, text + " more"), (None, other[::-1]), (2, None), (3, text), (3, text), (4, "")]
    folder = new_folder(spark, "tables")
    schema = SCHEMA + "".join(f", {c} string" for c in names)
    docs = spark.createDataFrame([(k, t, None, "s", len(t or ""), *[f"{c}{i}" for c in names]) for i, (k, t) in enumerate(rows)], schema)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    out = stages(spark, docs, folder)
    last = out["substring dedup"]
    assert last.columns == docs.columns
    assert sorted((x["doc_id"] or 0, x["_score"][:6]) for x in last.collect()) == [(0, "_score"), (1, "_score"), (1, "_score")]
    none = stages(spark, docs.limit(0), folder)
    assert all(x.count() == 0 for x in none.values()) and none["substring dedup"].columns == docs.columns
