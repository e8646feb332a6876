import json
import math

import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import ledger, manifest
from corpusgauge.operators.detections import rank_detections, result_faces, top_face
from corpusgauge.operators.manifest import MANIFEST_COLUMNS, MANIFEST_SCHEMA
from corpusgauge.operators.reports import fixed_text, interval_cell, report_json
from corpusgauge.sources import files, tables


def rows(spark, n=6, **changes):
    base = spark.range(n).select(
        F.lit("d").alias("dataset"),
        F.lit("s").alias("source"),
        F.when(F.col("id") % 2 == 0, "real").otherwise("fake").alias("label"),
        F.lit("train").alias("split"),
        F.concat(F.lit("f"), "id", F.lit(", \"x\".png")).alias("rel_path"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"),
        F.lit("png").alias("format"),
        F.lit(10).alias("width"),
        F.lit(20).alias("height"),
        F.lit("RGB").alias("mode"),
        F.col("id").alias("file_size"),
        F.when(F.col("id") == 0, 90).alias("jpeg_quality_est"),
        F.lit("True").alias("has_exif"),
        F.lit("False").alias("has_icc"),
        F.lit(None).cast("string").alias("has_xmp"),
        F.when(F.col("id") == 5, "bad").alias("read_error"),
    )
    return base.withColumns({k: v for k, v in changes.items()})


def test_manifest_round_trip(spark, tmp_path):
    df = rows(spark)
    tables.write_manifest(df, str(tmp_path / "m"))
    assert list((tmp_path / "m").glob("*.csv.gz"))
    back = tables.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*back.columns).collect()))


def test_manifest_rules(spark):
    df = rows(spark)
    assert {r["rule"]: r["n"] for r in manifest.validate_manifest(df).collect()} == {"unknown_label": 0, "duplicate_key": 0}
    for bad in (df.unionByName(df), df.withColumn("label", F.lit("x")), df.withColumn("label", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="invalid manifest"):
            manifest.require_valid(bad)
    with pytest.raises(ValueError, match="lacks columns"):
        manifest.validate_manifest(df.drop("sha256"))


def test_merge_is_one_to_one(spark):
    df = rows(spark)
    specs, meta = df.select("rel_path", "dataset", "source", "label", "split"), df.select("rel_path", "sha256", "width")
    merged = manifest.merge_specs_meta(specs, meta.limit(4))
    assert merged.columns == list(manifest.MANIFEST_COLUMNS) and merged.count() == 6 and merged.filter("sha256 is null").count() == 2
    for pair in ((specs, meta.unionByName(meta)), (specs.unionByName(specs), meta)):
        with pytest.raises(Exception, match="repeated rel_path"):
            manifest.merge_specs_meta(*pair).collect()


def test_roots(spark):
    assert manifest.parse_roots(["a=/x=y"]) == {"a": "/x=y"}
    for bad in ("a", "=b", "a="):
        with pytest.raises(ValueError):
            manifest.parse_roots([bad])
    with pytest.raises(Exception, match="no root for dataset"):
        manifest.resolve_paths(rows(spark), {"other": "/x"}).collect()


def test_import_stats(spark):
    files = [("s", "a", "h1"), ("s", "b", "h1"), ("s", "c", "h2"), ("s", "d", "h3"), ("t", "a", "h1")]
    df = spark.createDataFrame(files, "source string, rel_path string, sha256 string")
    held = spark.createDataFrame([("s", "h2"), ("s", "h2")], "source string, sha256 string")
    got = {r["source"]: r.asDict() for r in manifest.import_stats(df, held, 100, 1).collect()}
    assert got["s"] == {"source": "s", "found": 4, "selected": 4, "identical_skipped": 1, "already_present": 1, "copied": 2}
    assert got["t"]["copied"] == 1 and got["t"]["already_present"] == 0


def test_class_balance_warnings(spark):
    df = rows(spark)
    assert manifest.class_balance(df).first()["warning"] == "imbalanced"  # row 5, a fake, is unreadable
    assert manifest.class_balance(df.filter("label = 'real'")).first()["warning"] == "single_class"
    assert manifest.class_balance(rows(spark, 4)).first()["warning"] == "none"


def test_resume(spark):
    items = rows(spark)
    names = [r["rel_path"] for r in items.orderBy("file_size").collect()]
    log = [(1, names[0], "ok", "o0"), (2, names[1], "ok", "o1"), (3, names[2], "no_face", None), (4, names[1], "ok", "o1b")]
    log = spark.createDataFrame([("d", *r) for r in log], "dataset string, seq bigint, rel_path string, status string, processed_rel_path string")
    done = ledger.latest_records(log)
    there = spark.createDataFrame([("o0",), ("o1",)], "processed_rel_path string")
    drops = spark.createDataFrame([("d", names[3]), ("d", names[3]), ("d", names[5])], "dataset string, rel_path string")
    todo = {r["rel_path"]: r["action"] for r in ledger.resume_todo(items, done, there, drops).collect()}
    assert todo == {names[1]: "process", names[3]: "duplicate_dropped", names[4]: "process", names[5]: "read_error"}
    assert ledger.exclude_dropped(items, drops).count() == 4
    assert ledger.ledger_for_manifest(done, items.filter(F.col("rel_path") == names[0])).count() == 1


def test_progress_log(spark, tmp_path):
    lines = [
        {"seq": 1, "dataset": "d", "rel_path": "a", "status": "ok", "processed_rel_path": "x"},
        {"seq": 3, "dataset": "d", "rel_path": "a", "status": "no_face", "processed_rel_path": None},
        {"seq": 2, "dataset": "d", "rel_path": "b", "status": "ok", "processed_rel_path": "y"},
    ]
    text = "\n".join([json.dumps(x) for x in lines[:2]] + ["", json.dumps(lines[2]), '{"seq": 9, "dataset": "d", "rel_'])
    (tmp_path / "log.jsonl").write_text(text)
    got = {r["rel_path"]: (r["seq"], r["status"]) for r in tables.read_progress_log(spark, str(tmp_path / "log.jsonl")).collect()}
    assert got == {"a": (3, "no_face"), "b": (2, "ok")}


def test_predictions_keep_the_first_file(spark, tmp_path):
    header = "dataset,split,source,label,rel_path,processed_rel_path,logit\n"
    (tmp_path / "a.csv").write_text(header + "d,test,s,real,p1,o1,0.5\n")
    (tmp_path / "b.csv").write_text(header + "d,test,s,real,p1,o1,9.5\nd,test,s,fake,p2,o2,1.5\n")
    (tmp_path / "c.csv").write_text("dataset,logit\nd,1\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]
    got = {r["rel_path"]: r["logit"] for r in tables.read_predictions(spark, paths[:2]).collect()}
    assert got == {"p1": 0.5, "p2": 1.5}
    with pytest.raises(ValueError, match="not a predictions file"):
        tables.read_predictions(spark, paths)


def test_processed_rows_and_sink(spark, tmp_path):
    df = rows(spark).withColumn("status", F.lit("ok"))
    named = tables.with_output_name(df)
    assert tables.processed_rows(named, ["train"], ["d"]).count() == 6
    with pytest.raises(ValueError, match="no processed rows"):
        tables.processed_rows(named, ["test"])
    with pytest.raises(ValueError, match="not a processed manifest"):
        tables.processed_rows(df.drop("status"))
    tables.write_partitioned(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and back.select("processed_rel_path").distinct().count() == 6
    assert (tmp_path / "out" / "dataset=d" / "split=train" / "label=real").is_dir()


def test_detection_ranking(spark):
    boxes = [(0, 30, 0.99), (1, 5, 0.99), (2, 20, 0.95), (3, 40, 0.5)]
    df = spark.createDataFrame(
        [("img", pos, 0.0, 0.0, float(s), float(s), p, 0.5) for pos, s, p in boxes],
        "image_id string, pos int, x1 double, y1 double, x2 double, y2 double, prob double, scale double",
    )
    got = rank_detections(df).orderBy("face_rank").collect()
    assert [(r["pos"], r["x2"]) for r in got] == [(0, 60.0), (2, 40.0)]
    best = top_face(df).first()
    assert (best["pos"], best["num_faces"]) == (0, 2)
    faces = result_faces(rank_detections(df)).first()["faces"]
    assert [(f["face_index"], f["bbox"], f["detection_score"]) for f in faces] == [(0, [0, 0, 60, 60], 0.99), (1, [0, 0, 40, 40], 0.95)]


def test_text_and_json(spark):
    values = [0.8125, 0.8835, 0.0005, 1.0005, 2.5, 0.1235, 123.4565, 0.9995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 3):
        got = df.select("v", fixed_text(F.col("v"), digits).alias("t")).collect()
        assert [r["t"] for r in got] == [f"{r['v']:.{digits}f}" for r in got]
    none = F.lit(None).cast("double")
    assert spark.range(1).select(interval_cell(F.lit(0.25), F.lit(0.5)).alias("c")).first()["c"] == "[0.250, 0.500]"
    assert spark.range(1).select(interval_cell(none, F.lit(0.5)).alias("c")).first()["c"] == "TBD"
    odd = spark.createDataFrame([(math.nan, math.inf, 1.5)], "a double, b double, c double")
    assert json.loads(report_json(odd).first()["json"]) == {"a": None, "b": None, "c": 1.5}


def one_manifest_row(**changes):
    row = dict(dataset="d", source="s", label="real", split="train", rel_path="a.jpg", sha256="0" * 64, format="jpeg", width=3, height=4, mode="RGB",
               file_size=9, jpeg_quality_est=90, has_exif="True", has_icc="False", has_xmp=None, read_error=None)
    return tuple((row | changes).values())


def test_manifest_files_keep_every_value(spark, tmp_path):
    """Nulls, quotes, commas, blanks, line ends and other letters come back as they were, from several parts; an empty text comes back as null."""
    odd = ['say "hi"', "a,b", "two\nlines", "", None, " padded ", "ünï\\code", '"', "x\\", "'"]
    rows = [one_manifest_row(rel_path=f"{i}.jpg", read_error=text, source=text, width=None if i % 2 else i) for i, text in enumerate(odd)]
    df = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    tables.write_manifest(df.repartition(3).withColumn("more", F.lit(1)), f"{tmp_path}/m")
    back = tables.read_manifest(spark, f"{tmp_path}/m")
    want = [tuple(None if x == "" else x for x in row) for row in rows]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(want, key=str) and back.schema.simpleString() == df.schema.simpleString()
    assert all(f.name.endswith(".csv.gz") for f in (tmp_path / "m").glob("part-*"))


def test_manifest_files_are_checked_on_both_ends(spark, tmp_path):
    good = spark.createDataFrame([one_manifest_row()], MANIFEST_SCHEMA)
    for bad in (one_manifest_row(label="maybe", rel_path="b"), one_manifest_row()):
        with pytest.raises(ValueError, match="invalid manifest"):
            tables.write_manifest(good.unionByName(spark.createDataFrame([bad], MANIFEST_SCHEMA)), f"{tmp_path}/never")
    tables.write_manifest(good, f"{tmp_path}/m")
    header = ",".join(MANIFEST_COLUMNS)
    line = ",".join("" if x is None else str(x) for x in one_manifest_row())
    for name, text, error in [
        ("short", f"{header}\n{line}\nd,s,real\n", "torn"), ("long", f"{header}\n{line},1\n", "torn"), ("typed", f"{header}\n{line.replace(',3,4,', ',x,4,')}\n", "torn"),
        ("head", f"{header.replace('width', 'wide')}\n{line}\n", "no manifest"), ("label", f"{header}\n{line.replace('real', 'other')}\n", "invalid manifest"),
    ]:
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError, match=error):
            tables.read_manifest(spark, f"{tmp_path}/{name}.csv")


def test_layouts_of_a_listing(spark):
    paths = ["train/real/1.JPG", "train/real/more/2.png", "valid/fake/3.webp", "test/masks/4.png", "extra/real/5.png", "train/real/6.txt", "real/7.png", "train/real", "real/flux/8.jpeg",
             "fake/sdxl/deep/9.png", "fake/10.png", "real/flux/.png", None]
    df = spark.createDataFrame([(p, 1) for p in paths], "rel_path string, length int")
    split = files.layout_specs(df, "140k", "split", {"real": "ffhq"})
    assert sorted(map(tuple, split.collect())) == [
        ("train/real/1.JPG", "140k", "ffhq", "real", "train"), ("train/real/more/2.png", "140k", "ffhq", "real", "train"), ("valid/fake/3.webp", "140k", None, "fake", "valid"),
    ]
    assert sorted(map(tuple, files.missing_folders(split).collect())) == [("test", "fake"), ("test", "real"), ("train", "fake"), ("valid", "real")]
    external = files.layout_specs(df, "x")
    assert sorted(map(tuple, external.collect())) == [("fake/sdxl/deep/9.png", "x", "sdxl", "fake", "x"), ("real/flux/8.jpeg", "x", "flux", "real", "x")]
    assert files.layout_specs(df.limit(0), "x", "split").count() == 0
    with pytest.raises(ValueError, match="unknown layout"):
        files.layout_specs(df, "x", "flat")
