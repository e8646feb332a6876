"""Operator inputs derived from the given tables (whole tables, whole texts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.decision import apply_calibration
from corpusgauge.functions.formats import STANDARD_LUMA_TABLE, sniff_format
from corpusgauge.functions.geometry import detection_scale
from corpusgauge.functions.hashing import output_name, stable_mod
from corpusgauge.operators.audit import metadata_feature_columns
from corpusgauge.operators.ordering import ranked, with_value_blocks
from corpusgauge.operators.pixels import PIXEL_FEATURES, pixel_stats
from corpusgauge.operators.robustness import expand_grid

TEMPERATURE = 1.5
THRESHOLD = 0.6
DELTA = 0.05
SPLITS = ("train", "val_select", "val_calib", "test", "crossgen", "own")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items: one row per order, logits in tenths so that ties occur."""
    key = F.col("o_orderkey")
    z = (F.col("o_totalprice") - 250000.0) / 125000.0
    u = stable_mod(key, 42, 10000) / 10000.0
    dataset = F.when(F.col("o_orderstatus") == "P", "140k").when(F.col("o_orderstatus") == "F", "crossgen")
    level = F.substring("o_orderpriority", 1, 1)
    split = F.when(level == "1", "train").when(level == "2", "val_select").when(level == "3", "val_calib")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("item_id"),
        F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"),
        dataset.otherwise("own").alias("dataset"),
        F.when(z + 4.0 * (u - 0.5) > 0, "fake").otherwise("real").alias("label"),
        F.floor(17.0 * z + 0.5).cast("bigint").alias("tenths"),
        split.otherwise("test").alias("part"),
    )
    real = F.col("label") == "real"
    source = (
        F.when(F.col("dataset") == "140k", F.when(real, "ffhq").otherwise("stylegan"))
        .when(F.col("dataset") == "own", F.when(real, "phone").otherwise("mygen"))
        .otherwise(F.when(real, "celebahq").otherwise(pick(stable_mod(F.col("item_id"), 7, 2), ["sdxl", "flux"])))
    )
    return rows.select(
        "item_id",
        "model",
        "dataset",
        F.when(F.col("dataset") == "140k", F.col("part")).otherwise(F.col("dataset")).alias("split"),
        source.alias("source"),
        "label",
        F.concat(F.lit("item/"), "item_id").alias("rel_path"),
        "tenths",
        (F.col("tenths") / 10.0).alias("logit"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).withColumn("prob", apply_calibration(F.col("logit"), TEMPERATURE))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw manifest: one row per document."""
    key = F.col("doc_id")
    fmt = pick(stable_mod(key, 5, 4), ["jpeg", "png", "webp", "unknown"])
    text_flag = {s: pick(stable_mod(key, s, 3), ["True", "False", "1"]) for s in (21, 22, 23)}
    dataset = F.when(F.col("lang") == "en", "140k").otherwise("crossgen")
    part = stable_mod(key, 2, 7)
    split = F.when(part <= 4, "train").when(part == 5, "valid").otherwise("test")
    return table(spark, sf_dir, "documents").select(
        dataset.alias("dataset"),
        F.col("source"),
        pick(stable_mod(key, 1, 2), ["real", "fake"]).alias("label"),
        F.when(F.col("lang") == "en", split).otherwise("crossgen").alias("split"),
        F.concat(F.lit("doc/"), key).alias("rel_path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        fmt.alias("format"),
        (stable_mod(key, 3, 512) + 64).cast("int").alias("width"),
        (stable_mod(key, 4, 512) + 64).cast("int").alias("height"),
        F.lit("RGB").alias("mode"),
        F.col("n_chars").alias("file_size"),
        F.when(fmt == "jpeg", stable_mod(key, 8, 100) + 1).cast("int").alias("jpeg_quality_est"),
        text_flag[21].alias("has_exif"),
        text_flag[22].alias("has_icc"),
        text_flag[23].alias("has_xmp"),
        F.when(stable_mod(key, 6, 50) == 0, "truncated").alias("read_error"),
    )


def listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of two data folders, one path per document: some without an image's name, below other folders, or not deep enough."""
    key = F.col("doc_id")
    split, label = pick(stable_mod(key, 52, 4), ["train", "valid", "test", "extra"]), pick(stable_mod(key, 53, 3), ["real", "fake", "masks"])
    deep = F.when(stable_mod(key, 54, 5) == 0, "more/").otherwise("")
    name = F.concat(key, F.lit("."), pick(stable_mod(key, 55, 4), ["JPG", "png", "txt", "jpeg"]))
    by_source = F.when(stable_mod(key, 56, 6) == 0, "").otherwise(F.concat("source", F.lit("/")))
    by_split = stable_mod(key, 51, 2) == 0
    return table(spark, sf_dir, "documents").select(
        F.when(by_split, "split").otherwise("external").alias("layout"),
        F.when(by_split, F.concat(split, F.lit("/"), label, F.lit("/"), deep, name)).otherwise(F.concat(label, F.lit("/"), by_source, name)).alias("rel_path"),
    )


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per readable document with the features of its raw and its processed file: metadata of both, and pixels where a page of its number is its picture."""
    own = metadata_feature_columns()
    raw = manifest(spark, sf_dir).filter(F.col("read_error").isNull())
    # processed files: one size and format, and what the encoder makes of the content
    small = raw.select("rel_path", "label", F.lit(224).alias("width"), F.lit(224).alias("height"), F.lit("jpeg").alias("format"),
        (6000 + F.col("file_size") % 4000).alias("file_size"), (stable_mod(F.col("rel_path"), 57, 6) + 90).cast("int").alias("jpeg_quality_est"),
        F.lit("False").alias("has_exif"), F.lit("False").alias("has_icc"), F.lit("False").alias("has_xmp"))
    meta = raw.select("rel_path", "label", *[c.alias(f"raw_{name}") for name, c in own.items()])
    done = small.select("rel_path", *[c.alias(f"processed_{name}") for name, c in own.items()])

    def pixels_of(width: int, prefix: str) -> DataFrame:
        stats = pixel_stats(page_images(spark, sf_dir, width), ["item_id"])
        return stats.select(F.concat(F.lit("doc/"), "item_id").alias("rel_path"), *[F.col(c).alias(f"{prefix}_{c}") for c in PIXEL_FEATURES])

    joined = meta.join(done, "rel_path")
    for width, prefix in ((32, "raw"), (24, "processed")):
        joined = joined.join(pixels_of(width, prefix), "rel_path", "left")
    return joined


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation results: one row per manifest row."""
    key = F.col("rel_path")
    draw = stable_mod(key, 30, 20)
    status = (
        F.when(F.col("read_error").isNotNull(), "read_error").when(draw == 0, "no_face").when(draw == 1, "duplicate_dropped")
    ).otherwise("ok")
    rows = manifest(spark, sf_dir).withColumn("status", status)
    ok = F.col("status") == "ok"
    return rows.select(
        "dataset",
        "source",
        "label",
        "split",
        "rel_path",
        "sha256",
        "status",
        F.when(ok, 1 + stable_mod(key, 32, 3)).alias("num_faces"),
        F.when(ok, stable_mod(key, 33, 4) == 0).alias("crop_clamped"),
        F.when(
            ok, output_name(F.col("dataset"), F.col("split"), F.col("label"), F.col("sha256"), key)
        ).alias("processed_rel_path"),
    )


def _bits(of: Column) -> Column:
    """64 booleans to one BIGINT pattern."""
    bit = F.transform(of, lambda b, k: F.when(b, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bit, F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseOR(v))


def _flips(key: Column, seed: int) -> Column:
    """Mask with at most (hash % 6) bits set."""
    n = stable_mod(key, 10, 6)
    picks = [
        F.when(
            n > j,
            F.call_function("shiftleft", F.lit(1).cast("bigint"), stable_mod(F.concat(key, F.lit(f":{j}")), seed, 64).cast("int")),
        ).otherwise(F.lit(0).cast("bigint"))
        for j in range(5)
    ]
    return reduce(lambda a, b: a.bitwiseXOR(b), picks)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign and gradient hashes of embeddings, plus a copy of every third row with a few flipped bits."""
    e = F.col("embedding")
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        _bits(F.transform(e, lambda x: x > 0)).alias("phash"),
        _bits(F.transform(e, lambda x, k: x > F.get(e, (k + 1) % 64))).alias("dhash"),
    )
    copies = base.filter(F.col("item_id") % 3 == 0).select(
        (F.col("item_id") + 10**12).alias("item_id"),
        F.col("phash").bitwiseXOR(_flips(F.col("item_id").cast("string"), 11)).alias("phash"),
        F.col("dhash").bitwiseXOR(_flips(F.col("item_id").cast("string"), 12)).alias("dhash"),
    )
    split = pick(stable_mod(F.col("item_id"), 13, 6), list(SPLITS))
    rows = base.unionByName(copies).withColumn("split", split)
    dataset = F.when(F.col("split").isin("crossgen", "own"), F.col("split")).otherwise("140k")
    return rows.select(
        "item_id",
        "phash",
        "dhash",
        dataset.alias("dataset"),
        "split",
        F.concat(F.lit("img/"), "item_id").alias("rel_path"),
        pick(stable_mod(F.col("item_id"), 14, 2), ["real", "fake"]).alias("label"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("user"), "user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face boxes in detector pixels; one image per order key."""
    image = F.col("l_orderkey")
    width = (200 + image * 7919 % 1800).cast("int")
    height = (200 + image * 104729 % 1800).cast("int")
    x1, y1 = F.col("l_quantity") * 4.0, F.col("l_linenumber") * 20.0
    return table(spark, sf_dir, "lineitem").select(
        image.alias("image_id"),
        F.col("l_linenumber").alias("pos"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 10.0 + F.col("l_tax") * 1000.0).alias("x2"),
        (y1 + 10.0 + F.col("l_discount") * 900.0).alias("y2"),
        (F.lit(0.8) + F.col("l_discount") * 2.0).alias("prob"),
        width.alias("image_width"),
        height.alias("image_height"),
        detection_scale(width, height)["scale"].alias("scale"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (1 + stable_mod(F.col("event_id"), 15, 3)).alias("num_faces"),
        F.when(stable_mod(F.col("event_id"), 16, 4) > 0, F.concat(F.lit("up/"), "event_id", F.lit(".jpg"))).alias(
            "image_path"
        ),
        F.col("value").alias("latency_ms"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics with a quality label; `fixed` never varies."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("n_digits"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.lit(1.0).alias("fixed"),
    )
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "fake").otherwise("real").alias("label")
    )
    return docs.join(labels, "doc_id")


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") < 5, "fake").otherwise("real").alias("label"),
        F.when(stable_mod(F.col("vec_id"), 17, 5) == 0, "val").otherwise("train").alias("split"),
    )


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append log of preparation records, as JSON lines with a sequence; some lines are torn."""
    status = F.when(F.col("event_type") == "error", "read_error").when(F.col("event_type") == "view", "no_face")
    rec = F.struct(
        F.lit("140k").alias("dataset"),
        F.concat(F.lit("doc/"), "user_id").alias("rel_path"),
        status.otherwise("ok").alias("status"),
        F.concat(F.lit("out/"), "event_id", F.lit(".jpg")).alias("processed_rel_path"),
    )
    line = F.to_json(rec)
    torn = stable_mod(F.col("event_id"), 18, 25)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(torn == 0, F.substring(line, 1, 30)).when(torn == 1, F.lit("")).otherwise(line).alias("line"),
    )


def _magic(key: Column) -> Column:
    return pick(
        stable_mod(key, 40, 7),
        ["FFD8FF", "89504E470D0A1A0A", "52494646000000005745425056503820", "474946383961", "424D", "474946383761", ""],
    )


def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bytes behind different magic headers."""
    key = F.col("page_id")
    magic = _magic(key)
    return table(spark, sf_dir, "pages").select(
        key.alias("page_id"), F.col("url").alias("rel_path"), F.concat(F.unhex(magic), F.col("html").cast("binary")).alias("content")
    )


def with_upload_columns(pages: DataFrame) -> DataFrame:
    """Pages as uploads: bytes behind a magic header, hashed dimensions, faces and logit. Streams too."""
    key = F.col("page_id")
    content = F.concat(F.unhex(_magic(key)), F.col("html").cast("binary"))
    broken = stable_mod(key, 43, 9) == 0
    return pages.select(
        "page_id",
        F.when(stable_mod(key, 42, 11) == 0, 0).otherwise(F.octet_length(content)).cast("bigint").alias("file_size"),
        sniff_format(content).alias("format"),
        F.when(~broken, 64 + stable_mod(key, 44, 8000)).cast("int").alias("width"),
        F.when(~broken, 64 + stable_mod(key, 45, 8000)).cast("int").alias("height"),
        stable_mod(key, 46, 5).alias("num_faces"),
        ((stable_mod(key, 47, 101) - 50) / 10.0).alias("logit"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_upload_columns(table(spark, sf_dir, "pages"))


def page_images(spark: SparkSession, sf_dir: str, width: int = 32) -> DataFrame:
    """Each page's whole bytes as a BGR picture of fixed width, zero-padded to full rows."""
    raw = F.col("html").cast("binary")
    stride = 3 * width
    rows = F.ceil(F.octet_length(raw) / stride).cast("int")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("item_id"),
        pick(stable_mod(F.col("page_id"), 41, 3), ["ffhq", "sdxl", "flux"]).alias("source"),
        F.struct(
            F.col("url").alias("origin"),
            rows.alias("height"),
            F.lit(width).alias("width"),
            F.lit(3).alias("nChannels"),
            F.lit(16).alias("mode"),
            F.rpad(raw, rows * stride, F.lit(b"\x00")).alias("data"),
        ).alias("image"),
    )


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("sample_ms"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training history: one run per user, epochs in time order."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        F.round(F.col("value"), 0).alias("val_auc"),
    )
    placed = with_value_blocks(rows, {"at": "block"})
    return ranked(placed, ["run"], ["at", "event_id"], F.col("block"), "epoch").select("run", "epoch", "val_auc")


def feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four embeddings make one item: each is an 8x8 channel."""
    cells = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") - F.col("vec_id") % 4).alias("item_id"),
        (F.col("vec_id") % 4).cast("int").alias("c"),
        F.posexplode("embedding").alias("p", "v"),
    )
    return cells.select(
        "item_id", "c", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.col("v").cast("double").alias("a")
    )


def quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantisation tables at a hashed quality, first entry disturbed; every tenth item has none."""
    key = F.col("p_partkey")
    q = (1 + stable_mod(key, 50, 100)).cast("int")
    percent = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q).cast("int")
    base = F.array(*[F.lit(v) for v in STANDARD_LUMA_TABLE])

    def scaled(p: Column) -> Column:
        return F.transform(base, lambda v: F.least(F.lit(255), F.greatest(F.lit(1), F.floor((v * p + 50) / 100).cast("int"))))

    # a one-element transform binds the hashed percent once per row
    table_at = F.transform(F.array(percent), scaled)[0]
    bumped = F.transform(
        F.array(table_at), lambda t: F.concat(F.array(F.get(t, F.lit(0)) + stable_mod(key, 51, 40).cast("int")), F.slice(t, 2, 63))
    )[0]
    return table(spark, sf_dir, "part").select(
        key.alias("item_id"), F.when(stable_mod(key, 52, 10) > 0, bumped).alias("quant")
    )


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every in-distribution and cross-generator item at every grid point; noise grows along the grid."""
    rows = expand_grid(predictions(spark, sf_dir).filter(F.col("split").isin("test", "crossgen")))
    noise = ((F.col("item_id") * 31 + F.col("step") * 17) % 21 - 10) * F.col("step")
    return rows.withColumn("logit", (F.col("tenths") + noise) / 10.0).withColumn(
        "prob", apply_calibration(F.col("logit"), TEMPERATURE)
    )


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate models: one per brand, measures derived from its parts; some measures are missing."""
    n = F.count(F.lit(1))
    sizes, keys, prods = F.sum("p_size"), F.sum("p_partkey"), F.sum(F.col("p_size") * F.col("p_partkey"))
    grouped = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model"))
    base = grouped.agg(n.alias("n"), sizes.alias("s"), keys.alias("k"), prods.alias("sk"))
    mean = (6000 + F.col("k") % 3000) / 10000.0
    have_cross = F.col("n") % 7 != 0
    return base.select(
        "model",
        ((9600 + F.col("s") % 400) / 10000.0).alias("id_auc"),
        F.when(have_cross, mean).alias("crossgen_mean_auc"),
        F.when(have_cross, (5900 + F.col("k") % 3000 - F.col("s") % 50) / 10000.0).alias("crossgen_min_auc_ci_low"),
        ((7000 + F.col("sk") % 2500) / 10000.0).alias("own_auc"),
        F.when(F.col("n") % 5 != 0, (100 + F.col("sk") % 600).cast("double")).alias("p95_latency_ms"),
    )
