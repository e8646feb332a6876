import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusgauge.functions.decision import apply_calibration, label_to_int, outcome, verdict
from corpusgauge.functions.formats import (
    client_key,
    finite_or_null,
    flag,
    jpeg_quality_estimate,
    scaled_table,
    sniff_format,
    upload_error,
    upload_status,
)
from corpusgauge.functions.geometry import detection_scale, scaled_crop, square_crop
from corpusgauge.functions.hashing import offline_quality, output_name, stable_hash, stable_mod, stable_uniform_int


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def by_hand(seed, key):
    return int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big")


def test_stable_hash_matches_sha256(spark):
    keys = [f"k{i}é" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select("k", stable_hash(F.col("k"), 7).alias("h"), stable_mod(F.col("k"), 7, 10**8).alias("m")).collect()
    for r in rows:
        assert int(r["h"]) == by_hand(7, r["k"])
        assert r["m"] == by_hand(7, r["k"]) % 10**8


def test_uniform_int_range(spark):
    df = spark.range(500).select(offline_quality(F.col("id")).alias("q"))
    values = [r["q"] for r in df.collect()]
    assert min(values) == 80 and max(values) == 95 and len(set(values)) == 16
    with pytest.raises(ValueError):
        stable_uniform_int(F.lit("x"), 0, 5, 4)


def test_output_name(spark):
    name = one(spark, output_name(F.lit("d"), F.lit("s"), F.lit("real"), F.lit("ab" * 32), F.lit("a/b.png")))
    assert name == f"d/s/real/{'ab' * 8}_{by_hand(0, 'a/b.png') % 10**8:08d}.jpg"


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        (b"\xff\xd8\xff\xe0abc", "jpeg"),
        (b"\x89PNG\r\n\x1a\nrest", "png"),
        (b"RIFF1234WEBPVP8 ", "webp"),
        (b"RIFF1234WAVEfmt ", "unknown"),
        (b"RIFF", "unknown"),
        (b"GIF87a..", "gif"),
        (b"GIF89a..", "gif"),
        (b"BM....", "bmp"),
        (b"", "unknown"),
        (b"hello", "unknown"),
    ],
)
def test_sniff(spark, content, expected):
    assert one(spark, sniff_format(F.lit(content))) == expected


@pytest.mark.parametrize("quality", [1, 10, 35, 50, 75, 90, 95, 100])
def test_quality_estimate(spark, quality):
    df = spark.createDataFrame([(scaled_table(quality),)], "q array<int>")
    assert abs(df.select(jpeg_quality_estimate(F.col("q")).alias("v")).first()["v"] - quality) <= 1


def test_quality_estimate_without_table(spark):
    df = spark.createDataFrame([(None,), ([],)], "q array<int>")
    assert [r["v"] for r in df.select(jpeg_quality_estimate(F.col("q")).alias("v")).collect()] == [None, None]


@pytest.mark.parametrize(
    ("box", "size", "expected"),
    [
        ((40, 40, 60, 70), (200, 200), (39, None, None, False)),
        ((0, 0, 50, 50), (200, 200), (65, 0, 0, True)),
        ((10, 5, 90, 95), (100, 100), (100, 0, 0, True)),
    ],
)
def test_square_crop(spark, box, size, expected):
    crop = one(spark, square_crop(*[F.lit(float(v)) for v in box], *[F.lit(v) for v in size]))
    assert (crop["side"], crop["clamped"]) == (expected[0], expected[3])
    if expected[1] is not None:
        assert (crop["left"], crop["top"]) == expected[1:3]


def test_square_crop_rejects_degenerate_box(spark):
    with pytest.raises(PySparkException):
        one(spark, square_crop(*[F.lit(v) for v in (5.0, 5.0, 5.0, 9.0)], F.lit(100), F.lit(100)))


def test_scaled_crop_equals_crop_of_scaled_box(spark):
    a = one(spark, scaled_crop(*[F.lit(v) for v in (40.0, 40.0, 60.0, 70.0)], F.lit(0.5), F.lit(100), F.lit(100)))
    b = one(spark, square_crop(*[F.lit(v) for v in (20.0, 20.0, 30.0, 35.0)], F.lit(100), F.lit(100)))
    assert a == b


def test_detection_scale(spark):
    small, large = (one(spark, detection_scale(F.lit(w), F.lit(h))) for w, h in ((800, 600), (4096, 1)))
    assert (small["scale"], small["width"], small["height"]) == (1.0, 800, 600)
    assert (large["scale"], large["width"], large["height"]) == (0.25, 1024, 1)


def test_flags(spark):
    df = spark.createDataFrame([("True",), ("true",), ("1",), ("0",), ("yes",), (None,)], "t string")
    assert [r["v"] for r in df.select(flag(F.col("t")).alias("v")).collect()] == [1, 1, 1, 0, 0, 0]
    values = [one(spark, finite_or_null(F.lit(v))) for v in (1.5, math.nan, math.inf, -math.inf)]
    assert values == [1.5, None, None, None]


def test_verdict_band_is_open_and_optional(spark):
    def judge(p, delta):
        return one(spark, verdict(F.lit(p), 0.5, delta))

    assert judge(0.25, 0.25) == "REAL" and judge(0.75, 0.25) == "AI_GENERATED"
    assert judge(0.26, 0.25) == "UNCERTAIN" and judge(0.5, 0.0) == "AI_GENERATED"


def test_sigmoid_is_clipped(spark):
    assert one(spark, apply_calibration(F.lit(-1e6), 1.0)) == 1 / (1 + math.exp(50))
    assert one(spark, apply_calibration(F.lit(0.0), 3.0)) == 0.5


def test_labels_and_outcomes(spark):
    assert one(spark, label_to_int(F.lit("fake"))) == 1 and one(spark, label_to_int(F.lit("real"))) == 0
    with pytest.raises(PySparkException):
        one(spark, label_to_int(F.lit("odd")))
    got = [one(spark, outcome(F.lit(lb), F.lit(p), 0.5)) for lb in ("fake", "real") for p in (0.5, 0.4)]
    assert got == ["TP", "FN", "FP", "TN"]


def test_upload_rules_in_order(spark):
    rows = [
        (0, "gif", 10, 10, 1, "INVALID_IMAGE", 422),
        (11 * 1024 * 1024, "gif", 10, 10, 1, "FILE_TOO_LARGE", 413),
        (10, "gif", None, None, 1, "UNSUPPORTED_MEDIA_TYPE", 415),
        (10, "png", None, None, 1, "INVALID_IMAGE", 422),
        (10, "png", 50_000, 50_000, 1, "INVALID_IMAGE", 422),
        (10, "png", 10, 10, 0, "NO_FACE_DETECTED", 422),
        (10, "webp", 10, 10, 2, None, 200),
    ]
    df = spark.createDataFrame(rows, "s bigint, f string, w int, h int, n int, e string, c int")
    error = upload_error(*[F.col(c) for c in "sfwhn"])
    for r in df.select("*", error.alias("got"), upload_status(error).alias("code")).collect():
        assert (r["got"], r["code"]) == (r["e"], r["c"])


def test_client_key(spark):
    def key(header, host, trust):
        lit = [F.lit(v).cast("string") for v in (header, host)]
        return one(spark, client_key(*lit, trust))

    assert key(" 1.2.3.4 , 5.6.7.8", "9.9.9.9", True) == "1.2.3.4"
    assert key("1.2.3.4", "9.9.9.9", False) == "9.9.9.9"
    assert key("", "9.9.9.9", True) == "9.9.9.9" and key(None, None, True) == "unknown"
