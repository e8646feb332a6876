import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import pixels
from corpusgauge.sources import files


def png(rgb):
    """PNG bytes of an [h, w, 3] array."""
    h, w, _ = rgb.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def texture(size, seed):
    return np.random.default_rng(seed).integers(0, 256, (size, size, 3), dtype=np.uint8)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for label, source, sizes in (("real", "phone", (64, 100)), ("fake", "sdxl", (64, 256))):
        folder = root / label / source
        folder.mkdir(parents=True)
        for i, size in enumerate(sizes):
            (folder / f"{i}.{'PNG' if i else 'png'}").write_bytes(png(texture(size, i)))
    (root / "fake" / "sdxl" / "junk.jpg").write_bytes(b"not an image")
    (root / "fake" / "sdxl" / "notes.txt").write_text("x")
    return root


def test_discover_and_scan(spark, corpus):
    specs = files.discover_files(spark, str(corpus), "own")
    found = {r["rel_path"]: (r["source"], r["label"], r["split"]) for r in specs.collect()}
    assert len(found) == 5 and found["real/phone/1.PNG"] == ("phone", "real", "own")
    scanned = {r["rel_path"]: r for r in files.scan_files(spark, specs, str(corpus)).collect()}
    data = (corpus / "real/phone/0.png").read_bytes()
    row = scanned["real/phone/0.png"]
    assert (row["sha256"], row["file_size"], row["format"]) == (hashlib.sha256(data).hexdigest(), len(data), "png")
    assert row["read_error"] is None and scanned["fake/sdxl/junk.jpg"]["read_error"] == "cannot identify image file"


def test_discover_split_layout_and_empty(spark, tmp_path):
    folder = tmp_path / "train" / "fake"
    folder.mkdir(parents=True)
    with pytest.raises(ValueError, match="no images"):
        files.discover_files(spark, str(tmp_path), "main", "split", {"fake": "gan"})
    (folder / "a.webp").write_bytes(b"RIFF....WEBP")
    row = files.discover_files(spark, str(tmp_path), "main", "split", {"fake": "gan", "real": "cam"}).first()
    assert (row["rel_path"], row["source"], row["label"], row["split"]) == ("train/fake/a.webp", "gan", "fake", "train")


def test_pixels_from_files(spark, corpus):
    images = files.image_pixels(spark, str(corpus)).select(F.col("image.origin").alias("origin"), "image")
    rows = {r["origin"].rsplit("/", 2)[-2] + "/" + r["origin"].rsplit("/", 1)[-1]: r for r in pixels.pixel_stats(images, ["origin"]).collect()}
    assert rows["sdxl/junk.jpg"]["mean_r"] is None
    rgb = texture(64, 0)
    row = rows["phone/0.png"]
    unit = rgb / 255.0
    assert [row[f"mean_{c}"] for c in "rgb"] == pytest.approx(list(unit.mean(axis=(0, 1))))
    assert [row[f"std_{c}"] for c in "rgb"] == pytest.approx(list(unit.std(axis=(0, 1))))
    assert row["mean_brightness"] == pytest.approx(rgb.max(axis=2).mean() / 255)
    grey = np.array([[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) >> 16 for r, g, b in line] for line in rgb], float)
    edges = [grey[y, x - 1] + grey[y, x + 1] + grey[y - 1, x] + grey[y + 1, x] - 4 * grey[y, x] for y in range(1, 63) for x in range(1, 63)]
    assert row["laplacian_var"] == pytest.approx(np.var(edges))
    assert 0.5 < row["hf_energy_ratio"] < 1.0  # white noise: most of the plane lies beyond half the radius


def image_rows(spark, pictures):
    rows = [(g, (h, w, 3, bytearray(data))) for g, (h, w, data) in pictures]
    return spark.createDataFrame(rows, "source string, image struct<height:int,width:int,nChannels:int,data:binary>")


def grey_picture(values):
    grid = np.repeat(values.astype(np.uint8)[..., None], 3, axis=2)
    return (*values.shape, grid.tobytes())


def test_spectrum_peaks_at_the_frequency(spark):
    x = np.arange(128)
    wave = np.tile(127 + 100 * np.cos(2 * math.pi * 20 * x / 128), (128, 1))
    df = image_rows(spark, [("a", grey_picture(wave)), ("a", grey_picture(wave)), ("a", grey_picture(np.zeros((64, 64))))]).repartition(3)
    spectrum = pixels.mean_spectrum(df, "source", 128)
    top = spectrum.orderBy(F.col("value").desc()).first()
    assert top["y"] == 64 and abs(top["x"] - 64) == 20
    power = np.log(np.abs(np.fft.fftshift(np.fft.fft2(wave - wave.mean()))) ** 2 + 1e-8)
    cells = spark.createDataFrame([("a", y, x, float(power[y, x])) for y in range(128) for x in range(128)], "source string, y int, x int, value double")
    profile = {r["r"]: r["value"] for r in pixels.radial_profile(cells, "source", 128).collect()}
    assert len(profile) == 64 and max(profile, key=profile.get) == 20
    counts = pixels.spectrum_counts(df, "source", 128).first()
    assert (counts["used"], counts["skipped"]) == (2, 1)


def test_mean_spectrum_equals_numpy(spark):
    rng = np.random.default_rng(0)
    pictures = [rng.integers(0, 256, (40, 44)) for _ in range(5)]
    df = image_rows(spark, [("s", grey_picture(p)) for p in pictures]).repartition(4)
    got = pixels.mean_spectrum(df, "source", 32).toPandas().sort_values(["y", "x"])["value"].to_numpy()
    taper = np.outer(np.hanning(32), np.hanning(32))
    total = 0
    for p in pictures:
        patch = p[4:36, 6:38].astype(float)
        total = total + np.log(np.abs(np.fft.fftshift(np.fft.fft2((patch - patch.mean()) * taper))) ** 2 + 1e-8)
    assert np.allclose(got, (total / 5).ravel())


def test_flat_and_broken_images(spark):
    flat = (8, 8, bytes([7] * 192))
    df = image_rows(spark, [("flat", flat), ("cut", (8, 8, bytes(10))), ("bad", (-1, -1, b""))])
    rows = {r["source"]: r for r in pixels.pixel_stats(df, ["source"]).collect()}
    assert rows["flat"]["hf_energy_ratio"] == 0.0 and rows["flat"]["std_r"] == pytest.approx(0.0)
    assert rows["cut"]["mean_r"] is None and rows["bad"]["mean_r"] is None
