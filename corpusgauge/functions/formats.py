"""File-level signals: magic bytes, JPEG quality, tolerant flags, upload checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
SUPPORTED_FORMATS = ("jpeg", "png", "webp")

# The luminance quantisation table of the JPEG standard (Annex K), quality 50.
STANDARD_LUMA_TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)


def sniff_format(content: Column) -> Column:
    """Format from the leading bytes; the file name plays no part."""

    def head(hex_text: str, start: int = 1) -> Column:
        size = len(hex_text) // 2
        return F.hex(F.substring(content, start, size)) == hex_text

    return (
        F.when(head("FFD8FF"), "jpeg")
        .when(head("89504E470D0A1A0A"), "png")
        .when(head("52494646") & head("57454250", 9), "webp")
        .when(head("474946383761") | head("474946383961"), "gif")
        .when(head("424D"), "bmp")
        .otherwise("unknown")
    )


def scaled_table(quality: int) -> list[int]:
    """The standard table at a quality setting, in the integer arithmetic encoders use."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (v * percent + 50) // 100)) for v in STANDARD_LUMA_TABLE]


def quality_means() -> list[float]:
    """Mean table entry for quality 1..100; a mean does not depend on coefficient order."""
    return [sum(scaled_table(q)) / 64 for q in range(1, 101)]


def jpeg_quality_estimate(quant: Column) -> Column:
    """Quality whose table mean is closest, the lowest on a tie; null without a table.

    Means fall as quality rises, so the answer is how many midpoints between neighbours lie above.
    """
    total = F.aggregate(quant, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    mean = total / F.size(quant)
    first: dict[float, int] = {}
    for q, m in enumerate(quality_means(), 1):
        first.setdefault(m, q)
    levels = list(first)
    middles = F.array(*[F.lit((a + b) / 2) for a, b in zip(levels, levels[1:], strict=False)])
    qualities = F.array(*[F.lit(q) for q in first.values()])
    # a one-element transform binds the mean once, instead of once per midpoint
    above = F.transform(F.array(mean), lambda mu: F.size(F.filter(middles, lambda e: e > mu)))[0]
    return F.when(F.size(quant) > 0, F.element_at(qualities, above + 1))


def flag(value: Column) -> Column:
    """1 for the texts true/1 in any case, 0 for everything else including null."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False)).cast("int")


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null, so that JSON output stays valid."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def upload_error(
    size: Column,
    content_format: Column,
    width: Column,
    height: Column,
    num_faces: Column,
    max_bytes: int = 10 * 1024 * 1024,
    max_pixels: int = 40_000_000,
) -> Column:
    """First failing upload rule, or null. Undecodable content has null dimensions."""
    pixels = width.cast("bigint") * height.cast("bigint")
    return (
        F.when(size == 0, "INVALID_IMAGE")
        .when(size > max_bytes, "FILE_TOO_LARGE")
        .when(~content_format.isin(*SUPPORTED_FORMATS), "UNSUPPORTED_MEDIA_TYPE")
        .when(pixels.isNull() | (pixels > max_pixels), "INVALID_IMAGE")
        .when(num_faces == 0, "NO_FACE_DETECTED")
    )


def upload_status(error: Column) -> Column:
    """HTTP status of an upload error; 200 where there is none."""
    return (
        F.when(error.isNull(), 200).when(error == "FILE_TOO_LARGE", 413).when(error == "UNSUPPORTED_MEDIA_TYPE", 415)
    ).otherwise(422)


def client_key(forwarded_for: Column, host: Column, trust_forwarded_for: bool) -> Column:
    """Whom a request counts against: first forwarded address if trusted, else the peer."""
    peer = F.coalesce(host, F.lit("unknown"))
    if not trust_forwarded_for:
        return peer
    first = F.trim(F.element_at(F.split(forwarded_for, ","), 1))
    return F.when(F.length(forwarded_for) > 0, first).otherwise(peer)
