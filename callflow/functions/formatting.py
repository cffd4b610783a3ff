"""Small display and gate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats, limits and media types.
EXTENSIONS = ["wav", "mp3", "flac", "m4a", "ogg", "mp4"]
MAX_FILE_BYTES = 500 * 1024 * 1024
MIN_SECONDS, MAX_SECONDS = 1, 18000
MIME_FORMATS = {
    "audio/wav": "wav", "audio/wave": "wav", "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/flac": "flac",
    "audio/m4a": "m4a", "audio/mp4": "m4a", "audio/ogg": "ogg", "video/mp4": "m4a",
}
EXTENSION_MIME = {
    "wav": "audio/wav", "mp3": "audio/mpeg", "flac": "audio/flac", "m4a": "audio/m4a", "ogg": "audio/ogg", "mp4": "video/mp4",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_reason(size: Column, ext: Column) -> Column:
    """Why a file is refused, or null."""
    return (
        F.when(size > MAX_FILE_BYTES, "file_too_large")
        .when(size == 0, "file_empty")
        .when(~ext.isin(EXTENSIONS), "unsupported_format")
    )


def duration_reason(seconds: Column, low: float = MIN_SECONDS, high: float = MAX_SECONDS) -> Column:
    return F.when(seconds < low, "audio_too_short").when(seconds > high, "audio_too_long")


def mime_type(mime: Column, ext: Column) -> Column:
    """The given type if supported, else the one of the extension."""
    known = F.when(mime.isin(list(MIME_FORMATS)), mime)
    return F.coalesce(known, _lookup(EXTENSION_MIME, ext), F.lit("audio/wav"))


def media_format(mime: Column) -> Column:
    return _lookup(MIME_FORMATS, mime)


def clean_url(url: Column) -> Column:
    return F.btrim(F.coalesce(url, F.lit("")), F.lit("'\"; "))


def valid_url(url: Column) -> Column:
    u = clean_url(url)
    host = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return scheme.isin("http", "https") & (host != "")


def masked(key: Column) -> Column:
    return F.when(F.length(key) > 6, F.concat(F.substring(key, 1, 2), F.lit("..."), F.right(key, F.lit(4)))).otherwise("***")


def one_decimal(x: Column) -> Column:
    """One decimal, rounding the exact binary value and ties to even."""
    n = F.rint(x * 20)
    low = F.floor((n - 1) / 2)
    rest = n - 16 * x  # exact; against 4x it tells on which side of the tie x lies
    odd = F.when(rest > 4 * x, low).when(rest < 4 * x, low + 1).otherwise(low + low % 2)
    tenths = F.when(n % 2 == 0, F.floor(n / 2)).otherwise(odd)
    return F.format_string("%.1f", tenths / 10.0)


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(one_decimal(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(one_decimal(seconds / 60), F.lit("m")))
        .otherwise(F.concat(one_decimal(seconds / 3600), F.lit("h")))
    )


def size_text(size: Column) -> Column:
    out, value = None, size.cast("double")
    for unit in ("B", "KB", "MB", "GB"):
        text = F.concat(one_decimal(value), F.lit(f" {unit}"))
        out = F.when(value < 1024, text) if out is None else out.when(value < 1024, text)
        value = value / 1024
    return out.otherwise(F.concat(one_decimal(value), F.lit(" TB")))


def last_used_text(ts: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(ts.isNull(), "Never")
        .when(minutes < 60, ago(minutes, "mins"))
        .when(minutes < 1440, ago(minutes / 60, "hours"))
        .otherwise(ago(minutes / 1440, "days"))
    )


def elapsed_seconds(end: Column, created: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(created)) / 1_000_000


def cost_estimate(seconds: Column) -> Column:
    return F.struct(
        seconds.alias("duration_seconds"), (seconds * 0.1).alias("estimated_processing_time"), F.lit("standard").alias("tier")
    )
