"""Stable identities of media files and of their sidecar contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripline.functions.text import strip

# The separator and the leading tag of every hashed tuple.
_SEP = "\x1f"
_TAG_URL, _TAG_TITLE, _TAG_EXIF, _TAG_FILE, _TAG_SIDECAR = (
    "url",
    "title-time",
    "exif-hash",
    "file",
    "sidecar",
)


def _hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(_SEP, *parts))


def dedupe_key(
    url: Column,
    title: Column,
    epoch: Column,
    datetime_text: Column,
    perceptual_hash: Column,
    file_name: Column,
    file_size: Column,
) -> Column:
    """SHA-1 over the strongest identity that is at hand."""
    return (
        F.when(url != "", _hash(F.lit(_TAG_URL), strip(url)))
        .when(
            (title != "") & epoch.isNotNull(),
            _hash(F.lit(_TAG_TITLE), F.lower(title), epoch.cast("string")),
        )
        .when(
            (datetime_text != "") & (perceptual_hash != ""),
            _hash(F.lit(_TAG_EXIF), datetime_text, perceptual_hash),
        )
        .otherwise(_hash(F.lit(_TAG_FILE), F.lower(file_name), file_size.cast("string")))
    )


def sidecar_fingerprint(valid: Column, title: Column, description: Column, lat: Column, lng: Column):
    """SHA-1 over title, description and coordinates; NULL where there is no sidecar."""

    def norm(c: Column) -> Column:
        return F.lower(strip(F.coalesce(c, F.lit(""))))

    coords = F.when(
        lat.isNotNull() & lng.isNotNull(), F.format_string("%.6f,%.6f", lat, lng)
    ).otherwise("")
    return F.when(valid, _hash(F.lit(_TAG_SIDECAR), norm(title), norm(description), coords))
