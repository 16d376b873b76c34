"""Capture times, time zones and local days."""

from __future__ import annotations

import functools
import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = re.compile(r"\d{4}-\d{2}")
EXIF_TEXT = r"^\d{4}:\d{1,2}:\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"

SOURCE_SIDECAR, SOURCE_EXIF, SOURCE_MTIME, SOURCE_MANUAL = (
    "sidecar",
    "exif",
    "file_mtime",
    "manual",
)


#: Names that Python's list has and Spark's conversions refuse; the first two name no zone.
_REFUSED = {"Factory": None, "localtime": None, "ROC": "Asia/Taipei"}


@functools.cache
def _zone_pattern() -> str:
    """All IANA names, also those without an area (``Japan``, ``GMT``), as one pattern branching by
    area."""
    areas: dict[str, list[str]] = {}
    for name in sorted(zoneinfo.available_timezones() - set(_REFUSED)):
        area, slash, city = name.rpartition("/")
        if not area.startswith(("posix", "right")):
            areas.setdefault(area + slash, []).append(re.escape(city))
    branches = [f"{area}(?:{'|'.join(cities)})" for area, cities in areas.items()]
    return f"^(?:{'|'.join(branches)})$"


def valid_zone(tz: Column) -> Column:
    """The zone itself if known, else NULL: the conversion functions raise on unknown ones.
    A single pattern literal, since hundreds of literals would slow the analyzer down."""
    known = F.when(tz.rlike(_zone_pattern()), tz)
    for name, same in _REFUSED.items():
        if same:
            known = F.when(tz == name, F.lit(same)).otherwise(known)
    return known


def local_date(taken_at: Column, tz: Column) -> Column:
    """Calendar day at the zone; the UTC day where the zone is missing or unknown."""
    zone = F.coalesce(valid_zone(tz), F.lit("UTC"))
    return F.to_date(F.from_utc_timestamp(taken_at, zone))


def exif_wall_clock(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as a zone-less reading; NULL for anything malformed."""
    squeezed = F.regexp_replace(text, r"\s+", " ")
    return F.when(text.rlike(EXIF_TEXT), F.try_to_timestamp(squeezed, F.lit("y:M:d H:m:s")))


def taken_at(epoch: Column, datetime_text: Column, mtime: Column, tz: Column) -> Column:
    """Struct (at, source): sidecar epoch, else EXIF text in the zone, else file time."""
    wall = exif_wall_clock(datetime_text)
    exif = F.to_utc_timestamp(wall, F.coalesce(valid_zone(tz), F.lit("UTC")))
    none = F.lit(None)

    def choice(at: Column, source: str) -> Column:
        return F.struct(at.alias("at"), F.lit(source).alias("source"))

    return (
        F.when(epoch.isNotNull(), choice(F.timestamp_seconds(epoch), SOURCE_SIDECAR))
        .when(exif.isNotNull(), choice(exif, SOURCE_EXIF))
        .when(mtime.isNotNull(), choice(mtime, SOURCE_MTIME))
        .otherwise(
            F.struct(none.cast("timestamp").alias("at"), none.cast("string").alias("source"))
        )
    )


def month_bounds(month_filter: str) -> tuple[str, str]:
    """``YYYY-MM`` or ``YYYY-MM,YYYY-MM`` as ordered inclusive bounds."""
    months = [m.strip() for m in month_filter.split(",")]
    if len(months) > 2 or any(not _MONTH.fullmatch(m) for m in months):
        raise ValueError(f"expected YYYY-MM[,YYYY-MM], got {month_filter!r}")
    return min(months), max(months)


def in_months(at: Column, lo: str, hi: str) -> Column:
    """Whether the UTC month lies in the inclusive range; false for NULL. Half-open bounds
    on the bare column, so that it reaches the scan as a range filter."""
    lo, hi = min(lo, hi), max(lo, hi)
    year, month = int(hi[:4]), int(hi[5:])
    after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    start = F.lit(f"{lo}-01").cast("timestamp")
    return F.coalesce((at >= start) & (at < F.lit(after).cast("timestamp")), F.lit(False))
