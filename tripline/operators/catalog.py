"""Queries over the media and place tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def media_by_key(media: DataFrame, key: str, column: str = "dedupe_key") -> DataFrame:
    return media.where(F.col(column) == key)


def place_by_cell(place: DataFrame, cell) -> DataFrame:
    return place.where(F.col("cell_id") == cell)


def located_items(media: DataFrame, year: int | None = None) -> DataFrame:
    """Rows with a place on earth and in time; ``year`` is the *local* year.

    The order is (taken_at, media_id); sort where a consumer needs it, see ``in_time_order``.
    """
    rows = media.where(F.col("latitude").isNotNull() & F.col("taken_at").isNotNull())
    if year is not None:
        # A range on the bare column: reaches the scan, unlike year(local_date) = y.
        rows = rows.where(
            F.col("local_date").between(F.lit(f"{year:04d}-01-01").cast("date"),
                                        F.lit(f"{year:04d}-12-31").cast("date"))
        )
    return rows


def in_time_order(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total order by range partitions over (by, taken_at, media_id)."""
    return rows.orderBy(*by, "taken_at", "media_id")


def located_with_place(media: DataFrame, place: DataFrame, year: int | None = None) -> DataFrame:
    """Located items left-joined to their place. Whether ``place`` is broadcast is left to
    the optimizer, which knows its size; a large one is shuffled, and a cell holding very
    many items is split there by the adaptive skew join."""
    names = place.select(
        F.col("cell_id").alias("geo_cell"),
        *[c for c in ("country_code", "city", "admin1", "formatted_address") if c in place.columns],
    )
    return located_items(media, year).join(names, "geo_cell", "left")


def count_media(media: DataFrame, located_only: bool = False) -> DataFrame:
    rows = media.where(F.col("latitude").isNotNull()) if located_only else media
    return rows.agg(F.count(F.lit(1)).alias("n"))


def catalog_range(
    media: DataFrame, place: DataFrame, by: Sequence[str] = ("track_id",)
) -> DataFrame:
    """First and last UTC day and the sorted country codes. The set of codes is bounded by
    the number of countries, so it is collected inside the aggregation."""
    rows = located_with_place(media, place)
    codes = F.array_sort(
        F.collect_set(F.when(F.col("country_code") != "", F.col("country_code")))
    )
    return rows.groupBy(*by).agg(
        F.to_date(F.min("taken_at")).alias("min"),
        F.to_date(F.max("taken_at")).alias("max"),
        codes.alias("countries"),
    )


def dangling_links(media: DataFrame, place: DataFrame) -> DataFrame:
    """Items whose cell link points to no place."""
    return media.where(F.col("geo_cell").isNotNull()).join(
        place.select(F.col("cell_id").alias("geo_cell")), "geo_cell", "left_anti"
    )


def load_points(
    media: DataFrame,
    place: DataFrame,
    start: Column | str | None = None,
    end: Column | str | None = None,
    region: Sequence[str] | None = None,
    by: Sequence[str] = ("track_id",),
) -> DataFrame:
    """Located items with ``start <= taken_at < end`` (UTC; a bound of None is left out) and
    their place names; ``region`` keeps the listed countries. The time range is on the scanned
    column, so it is pushed down."""

    def instant(v: Column | str) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("timestamp")

    window = media
    if start is not None:
        window = window.where(F.col("taken_at") >= instant(start))
    if end is not None:
        window = window.where(F.col("taken_at") < instant(end))
    rows = located_with_place(window, place)
    if region:
        rows = rows.where(F.upper("country_code").isin([c.upper() for c in region]))
    return as_points(rows, by)


def as_points(rows: DataFrame, by: Sequence[str] = ("track_id",)) -> DataFrame:
    return rows.select(
        *by,
        "media_id",
        F.col("taken_at").alias("t"),
        F.coalesce("local_date", F.to_date("taken_at")).alias("local_date"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        F.col("country_code").alias("cc"),
        "city",
        "admin1",
        "url",
    )
