"""Density over time, and positions at adaptive place levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.functions.geo import cell_of, cell_parent
from tripline.functions.labels import city_label
from tripline.operators.runs import mean_degrees


def photo_density(
    points: DataFrame, width: str = "1 day", by: Sequence[str] = ("track_id",)
) -> DataFrame:
    """Number of photos per time bin; combined map-side, so a hot bin costs one row per task."""
    return (
        points.groupBy(*by, F.window("t", width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("photos"))
        .select(*by, F.col("bin.start").alias("bin_start"), "photos")
    )


def poi_rollup(
    points: DataFrame, cell_level: int = 12, by: Sequence[str] = ("track_id",)
) -> DataFrame:
    """Count and mean position per country, per city and per neighbourhood cell."""
    cell = cell_parent(cell_of(F.col("lat"), F.col("lng")), cell_level)
    rows = points.where(F.col("cc") != "").select(
        *by,
        "cc",
        city_label(F.col("cc"), F.col("city"), F.col("admin1")).alias("city"),
        cell.alias("cell"),
        "lat",
        "lng",
    )
    # The finest grouping is reduced first; the levels then run over its few rows.
    fine = rows.groupBy(*by, "cc", "city", "cell").agg(
        F.sum("lat").alias("lat"), F.sum("lng").alias("lng"), F.count(F.lit(1)).alias("n")
    )
    levels = fine.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(level).alias("level"),
                        F.col("cc").alias("cc"),
                        (F.col("city") if depth > 0 else F.lit(None).cast("string")).alias("city"),
                        (F.col("cell") if depth > 1 else F.lit(None).cast("long")).alias("cell"),
                    )
                    for depth, level in enumerate(("country", "city", "area"))
                ]
            )
        ).alias("k"),
        "lat",
        "lng",
        "n",
    )
    total = F.sum("n")
    return (
        levels.where((F.col("k.level") == "country") | F.col("k.city").isNotNull())
        .groupBy(*by, "k.level", "k.cc", "k.city", "k.cell")
        .agg(
            total.alias("photos"),
            mean_degrees(F.sum("lat"), total).alias("lat"),
            mean_degrees(F.sum("lng"), total).alias("lng"),
        )
    )

