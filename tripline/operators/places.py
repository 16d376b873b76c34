"""Place names for the cells that located items fall into.

Items are reduced to their cells first, by a map-side combined aggregation, so everything
about lookups and names runs once per cell, however many items share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.geo import (
    PLACE_LEVEL,
    cell_center_lat,
    cell_center_lng,
    cell_parent,
)
from tripline.functions.labels import COMPONENTS_DDL, json_list, place_area, place_city, place_country

MONTHLY_LOOKUPS = 10_000
RESPONSE_DDL = f"array<struct<formatted_address:string,address_components:{COMPONENTS_DDL}>>"


def pending_geocode(media: DataFrame, recalculate: bool = False) -> DataFrame:
    """Located items without a place link, or all located ones."""
    rows = media.where(F.col("latitude").isNotNull())
    return rows if recalculate else rows.where(F.col("geo_cell").isNull())


def estimate_cells(
    media: DataFrame,
    levels: Sequence[int],
    recalculate: bool = False,
    budget: int = MONTHLY_LOOKUPS,
) -> DataFrame:
    """Pending items and distinct cells per level, in one pass. Base cells are made distinct
    first; only those are expanded to the levels."""
    pending = pending_geocode(media, recalculate)
    base = pending.groupBy("base_cell").agg(F.count(F.lit(1)).alias("_items"))
    per_level = base.select(
        "_items",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(level).alias("level"),
                        cell_parent(F.col("base_cell"), level).alias("cell"),
                    )
                    for level in sorted(set(levels))
                ]
            )
        ).alias("l"),
    )
    cells = F.count_distinct("l.cell")
    return (
        per_level.groupBy("l.level")
        .agg(F.sum("_items").alias("pending"), cells.alias("cells"))
        .withColumn("within_budget", F.col("cells") <= budget)
    )


def pending_cells(
    pending: DataFrame, place: DataFrame, level: int = PLACE_LEVEL, recalculate: bool = False
) -> DataFrame:
    """One row per cell of pending items: first time seen, number of items, and whether it
    needs a lookup (no place row, or one without a stored response, or all)."""
    cells = (
        pending.withColumn("cell_id", cell_parent(F.col("base_cell"), level))
        .where(F.col("cell_id").isNotNull())
        .groupBy("cell_id")
        .agg(F.min("taken_at").alias("first_at"), F.count(F.lit(1)).alias("items"))
    )
    known = place.select("cell_id", F.col("geocode_raw").isNotNull().alias("_raw"))
    needs = F.lit(True) if recalculate else ~F.coalesce("_raw", F.lit(False))
    return cells.join(known, "cell_id", "left").select(
        "cell_id", "first_at", "items", needs.alias("needs_lookup")
    )


def geocode_worklist(cells: DataFrame, max_lookups: int | None = None) -> DataFrame:
    """Cells to look up, by first time seen; at most ``max_lookups`` (a top-k, no full sort)."""
    work = cells.where("needs_lookup").select("cell_id", "first_at", "items")
    if max_lookups is None:
        return work
    return work.orderBy(F.col("first_at").asc_nulls_last(), "cell_id").limit(max_lookups)


def _first_result(response: Column) -> Column:
    """The first result of a lookup response; NULL for none, or anything but a list."""
    return F.get(json_list(response, RESPONSE_DDL), F.lit(0))


def enrich_places(
    worklist: DataFrame, responses: DataFrame, now: Column | None = None
) -> DataFrame:
    """Place rows of the worklist cells that have a result. ``responses`` has (cell_id,
    response): the lookup itself is done outside and lands as a table."""
    at = F.current_timestamp() if now is None else now
    single = responses.groupBy("cell_id").agg(F.min("response").alias("response"))
    found = (
        worklist.select("cell_id")
        .join(single, "cell_id")
        .withColumn("_r", _first_result(F.col("response")))
        .where(F.col("_r").isNotNull())
    )
    components = F.coalesce("_r.address_components", F.array().cast(COMPONENTS_DDL))
    cell = F.col("cell_id")
    return found.withColumn("_c", components).select(
        "cell_id",
        cell_center_lat(cell).alias("center_lat"),
        cell_center_lng(cell).alias("center_lng"),
        place_city(F.col("_c")).alias("city"),
        place_area(F.col("_c")).alias("admin1"),
        place_country(F.col("_c")).alias("country_code"),
        F.coalesce("_r.formatted_address", F.lit("")).alias("formatted_address"),
        F.to_json("_c").alias("geocode_raw"),
        at.alias("geocoded_at"),
    )


def link_media(
    pending: DataFrame,
    cells: DataFrame,
    found: DataFrame,
    level: int = PLACE_LEVEL,
    key: str | Sequence[str] = "media_id",
) -> DataFrame:
    """(key, geo_cell) of every pending item whose cell was known already or was found now."""
    keys = [key] if isinstance(key, str) else list(key)
    known = cells.where(~F.col("needs_lookup")).select("cell_id")
    linked = known.unionByName(found.select("cell_id")).withColumnRenamed("cell_id", "geo_cell")
    return pending.select(
        *keys, cell_parent(F.col("base_cell"), level).alias("geo_cell")
    ).join(linked, "geo_cell").select(*keys, "geo_cell")


def derive_all(place: DataFrame, redo: bool = False) -> DataFrame:
    """Place rows whose city and area are derived anew from the stored response: those without
    a city, or all that have a response. A stored value that is not a list yields NULLs."""
    rows = place.where(F.col("geocode_raw").isNotNull())
    if not redo:
        rows = rows.where(F.col("city").isNull())
    return rows.withColumn("_c", json_list(F.col("geocode_raw"), COMPONENTS_DDL)).withColumns(
        {"city": place_city(F.col("_c")), "admin1": place_area(F.col("_c"))}
    ).drop("_c")


def geocode_stats(cells: DataFrame, worklist: DataFrame, found: DataFrame) -> DataFrame:
    """Counters of one enrichment: a row of total_items, processed, skipped, api_calls, errors."""
    status = (
        cells.join(worklist.select("cell_id", F.lit(True).alias("_asked")), "cell_id", "left")
        .join(found.select("cell_id", F.lit(True).alias("_found")), "cell_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_asked", "_found")})
    )
    items = F.col("items")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, items)), F.lit(0))

    return status.agg(
        F.coalesce(F.sum(items), F.lit(0)).alias("total_items"),
        total(~F.col("needs_lookup") | F.col("_found")).alias("processed"),
        total(F.col("_asked") & ~F.col("_found")).alias("skipped"),
        F.count_if("_asked").alias("api_calls"),
        F.lit(0).cast("long").alias("errors"),
    )
