"""Photo-shaped inputs derived from the driver's ``events`` and ``nation`` tables.

Every derived table holds one or more rows per event, so the work of each query grows with
the tables. Derived tables are written to the shared folder on first use and read from
there, as a catalog is: the queries' filters and columns then reach a scan of stored
columns. The SQL twins in ``queries.base_sql`` spell the same derivations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions.geo import (
    PLACE_LEVEL,
    cell_center_lat,
    cell_center_lng,
    cell_of,
    cell_parent,
)
from tripline.functions.labels import PHOTO_URL_PREFIX
from tripline.functions.times import local_date
from tripline.session import scratch_path, tune, write_stage


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


_STORED: dict[tuple[str, str, str], tuple] = {}


def is_stored(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _STORED


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if not is_stored(spark, sf_dir, name):
        df = build()
        path = scratch_path(spark, name)
        write_stage(df, path, plain=True)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def _by_country(slot: Column, sg, jp, th) -> Column:
    return F.when(slot % 3 == 0, sg).when(slot % 3 == 1, jp).otherwise(th)


def _slot() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("int") % 27


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "media", lambda: _media(spark, sf_dir))


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: one located or unlocated photo per event, one track per user."""
    e = events(spark, sf_dir).withColumn("_slot", _slot())
    slot, part = F.col("_slot"), F.col("value") - F.floor("value")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    located = (k % 29) != 0
    lat = _by_country(slot, 1.3, 35.68, 13.75) + F.lit(0.15) * slot + F.lit(0.01) * part
    lng = _by_country(slot, 103.8, 139.69, 100.5) + F.lit(0.01) * part
    zone = _by_country(
        slot, F.lit("Asia/Singapore"), F.lit("Asia/Tokyo"), F.lit("Asia/Bangkok")
    )
    return (
        e.withColumn("latitude", F.when(located, lat))
        .withColumn("longitude", F.when(located, lng))
        .withColumn("timezone", F.when(F.col("event_id") % 7 != 0, zone))
        .select(
            F.col("event_id").alias("media_id"),
            F.col("user_id").alias("track_id"),
            F.concat(F.lit("IMG_"), F.col("event_id"), F.lit(".jpg")).alias("file_name"),
            F.col("ts").alias("taken_at"),
            "timezone",
            local_date(F.col("ts"), F.col("timezone")).alias("local_date"),
            "latitude",
            "longitude",
            cell_of(F.col("latitude"), F.col("longitude")).alias("base_cell"),
            F.concat(F.lit("cell_"), slot).alias("geo_cell"),
            F.when(
                F.col("event_id") % 3 != 0,
                F.concat(
                    F.when(F.col("event_id") % 5 != 0, PHOTO_URL_PREFIX).otherwise(
                        "https://example.org/p/"
                    ),
                    F.col("event_id"),
                ),
            ).alias("url"),
        )
        .repartitionByRange("track_id", "taken_at")
        .sortWithinPartitions("track_id", "taken_at")
    )


def place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place names of 25 of the 27 cells."""
    tune(spark)
    n = F.col("n_nationkey")
    return (
        spark.read.parquet(f"{sf_dir}/nation.parquet")
        .select(
            F.concat(F.lit("cell_"), n).alias("cell_id"),
            _by_country(n, F.lit("SG"), F.lit("JP"), F.lit("TH")).alias("country_code"),
            F.when(n != 5, F.col("n_name")).alias("city"),
            F.when(n.isin(1, 4), " Tokyo ")
            .otherwise(F.concat(F.lit("ADM_"), n % 3))
            .alias("admin1"),
        )
    )


# Items from this day on are not linked to a place yet.
GEOCODED_UNTIL = "2024-01-20"


def geo_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "geo_media", lambda: _geo_media(spark, sf_dir))


def _geo_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with grid cells as links; the last third of January is still pending."""
    done = F.col("taken_at") < F.lit(GEOCODED_UNTIL).cast("timestamp")
    cell = cell_parent(F.col("base_cell"), PLACE_LEVEL)
    return media(spark, sf_dir).withColumn("geo_cell", F.when(done, cell))


def _cells(rows: DataFrame) -> DataFrame:
    cell = cell_parent(F.col("base_cell"), PLACE_LEVEL)
    return rows.where(F.col("base_cell").isNotNull()).select(cell.alias("cell_id")).distinct()


def _components(cell: Column) -> Column:
    """Address components of a cell, in six shapes."""

    def part(types: list[str], name: Column, short: Column | None = None) -> Column:
        return F.struct(
            F.array(*map(F.lit, types)).alias("types"),
            name.alias("long_name"),
            (name if short is None else short).alias("short_name"),
        )

    def named(text: str) -> Column:
        return F.concat(F.lit(text), (cell % 97).cast("string"))

    area = part(["administrative_area_level_1", "political"], named("Area "))
    country = part(
        ["country", "political"],
        named("Country "),
        F.when(cell % 3 == 0, "SG").when(cell % 3 == 1, "JP").otherwise("TH"),
    )
    second = part(["administrative_area_level_2", "political"], named("District "))
    shapes = [
        [part(["locality", "political"], named("Town ")), second, area, country],
        [second, part(["postal_town"], named("Post ")), area, country],
        [part(["political", "sublocality", "sublocality_level_1"], named("Ward ")), area, country],
        [second, part(["administrative_area_level_3"], named("Commune ")), country],
        [part(["locality"], F.lit("")), second, part(["locality"], named("Later ")), country],
        [part(["route"], named("Road "))],
    ]
    return F.get(F.array(*[F.array(*shape) for shape in shapes]), (cell % 6).cast("int"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "responses", lambda: _responses(spark, sf_dir))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup responses of the cells; some cells have none, an empty or a broken one."""
    cell = F.col("cell_id")
    result = F.struct(
        F.concat(F.lit("Address of "), cell.cast("string"), F.repeat(F.lit(" x"), 150)).alias(
            "formatted_address"
        ),
        _components(cell).alias("address_components"),
    )
    text = (
        F.when(cell % 11 == 0, "[]")
        .when(cell % 17 == 0, '{"error": 1}')
        .otherwise(F.to_json(F.array(result)))
    )
    return _cells(media(spark, sf_dir)).where(cell % 13 != 0).select("cell_id", text.alias("response"))


def geo_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "geo_place", lambda: _geo_place(spark, sf_dir))


def _geo_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the linked items; every fifth has no stored response yet, some no city."""
    cell = F.col("cell_id")
    linked = geo_media(spark, sf_dir).where(F.col("geo_cell").isNotNull())
    raw = F.when(cell % 7 == 1, '{"not": "a list"}').otherwise(F.to_json(_components(cell)))
    return _cells(linked).select(
        "cell_id",
        cell_center_lat(cell).alias("center_lat"),
        cell_center_lng(cell).alias("center_lng"),
        F.when(cell % 4 != 0, F.lit("Old city")).alias("city"),
        F.lit("Old area").alias("admin1"),
        F.lit("XX").alias("country_code"),
        F.lit("Old address").alias("formatted_address"),
        F.when(cell % 5 != 0, raw).alias("geocode_raw"),
        F.lit("2024-01-20").cast("timestamp").alias("geocoded_at"),
    )
