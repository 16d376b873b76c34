"""EXIF values as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions.geo import exif_degrees
from tripline.functions.text import strip

# Columns of a photo metadata file.
CSV_DDL = (
    "SourceFile string, FileName string, Directory string, DateTimeOriginal string, "
    "GPSLatitude double, GPSLongitude double, GPSAltitude double"
)


def exif_columns(raw: DataFrame) -> DataFrame:
    """(track_id,) path, datetime_text, lat, lng, altitude, perceptual_hash, meta of raw EXIF rows with
    date_time_original, date_time, lat/lng as decimal or [d, m, s] and their hemispheres."""
    lat = exif_degrees(F.col("lat_decimal"), F.col("lat_dms"), F.col("lat_ref"), "S")
    lng = exif_degrees(F.col("lng_decimal"), F.col("lng_dms"), F.col("lng_ref"), "W")
    both = lat.isNotNull() & lng.isNotNull()
    texts = [F.when(strip(F.col(c)) != "", F.col(c)) for c in ("date_time_original", "date_time")]
    altitude = (
        F.col("altitude").try_cast("double") if "altitude" in raw.columns else F.lit(None)
    ).cast("double")
    return raw.select(
        *[c for c in ("track_id",) if c in raw.columns],
        "path",
        F.coalesce(*texts).alias("datetime_text"),
        F.when(both, lat).alias("lat"),
        F.when(both, lng).alias("lng"),
        F.when(both, altitude).alias("altitude"),
        "perceptual_hash",
        "meta",
    )


def read_exif_csv(spark: SparkSession, path: str) -> DataFrame:
    """A photo metadata CSV as EXIF rows; coordinates there are signed decimals."""
    rows = spark.read.csv(path, header=True, schema=CSV_DDL)
    tags = ["FileName", "DateTimeOriginal", "GPSLatitude", "GPSLongitude", "GPSAltitude"]
    pairs = [x for t in tags for x in (F.lit(t), F.col(t).cast("string"))]
    none = F.lit(None)
    return exif_columns(
        rows.select(
            F.regexp_replace("SourceFile", r"^\./", "").alias("path"),
            F.col("DateTimeOriginal").alias("date_time_original"),
            none.cast("string").alias("date_time"),
            F.col("GPSLatitude").alias("lat_decimal"),
            F.col("GPSLongitude").alias("lng_decimal"),
            none.cast("array<double>").alias("lat_dms"),
            none.cast("array<double>").alias("lng_dms"),
            none.cast("string").alias("lat_ref"),
            none.cast("string").alias("lng_ref"),
            F.col("GPSAltitude").alias("altitude"),
            none.cast("string").alias("perceptual_hash"),
            F.create_map(*pairs).alias("meta"),
        )
    )
