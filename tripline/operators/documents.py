"""Timeline documents, listings and summaries.

A document is kept as ordered *lines* whose concatenation is the JSON text, so a timeline
of any length is written by many tasks and never gathered in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.labels import PHOTO_URL_PREFIX, city_label, photo_id
from tripline.operators.ordered import mark_first, number_rows

# The names of a payload row's positions.
POINT_FIELDS = ("t", "lat", "lng", "cc", "city", "photo_id")

LINE_ORDER = ("section", "line_us", "line_id")
_HEAD, _STAY, _MIDDLE, _POINT, _FOOT = range(5)


def points_payload(points: DataFrame, by: Sequence[str] = ("track_id",)) -> DataFrame:
    """Compact rows: minute text, coordinates to 5 decimals, country, city label, photo id."""
    return points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        *by,
        F.coalesce(
            F.date_format("t", "yyyy-MM-dd'T'HH:mm"),
            F.col("local_date").cast("string"),
            F.lit(""),
        ).alias("t"),
        F.round("lat", 5).alias("lat"),
        F.round("lng", 5).alias("lng"),
        "cc",
        city_label(F.col("cc"), F.col("city"), F.col("admin1")).alias("city"),
        photo_id(F.col("url")).alias("photo_id"),
        F.unix_micros(F.col("t")).alias("line_us"),
        F.col("media_id").cast("string").alias("line_id"),
    )


def _json(c: Column) -> Column:
    """A scalar as JSON text, ``null`` included."""
    one = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_replace(one, r'^\{"v":|\}$', "")


def _element(first: Column, text: Column) -> Column:
    return F.concat(F.when(first, "").otherwise(","), text)


def timeline_lines(
    headers: DataFrame,
    stays: DataFrame,
    points: DataFrame | None = None,
    by: Sequence[str] = ("timeline_id",),
) -> DataFrame:
    """Lines of one JSON document per row of ``headers``.

    ``headers`` has ``by``, title, prompts (array of string), generated_at (text) and
    optionally build (a struct). ``stays`` and ``points`` carry the ``by`` columns.
    """
    by = list(by)
    none_us, none_id = F.lit(None).cast("long"), F.lit(None).cast("string")
    doc_id = F.concat_ws("-", *[F.col(c).cast("string") for c in by])
    build = (
        [F.lit(',"build":'), F.to_json("build", {"ignoreNullFields": "false"})]
        if "build" in headers.columns
        else []
    )
    head = F.concat(
        F.lit('{"id":'), _json(doc_id),
        F.lit(',"title":'), _json(F.coalesce("title", doc_id)),
        F.lit(',"prompts":'), F.to_json("prompts"),
        F.lit(',"generated_at":'), _json(F.col("generated_at")),
        *build,
        F.lit(',"stays":['),
    )

    def marker(section: int, text: Column) -> DataFrame:
        return headers.select(
            *by,
            F.lit(section).alias("section"),
            none_us.alias("line_us"),
            none_id.alias("line_id"),
            text.alias("line"),
        )

    def body(section: int, rows: DataFrame, text: Column) -> DataFrame:
        # Only lines of known documents.
        flagged = mark_first(rows, by, ["line_us", "line_id"]).join(
            headers.select(*by), by, "left_semi"
        )
        return flagged.select(
            *by,
            F.lit(section).alias("section"),
            "line_us",
            "line_id",
            _element(F.col("is_first"), text).alias("line"),
        )

    stay_rows = stays.withColumnsRenamed({"first_us": "line_us", "first_id": "line_id"})
    stay_text = F.to_json(
        F.struct(
            "label",
            F.col("from").cast("string").alias("from"),
            F.col("to").cast("string").alias("to"),
            "lat",
            "lng",
            "photo_count",
            "sample_url",
        ),
        {"ignoreNullFields": "false"},
    )
    lines = marker(_HEAD, head).unionByName(body(_STAY, stay_rows, stay_text))
    if points is None:
        return lines.unionByName(marker(_FOOT, F.lit("]}")))
    fields = ",".join(f'"{f}"' for f in POINT_FIELDS)
    middle = F.lit(
        f'],"photo_url_prefix":"{PHOTO_URL_PREFIX}","point_fields":[{fields}],"points":['
    )
    point_text = F.concat(
        F.lit("["), F.concat_ws(",", *[_json(F.col(f)) for f in POINT_FIELDS]), F.lit("]")
    )
    return (
        lines.unionByName(marker(_MIDDLE, middle))
        .unionByName(body(_POINT, points_payload(points, by), point_text))
        .unionByName(marker(_FOOT, F.lit("]}")))
    )


# Fixed value: how a stay is listed for reading.
STAY_LINE = "  %2d. %-24s %-28s (%d photos)"


def stay_listing(stays: DataFrame, by: Sequence[str] = ("track_id",)) -> DataFrame:
    """Numbered stays with the days collapsed to one where they are equal."""
    numbered = number_rows(stays, by, ["first_us", "first_id"])
    a, b = F.col("from").cast("string"), F.col("to").cast("string")
    days = F.when(a == b, a).otherwise(F.concat_ws("..", a, b))
    return numbered.select(
        *by,
        "position",
        days.alias("days"),
        "label",
        "photo_count",
        F.format_string(STAY_LINE, "position", days, "label", "photo_count")
        .alias("line"),
    )


def timeline_summary(stays: DataFrame, by: Sequence[str] = ("track_id",)) -> DataFrame:
    """Number of stays, photos and distinct labels, and days from first to last."""
    order = F.struct("first_us", "first_id")
    return stays.groupBy(*by).agg(
        F.count(F.lit(1)).alias("stays"),
        F.sum("photo_count").alias("photos"),
        F.count_distinct("label").alias("places"),
        (F.datediff(F.max_by("to", order), F.min_by("from", order)) + 1).alias("days"),
    )
