"""Typed view of sidecar documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.identity import sidecar_fingerprint
from tripline.functions.steps import once
from tripline.functions.text import strip

_TEXTS = ("title", "description", "url")
_TIMES = ("photoTakenTime", "creationTime")
_PLACES = ("geoData", "geoDataExif")
_DEGREES = ("latitude", "longitude", "altitude")

# The fields in use; leaves stay variants, so that their JSON type can be checked. The document's own
# are taken out of it at once: every look for a single one goes through its names anew.
_SHAPE = "struct<{}>".format(",".join(f"{c}:variant" for c in _TEXTS + _TIMES + _PLACES))
_TIME_SHAPE = "struct<timestamp:variant,formatted:variant>"
_PLACE_SHAPE = "struct<latitude:variant,longitude:variant,altitude:variant>"


def _absent_or(leaf: Column, test: Column) -> Column:
    return leaf.isNull() | F.coalesce(test, F.lit(False))


def _as(leaf: Column, type_name: str) -> Column:
    return F.try_variant_get(leaf, "$", type_name)


# All or nothing: one field of a wrong type makes the document unusable. Unknown fields do not
# matter, and numbers given as text are fine for coordinates. The checks of each part, never NULL:


def _all(*checks: Column) -> Column:
    return reduce(lambda a, b: a & b, checks)


def _is_block(there: Column, is_object: Column) -> Column:
    """Absent, null, or an object; what is no object reads as a NULL struct."""
    return is_object | there.isNull() | (F.schema_of_variant(there) == "VOID")


def _is_text(leaf: Column) -> Column:
    return _absent_or(leaf, F.schema_of_variant(leaf).isin("STRING", "VOID"))


def _is_time(timestamp: Column, formatted: Column) -> Column:
    kind, number = F.schema_of_variant(timestamp), _as(timestamp, "double")
    whole = kind.isin("STRING", "VOID", "BIGINT") | (
        ((kind == "DOUBLE") | kind.startswith("DECIMAL")) & (number == F.floor(number))
    )
    return _all(_is_text(formatted), _absent_or(timestamp, whole))


def _is_place(*degrees: Column) -> Column:
    # A JSON null is no number, unlike an absent field.
    return _all(*[_absent_or(leaf, _as(leaf, "double").isNotNull()) for leaf in degrees])


def _epoch(timestamp: Column) -> Column:
    text = strip(_as(timestamp, "string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def _coords(lat: Column, lng: Column) -> Column:
    """(lat, lng) of a block; the exact origin stands for "no location"."""
    lat, lng = (F.coalesce(_as(c, "double"), F.lit(0.0)) for c in (lat, lng))
    return F.when((lat != 0.0) | (lng != 0.0), F.struct(lat.alias("lat"), lng.alias("lng")))


def _apart(df: DataFrame, value: Column, name: str, **fields: str) -> DataFrame:
    """The struct ``value``, computed once, as columns: whether it is there under ``name``, and its fields."""
    rows = once(df, value, name)
    parts = [F.col(name)[field].alias(c) for c, field in fields.items()]
    return rows.select(*df.columns, F.col(name).isNotNull().alias(name), *parts)


def parse_sidecars(docs: DataFrame, text: str = "json") -> DataFrame:
    """Add raw_title (of any JSON object), valid, title, description, url, epoch, lat, lng and
    fingerprint. Broken text is not valid and never fails the job."""
    # A step for each part: what one step computes is one method of generated code, and the JVM
    # only interprets a method that is too large.
    rows = once(docs, F.try_parse_json(text), "_doc")
    rows = _apart(rows, F.try_variant_get("_doc", "$", _SHAPE), "_root", **{f"_{c}": c for c in _TEXTS + _TIMES + _PLACES})
    title = F.col("_title")
    raw_title = F.when(F.schema_of_variant(title) == "STRING", _as(title, "string"))
    texts = F.struct(
        raw_title.alias("title"),
        _as(F.col("_description"), "string").alias("description"),
        _as(F.col("_url"), "string").alias("url"),
        _all(F.col("_root"), *[_is_text(F.col(f"_{t}")) for t in _TEXTS]).alias("valid"),
    )
    rows = _apart(rows, texts, "_texts", _raw_title="title", _a_description="description", _a_url="url", _valid="valid")
    valid = F.col("_valid")
    for t in _TIMES:
        rows = _apart(rows, F.try_variant_get(f"_{t}", "$", _TIME_SHAPE), f"{t}_", **{f"{t}_{c}": c for c in ("timestamp", "formatted")})
        leaves = [F.col(f"{t}_{c}") for c in ("timestamp", "formatted")]
        fits = _all(_is_block(F.col(f"_{t}"), F.col(f"{t}_")), _is_time(*leaves))
        step = F.struct(_epoch(leaves[0]).alias("epoch"), fits.alias("valid"))
        rows = _apart(rows, step, f"{t}_step", **{f"{t}_{c}": c for c in ("epoch", "valid")})
        valid = valid & F.col(f"{t}_valid")
    for p in _PLACES:
        rows = _apart(rows, F.try_variant_get(f"_{p}", "$", _PLACE_SHAPE), f"{p}_", **{f"{p}_{c}": c for c in _DEGREES})
        leaves = [F.col(f"{p}_{c}") for c in _DEGREES]
        fits = _all(_is_block(F.col(f"_{p}"), F.col(f"{p}_")), _is_place(*leaves))
        at = _coords(*leaves[:2])
        step = F.struct(at["lat"].alias("lat"), at["lng"].alias("lng"), fits.alias("valid"))
        rows = _apart(rows, step, f"{p}_step", **{f"{p}_{c}": c for c in ("lat", "lng", "valid")})
        valid = valid & F.col(f"{p}_valid")
    epoch = F.coalesce(*[F.col(f"{t}_epoch") for t in _TIMES])
    # Both coordinates of a block are there, or neither is.
    lat, lng = (F.coalesce(*[F.col(f"{p}_{c}") for p in _PLACES]) for c in ("lat", "lng"))
    typed = F.struct(valid.alias("valid"), epoch.alias("epoch"), lat.alias("lat"), lng.alias("lng"))
    rows = _apart(rows, typed, "_typed", **{f"_the_{c}": c for c in ("valid", "epoch", "lat", "lng")})
    rows = rows.select(*docs.columns, "_raw_title", "_a_description", "_a_url", *[f"_the_{c}" for c in ("valid", "epoch", "lat", "lng")])
    valid = F.col("_the_valid")

    def if_valid(name: str) -> Column:
        return F.when(valid, F.col(name))

    rows = rows.select(
        *docs.columns,
        F.col("_raw_title").alias("raw_title"),
        valid.alias("valid"),
        if_valid("_raw_title").alias("title"),
        if_valid("_a_description").alias("description"),
        if_valid("_a_url").alias("url"),
        *[if_valid(f"_the_{c}").alias(c) for c in ("epoch", "lat", "lng")],
    )
    fingerprint = sidecar_fingerprint(
        F.col("valid"), F.col("title"), F.col("description"), F.col("lat"), F.col("lng")
    )
    return rows.withColumn("fingerprint", fingerprint)
