"""Identity, location and time of ingested files, and what to do with each.

The catalog is keyed by (track_id, dedupe_key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.geo import BASE_LEVEL, cell_level, cell_of, cell_parent
from tripline.functions.identity import dedupe_key
from tripline.functions.steps import once
from tripline.functions.times import SOURCE_MANUAL, in_months, local_date, taken_at

KEY = ["track_id", "dedupe_key"]
TZ_LEVEL = 8
#: Cells of a cover that is sent to the items; those of a larger one are met in a join.
SENT_CELLS = 100_000

# Where a location came from.
LOCATION_SIDECAR, LOCATION_EXIF, LOCATION_MANUAL, LOCATION_NONE = (
    "takeout_geodata",
    "exif_gps",
    "manual",
    "none",
)

# What a re-run needs to know of a row already in the catalog.
PREVIOUS_COLUMNS = (
    "taken_at",
    "taken_at_source",
    "timezone",
    "latitude",
    "longitude",
    "base_cell",
    "geo_cell",
    "location_source",
    "needs_review",
    "created_at",
    "sidecar_fingerprint",
    "perceptual_hash",
    "exif",
)


def set_location(lat: Column, lng: Column, source: str) -> dict[str, Column]:
    """Columns of a located row: coordinates, base cell, source."""
    return {
        "latitude": lat,
        "longitude": lng,
        "base_cell": cell_of(lat, lng),
        "location_source": F.lit(source),
    }


def clear_location() -> dict[str, Column]:
    """Columns of an unlocated row."""
    nothing = {c: F.lit(None).cast("double") for c in ("latitude", "longitude")}
    cells = {c: F.lit(None).cast("long") for c in ("base_cell", "geo_cell")}
    return nothing | cells | {"location_source": F.lit(LOCATION_NONE)}


def load_previous(catalog: DataFrame) -> DataFrame:
    """The catalog's keys with what a re-run needs, as one struct ``prev``. Its flag ``known`` tells
    that there is a row, so that a step that takes no other field reads no other column."""
    return catalog.select(*KEY, F.struct(*PREVIOUS_COLUMNS, F.lit(True).alias("known")).alias("prev"))


def join_sidecars(files: DataFrame, matches: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files with the parsed fields of their sidecar as struct ``sc`` (NULL unless valid)."""
    docs = sidecars.where("valid").select(
        "track_id",
        F.col("path").alias("sidecar"),
        F.struct("title", "description", "url", "epoch", "lat", "lng", "fingerprint", "json").alias(
            "sc"
        ),
    )
    # A file without a match joins on its own path, which no sidecar has: no hot NULL key.
    return (
        files.join(matches.select("track_id", "path", "sidecar"), ["track_id", "path"], "left")
        .withColumn("_doc", F.coalesce("sidecar", "path"))
        .join(docs.withColumnRenamed("sidecar", "_doc"), ["track_id", "_doc"], "left")
        .drop("_doc")
    )


def has_cheap_identity() -> Column:
    """Whether the sidecar alone tells what the file is: by an address, or title and time."""
    sc = F.col("sc")
    return F.coalesce(sc.url != "", F.lit(False)) | (F.coalesce(sc.title != "", F.lit(False)) & sc.epoch.isNotNull())


def add_settled(files: DataFrame, previous: DataFrame, months: tuple[str, str] | None = None, force: bool = False) -> DataFrame:
    """Add ``settled``: the action of a file for which the sidecar and three columns of the catalog
    are enough to leave it alone, else NULL. Such a file needs no image, no zone, and no other
    column of the catalog. Its stored key is the one of its sidecar, and neither changed."""
    sc = F.col("sc")
    none = F.lit(None).cast("string")
    cheap = F.col("error").isNull() & has_cheap_identity()
    key = dedupe_key(sc.url, sc.title, sc.epoch, none, none, F.col("name"), F.col("size"))
    # What cannot be settled has a key of its own, which no row of the catalog has.
    rows = files.withColumn("_key", F.when(cheap, key).otherwise(F.concat(F.lit("?"), "path")))
    whole = previous.where("taken_at is not null").select(
        "track_id", F.col("dedupe_key").alias("_key"), F.struct(F.col("sidecar_fingerprint").alias("fingerprint")).alias("_known")
    )
    if force:
        whole = whole.limit(0)
    same = F.col("_known").isNotNull() & F.col("_known.fingerprint").eqNullSafe(sc.fingerprint)
    early = F.lit(False)
    if months:
        early = F.col("error").isNull() & sc.epoch.isNotNull() & ~in_months(F.timestamp_seconds(sc.epoch), *months)
    settled = F.when(early, "filtered").when(same, "skipped")
    return rows.join(whole, ["track_id", "_key"], "left").withColumn("settled", settled).drop("_key", "_known")


def join_exif(files: DataFrame, exif: DataFrame) -> DataFrame:
    """Add struct ``ex`` where the image has to be consulted: a photo whose sidecar lacks
    location, time or identity. The hash counts only where the identity is lacking. Of the EXIF
    table only rows of such files come to the join."""
    sc = F.col("sc")
    cheap = has_cheap_identity()
    need = (F.col("kind") == "photo") & (sc.lat.isNull() | sc.epoch.isNull() | ~cheap)
    asked = exif.join(files.where(need).select("track_id", "path"), ["track_id", "path"], "left_semi")
    # One row per file, whatever the table holds: a second one must not multiply the file.
    order = F.struct("datetime_text", "lat", "lng", "perceptual_hash")
    image = asked.groupBy("track_id", "path").agg(
        F.min_by(F.struct("datetime_text", "lat", "lng", "perceptual_hash", "meta"), order).alias("_ex")
    )
    hashed = F.when(cheap, F.lit(None)).otherwise(F.col("_ex.perceptual_hash"))
    return (
        files.join(image, ["track_id", "path"], "left")
        .withColumn("ex", F.when(need, F.col("_ex").withField("perceptual_hash", hashed)))
        .drop("_ex")
    )


def add_identity(files: DataFrame) -> DataFrame:
    sc, ex = F.col("sc"), F.col("ex")
    return files.withColumn(
        "dedupe_key",
        dedupe_key(
            sc.url, sc.title, sc.epoch, ex.datetime_text, ex.perceptual_hash,
            F.col("name"), F.col("size"),
        ),
    )


def resolve_location(rows: DataFrame) -> DataFrame:
    """Sidecar, then EXIF, then none; a manual location in the catalog stays, with its cells
    and review flag. An item that stays in its cell keeps its place link."""
    sc, ex, prev = F.col("sc"), F.col("ex"), F.col("prev")

    def found(lat: Column, lng: Column, source: str) -> Column:
        columns = set_location(lat, lng, source)
        return F.when(
            lat.isNotNull() & lng.isNotNull(),
            F.struct(*[v.alias(k) for k, v in columns.items()]),
        )

    none = F.struct(*[v.alias(k) for k, v in clear_location().items() if k != "geo_cell"])
    fresh = F.coalesce(
        found(sc.lat, sc.lng, LOCATION_SIDECAR), found(ex.lat, ex.lng, LOCATION_EXIF), none
    )
    manual = F.coalesce(prev.location_source == LOCATION_MANUAL, F.lit(False))
    new = F.col("_loc")

    def kept(name: str) -> Column:
        return F.when(manual, prev[name]).otherwise(new[name]).alias(name)

    same_cell = prev.base_cell == new.base_cell
    return once(rows, fresh, "_loc").withColumns(
        {
            "latitude": kept("latitude"),
            "longitude": kept("longitude"),
            "base_cell": kept("base_cell"),
            "geo_cell": F.when(manual | same_cell, prev.geo_cell),
            "location_source": kept("location_source"),
            "needs_review": F.when(manual, prev.needs_review).otherwise(new.latitude.isNull()),
        }
    ).drop("_loc")


def assign_timezone(rows: DataFrame, tz_cells: DataFrame) -> DataFrame:
    """Zone of the finest cell around the item that the cover ``tz_cells`` (cell, tz) has; else NULL.
    The cover may mix levels: coarse cells inside a zone, finer ones along its borders. Of two
    zones of one and the same cell the first by name counts.

    A cover of up to ``SENT_CELLS`` cells goes to the items, which stay where they are. For a larger
    one items are reduced to their cells before these meet the cover, so a cell that a third of
    all items share meets it once."""
    zones = tz_cells.where("cell is not null").groupBy("cell").agg(F.min("tz").alias("tz"))
    # A grid has BASE_LEVEL levels, so no more numbers than that.
    sizes = {r[0]: r[1] for r in zones.groupBy(cell_level(F.col("cell"))).count().collect()}
    levels = sorted((n for n in sizes if n <= BASE_LEVEL), reverse=True)
    if not levels:
        return rows.withColumn("zone", F.lit(None).cast("string"))
    if sum(sizes.values()) <= SENT_CELLS:
        at = cell_of(F.col("latitude"), F.col("longitude"))
        for n in levels:
            of_level = zones.where(cell_level(F.col("cell")) == n).select(F.col("cell").alias("_cell"), F.col("tz").alias(f"_tz{n}"))
            rows = rows.withColumn("_cell", cell_parent(at, n)).join(F.broadcast(of_level), "_cell", "left")
        # A level without a zone around an item leaves it to the next coarser one.
        zone = F.coalesce(*[F.col(f"_tz{n}") for n in levels])
        return rows.withColumn("zone", zone).drop("_cell", *[f"_tz{n}" for n in levels])
    cell = cell_parent(cell_of(F.col("latitude"), F.col("longitude")), levels[0])
    # Unlocated rows get keys of their own instead of one hot NULL key; no cell is negative.
    spread = -1 - F.pmod(F.hash("path"), F.lit(1 << 20)).cast("long")
    rows = rows.withColumn("_cell", F.coalesce(cell, spread))
    around = F.array(*[F.struct(F.lit(n).alias("n"), cell_parent(F.col("_cell"), n).alias("cell")) for n in levels])
    met = rows.where("_cell >= 0").select("_cell").distinct().withColumn("_a", F.explode(around))
    named = met.select("_cell", "_a.n", "_a.cell").join(zones, "cell")
    finest = named.groupBy("_cell").agg(F.max_by("tz", "n").alias("zone"))
    return rows.join(finest, "_cell", "left").drop("_cell")


def resolve_time(rows: DataFrame) -> DataFrame:
    """Capture time and its source, the zone and the local day; a manual time stays."""
    sc, ex, prev = F.col("sc"), F.col("ex"), F.col("prev")
    manual = F.coalesce(prev.taken_at_source == SOURCE_MANUAL, F.lit(False))
    new = F.col("_time")
    rows = once(rows, taken_at(sc.epoch, ex.datetime_text, F.col("mtime"), F.col("zone")), "_time").withColumns(
        {
            "taken_at": F.when(manual, prev.taken_at).otherwise(new["at"]),
            "taken_at_source": F.when(manual, SOURCE_MANUAL).otherwise(new["source"]),
            "timezone": F.when(manual, prev.timezone).otherwise(F.col("zone")),
        }
    )
    day = local_date(F.col("taken_at"), F.col("timezone"))
    return rows.withColumn("local_date", day).drop("_time", "zone")


def classify(
    rows: DataFrame, months: tuple[str, str] | None = None, force: bool = False
) -> DataFrame:
    """Add ``action``: error, filtered, skipped, created, refreshed or updated."""
    sc, prev = F.col("sc"), F.col("prev")
    same = prev.sidecar_fingerprint.eqNullSafe(sc.fingerprint)
    done = prev.taken_at.isNotNull() & same & F.lit(not force)
    early = late = F.lit(False)
    if months:
        early = sc.epoch.isNotNull() & ~in_months(F.timestamp_seconds(sc.epoch), *months)
        late = sc.epoch.isNull() & ~in_months(F.col("taken_at"), *months)
    action = (
        F.when(F.col("error").isNotNull(), "error")
        .when(early, "filtered")
        .when(done, "skipped")
        .when(late, "filtered")
        .when(prev.known.isNull(), "created")
        .when(~same, "refreshed")
        .otherwise("updated")
    )
    return rows.withColumn("action", action)


CATALOG_DDL = """track_id long, dedupe_key string, url string, file_name string, kind string,
source_path string, taken_at timestamp, taken_at_source string, timezone string,
local_date date, latitude double, longitude double, base_cell long, geo_cell long,
location_source string, sidecar_raw string, exif map<string,string>,
sidecar_fingerprint string, perceptual_hash string, needs_review boolean,
created_at timestamp, updated_at timestamp"""

WRITTEN = ("created", "refreshed", "updated")


def catalog_rows(rows: DataFrame) -> DataFrame:
    """Catalog columns of the rows to write. A re-read that did not consult the image keeps the
    stored EXIF values."""
    sc, ex, prev = F.col("sc"), F.col("ex"), F.col("prev")
    written = reduce(lambda a, b: a | b, [F.col("action") == a for a in WRITTEN])
    return rows.where(written).select(
        *KEY,
        F.when(sc.url != "", sc.url).alias("url"),
        F.col("name").alias("file_name"),
        "kind",
        F.col("path").alias("source_path"),
        "taken_at",
        "taken_at_source",
        "timezone",
        "local_date",
        "latitude",
        "longitude",
        "base_cell",
        "geo_cell",
        "location_source",
        sc.json.alias("sidecar_raw"),
        F.coalesce(ex.meta, prev.exif).alias("exif"),
        sc.fingerprint.alias("sidecar_fingerprint"),
        F.coalesce(ex.perceptual_hash, prev.perceptual_hash).alias("perceptual_hash"),
        "needs_review",
        prev.created_at.alias("created_at"),
    )


def resolve_duplicates(rows: DataFrame) -> DataFrame:
    """One row per key: the one of the first path. An aggregation, so copies are reduced where
    they are read; a key with a third of all rows costs one row per task."""
    rest = [c for c in rows.columns if c not in KEY]
    best = F.min_by(F.struct(*rest), F.struct("source_path", "file_name"))
    return rows.groupBy(*KEY).agg(best.alias("_row")).select(*KEY, "_row.*").select(*rows.columns)


def ingest_stats(rows: DataFrame, prefiltered: DataFrame | None = None) -> DataFrame:
    """One row of counters over classified rows; ``prefiltered`` holds the media files of
    folders that were not scanned."""
    written = F.col("action").isin(*WRITTEN)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("action") == a).alias(name)
            for a, name in (
                ("created", "created"),
                ("updated", "updated"),
                ("refreshed", "refreshed"),
                ("skipped", "skipped"),
                ("filtered", "filtered"),
                ("error", "errors"),
            )
        ],
        F.count_if(written & located).alias("with_location"),
        F.count_if(written & ~located).alias("without_location"),
        F.count_if(F.col("sc").isNotNull() & (F.col("action") != "error")).alias("with_sidecar"),
    )
    if prefiltered is None:
        return counts
    n = F.count(F.lit(1))
    left_out = prefiltered.agg(n.alias("total"), n.alias("filtered"))
    both = counts.unionByName(left_out, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in counts.columns])


def quarantine(rows: DataFrame) -> DataFrame:
    """Paths and reasons of the files that could not be read."""
    return rows.where(F.col("action") == "error").select("path", "error")
