"""Match media files to their sidecars, by equi-joins only.

Three tiers, the first hit counts: exact candidate names, the title inside the document,
and a cut sidecar name that is a prefix of one media name. All within one folder of one track:
paths are relative to a track's root, so equal paths of two tracks are different files. Every
right side is unique in its join key, so no join multiplies rows, and the keys hold a name
besides the folder, so a folder with a third of all files spreads over the cluster.

``files`` has track_id, dir, name, path (all files that are not sidecars, plus ``kind``);
``sidecars`` has track_id, dir, name, path and raw_title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.names import (
    bases_of,
    candidates_of,
    implied_media_name,
    sidecar_counter,
    with_name_parts,
)
from tripline.functions.text import stem_of
from tripline.session import materialize

_MIN_PREFIX = 6
FILE = ["track_id", "path"]
FOLDER = ["track_id", "dir"]


def taken_apart(media: DataFrame) -> DataFrame:
    """``media`` with its name parts, which are found once for all tiers."""
    return media if "_core" in media.columns else with_name_parts(media.select(*FILE, "dir", "name")).drop("_stem")


def _row(media: DataFrame) -> list[str]:
    """What tells the rows of ``media`` apart: a number where they have one, else the file."""
    return ["_id"] if "_id" in media.columns else FILE


def cues_of(sidecars: DataFrame) -> DataFrame:
    """What the tiers ask of ``sidecars``: the title inside, and the counter and the media name that
    their own name tells. Found once for all tiers."""
    if "_implied" in sidecars.columns:
        return sidecars
    name = F.col("name")
    return sidecars.select(
        *FILE, "dir", "name", "raw_title",
        sidecar_counter(name).alias("_counter"), implied_media_name(name).alias("_implied"),
    )


def _with_folder(row: list[str]) -> list[str]:
    return [*row, *(c for c in FOLDER if c not in row)]


def _first_hit(hits: DataFrame, row: list[str], rank: Column) -> DataFrame:
    return hits.groupBy(*row).agg(F.min_by("sidecar", rank).alias("sidecar"))


def match_exact(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(row of ``media``, sidecar) by exact names regardless of case; names of the unedited original come
    after the media's own. Of sidecars equal but for case the last one counts."""
    rows = taken_apart(media)
    row = _row(rows)
    ext, original = F.col("_ext"), F.concat("_original", "_ext")
    own = candidates_of(F.col("name"), F.col("_core"), ext, F.col("_n"))
    edited = candidates_of(original, F.col("_original_core"), ext, F.col("_original_n"))
    names = F.when(F.col("_original").isNull(), own).otherwise(F.concat(own, edited))
    wanted = rows.select(*_with_folder(row), F.posexplode(names).alias("_rank", "_name")).select(
        *_with_folder(row), "_rank", F.lower("_name").alias("_name")
    )
    by_name = sidecars.groupBy(*FOLDER, F.lower("name").alias("_name")).agg(
        F.max("path").alias("sidecar")
    )
    return _first_hit(wanted.join(by_name, [*FOLDER, "_name"]), row, F.col("_rank"))


def match_title(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(row of ``media``, sidecar) by the title inside. Of several sidecars with the title the one with the
    media's counter counts, else the only one, else the first without a counter."""
    title = F.col("raw_title")
    titles = (
        cues_of(sidecars).where(title != "")
        .select(
            *FOLDER,
            F.col("_counter").alias("_n"),
            F.col("path").alias("_sidecar"),
            F.explode(F.array_distinct(F.array(F.lower(title), F.lower(stem_of(title))))).alias(
                "_title"
            ),
        )
    )
    by_counter = titles.groupBy(*FOLDER, "_title", "_n").agg(F.min("_sidecar").alias("_same"))
    by_title = titles.groupBy(*FOLDER, "_title").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("_sidecar")).alias("_only"),
        F.min(F.when(F.col("_n") == "0", F.col("_sidecar"))).alias("_plain"),
    )
    rows = taken_apart(media)
    row = _row(rows)
    own = bases_of(F.col("_core"), F.col("_ext"))
    edited = bases_of(F.col("_original_core"), F.col("_ext"))
    bases = F.when(F.col("_original").isNull(), own).otherwise(F.concat(own, edited))
    wanted = rows.select(
        *_with_folder(row),
        # A value that no counter has keeps rows without one off a common NULL key.
        F.coalesce("_n", F.lit("none")).alias("_n"),
        F.posexplode(bases).alias("_rank", "_title"),
    )
    found = wanted.join(by_title, [*FOLDER, "_title"]).join(
        by_counter, [*FOLDER, "_title", "_n"], "left"
    )
    hits = found.withColumn("sidecar", F.coalesce("_same", "_only", "_plain"))
    return _first_hit(hits.where(F.col("sidecar").isNotNull()), row, F.col("_rank"))


def match_prefix(media: DataFrame, sidecars: DataFrame, siblings: DataFrame) -> DataFrame:
    """(row of ``media``, sidecar) by a cut name: what the sidecar name implies is a prefix of the media
    name, at least 6 characters and half of it long, and starts exactly one file of the
    folder. The longest counts; two sidecars of that same prefix are refused."""
    implied = (
        cues_of(sidecars).select(*FOLDER, F.col("_implied").alias("_prefix"), "path")
        .where(F.length("_prefix") >= _MIN_PREFIX)
        .groupBy(*FOLDER, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_sidecar"))
    )
    media = taken_apart(media)
    row = _row(media)
    target = F.lower(F.coalesce(F.concat("_original", "_ext"), "name"))
    shortest = F.greatest(F.lit(_MIN_PREFIX), F.floor(F.length("_target") / 2).cast("int"))
    # Names meet the prefixes of their folder by their first characters, which all of them have, so
    # a large folder spreads over its names. A name is cut only at lengths that one of those has:
    # a plain distinct, no more rows for a lead than names have lengths.
    lead = [*FOLDER, "_lead"]
    cuts = implied.select(*FOLDER, F.left("_prefix", F.lit(_MIN_PREFIX)).alias("_lead"), F.length("_prefix").alias("_len")).distinct()
    prefixes = (
        media.select(*_with_folder(row), target.alias("_target"))
        .where(F.length("_target") >= _MIN_PREFIX)
        .withColumn("_lead", F.left("_target", F.lit(_MIN_PREFIX)))
        .join(cuts, lead)
        .where(F.col("_len").between(shortest, F.length("_target")))
        .withColumn("_prefix", F.left("_target", F.col("_len")))
        .drop("_lead", "_target")
    )
    # Prefixes that start one file only, met in the same way and counted where they are cut.
    starts = (
        siblings.select(*FOLDER, F.lower("name").alias("_file"))
        .withColumn("_lead", F.left("_file", F.lit(_MIN_PREFIX)))
        .join(cuts, lead)
        .where(F.length("_file") >= F.col("_len"))
        .select(*FOLDER, F.left("_file", F.col("_len")).alias("_prefix"))
        .groupBy(*FOLDER, "_prefix")
        .agg(F.count(F.lit(1)).alias("_files"))
        .where("_files = 1")
    )
    hits = prefixes.join(implied, [*FOLDER, "_prefix"]).join(starts, [*FOLDER, "_prefix"], "left_semi").select(
        *row, F.when(F.col("_n") == 1, F.col("_sidecar")).alias("sidecar"), "_len"
    )
    longest = hits.groupBy(*row).agg(
        F.max_by(F.struct("sidecar"), "_len").alias("_best")
    )
    return longest.select(*row, F.col("_best.sidecar").alias("sidecar")).where(
        "sidecar is not null"
    )


def match_sidecars(files: DataFrame, sidecars: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """Every media file with its sidecar path and tier (NULL for none). ``siblings``: all files of
    the folders, where ``files`` are only those to be matched. Names are taken apart once, on both
    sides, and written, so that documents are not parsed for every tier. Between the tiers a file is the
    number of its row there, not its path. The few files without an exact hit are written once; the
    later tiers work on them alone."""
    sidecars = materialize(cues_of(sidecars), "cues")
    media = taken_apart(files.where(F.col("kind").isNotNull()))
    media = materialize(media.withColumn("_id", F.monotonically_increasing_id()), "names")
    # The name of a file with a hit is not asked for again.
    exact = media.join(match_exact(media, sidecars), "_id", "left")
    exact = materialize(exact.withColumns({c: F.when(F.col("sidecar").isNull(), F.col(c)) for c in media.columns if c not in FILE}), "exact")
    left = exact.where(F.col("sidecar").isNull()).drop("sidecar")
    later = (
        left.join(match_title(left, sidecars).withColumnRenamed("sidecar", "_b"), "_id", "left")
        .join(
            match_prefix(left, sidecars, files if siblings is None else siblings).withColumnRenamed("sidecar", "_c"),
            "_id", "left",
        )
        .select(
            *FILE,
            F.coalesce("_b", "_c").alias("sidecar"),
            F.when(F.col("_b").isNotNull(), "title")
            .when(F.col("_c").isNotNull(), "prefix")
            .alias("tier"),
        )
    )
    return (
        exact.where(F.col("sidecar").isNotNull())
        .select(*FILE, "sidecar", F.lit("exact").alias("tier"))
        .unionByName(later)
    )
