"""Ingest a listing with its sidecars into the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.names import in_folder_years, is_sidecar, media_kind
from tripline.functions.times import month_bounds
from tripline.operators import resolve
from tripline.operators.matching import match_sidecars
from tripline.operators.upsert import upsert_media
from tripline.session import materialize
from tripline.sources.sidecars import parse_sidecars


@dataclass
class Ingested:
    catalog: DataFrame  # the next snapshot
    changes: DataFrame  # what is new in it, for a merge
    rows: DataFrame  # every file with its action
    stats: DataFrame
    quarantine: DataFrame


def media_side(listing: DataFrame, months: tuple[str, str] | None = None):
    """(files next to sidecars with their kind, media left out by the folder year)."""
    files = listing.where(~is_sidecar(F.col("name"))).withColumn("kind", media_kind(F.col("name")))
    if months is None:
        return files, None
    scanned = in_folder_years(F.col("dir"), *months)
    return files.where(scanned), files.where(~scanned & F.col("kind").isNotNull())


def resolve_files(
    files: DataFrame,
    matches: DataFrame,
    sidecars: DataFrame,
    exif: DataFrame,
    tz_cells: DataFrame,
    previous: DataFrame,
    months: tuple[str, str] | None = None,
    force: bool = False,
) -> DataFrame:
    """Every media file with its action; those that the sidecar and the catalog do not settle
    with identity, location and time, too."""
    return resolve_met(with_sidecars(files, matches, sidecars), exif, tz_cells, previous, months, force)


def with_sidecars(files: DataFrame, matches: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The media files, each with its sidecar."""
    rows = resolve.join_sidecars(files.where(F.col("kind").isNotNull()), matches, sidecars)
    return rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))


def resolve_met(
    rows: DataFrame,
    exif: DataFrame,
    tz_cells: DataFrame,
    previous: DataFrame,
    months: tuple[str, str] | None = None,
    force: bool = False,
    written: bool = False,
) -> DataFrame:
    """Of ``with_sidecars``. The files that are settled, in a repeated run nearly all, leave before EXIF
    rows, zones and the catalog's other columns are joined. ``written``: ``rows`` are a stage and
    ``previous`` has no row, so they are not written once more for the steps that read them."""
    rows = resolve.add_settled(rows, previous, months, force)
    # Only what goes on needs the document itself.
    text = F.when(F.col("settled").isNull(), F.col("sc.json"))
    if not written:
        rows = materialize(rows.withColumn("sc", F.when(F.col("sc").isNotNull(), F.col("sc").withField("json", text))), "settled")
    # Told by the expression: a step for written rows alone leaves these out when it is planned.
    action = F.when(F.col("settled") == "skipped", "skipped").otherwise("filtered")
    settled = rows.where("settled is not null").withColumn("action", action).drop("settled")
    rest = resolve.add_identity(resolve.join_exif(rows.where("settled is null").drop("settled"), exif))
    rest = rest.join(resolve.load_previous(previous), resolve.KEY, "left")
    rest = resolve.resolve_location(rest)
    rest = resolve.resolve_time(resolve.assign_timezone(rest, tz_cells))
    return resolve.classify(rest, months, force).unionByName(settled, allowMissingColumns=True)


def ingest(
    listing: DataFrame,
    documents: DataFrame,
    exif: DataFrame,
    tz_cells: DataFrame,
    catalog: DataFrame,
    *,
    month_filter: str | None = None,
    force: bool = False,
    now: Column | None = None,
) -> Ingested:
    """``listing`` has track_id, path, dir, name, size, mtime and optionally error;
    ``documents`` has track_id, path, dir, name, json; ``exif`` has track_id, path, datetime_text, lat, lng,
    perceptual_hash, meta. Folders of other years are dropped before a document is parsed, and
    each document is parsed once: the typed result is written for the steps that follow."""
    months = month_bounds(month_filter) if month_filter else None
    files, skipped_folders = media_side(listing, months)
    if months:
        documents = documents.where(in_folder_years(F.col("dir"), *months))
    sidecars = materialize(parse_sidecars(documents), "sidecars")
    matches = match_sidecars(files, sidecars)
    # Four results are taken from the rows.
    rows = materialize(resolve_files(files, matches, sidecars, exif, tz_cells, catalog, months, force), "rows")
    changes = resolve.resolve_duplicates(resolve.catalog_rows(rows))
    return Ingested(
        catalog=upsert_media(catalog, changes, now),
        changes=changes,
        rows=rows,
        stats=resolve.ingest_stats(rows, skipped_folders),
        quarantine=resolve.quarantine(rows),
    )
