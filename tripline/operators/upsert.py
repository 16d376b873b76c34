"""Keyed insert-or-overwrite between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    current: DataFrame, changes: DataFrame, key: str | Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """``current`` with the rows of ``changes`` inserted or written over it. ``keep`` columns
    retain their old value if there is one. Both sides are unique in ``key``, so the join
    has no hot key; a catalog bucketed by ``key`` needs no shuffle on its side."""
    keys = [key] if isinstance(key, str) else list(key)
    old = current.select(*keys, F.struct(*current.columns).alias("_old"))
    new = changes.select(*keys, F.struct(*changes.columns).alias("_new"))

    def pick(c: str) -> Column:
        if c not in changes.columns:
            return F.col(f"_old.{c}")
        if c in keep:
            return F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}"))
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))

    joined = old.join(new, keys, "full_outer")
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in current.columns])


def upsert_media(
    current: DataFrame,
    changes: DataFrame,
    now: Column | None = None,
    key: str | Sequence[str] = ("track_id", "dedupe_key"),
) -> DataFrame:
    """Media upsert: created_at is kept, updated_at stamped on every written row."""
    at = F.current_timestamp() if now is None else now
    stamped = changes.withColumns(
        {
            "created_at": F.coalesce("created_at", at) if "created_at" in changes.columns else at,
            "updated_at": at,
        }
    )
    return upsert(current, stamped, key, keep=("created_at",))


def upsert_place(current: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(current, changes, "cell_id")


def link_cells(
    media: DataFrame,
    pairs: DataFrame,
    now: Column | None = None,
    key: str | Sequence[str] = "media_id",
) -> DataFrame:
    """Set ``geo_cell`` (and updated_at, if kept) for (key, geo_cell) pairs; others unchanged.
    ``key`` identifies an item: with several tracks, give the track, too."""
    keys = [key] if isinstance(key, str) else list(key)
    at = F.current_timestamp() if now is None else now
    links = pairs.select(*keys, F.col("geo_cell").alias("_cell"))
    changed = {"geo_cell": F.coalesce("_cell", "geo_cell")}
    if "updated_at" in media.columns:
        changed["updated_at"] = F.when(F.col("_cell").isNotNull(), at).otherwise(
            F.col("updated_at")
        )
    return media.join(links, keys, "left").withColumns(changed).select(*media.columns)
