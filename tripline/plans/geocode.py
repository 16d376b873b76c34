"""Attach place names to the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tripline.functions.geo import PLACE_LEVEL
from tripline.operators.places import (
    enrich_places,
    geocode_stats,
    geocode_worklist,
    link_media,
    pending_cells,
    pending_geocode,
)
from tripline.operators.upsert import link_cells, upsert_place


@dataclass
class Geocoded:
    media: DataFrame
    place: DataFrame
    stats: DataFrame


def geocode(
    media: DataFrame,
    place: DataFrame,
    responses: DataFrame,
    *,
    level: int = PLACE_LEVEL,
    recalculate: bool = False,
    max_lookups: int | None = None,
    now: Column | None = None,
    key: str | Sequence[str] = "media_id",
) -> Geocoded:
    """Pending items -> cells -> lookups joined to ``responses`` -> places -> links. A cell
    known already is always linked, also when the budget is used up."""
    pending = pending_geocode(media, recalculate)
    cells = pending_cells(pending, place, level, recalculate)
    worklist = geocode_worklist(cells, max_lookups)
    found = enrich_places(worklist, responses, now)
    links = link_media(pending, cells, found, level, key)
    return Geocoded(
        media=link_cells(media, links, now, key),
        place=upsert_place(place, found),
        stats=geocode_stats(cells, worklist, found),
    )
