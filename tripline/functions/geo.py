"""Distances and spatial cells.

Cells form a quad grid over longitude and latitude. At level L both axes are cut into
2**L steps, and a cell packs (level, x, y) into one long, so a parent is two bit shifts
and every parent covers exactly its children.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Level stored with every item (about 19 m x 10 m at the equator).
BASE_LEVEL = 21
# Level at which items share one place name (about 0.3 km x 0.15 km at the equator).
PLACE_LEVEL = 17

_AXIS_BITS = 21
_AXIS_MASK = (1 << _AXIS_BITS) - 1


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlng = F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_dlng), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _axis(value: Column, offset: float, width: float, level: int) -> Column:
    step = F.floor((value + F.lit(offset)) / F.lit(width) * F.lit(float(1 << level)))
    return F.greatest(F.least(step, F.lit((1 << level) - 1)), F.lit(0)).cast("long")


def _pack(level: Column, x: Column, y: Column) -> Column:
    return (
        F.shiftleft(level.cast("long"), 2 * _AXIS_BITS)
        .bitwiseOR(F.shiftleft(x, _AXIS_BITS))
        .bitwiseOR(y)
    )


def cell_level(cell: Column) -> Column:
    return F.shiftright(cell, 2 * _AXIS_BITS)


def _cell_x(cell: Column) -> Column:
    return F.shiftright(cell, _AXIS_BITS).bitwiseAND(F.lit(_AXIS_MASK).cast("long"))


def _cell_y(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(_AXIS_MASK).cast("long"))


def cell_of(lat: Column, lng: Column, level: int = BASE_LEVEL) -> Column:
    """The cell of a point; NULL where a coordinate is NULL."""
    packed = _pack(F.lit(level), _axis(lng, 180.0, 360.0, level), _axis(lat, 90.0, 180.0, level))
    return F.when(lat.isNotNull() & lng.isNotNull(), packed)


def cell_parent(cell: Column, level: int) -> Column:
    """The cell at a coarser level; a level at or beyond the cell's own returns the cell."""
    up = cell_level(cell) - F.lit(level)
    factor = F.pow(F.lit(2.0), up.cast("double")).cast("long")
    parent = _pack(
        F.lit(level),
        F.floor(_cell_x(cell) / factor).cast("long"),
        F.floor(_cell_y(cell) / factor).cast("long"),
    )
    return F.when(up <= 0, cell).otherwise(parent)


def cell_center_lat(cell: Column) -> Column:
    steps = F.pow(F.lit(2.0), cell_level(cell).cast("double"))
    return (_cell_y(cell) + F.lit(0.5)) / steps * F.lit(180.0) - F.lit(90.0)


def cell_center_lng(cell: Column) -> Column:
    steps = F.pow(F.lit(2.0), cell_level(cell).cast("double"))
    return (_cell_x(cell) + F.lit(0.5)) / steps * F.lit(360.0) - F.lit(180.0)


def degrees_from_dms(dms: Column) -> Column:
    """``[degrees, minutes, seconds]`` to decimal degrees; NULL unless exactly three parts."""
    return F.when(
        F.size(dms) == 3,
        F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60 + F.get(dms, F.lit(2)) / 3600,
    )


def exif_degrees(decimal: Column, dms: Column, ref: Column, negative: str) -> Column:
    """A GPS coordinate given as a decimal or as a triple; the hemisphere may negate it."""
    value = F.coalesce(decimal.cast("double"), degrees_from_dms(dms))
    return F.when(ref == negative, -value).otherwise(value)
