"""City labels, photo ids and place names from address components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripline.functions.text import blank_to_null, strip

# Fixed values: (country, first-level area) pairs whose area is itself the city.
METRO_AREAS = (
    ("JP", "Tokyo"),
    ("VN", "Hà Nội"),
)

# Component types tried in turn for the city, and the one for the area.
CITY_TYPES = (
    "locality",
    "postal_town",
    "sublocality_level_1",
    "administrative_area_level_3",
    "administrative_area_level_2",
)
AREA_TYPE = "administrative_area_level_1"
COUNTRY_TYPE = "country"

# Fixed value: the part photo links have in common.
PHOTO_URL_PREFIX = "https://photos.google.com/photo/"

COMPONENTS_DDL = "array<struct<types:array<string>,long_name:string,short_name:string>>"


def city_label(
    country: Column, city: Column, area: Column, metros: tuple = METRO_AREAS
) -> Column:
    """The city-tier label: metros collapse to their area, others use the city, then the area."""
    area = blank_to_null(strip(area))
    is_metro = reduce(
        lambda a, b: a | b,
        [(country == cc) & (area == name) for cc, name in metros],
        F.lit(False),
    )
    return F.when(is_metro, area).otherwise(F.coalesce(blank_to_null(city), area))


def photo_id(url: Column) -> Column:
    """The link without the common prefix; other links whole; NULL for none."""
    n = len(PHOTO_URL_PREFIX)
    return F.when(
        url.startswith(PHOTO_URL_PREFIX), F.substring(url, n + 1, 1 << 30)
    ).otherwise(blank_to_null(url))


def component(components: Column, kind: Column | str, field: str = "long_name") -> Column:
    """A field of the *first* component having the type; no search beyond that one."""
    hits = F.filter(components, lambda c: F.array_contains(c["types"], kind))
    return F.get(hits, F.lit(0))[field]


def place_city(components: Column) -> Column:
    """First non-empty name along the type chain. One expression over the chain, so that a
    parsed column is referred to once."""
    chain = F.array(*map(F.lit, CITY_TYPES))
    names = F.transform(chain, lambda kind: component(components, kind))
    return F.get(F.filter(names, lambda name: name != ""), F.lit(0))


def json_list(text: Column, ddl: str) -> Column:
    """Parsed JSON text that is a list; NULL for anything else."""
    return F.from_json(F.regexp_extract(text, r"^(?s)\s*(\[.*)$", 1), ddl)


def place_area(components: Column) -> Column:
    return component(components, AREA_TYPE)


def place_country(components: Column) -> Column:
    return component(components, COUNTRY_TYPE, "short_name")
