"""File names of media and of their sidecars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.text import extension_of, stem_of

# Media extensions.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".tiff", ".gif", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v", ".3gp", ".avi", ".mkv", ".webm")

# Endings of edited copies, in the export languages.
EDITED_MARKERS = (
    "-edited",
    "-edit",
    "-bearbeitet",
    "-modifié",
    "-modifie",
    "-ha editado",
    "-editado",
    "-bewerkt",
    "-edytowane",
    "-redigerad",
    "-muokattu",
    "-editat",
    "-편집",
    "-編集済み",
)

# Parts of sidecar names, and the folder of a capture year.
SIDECAR_EXTENSION = ".json"
SUPPLEMENT = ".supplemental-metadata"
SUPPLEMENT_STEM = ".supplemental"
YEAR_FOLDER = r"Photos from (\d{4})$"

# Fixed value: a counter in parentheses at the end of a stem.
_COUNTER = r"^(?s)(.*?)(?:\((\d+)\))?$"
_EDITED = "(?iu)(?:" + "|".join(re.escape(m) for m in EDITED_MARKERS) + ")$"


def is_sidecar(name: Column) -> Column:
    return F.lower(name).endswith(SIDECAR_EXTENSION)


def media_kind(name: Column) -> Column:
    """``photo``, ``video`` or NULL by extension."""
    ext = F.lower(extension_of(name))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "photo").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def counter_core(stem: Column) -> Column:
    return F.regexp_extract(stem, _COUNTER, 1)


def counter(stem: Column) -> Column:
    """Digits of a trailing ``(n)`` without leading zeros; NULL for none."""
    digits = F.regexp_extract(stem, _COUNTER, 2)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))


def original_stem(stem: Column) -> Column:
    """The stem without its "edited" ending; NULL if it has none."""
    return F.when(stem.rlike(_EDITED), F.regexp_replace(stem, _EDITED, ""))


def strip_edited(name: Column) -> Column:
    """The name without its "edited" ending; NULL if it has none."""
    return F.concat(original_stem(stem_of(name)), extension_of(name))


def with_name_parts(media: DataFrame) -> DataFrame:
    """Take ``name`` apart once per row: _ext, _stem, _original (stem without the "edited"
    ending, NULL for none), and core and counter of both. The array round trip keeps the
    optimizer from repeating the patterns in every expression that uses a part."""

    def once(df: DataFrame, **parts: Column) -> DataFrame:
        packed = F.struct(*[c.alias(k) for k, c in parts.items()])
        return df.select("*", F.explode(F.array(packed)).alias("_p")).select(
            *df.columns, "_p.*"
        )

    rows = once(media, _ext=extension_of(F.col("name")))
    stem = F.left("name", F.length("name") - F.length("_ext"))
    rows = once(rows, _stem=stem, _original=original_stem(stem))
    return once(
        rows,
        _core=counter_core(F.col("_stem")),
        _n=counter(F.col("_stem")),
        _original_core=counter_core(F.col("_original")),
        _original_n=counter(F.col("_original")),
    )


def candidates_of(name: Column, core: Column, ext: Column, n: Column) -> Column:
    """Exact sidecar names of a media name taken apart, most specific first, no repeats."""
    base, end = F.concat(core, ext), F.lit(SIDECAR_EXTENSION)
    names = F.array(
        F.concat(base, F.lit(SUPPLEMENT + "("), n, F.lit(")"), end),
        F.concat(base, F.lit("("), n, F.lit(")"), end),
        F.concat(name, F.lit(SUPPLEMENT), end),
        F.concat(name, end),
        F.concat(base, F.lit(SUPPLEMENT), end),
        F.concat(base, end),
    )
    # Drops NULLs (names with a counter where there is none) and repeats, in order.
    return F.array_except(names, F.array(F.lit(None).cast("string")))


def sidecar_candidates(name: Column) -> Column:
    stem = stem_of(name)
    return candidates_of(name, counter_core(stem), extension_of(name), counter(stem))


def bases_of(core: Column, ext: Column) -> Column:
    """The two titles a media name may stand for: without its counter, and without extension."""
    return F.array(F.lower(F.concat(core, ext)), F.lower(core))


def sidecar_counter(name: Column) -> Column:
    """Counter of a sidecar name, taken behind its last two extensions; ``0`` for none."""
    cut = F.left(name, F.length(name) - len(SIDECAR_EXTENSION))
    return F.coalesce(counter(stem_of(cut)), F.lit("0"))


def implied_media_name(name: Column) -> Column:
    """What a sidecar name tells of its media name (lower case): without extension, counter and
    the possibly cut supplement."""
    core = F.lower(counter_core(F.regexp_replace(name, r"(?i)\.json$", "")))
    at = F.instr(core, SUPPLEMENT_STEM)
    return F.when(at > 0, F.left(core, at - 1)).otherwise(core)


def folder_year(directory: Column) -> Column:
    """Year of a ``Photos from YYYY`` folder, else NULL."""
    year = F.regexp_extract(directory, YEAR_FOLDER, 1)
    return F.when(year != "", year.cast("int"))


def in_folder_years(directory: Column, lo_month: str, hi_month: str) -> Column:
    """Whether a folder may hold items of the months: one year of slack on both sides; folders
    without a year always may."""
    year = folder_year(directory)
    return F.coalesce(
        year.between(int(lo_month[:4]) - 1, int(hi_month[:4]) + 1), F.lit(True)
    )
