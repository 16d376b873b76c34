"""Small text helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim every kind of white space, also beyond ASCII (``trim`` only takes blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def directory_of(path: Column) -> Column:
    """Everything before the last ``/``; empty for a bare name."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?s)(?:.*/)?([^/]*)$", 1)


def extension_of(name: Column) -> Column:
    """Extension with its dot, as in ``a.tar.gz`` -> ``.gz``; leading dots belong to the stem."""
    return F.regexp_extract(name, r"^(?s)(?:\.*[^.].*)(\.[^.]*)$", 1)


def stem_of(name: Column) -> Column:
    return F.left(
        name, F.length(name) - F.length(extension_of(name))
    )
