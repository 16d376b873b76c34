"""Steps of a computation that stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once per row: a projection would be inlined into every
    expression using it, and filters on it pushed below, each repeating the work. It is a method of
    its own in the generated code, too, and the JVM only interprets a method that is too large."""
    return df.select("*", F.explode(F.array(value)).alias(name))
