"""Positions within ordered groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripline.session import materialize


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add the 1-based position in each ``by`` group.

    A plain ``row_number`` would sort a whole group in one task. Here range partitions cut
    the groups; positions are counted inside each piece and moved by the sizes of the pieces
    before it, of which a group has no more than there are partitions. The pieces are
    written once, because both the sizes and the rows must see the same cuts.
    """
    by, order = list(by), list(order)
    pieces = materialize(
        df.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id()),
        "pieces",
    )
    earlier = (
        Window.partitionBy(*by)
        .orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        pieces.groupBy(*by, "_piece")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*by, "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    return (
        pieces.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*by, "_piece"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_piece")
    )


def mark_first(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "is_first"
) -> DataFrame:
    """Add whether the row is the first of its ``by`` group: a small aggregate per group,
    joined back. The order columns must identify a row within its group."""
    by, order = list(by), list(order)
    first = df.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        df.join(first, by)
        .withColumn(name, F.struct(*order).eqNullSafe(F.col("_first")))
        .drop("_first")
    )
