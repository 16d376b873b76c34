"""Runs of equal labels in time order, blip smoothing, and stays.

A *run table* has one row per run (or per item, or per cluster: each is a run of its own)::

    <by...>, run_key, first_us, first_id, first_date, last_us, last_id, last_date,
    sum_lat, sum_lng, n, first_url

``by`` names the columns of one ordered sequence, by default one track. Nothing here
partitions by ``by`` alone at item level: one track may hold a third of all rows. The order
is cut into range partitions over ``(by, time, id)``, which also cut through a track and
even through one instant; each piece is reduced by itself, and only the pieces' *edges*
(at most two rows per piece) meet again per track.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK = ("track_id",)

_RUN_FIELDS = [
    T.StructField("run_key", T.StringType()),
    T.StructField("first_us", T.LongType()),
    T.StructField("first_id", T.StringType()),
    T.StructField("first_date", T.DateType()),
    T.StructField("last_us", T.LongType()),
    T.StructField("last_id", T.StringType()),
    T.StructField("last_date", T.DateType()),
    T.StructField("sum_lat", T.DoubleType()),
    T.StructField("sum_lng", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("first_url", T.StringType()),
]
RUN_COLUMNS = [f.name for f in _RUN_FIELDS]


def item_runs(points: DataFrame, key: Column, by: Sequence[str] = TRACK) -> DataFrame:
    """Each point as a run of one. ``points`` has ``by``, media_id, t, local_date, lat, lng, url."""
    us, ident = F.unix_micros("t"), F.col("media_id").cast("string")
    return points.select(
        *by,
        key.alias("run_key"),
        us.alias("first_us"),
        ident.alias("first_id"),
        F.col("local_date").alias("first_date"),
        us.alias("last_us"),
        ident.alias("last_id"),
        F.col("local_date").alias("last_date"),
        F.col("lat").alias("sum_lat"),
        F.col("lng").alias("sum_lng"),
        F.lit(1).cast("long").alias("n"),
        F.when(F.col("url") != "", F.col("url")).alias("first_url"),
    )


def merge_runs(groups: GroupedData, *more: Column) -> DataFrame:
    """Fuse the runs of each group into one run. Ends are taken as whole structs, which keeps
    the number of aggregates per row small."""
    start = F.struct("first_us", "first_id", "first_date")
    end = F.struct("last_us", "last_id", "last_date")
    link = F.struct("first_us", "first_id", "first_url")
    fused = groups.agg(
        F.min(start).alias("_start"),
        F.max(end).alias("_end"),
        F.sum("sum_lat").alias("sum_lat"),
        F.sum("sum_lng").alias("sum_lng"),
        F.sum("n").alias("n"),
        F.min(F.when(F.col("first_url").isNotNull(), link)).alias("_link"),
        *more,
    )
    return fused.select("*", "_start.*", "_end.*", F.col("_link.first_url").alias("first_url")).drop(
        "_start", "_end", "_link"
    )


def _starts_new(order) -> Column:
    """1 where the key differs from the row before (also at the first row), else 0."""
    key = F.struct("run_key")
    return F.when(F.lag(key).over(order).eqNullSafe(key), 0).otherwise(1)


def coalesce_runs(runs: DataFrame, by: Sequence[str] = TRACK) -> DataFrame:
    """Fuse neighbouring runs of equal key, whatever their number per track."""
    by = list(by)
    # 1. Cut the order into pieces; runs inside a piece.
    pieces = runs.repartitionByRange(*by, "first_us", "first_id").withColumn(
        "_piece", F.spark_partition_id()
    )
    inside = Window.partitionBy(*by, "_piece").orderBy("first_us", "first_id")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    cut = pieces.withColumn("_new", _starts_new(inside)).withColumn(
        "_part", F.sum("_new").over(inside.rowsBetween(*so_far))
    )
    key = F.first("run_key").alias("run_key")
    parts = merge_runs(cut.groupBy(*by, "_piece", "_part"), key)
    # 2. Only the first and last run of a piece can go on in a neighbour. The others get a
    #    group of their own, so the window below sees at most two rows per piece and track.
    parts = parts.withColumn(
        "_edge",
        (F.col("_part") == 1)
        | (F.col("_part") == F.max("_part").over(Window.partitionBy(*by, "_piece"))),
    ).withColumn("_own", F.when(~F.col("_edge"), F.col("first_id")))
    across = Window.partitionBy(*by, "_own").orderBy("first_us", "first_id")
    goes_on = (F.lag("_piece").over(across) != F.col("_piece")) & (_starts_new(across) == 0)
    run = F.sum(F.when(goes_on, 0).otherwise(1)).over(across.rowsBetween(*so_far))
    runs_across = parts.withColumn("_run", run).groupBy(*by, "_own", "_run")
    return merge_runs(runs_across, key).select(*by, *RUN_COLUMNS)


def segment_runs(points: DataFrame, key: Column, by: Sequence[str] = TRACK) -> DataFrame:
    """Maximal runs of equal ``key`` in (time, id) order; ``key`` is any column expression."""
    return coalesce_runs(item_runs(points, key, by), by)


# --------------------------------------------------------------------------------------
# Smoothing
# --------------------------------------------------------------------------------------
def smooth_runs(
    runs: DataFrame, min_hours: Column | float, by: Sequence[str] = TRACK
) -> DataFrame:
    """Absorb interior runs that span less than ``min_hours`` between two runs of one key,
    leftmost first, to the fixed point.

    The leftmost-first fixed point needs one look at each run: keep a stack, and when the
    top is short and the run below it has the key of the run that comes in, fuse all three.
    A run that spans ``min_hours`` is never absorbed, so the stretches between two such
    *long* runs do not influence each other. The first pass therefore reduces, in every
    range partition, what lies between its first and its last long run. The second pass
    joins, per track, the little that is left at the partitions' ends. ``min_hours`` may be
    a column, constant within ``by``.
    """
    by = list(by)
    hours = min_hours if isinstance(min_hours, Column) else F.lit(min_hours)
    table = runs.select(
        *by,
        *RUN_COLUMNS,
        (hours.cast("double") * F.lit(3_600_000_000.0)).cast("long").alias("_min_us"),
        F.lit(True).alias("_open"),
    )
    schema, order = table.schema, ["first_us", "first_id"]
    width = len(by)
    pieces = (
        table.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .mapInArrow(_Smoother(width, whole=False), schema)
    )
    own = F.when(~F.col("_open"), F.col("first_id"))
    return (
        pieces.withColumn("_own", own)
        .repartition(*by, "_own")
        .sortWithinPartitions(*by, "_own", *order)
        .drop("_own")
        .mapInArrow(_Smoother(width, whole=True), schema)
        .select(*by, *RUN_COLUMNS)
    )


# Positions behind the ``by`` columns.
_KEY, _FIRST_US, _LAST_US, _LAST_ID, _LAST_DATE = 0, 1, 4, 5, 6
_SUM_LAT, _SUM_LNG, _N, _URL, _MIN_US, _OPEN = 7, 8, 9, 10, 11, 12


class _Smoother:
    """Task-side stack pass over sorted runs; holds only runs begun within ``min_hours``.

    ``whole`` tells whether the pass sees each sequence from its start (second pass, where
    rows already final only pass through) or from an arbitrary point on (first pass).
    """

    def __init__(self, width: int, whole: bool):
        self.width, self.whole = width, whole

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self._group, self._stack, self._out = None, [], []
        self._synced = self._edge_open = self._leaked = False
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                self._take(list(row))
            if self._out:
                yield self._drain(schema)
        self._flush()
        if self._out:
            yield self._drain(schema)

    def _drain(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*self._out)
        self._out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    def _emit(self, run: list, is_open: bool) -> None:
        run[self.width + _OPEN] = is_open
        self._out.append(run)

    def _flush(self) -> None:
        for run in self._stack:
            self._emit(run, True)
        self._stack = []

    def _take(self, run: list) -> None:
        w, stack = self.width, self._stack
        if self.whole and not run[w + _OPEN]:
            self._out.append(run)
            return
        group = run[:w]
        if group != self._group:
            self._flush()
            self._group, self._synced = group, self.whole
            self._edge_open, self._leaked = True, False
        if not self._synced:
            # Before the first long run the left context is unknown: hand on as is.
            if run[w + _LAST_US] - run[w + _FIRST_US] < run[w + _MIN_US]:
                self._emit(run, True)
                return
            self._synced = True
        self._push(run)
        self._release()

    def _push(self, run: list) -> None:
        w, stack = self.width, self._stack
        if len(stack) > 1:
            below, top = stack[-2], stack[-1]
            short = top[w + _LAST_US] - top[w + _FIRST_US] < top[w + _MIN_US]
            if short and below[w + _KEY] == run[w + _KEY]:
                for part in (top, run):
                    for i in (_SUM_LAT, _SUM_LNG, _N):
                        below[w + i] += part[w + i]
                    below[w + _URL] = below[w + _URL] or part[w + _URL]
                for i in (_LAST_US, _LAST_ID, _LAST_DATE):
                    below[w + i] = run[w + i]
                stack.pop()
                return
        stack.append(run)

    def _release(self) -> None:
        """Hand on the runs below the top that nothing to come can change."""
        w, stack = self.width, self._stack
        top = stack[-1]
        if len(stack) > 1 and top[w + _LAST_US] - top[w + _FIRST_US] >= top[w + _MIN_US]:
            # Between two long runs all is settled, but the piece's outermost long runs
            # and stretches handed on in part before must be seen again.
            self._emit(stack[0], self._edge_open or self._leaked)
            for run in stack[1:-1]:
                self._emit(run, self._leaked)
            self._edge_open, self._leaked = self._leaked, False
            self._stack = [top]
            return
        now = top[w + _LAST_US]
        while len(stack) > 2 and now - stack[1][w + _FIRST_US] >= stack[1][w + _MIN_US]:
            # A run below the top that began ``min_hours`` ago is never absorbed.
            self._emit(stack.pop(0), True)
            self._leaked = True


def mean_degrees(total: Column, n: Column) -> Column:
    """Mean to 5 decimals. The first rounding drops the noise of the summation order, which
    differs from run to run, so that it cannot decide a tie."""
    return F.round(F.round(total / n, 10), 5)


def stays(runs: DataFrame, by: Sequence[str] = TRACK) -> DataFrame:
    """One row per stay: days of the first and last item in time, mean position, count, link."""
    return runs.select(
        *by,
        F.col("run_key").alias("label"),
        F.col("first_date").alias("from"),
        F.col("last_date").alias("to"),
        mean_degrees(F.col("sum_lat"), F.col("n")).alias("lat"),
        mean_degrees(F.col("sum_lng"), F.col("n")).alias("lng"),
        F.col("n").alias("photo_count"),
        F.col("first_url").alias("sample_url"),
        "first_us",
        "first_id",
    )
