"""Sequential clustering around a running centroid, and the clusters' labels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.geo import EARTH_RADIUS_KM
from tripline.operators.runs import RUN_COLUMNS, TRACK, item_runs, merge_runs

# A jump of this many radii starts a new cluster whatever the centroid is: the centroid
# stays within about one radius of the last item, as long as a radius is small on the
# globe and does not reach a pole or the date line (see ``_certain_break``).
_JUMP_RADII = 3.0
_MAX_RADIUS_KM = 200.0
_MAX_LATITUDE = 80.0


def leader_clusters(
    points: DataFrame, merge_km: Column | float, by: Sequence[str] = TRACK
) -> DataFrame:
    """Add ``cluster_id``: an item joins the current cluster if it lies within ``merge_km``
    of the mean position of the cluster's items so far, else it starts the next one. The id
    is the cluster's first media_id (as text).

    Each choice depends on all choices before it, but not across a jump so long that no
    centroid could bridge it. Every range partition settles its rows from its first such
    jump on; rows before it wait for the state at the end of the partition before, which
    its last row carries. Only those rows meet per track in the second pass, which streams
    with constant state.
    """
    by = list(by)
    km = merge_km if isinstance(merge_km, Column) else F.lit(merge_km)
    rest = [c for c in points.columns if c not in by]
    table = points.select(
        *by,
        *rest,
        F.unix_micros("t").alias("_us"),
        F.col("media_id").cast("string").alias("_id"),
        F.col("lat").cast("double").alias("_lat"),
        F.col("lng").cast("double").alias("_lng"),
        km.cast("double").alias("_km"),
        F.lit(None).cast("string").alias("cluster_id"),
        F.lit(None).cast("double").alias("_clat"),
        F.lit(None).cast("double").alias("_clng"),
        F.lit(None).cast("long").alias("_cn"),
        F.lit(True).alias("_open"),
    )
    schema = table.schema
    pieces = (
        table.repartitionByRange(*by, "_us", "_id")
        .sortWithinPartitions(*by, "_us", "_id")
        .mapInArrow(_Leader(len(by), whole=False), schema)
    )
    return (
        pieces.withColumn("_own", F.when(~F.col("_open"), F.col("_id")))
        .repartition(*by, "_own")
        .sortWithinPartitions(*by, "_own", "_us", "_id")
        .drop("_own")
        .mapInArrow(_Leader(len(by), whole=True), schema)
        .select(*by, *rest, "cluster_id")
    )


def _km(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    phi1, phi2 = math.radians(lat1), math.radians(lat2)
    a = math.sin(math.radians(lat2 - lat1) / 2)
    b = math.sin(math.radians(lng2 - lng1) / 2)
    h = a * a + math.cos(phi1) * math.cos(phi2) * b * b
    return 2 * EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


def _certain_break(lat: float, lng: float, next_lat: float, next_lng: float, km: float) -> bool:
    """Whether the next item starts a cluster whatever came before (a sufficient test)."""
    if not 0.0 <= km <= _MAX_RADIUS_KM or abs(lat) > _MAX_LATITUDE:
        return False
    reach = math.degrees(2 * km / EARTH_RADIUS_KM) / math.cos(math.radians(abs(lat) + 2.0))
    if abs(lng) + reach >= 180.0:
        return False
    return _km(lat, lng, next_lat, next_lng) > _JUMP_RADII * km + 1e-6


class _Leader:
    """Task-side pass over sorted items with constant state per sequence."""

    def __init__(self, width: int, whole: bool):
        self.width, self.whole = width, whole

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, state = None, None, None
        for batch in batches:
            names = batch.schema.names
            col = {n: batch.column(n).to_pylist() for n in names if n.startswith("_")}
            ids = batch.column("cluster_id").to_pylist()
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(self.width))))
            for i, (here, lat, lng) in enumerate(zip(groups, col["_lat"], col["_lng"])):
                if self.whole and not col["_open"][i]:
                    continue
                if here != group:
                    group, last, state = here, None, None
                if ids[i] is not None:
                    # End of an earlier piece, settled there: go on from its state.
                    state = [ids[i], col["_clat"][i], col["_clng"][i], col["_cn"][i]]
                    continue
                km = col["_km"][i]
                if state is None:
                    if self.whole or (last and _certain_break(*last, lat, lng, km)):
                        state = [col["_id"][i], lat, lng, 1]
                elif _km(state[1], state[2], lat, lng) <= km:
                    state[3] += 1
                    state[1] += (lat - state[1]) / state[3]
                    state[2] += (lng - state[2]) / state[3]
                else:
                    state = [col["_id"][i], lat, lng, 1]
                last = (lat, lng)
                if state is not None:
                    ids[i], col["_clat"][i], col["_clng"][i], col["_cn"][i] = state
                    col["_open"][i] = False
            if not self.whole:
                self._reopen_ends(groups, col["_open"])
            yield self._rebuild(batch, ids, col)

    @staticmethod
    def _reopen_ends(groups: list, is_open: list) -> None:
        """The last row of a sequence in a batch carries the state on. (Where the sequence
        goes on in the next batch of the piece this is more than needed, and harmless.)"""
        n = len(groups)
        for i in range(n):
            if i == n - 1 or groups[i] != groups[i + 1]:
                is_open[i] = True

    @staticmethod
    def _rebuild(batch: pa.RecordBatch, ids: list, col: dict) -> pa.RecordBatch:
        changed = {"cluster_id": ids} | {k: col[k] for k in ("_clat", "_clng", "_cn", "_open")}
        arrays = [
            pa.array(changed[f.name], f.type) if f.name in changed else batch.column(f.name)
            for f in batch.schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def cluster_runs(clustered: DataFrame, label: Column, by: Sequence[str] = TRACK) -> DataFrame:
    """One run per cluster, keyed by its most common label; ties go to the label seen first.

    Two aggregations, both combined map-side: per (cluster, label), then per cluster."""
    by = list(by)
    items = item_runs(clustered.withColumn("_label", label), F.col("_label"), [*by, "cluster_id"])
    # The labels of a cluster interleave in time: keep when each link was seen.
    seen = F.struct("first_us", "first_id", "first_url")
    items = items.withColumn("_seen", F.when(F.col("first_url").isNotNull(), seen))
    first_seen = F.min("_seen").alias("_seen")
    per_label = merge_runs(items.groupBy(*by, "cluster_id", "run_key"), first_seen)
    rank = F.struct((-F.col("n")).alias("n"), "first_us", "first_id", "run_key")
    best = F.min(rank)["run_key"].alias("run_key")
    return (
        merge_runs(per_label.groupBy(*by, "cluster_id"), best, first_seen)
        .withColumn("first_url", F.col("_seen.first_url"))
        .select(*by, "cluster_id", *RUN_COLUMNS)
    )
