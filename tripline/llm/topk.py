"""Exact top-k search by inner product, with bounds from multi-resolution segment statistics.

Every vector is cut into segments, coarse to fine. With the mean m and the deviation s of a
segment of n components, the squared distance of two vectors is at least the sum of
n * ((m - m')^2 + (s - s')^2) over segments, which bounds their inner product from above by the
sum of n * (m * m' + s * s'). Finer segments bound more tightly. A query drops a candidate as
soon as one bound is below its k-th best score so far; survivors get their exact score.

Queries are dealt into blocks, candidates into slices; a task holds one block of queries and
streams one slice past it, keeping k scores per query. The best k of each slice meet in a second
step. Nothing is broadcast, and no task holds more than a block of queries and one Arrow batch.

A component x becomes floor(scale * x), x as double. Vectors that are null, or hold a null or
non-finite component, take no part; nor do rows without an id. Vectors of unequal length are
compared over their common components, an empty one scores 0 with all. A repeated query
counts once, a repeated candidate each time; a row with the query's id is the query's own.
Different vectors under one query id share one result. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
#: Least candidates of a slice; slices are otherwise as few as keep the cores busy.
SLICE = 8192
SEGMENTS = (4, 16)
#: Candidates scored first, to have a k-th best score early.
PROBE = 64
_ROWS = "query_id long, vec_id long, score long"


def quantized(embedding: Column, scale: int = 64) -> Column:
    """The components as whole numbers; null where the vector takes no part."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, padded with zeros where they are shorter."""
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    widest = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), max(widest, width or 0)), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation of each segment: the bound is their inner product."""
    parts = np.array_split(vectors.astype(np.float64), min(segments, max(1, vectors.shape[1])), axis=1)
    columns = []
    for p in parts:
        n = p.shape[1]
        if n:
            columns += [p.mean(axis=1) * np.sqrt(n), p.std(axis=1) * np.sqrt(n)]
    return np.stack(columns, axis=1) if columns else np.zeros((len(vectors), 1))


class Block:
    """Queries of one block and their best scores so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)

    def _offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.found[q], ids), np.append(self.scores[q], scores)
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[q], self.scores[q] = ids[best], scores[best]

    def scan(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(self.vectors.shape[1], vectors.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        mine, other = pad(self.vectors), pad(vectors)
        # Room for the rounding of the statistics.
        size = np.sqrt((mine.astype(float) ** 2).sum(axis=1)), np.sqrt((other.astype(float) ** 2).sum(axis=1))
        slack = 1e-9 * (1 + size[0] * size[1].max(initial=0.0))
        coarse, *finer = [(segment_statistics(mine, n), segment_statistics(other, n)) for n in SEGMENTS]
        for begin in range(0, len(self.ids), 256):
            bounds = coarse[0][begin : begin + 256] @ coarse[1].T
            for i, bound in enumerate(bounds):
                q = begin + i
                todo = np.flatnonzero(ids != self.ids[q])
                if len(self.scores[q]) < self.k and len(todo) > PROBE + self.k:
                    first = todo[np.argpartition(-bound[todo], PROBE)[: PROBE + self.k]]
                    self._offer(q, ids[first], other[first] @ mine[q])
                    rest = np.ones(len(ids), dtype=bool)
                    rest[first] = False
                    todo = todo[rest[todo]]
                if len(self.scores[q]) == self.k:
                    least = self.scores[q][-1] - slack[q]
                    todo = todo[bound[todo] >= least]
                    for own, theirs in finer:
                        todo = todo[theirs[todo] @ own[q] >= least]
                if len(todo):
                    self._offer(q, ids[todo], other[todo] @ mine[q])

    def result(self) -> pa.RecordBatch:
        counts = [len(x) for x in self.found]
        columns = [np.repeat(self.ids, counts), np.concatenate([*self.found, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0, np.int64)])]
        return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])


def _search(k: int):
    """Rows come sorted by block, slice and kind: queries (0), then candidates (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, block = None, [], [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("block", "slice", "kind")], axis=1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                b, s, kind = keys[begin].tolist()
                if (b, s) != at:
                    if block is not None:
                        yield block.result()
                    at, ids, vectors, block = (b, s), [], [], None
                part = batch.slice(begin, end - begin)
                own, matrix = np.asarray(part.column("vec_id")), _matrix(part.column("v"))
                if kind == 0:
                    ids.append(own)
                    vectors.append(matrix)
                    continue
                if block is None and ids:
                    width = max(m.shape[1] for m in vectors)
                    stacked = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in vectors])
                    block = Block(np.concatenate(ids), stacked, k)
                if block is not None:
                    for a in range(0, len(own), SLICE):
                        block.scan(own[a : a + SLICE], matrix[a : a + SLICE])
        if block is not None:
            yield block.result()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best of ``vectors`` for each of ``queries`` (both: vec_id, v), itself left out:
    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    vectors, queries = (x.where("vec_id is not null and v is not null") for x in (vectors, queries))
    queries = queries.dropDuplicates(["vec_id", "v"])
    n_vectors, n_queries = vectors.count(), queries.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    wanted = 4 * spark.sparkContext.defaultParallelism
    slices = max(1, min(-(-n_vectors // SLICE), -(-wanted // blocks)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(block.alias("block"), numbers(slices).alias("slice"), F.lit(0).alias("kind"), "vec_id", "v")
    given = vectors.select(numbers(blocks).alias("block"), part.alias("slice"), F.lit(1).alias("kind"), "vec_id", "v")
    tasks = asked.unionByName(given).repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    best = tasks.mapInArrow(_search(k), _ROWS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_scores(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """Queries are the rows whose ``vec_id`` is divisible by ``every``."""
    vectors = embeddings.select("vec_id", quantized(F.col("embedding"), scale).alias("v"))
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
