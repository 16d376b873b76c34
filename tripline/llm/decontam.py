"""Benchmark decontamination: item-sized windows of documents against benchmark items.

Words are lower-cased (A-Z); shingles are of ``SHINGLE`` words. For every size that an item has,
windows of that many words slide over each whole document. A window and an item of that size
match if their weighted shingle sets (a shingle weighs as often as it occurs) have a Jaccard
similarity of ``SIMILARITY`` or more. Three steps find them:

1. Gate: such a pair shares at least s / (1 + s) of both shingle counts together. Running
   counts of shingles known to the benchmark leave the windows that can reach this.
2. SimHash: fingerprints of those windows meet the fingerprints of the items of their size
   through a multi-index: with ``RADIUS`` + 1 blocks of bits, any pair within the radius
   agrees in one block, so the index returns all of them.
3. Exact weighted similarity of what is left.

The benchmark goes to the executors in parts of at most about ``PART_WORDS`` words, so its size
is bounded whatever the benchmark's; each part reads the documents once.

A document shorter than an item is one window as a whole. Items with fewer than ``SHINGLE``
words are one shingle; items without words match nothing. Items that agree in id and text are one;
one without an id has no place in ``item_ids`` but counts for ``similarity``, and so for what is
contaminated. Null texts are empty. Rows are worked on alone, so repeated rows and null ids need no care.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.simhash import majority_bits
from tripline.llm.tokens import WORD_PATTERN, chunks, run_hashes, words_of
from tripline.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Weighted sets at the similarity differ in about 10 of 64 bits (deviation 3).
RADIUS = 20
PART_WORDS = 2_000_000
_BITMAP_BITS = 22


def shingles(hashes: np.ndarray) -> np.ndarray:
    return run_hashes(hashes, min(SHINGLE, len(hashes))) if len(hashes) else hashes


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def fingerprint(values: np.ndarray) -> int:
    return int(majority_bits(values, np.array([0, len(values)]))[0])


class BlockIndex:
    """Fingerprints by the values of ``radius + 1`` blocks of bits."""

    def __init__(self, fps: list[int], radius: int):
        cuts = np.linspace(0, 64, min(radius + 1, 64) + 1).astype(int).tolist()
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
        self.fps, self.radius = fps, radius
        self.tables = [defaultdict(list) for _ in self.blocks]
        for i, fp in enumerate(fps):
            for (shift, mask), table in zip(self.blocks, self.tables):
                table[fp >> shift & mask].append(i)

    def within(self, fp: int) -> list[int]:
        met = set()
        for (shift, mask), table in zip(self.blocks, self.tables):
            met.update(table.get(fp >> shift & mask, ()))
        return [i for i in met if (self.fps[i] ^ fp).bit_count() <= self.radius]


class Benchmark:
    """One part of the benchmark, ready for lookups."""

    def __init__(self, ids: list, texts: list):
        w = words_of(pa.array(texts, pa.string()), lower=True)
        hashes = w.hashes()
        self.sizes: dict[int, tuple[BlockIndex, list]] = {}
        known: dict[int, list[np.ndarray]] = defaultdict(list)
        by_size = defaultdict(list)
        for i, item in enumerate(ids):
            own = hashes[w.first[i] : w.first[i + 1]]
            if len(own):
                values = shingles(own)
                known[min(SHINGLE, len(own))].append(values)
                by_size[len(own)].append((item, values))
        for n, items in by_size.items():
            index = BlockIndex([fingerprint(v) for _, v in items], RADIUS)
            self.sizes[n] = (index, [(item, Counter(v.tolist())) for item, v in items])
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.bitmaps = {}
        for k, values in self.known.items():
            bitmap = np.zeros(1 << _BITMAP_BITS, dtype=bool)
            bitmap[values >> np.uint64(64 - _BITMAP_BITS)] = True
            self.bitmaps[k] = bitmap

    def hits(self, k: int, values: np.ndarray) -> np.ndarray:
        """Which of the shingles of ``k`` words the benchmark has."""
        out = self.bitmaps[k][values >> np.uint64(64 - _BITMAP_BITS)]
        maybe = np.flatnonzero(out)
        known = self.known[k]
        at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
        out[maybe] = known[at] == values[maybe]
        return out

    def search(self, words: np.ndarray, by_k: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict:
        """Best similarity per matching item of one document."""
        best: dict = {}
        for n, (index, items) in self.sizes.items():
            k = min(SHINGLE, n)
            values, hit = by_k[k]
            m = n - k + 1
            own = min(m, len(values))
            least = math.ceil(SIMILARITY / (1 + SIMILARITY) * (m + own) - 1e-9)
            if own < least or not len(values):
                continue
            total = np.append(0, np.cumsum(hit))
            starts = np.flatnonzero(total[own:] - total[:-own] >= least)
            if not len(starts):
                continue
            with np.errstate(over="ignore"):
                sums = np.append(np.uint64(0), np.cumsum(values))
                content = sums[starts + own] - sums[starts]
            # Windows with the same shingles are looked at once.
            for s in starts[np.unique(content, return_index=True)[1]].tolist():
                window = values[s : s + own]
                near = index.within(fingerprint(window))
                if near:
                    have = Counter(window.tolist())
                    for i in near:
                        item, want = items[i]
                        similarity = weighted_jaccard(have, want)
                        if similarity >= SIMILARITY:
                            best[item] = max(best.get(item, 0.0), similarity)
        return best


def _search_batches(benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = benchmark.value
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words_of(part.column("text"), lower=True)
                hashes = w.hashes()
                found: list[dict] = [{} for _ in range(part.num_rows)]
                every = {}
                for k in known.known:
                    values = run_hashes(hashes, k)
                    hit = known.hits(k, values)
                    inside = np.zeros(len(values), dtype=bool)
                    inside[w.valid(k)] = True
                    every[k] = (values, hit & inside)
                rows = w.rows()
                touched = np.unique(np.concatenate([rows[np.flatnonzero(h)] for _, h in every.values()] or [rows[:0]]))
                for row in touched.tolist():
                    a, b = int(w.first[row]), int(w.first[row + 1])
                    own = {k: (v[a : b - k + 1], h[a : b - k + 1]) for k, (v, h) in every.items() if b - a >= k}
                    own |= {k: (v[:0], h[:0]) for k, (v, h) in every.items() if b - a < k}
                    found[row] = known.search(hashes[a:b], own)
                ids = [sorted(i for i in f if i is not None) for f in found]
                best = [max(f.values()) if f else 0.0 for f in found]
                columns = [part.column("id"), part.column("text_hash"), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())]
                yield pa.record_batch(columns, names=["id", "text_hash", "item_ids", "similarity"])

    return run


def benchmark_parts(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Benchmark]:
    """The items in parts of bounded size."""
    given = items.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    given = materialize(given.where("text is not null").distinct(), "benchmark-items")
    words = given.agg(F.sum(F.regexp_count("text", F.lit(WORD_PATTERN)))).first()[0] or 0
    parts = max(1, -(-words // PART_WORDS))
    for p in range(parts):
        rows = given.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect()
        yield Benchmark([r["id"] for r in rows], [r["text"] for r in rows])


def contaminated(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``item_ids`` (sorted, of all matching items that have one) and the
    greatest ``similarity`` (0 where nothing matches) of every row. Over several parts, rows of one id and text are one row."""
    text = F.col(text_column).cast("string")
    given = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash long, item_ids array<long>, similarity double"
    found = None
    for part in benchmark_parts(items):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        one = given.mapInArrow(_search_batches(shared), schema)
        found = one if found is None else found.unionByName(one).groupBy("id", "text_hash").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("similarity").alias("similarity")
        )
    return found.withColumnRenamed("id", "doc_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        (F.col("similarity") > 0).alias("contaminated"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        "similarity",
    )
