"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``TICKS`` places. Every shard owns ``VNODES`` of them by hash; a text hashes to a
place and belongs to the next virtual node clockwise, so equal texts start at the same place.
Every shard has an exact capacity in rows (``rows``: counts at most one apart). What a full
shard cannot take continues clockwise to the next virtual node of a shard with room.

Rows of one place all walk the same way, so the walk is settled on row counts per place: a
table of at most ``TICKS`` rows however large the input is, which goes through the driver and
comes back as segments (place, ranks from-to, shard, first slot). Rows are then numbered inside
their place by range pieces (a hot text is cut like everything else) and look up their segment.

Null texts have no bytes and the CRC of none. Null ids come first inside a place. Repeated rows
are rows of their own. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.operators.ordered import number_rows
from tripline.session import materialize

#: Places on the ring, a power of two; bounds what passes the driver.
TICK_BITS = 16
VNODES = 128


def ring(shards: int, vnodes: int = VNODES, bits: int = TICK_BITS) -> np.ndarray:
    """The shard that owns each place or, where none does, -1. The lower shard wins a place."""
    owner = np.full(1 << bits, -1, dtype=np.int64)
    for shard in range(shards - 1, -1, -1):
        for v in range(vnodes):
            owner[xxhash.xxh64_intdigest(f"shard-{shard}-{v}") >> (64 - bits)] = shard
    return owner


def capacities(total: int, shards: int) -> np.ndarray:
    """Exact row capacities, at most one apart."""
    return np.full(shards, total // shards, dtype=np.int64) + (np.arange(shards) < total % shards)


def _clockwise(owner: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """For each place the shard of the next virtual node at or after it whose shard is open."""
    at = np.flatnonzero((owner >= 0) & open_[owner])
    if not len(at):  # every virtual node of the shards with room lost its place to another
        return np.full(len(owner), int(np.flatnonzero(open_)[0]))
    return owner[at[np.searchsorted(at, np.arange(len(owner))) % len(at)]]


def walk(counts: dict[int, int], owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Segments (place, first rank, end rank, shard, first slot) that fill every capacity.

    Round by round all waiting rows ask the next open shard clockwise. A shard takes them in
    ring order until it is full, so at least one shard fills up in each round but the last.
    """
    room = capacity.copy()
    waiting = {t: (0, n) for t, n in sorted(counts.items())}
    taken: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    while waiting:
        asks = _clockwise(owner, room > 0)
        left = {}
        for tick, (begin, end) in waiting.items():
            shard = int(asks[tick])
            n = int(min(end - begin, room[shard]))
            if n:
                taken[tick].append((begin, begin + n, shard))
                room[shard] -= n
            if begin + n < end:
                left[tick] = (begin + n, end)
        waiting = left
    used = np.zeros(len(capacity), dtype=np.int64)
    segments = []
    for tick in sorted(taken):
        for begin, end, shard in taken[tick]:
            segments.append((tick, begin, end, shard, int(used[shard])))
            used[shard] += end - begin
    return segments


def place_rows(
    docs: DataFrame,
    shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``home`` (the shard that the ring alone would give),
    ``shard`` and ``slot`` (gapless from 0 in each shard) per row, and the ``carry`` columns."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
        *[F.col(c).alias(f"_carried_{i}") for i, c in enumerate(carry)],
    ).withColumn("_tick", F.shiftrightunsigned("_hash", 64 - TICK_BITS).cast("int"))
    numbered = materialize(number_rows(keyed, ["_tick"], ["_hash", "doc_id", "size", "text_crc32"], "_rank"), "ring-rows")
    # At most 1 << TICK_BITS rows, whatever the input holds.
    counts = {r["_tick"]: r["n"] for r in numbered.groupBy("_tick").agg(F.count("*").alias("n")).collect()}
    owner = ring(shards)
    segments = walk(counts, owner, capacities(sum(counts.values()), shards))
    home = _clockwise(owner, np.ones(shards, dtype=bool))
    by_tick: dict[int, list[tuple]] = defaultdict(list)
    for tick, begin, end, shard, slot in segments:
        by_tick[tick].append((begin, end, shard, slot))
    table = pd.DataFrame(
        {
            "_tick": np.array(list(by_tick), dtype=np.int32),
            "_home": np.array([home[t] for t in by_tick], dtype=np.int32),
            **{f"_{c}": [[s[i] for s in by_tick[t]] for t in by_tick] for i, c in enumerate(("begin", "end", "to", "at"))},
        }
    )
    segments_df = spark.createDataFrame(
        table, "_tick int, _home int, _begin array<long>, _end array<long>, _to array<int>, _at array<long>"
    )
    # Bounded by the ring's places, so every executor can hold it.
    joined = numbered.join(F.broadcast(segments_df), "_tick").withColumn(
        "_i", F.expr("size(filter(_end, e -> e < _rank)) + 1")
    )
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_home").alias("home"),
        F.element_at("_to", F.col("_i")).alias("shard"),
        (F.element_at("_at", F.col("_i")) + F.col("_rank") - 1 - F.element_at("_begin", F.col("_i"))).alias("slot"),
        *[F.col(f"_carried_{i}").alias(c) for i, c in enumerate(carry)],
    )


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home",
    )
