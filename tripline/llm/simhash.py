"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint has one bit per position, set if over half of the text's shingle hashes have it.
Two fingerprints at ``radius`` differing bits or fewer are linked. Cut 64 bits into ``2 * radius``
blocks: a linked pair differs in at most ``radius`` of them, so the other ``radius`` blocks
agree, and the pair meets under at least one choice of ``radius`` whole blocks as key. Every
pair that meets is verified by its Hamming distance.

Only distinct fingerprints are keyed, so copies cost nothing. A key with more than ``LARGE``
fingerprints is cut again in the same way over its free bits, which bounds a group by the
values of the bits still free. Groups return a spanning star per component, never all pairs.

Null texts count as empty. Texts without words have fingerprint zero and are linked like any
others. Rows with equal ids are separate rows; a null id never names a component unless all
of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.components import connected_components
from tripline.llm.tokens import SEPARATOR, chunks, words_of
from tripline.session import materialize

#: Fingerprints under one key that are compared directly; larger groups are cut again.
LARGE = 2048


def shingle_digests(texts: pa.Array, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of ``size`` words, A-Z lower-cased, and the first
    shingle of each text. A text with fewer words is one shingle; without words it has none."""
    w = words_of(texts, lower=True)
    # One blank after each word, in place of whatever stands there.
    gap = SEPARATOR[w.data]
    keep = ~gap
    tail = w.ends[w.ends < len(w.data)]
    data = w.data.copy()
    data[tail[gap[tail]]] = 32
    keep[tail] = True
    moved = np.append(0, np.cumsum(keep))
    begins, ends = moved[w.starts], moved[w.starts] + (w.ends - w.starts)
    counts = w.counts
    shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    first = np.append(0, np.cumsum(shingles))
    lead = np.arange(first[-1]) - np.repeat(first[:-1], shingles) + np.repeat(w.first[:-1], shingles)
    last = np.minimum(lead + size, np.repeat(w.first[1:], shingles)) - 1
    raw, digest = data[keep].tobytes(), xxhash.xxh64_intdigest
    values = [digest(raw[a:b], 42) for a, b in zip(begins[lead].tolist(), ends[last].tolist())]
    return np.array(values, dtype=np.uint64), first


def majority_bits(digests: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its digests have, as uint64."""
    counts = np.diff(first)
    out = np.zeros(len(counts), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        bits = np.unpackbits(digests.astype(">u8").view(np.uint8)).reshape(-1, 64)
        total = np.add.reduceat(bits, first[:-1][filled], axis=0, dtype=np.int32)
        packed = np.packbits(total * 2 > counts[filled, None], axis=1)
        out[filled] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long) of every row of id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                fp = majority_bits(*shingle_digests(part.column("text"), size))
                yield pa.record_batch([part.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    given = docs.select("id", "text")
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _mask(blocks: list[list[int]]) -> int:
    return sum(1 << b for block in blocks for b in block)


def key_masks(radius: int) -> tuple[list[int], list[list[int]]]:
    """Masks of the first keys and, for each of them, of the finer keys over its free bits."""
    blocks = _cuts(list(range(64)), 2 * radius)
    coarse, fine = [], []
    for kept in combinations(blocks, radius):
        mask = _mask(list(kept))
        free = _cuts([b for b in range(64) if not mask >> b & 1], 2 * radius)
        coarse.append(mask)
        fine.append([mask | _mask(list(more)) for more in combinations(free, radius)])
    return coarse, fine


def _labels_by_pairs(values: np.ndarray, radius: int) -> np.ndarray:
    """Smallest position reachable over links, by comparing all values in blocks."""
    label = np.arange(len(values))
    pairs_a, pairs_b = [], []
    for begin in range(0, len(values), 512):
        near = np.bitwise_count(values[begin : begin + 512, None] ^ values[None, :]) <= radius
        a, b = np.nonzero(near)
        a = a + begin
        keep = a > b
        pairs_a.append(a[keep])
        pairs_b.append(b[keep])
    return _relax(label, np.concatenate(pairs_a), np.concatenate(pairs_b))


def _labels_by_flips(values: np.ndarray, radius: int) -> np.ndarray:
    """The same for many sorted values that share most bits: flips of up to ``radius`` free bits."""
    differing = int(np.bitwise_or.reduce(values ^ values[0]))
    free = [b for b in range(64) if differing >> b & 1]
    pairs_a, pairs_b = [], []
    for n in range(1, radius + 1):
        for flipped in combinations(free, n):
            other = values ^ np.uint64(sum(1 << b for b in flipped))
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = np.flatnonzero((values[at] == other) & (other < values))
            pairs_a.append(hit)
            pairs_b.append(at[hit])
    return _relax(np.arange(len(values)), np.concatenate(pairs_a), np.concatenate(pairs_b))


def _relax(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _stars(radius: int):
    """Arrow pass over groups of fingerprints under one key: each member beside the smallest
    one that it reaches inside the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            values = np.asarray(column.flatten()).view(np.uint64)
            bounds = np.append(0, np.cumsum(np.asarray(column.value_lengths())))
            sizes = np.diff(bounds)
            pair = bounds[:-1][sizes == 2]
            x, y = values[pair], values[pair + 1]
            near = np.bitwise_count(x ^ y) <= radius
            a, b = [np.maximum(x, y)[near]], [np.minimum(x, y)[near]]
            for begin, end in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2]):
                group = np.unique(values[begin:end])
                label = (_labels_by_pairs if len(group) <= LARGE else _labels_by_flips)(group, radius)
                moved = label < np.arange(len(group))
                a.append(group[moved])
                b.append(group[label[moved]])
            out = [pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)]
            yield pa.record_batch(out, names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (``a``, ``b``) that connect the same distinct ``fp`` as all pairs within ``radius``."""
    coarse, fine = key_masks(radius)
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in coarse])).alias("k", "key")
    )
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["k", "key"]), "simhash-keys")
    small = shared.where(F.col("n") <= LARGE).groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in fine])
    finer = (
        shared.where(F.col("n") > LARGE)
        .select("k", "fp", F.posexplode(F.element_at(table, F.col("k") + 1)).alias("k2", "mask"))
        .select("k", "k2", "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        .groupBy("k", "k2", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    groups = small.select("fps").unionByName(finer.select("fps"))
    out = groups.mapInArrow(_stars(radius), "a long, b long").distinct()
    out.stage_path = shared.stage_path  # for who wants to discard it
    return out


def near_duplicates_by(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """``docs``: id (of any type), text. Adds ``fp`` and ``component``, the least fingerprint
    of each row's component, in place of the text."""
    fps = materialize(fingerprints(docs, size), "simhash-fps")
    distinct = fps.select("fp").distinct()
    labels = connected_components(links(distinct, radius))
    # Only linked fingerprints have a label; each of the others is a component of its own.
    return fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "id", "fp", F.coalesce("label", "fp").alias("component")
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, radius: int = 3
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id reachable over links."""
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    marked = materialize(near_duplicates_by(given, size, radius), "simhash-components")
    least = marked.groupBy("component").agg(F.min("id").alias("component_id"))
    return marked.join(least, "component").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
