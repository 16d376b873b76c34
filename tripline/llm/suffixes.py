"""Substring dedup by sorted suffixes: every byte of a repeated string of ``WINDOW`` bytes goes,
but for the place where the string starts first.

A window is ``WINDOW`` consecutive bytes of one text. It is a repeat if the same bytes start
earlier: in a row before, or before in the same row. Windows are judged on the input.

1. *Buckets.* A window's anchor is the least hash among its runs of ``GRAM`` bytes, leftmost if it
   occurs twice. Equal windows have equal anchors at equal places, so suffixes with different
   anchors need not be compared. Anchors that occur once are left out.
2. *Passages.* Consecutive windows with one anchor are a passage. Of equal passages under an anchor
   the first stands for all, and the others go as a whole.
3. *Suffix sort.* What starts the windows of the different passages of a bucket are suffixes, sorted
   by a merge sort that takes all buckets of a shard in step. Two suffixes are compared by the
   length of their common extension, found by binary search over prefix polynomial hashes. Every
   pair of neighbours is then verified byte by byte; a bucket order that a collision has spoilt is
   sorted again by the bytes themselves. Suffixes with a common extension of a whole window are one
   string, of which the first place stays.
4. A bucket with over ``HOT`` different passages (a common line in many contexts) is cut in two by
   the place of the anchor in the window, with a longer common part as key for either half, again
   and again where needed; a half that is equal in many passages is one passage again.

``HOT`` and ``SHARD`` bound what a task holds; they do not change the result.

A null text is empty. A null id is larger than all others. Rows with equal ids are rows of their
own, one before the other by the hash of their texts; rows that are equal in both are the same row
twice, and each returns what it returns alone. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.tokens import chunks, mix
from tripline.session import discard, materialize

WINDOW = 100
GRAM = 32
#: Grams in a window, and so the places that an anchor can have in it.
PLACES = WINDOW - GRAM + 1
#: Different passages of a bucket that are sorted in one task.
HOT = 500
#: Passages that are sorted at a time.
SHARD = 20_000
#: Stands for a null id: larger than all others.
LAST = (1 << 63) - 1
#: An odd number: it has an inverse, so a prefix sum can be moved to any place.
BASE = 0x9E3779B97F4A7C15
#: Text bytes hashed at a time; one longer text is still taken whole.
_PART = 1 << 18
#: Neighbours verified at a time.
_PAIRS = 1 << 16


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


class Hashes:
    """Polynomial hashes of all ranges of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.data = data
        room = 1 << max(12, int(len(data)).bit_length())
        self.inverse = _powers(room, pow(BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            values = (data.astype(np.uint64) + np.uint64(1)) * _powers(room, BASE)[: len(data)]
            self.sums = np.append(np.uint64(0), np.cumsum(values))

    def of(self, begin: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[begin + size] - self.sums[begin]) * self.inverse[begin]

    def grams(self) -> np.ndarray:
        n = len(self.data) - GRAM + 1
        with np.errstate(over="ignore"):
            return mix((self.sums[GRAM:] - self.sums[:n]) * self.inverse[:n])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common extension of two suffixes, up to ``WINDOW``."""
        length = np.zeros(len(a), dtype=np.int64)
        step = 1 << (WINDOW.bit_length() - 1)
        with np.errstate(over="ignore"):
            shift_a, shift_b, from_a, from_b = self.inverse[a], self.inverse[b], self.sums[a], self.sums[b]
            while step:
                longer = np.minimum(length + step, WINDOW)
                same = (self.sums[a + longer] - from_a) * shift_a == (self.sums[b + longer] - from_b) * shift_b
                length = np.where(same, longer, length)
                step >>= 1
        return length


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array and where each text begins."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[bounds[0] : bounds[-1]] if values else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _least(grams: np.ndarray) -> np.ndarray:
    """The least gram of the window at each position."""
    out, span = grams, 1
    while span * 2 <= PLACES:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (PLACES - span)], out[PLACES - span :]) if span < PLACES else out


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, text, first window, number of windows, and place of the anchor in the first window,
    of each passage."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    grams = Hashes(data).grams()
    least = _least(grams)
    rows = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - WINDOW + 1, 0))
    counts = np.bincount(rows, minlength=len(bounds) - 1)
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[rows]
    if not len(starts):
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    value = least[starts]
    new = np.append(True, (value[1:] != value[:-1]) | (rows[1:] != rows[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    at, end = starts[first], starts[last]
    anchor = np.empty(len(at), dtype=np.int64)
    for begin in range(0, len(at), _PAIRS):
        part = at[begin : begin + _PAIRS]
        found = grams[part[:, None] + np.arange(PLACES)] == least[part][:, None]
        anchor[begin : begin + _PAIRS] = part + found.argmax(axis=1)
    # Windows that begin behind the anchor have the same gram at a later place.
    cut = np.flatnonzero(anchor < end)
    if len(cut):
        more_at, more_end, more_anchor, more_row = [], [], [], []
        for i in cut.tolist():
            places = np.flatnonzero(grams[at[i] : end[i] + PLACES] == value[first[i]]) + at[i]
            places = places[: int(np.searchsorted(places, end[i])) + 1]
            begins = np.append(at[i], places[:-1] + 1)
            more_at.append(begins)
            more_end.append(np.append(begins[1:] - 1, end[i]))
            more_anchor.append(places)
            more_row.append(np.full(len(begins), rows[first[i]]))
        keep = np.ones(len(at), dtype=bool)
        keep[cut] = False
        at, end = np.concatenate([at[keep], *more_at]), np.concatenate([end[keep], *more_end])
        anchor, row = np.concatenate([anchor[keep], *more_anchor]), np.concatenate([rows[first[keep]], *more_row])
    else:
        row = rows[first]
    return least[at], row, at, end - at + 1, anchor - at


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", _PART):
            keys, counts = np.unique(passages(*_bytes_of(part.column("text")))[0], return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "m"])


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    identity = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in chunks(batch, "text", _PART):
            data, bounds = _bytes_of(part.column("text"))
            keys, row, at, n, place = passages(data, bounds)
            raw = data.tobytes()
            whole = [identity(raw[s:e]) for s, e in zip(at.tolist(), (at + n + WINDOW - 1).tolist())]
            columns = {
                "key": pa.array(keys.view(np.int64)),
                "passage": pa.array(np.array(whole, dtype=np.uint64).view(np.int64)),
                "kid": part.column("kid").take(pa.array(row)),
                "text_hash": part.column("text_hash").take(pa.array(row)),
                "at": pa.array((at - bounds[row]).astype(np.int32)),
                "shape": pa.array((n * 128 + place).astype(np.int32)),
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))


_ROW = "key long, kid long, text_hash long, at int, shape int, text binary"


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the passages listed beside each text."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py().encode()
            wanted = batch.column("wanted")[i].values
            at, shape = (np.asarray(wanted.field(c)) for c in ("at", "shape"))
            texts = [text[s:e] for s, e in zip(at.tolist(), (at + (shape >> 7) + WINDOW - 1).tolist())]
            same = lambda c: pa.array(np.full(len(at), batch.column(c)[i].as_py(), dtype=np.int64))  # noqa: E731, B023
            columns = [wanted.field("key"), same("kid"), same("text_hash"), wanted.field("at"), wanted.field("shape"), pa.array(texts, pa.binary()), wanted.field("hot")]
            yield pa.record_batch(columns, names=["key", "kid", "text_hash", "at", "shape", "text", "hot"])


def _halves(level: int):
    """Passages cut by the place of the anchor, each part keyed by what all its windows share."""
    parts = 1 << level
    cuts = [-(-i * PLACES // parts) for i in range(parts + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, kid, text_hash, at, shape, text in zip(*(batch.column(c).to_pylist() for c in ("key", "kid", "text_hash", "at", "shape", "text"))):
                n, place = shape >> 7, shape & 127
                for i, (low, high) in enumerate(zip(cuts[:-1], (c - 1 for c in cuts[1:]))):
                    last, first = max(low, place - n + 1), min(high, place)
                    if last > first:
                        continue
                    shared = text[place - low : place - high + WINDOW]
                    own = xxhash.xxh3_64_intdigest(shared, i + (level << 8)) - (1 << 63)
                    part = text[place - first : place - last + WINDOW]
                    out.append((own, kid, text_hash, at + place - first, (first - last + 1) * 128 + first, part))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)]
            yield pa.record_batch(columns, names=["key", "kid", "text_hash", "at", "shape", "text"])

    return run


def _merged(hashes: Hashes, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stable merge sort of the suffixes in each bucket; all merges of a round go in step."""
    run, largest = 1, int(size.max(initial=1))
    while run < largest:
        pairs = -(-size // (2 * run))
        bucket = np.repeat(np.arange(len(size)), pairs)
        number = np.arange(len(bucket)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        begin = first[bucket] + number * 2 * run
        stop = first[bucket] + size[bucket]
        middle = np.minimum(begin + run, stop)
        end = np.minimum(middle + run, stop)
        out = order.copy()
        going = middle < end
        x, y, m, e = begin[going], middle[going], middle[going], end[going]
        to = x.copy()
        while len(x):
            a, b = order[x], order[y]
            length = hashes.common(a, b)
            inside = np.minimum(length, WINDOW - 1)
            left = (length >= WINDOW) | (hashes.data[a + inside] < hashes.data[b + inside])
            out[to] = np.where(left, a, b)
            x, y, to = x + left, y + ~left, to + 1
            ended = y == e
            if ended.any():
                # What is left of the first run moves behind the second.
                rest = (m - x)[ended]
                offset = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
                out[np.repeat(to[ended], rest) + offset] = order[np.repeat(x[ended], rest) + offset]
            open_ = ~ended & (x < m)
            x, y, m, e, to = x[open_], y[open_], m[open_], e[open_], to[open_]
        order = out
        run *= 2
    return order


def sorted_suffixes(data: np.ndarray, suffixes: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``suffixes``: begins of windows in ``data``; ``bucket``: ascending. The order of all
    suffixes in their buckets, equal ones as given, and which of them equals the one before."""
    new = np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(bucket)))
    # The sort moves suffixes; numbers of them follow from the place each one has.
    order = _merged(Hashes(data), suffixes, first, size)
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    same, spoilt = np.zeros(len(order), dtype=bool), np.zeros(len(first), dtype=bool)
    of = np.cumsum(new) - 1
    pairs = np.flatnonzero(~new)
    for begin in range(0, len(pairs), _PAIRS):
        at = pairs[begin : begin + _PAIRS]
        a, b = windows[order[at - 1]], windows[order[at]]
        differ = a != b
        any_ = differ.any(axis=1)
        same[at] = ~any_
        where = differ.argmax(axis=1)[:, None]
        falls = any_ & (np.take_along_axis(a, where, 1) > np.take_along_axis(b, where, 1)).ravel()
        spoilt[of[at[falls]]] = True
    for i in np.flatnonzero(spoilt).tolist():
        a, b = int(first[i]), int(first[i] + size[i])
        order[a:b] = sorted(suffixes[a:b].tolist(), key=lambda s: windows[s].tobytes())
        same[a + 1 : b] = [windows[x].tobytes() == windows[y].tobytes() for x, y in zip(order[a : b - 1], order[a + 1 : b])]
    return order, same


_MARKS = "kid long, text_hash long, at int, n int"


def _marks(kid, text_hash, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(kid), pa.array(text_hash), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.record_batch(columns, names=["kid", "text_hash", "at", "n"])


def shard_marks(rows: pa.Table) -> pa.RecordBatch:
    """Repeated windows in whole buckets, sorted by key, kid, text_hash and at."""
    keys, kid, text_hash, at, shape = (np.asarray(rows.column(c)) for c in ("key", "kid", "text_hash", "at", "shape"))
    again = np.append(False, (keys[1:] == keys[:-1]) & (kid[1:] == kid[:-1]) & (text_hash[1:] == text_hash[:-1]) & (at[1:] == at[:-1]))[: len(keys)]
    if again.any():
        return shard_marks(rows.filter(pa.array(~again)))
    if not len(keys):
        return _marks(kid, text_hash, at, at)
    texts = rows.column("text").combine_chunks().cast(pa.large_binary())
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[bounds[0] : bounds[-1]]
    n, place = shape >> 7, shape & 127
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    number = np.cumsum(np.append(True, keys[1:] != keys[:-1]))
    bucket = number[owner] * 128 + place[owner] - j
    # Stable: the suffixes of a bucket stay in the order of their rows.
    by_bucket = np.argsort(bucket, kind="stable")
    bucket = bucket[by_bucket]
    shared = np.append(bucket[1:] == bucket[:-1], False) | np.append(False, bucket[1:] == bucket[:-1])
    owner, j, bucket = owner[by_bucket][shared], j[by_bucket][shared], bucket[shared]
    begins = bounds[:-1][owner] - bounds[0] + j
    order, same = sorted_suffixes(data, begins, bucket)
    gone = np.sort(order[same])
    # Back from bytes to passages, and neighbours to one mark.
    of = np.searchsorted(bounds - bounds[0], gone, side="right") - 1
    first = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1) | (of[1:] != of[:-1]))[: len(gone)])
    length = np.diff(np.append(first, len(gone)))
    of = of[first]
    return _marks(kid[of], text_hash[of], at[of] + (gone[first] - (bounds[of] - bounds[0])), length)


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Shards end between keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > SHARD:
            rows = pa.Table.from_batches(held)
            keys = np.asarray(rows.column("key"))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield shard_marks(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield shard_marks(pa.Table.from_batches(held))


_PLACE = ("kid", "text_hash", "at")


def _firsts(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first of equal passages, as ``o``, and how many there are, as ``m``."""
    return rows.groupBy(*by).agg(F.min(F.struct(*_PLACE, "shape")).alias("o"), F.count("*").alias("m"))


def _others(rows: DataFrame, firsts: DataFrame, by: list[str]) -> DataFrame:
    """Marks of whole passages that another one stands for."""
    later = rows.join(firsts.where("m > 1").select(*by, "o"), by).where(F.struct(*_PLACE) != F.struct(*[f"o.{c}" for c in _PLACE]))
    return later.select(*_PLACE, F.shiftright("shape", 7).alias("n"))


def _several(firsts: DataFrame) -> DataFrame:
    """The first passages under keys that have different ones, and whether they are many."""
    sizes = firsts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", (F.col("c") > HOT).alias("hot"))
    return firsts.join(sizes, "key")


def repeated_windows(docs: DataFrame) -> list[DataFrame]:
    """``docs``: kid, text_hash, text. Written marks of all windows that repeat an earlier one: the
    ``n`` positions from ``at`` on. Other stages are deleted as soon as the next is written."""
    texts = docs.select("kid", "text_hash", "text")
    keys = docs.select("text").mapInArrow(_key_rows, "key long, m long")
    keys = materialize(keys.groupBy("key").agg(F.sum("m").alias("m")).where("m > 1").select("key"), "suffix-keys")
    rows = texts.mapInArrow(_passage_rows, "key long, passage long, kid long, text_hash long, at int, shape int")
    rows = materialize(rows.join(keys, "key"), "suffix-passages")
    discard(keys)
    firsts = materialize(_firsts(rows, ["key", "passage"]), "suffix-firsts")
    marks = [materialize(_others(rows, firsts, ["key", "passage"]), "suffix-marks")]
    discard(rows)
    wanted = _several(firsts).select("o.kid", "o.text_hash", F.struct("key", "o.at", "o.shape", "hot").alias("w"))
    wanted = materialize(wanted.groupBy("kid", "text_hash").agg(F.collect_list("w").alias("wanted")), "suffix-wanted")
    discard(firsts)
    known = texts.join(wanted, ["kid", "text_hash"])
    known = materialize(known.mapInArrow(_text_rows, f"{_ROW}, hot boolean"), "suffix-texts")
    discard(wanted)
    level, stages, few = 0, [known], [known.where("not hot").drop("hot")]
    while known.where("hot").limit(1).count():
        level += 1
        parts = materialize(known.where("hot").drop("hot").mapInArrow(_halves(level), _ROW), "suffix-parts")
        firsts = materialize(_firsts(parts, ["key", "text"]), "suffix-firsts")
        marks.append(materialize(_others(parts, firsts, ["key", "text"]), "suffix-marks"))
        discard(parts)
        many = (F.col("hot") & F.lit(1 << level < PLACES)).alias("hot")
        known = materialize(_several(firsts).select("key", *[f"o.{c}" for c in _PLACE], "o.shape", "text", many), "suffix-texts")
        discard(firsts)
        stages.append(known)
        few.append(known.where("not hot").drop("hot"))
    dealt = few[0]
    for more in few[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.repartition("key").sortWithinPartitions("key", *_PLACE)
    marks.append(materialize(dealt.mapInArrow(_sorted_rows, _MARKS), "suffix-marks"))
    discard(*stages)
    return marks


def _spans(size: int, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that marked windows cover."""
    order = np.argsort(at, kind="stable")
    begin, end = at[order].astype(np.int64), np.maximum.accumulate((at + n)[order].astype(np.int64) + WINDOW - 1)
    new = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(first) else first


_KEPT = "kid long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<begin:int,end:int>>"


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, digests, spans = [], [], [], []
        for text, marks in zip(batch.column("text"), batch.column("marks")):
            raw = (text.as_py() or "").encode()
            sizes.append(len(raw))
            if marks.values is None:
                removed.append(0)
                digests.append(hashlib.sha256(raw).hexdigest())
                spans.append([])
                continue
            begin, end = _spans(len(raw), *(np.asarray(marks.values.field(c)) for c in ("at", "n")))
            kept = hashlib.sha256()
            for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)]):
                kept.update(raw[a:b])
            removed.append(int((end - begin).sum()))
            digests.append(kept.hexdigest())
            spans.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        columns = [batch.column("kid"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)]
        yield pa.record_batch(columns, names=["kid", "n_bytes", "n_removed", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``kept_sha256`` and the removed ``spans`` (bytes,
    ends exclusive) of every row."""
    text = F.col(text_column).cast("string")
    given = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("kid"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    marks = repeated_windows(given)
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    grouped = every.groupBy("kid", "text_hash").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    grouped = materialize(grouped, "suffix-documents")
    discard(*marks)
    kept = given.join(grouped, ["kid", "text_hash"], "left").select("kid", "text", "marks").mapInArrow(_kept_rows, _KEPT)
    return kept.select(F.when(F.col("kid") != LAST, F.col("kid")).alias("doc_id"), "n_bytes", "n_removed", "kept_sha256", "spans")


def digest(docs: DataFrame) -> DataFrame:
    rows = remove_repeats(docs)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
