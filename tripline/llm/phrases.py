"""Repeated passages: every run of ``WINDOW`` words that starts in an earlier document, too.

A word is removed from a document if a window that covers it has the same words as a window
that starts in a document with a smaller id. Windows are judged on the input.

1. *Anchors.* A window's anchor is the least hash among its runs of ``GRAM`` words. Equal windows
   have equal anchors, and only about two windows in nine begin a new one. Anchors of at least
   two documents are kept; no other window can recur.
2. *Passages.* Runs of windows with one kept anchor, cut at ``PASSAGE`` windows, keyed by the
   anchor. They travel as hashes and places. Of equal passages the one of the first document stands
   for all: it stays, those of later documents are repeats as a whole.
3. *Automata.* Where different passages share an anchor, the text of the first of each is read. Keys
   are dealt out; in each task, shards of ``SHARD`` passages confirm which windows recur and
   compile those into an Aho-Corasick automaton over whole words. All passages of the shard stream
   through it, first documents first, and its matches tell where a window of an earlier
   document occurs. Where an anchor has over ``HOT`` different passages, their windows are keyed
   one by one by their words.
4. Marks go back to the documents, and covered words are left out.

What streams through the automata is the distinct passages, not the documents: anchors have
already told which stretches cannot match, and equal stretches match alike.

Keys and passage identities are 64-bit hashes; windows of different passages are compared word by word.

A null text has no words. A null id counts as larger than all others. Rows with equal ids are
one document: none of them repeats another. Repeated rows each return their own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.tokens import Words, chunks, mix, run_hashes, words_of
from tripline.session import discard, materialize

WINDOW = 13
GRAM = 6
PASSAGE = 12
#: Different passages that may share an anchor before their windows are keyed one by one.
HOT = 1_000
SHARD = 20_000
#: Stands for a null id: larger than all others.
LAST = (1 << 63) - 1


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of the window at each position (across text borders, too)."""
    grams = run_hashes(hashes, GRAM)
    width = WINDOW - GRAM + 1
    m = len(grams) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = grams[:m].copy()
    for k in range(1, width):
        np.minimum(out, grams[k : k + m], out=out)
    # A second mixing spreads the small values that minima are.
    return mix(out)


def _joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank after each, and where each begins and ends."""
    raw = w.data
    lengths = w.ends - w.starts
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    if len(ends):
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(begins, lengths) + at] = raw[np.repeat(w.starts, lengths) + at]
    return out.tobytes(), begins, ends - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            w = words_of(part.column("text"))
            starts, rows = w.valid(WINDOW), w.rows()
            anchors = window_anchors(w.hashes())[starts] if len(starts) else np.zeros(0, np.uint64)
            rows = rows[starts]
            order = np.lexsort((anchors, rows))
            anchors, rows = anchors[order], rows[order]
            new = np.ones(len(anchors), dtype=bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
            anchors, rows = anchors[new], rows[new]
            kid = np.asarray(part.column("kid"))[rows]
            yield pa.record_batch([pa.array(anchors.view(np.int64)), pa.array(kid)], names=["anchor", "kid"])


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            w = words_of(part.column("text"))
            starts = w.valid(WINDOW)
            if not len(starts):
                continue
            hashes = w.hashes()
            anchors, whole = window_anchors(hashes)[starts], run_hashes(hashes, WINDOW)
            rows = w.rows()[starts]
            # A passage ends where the text or the anchor changes.
            cut = np.append(True, (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1]))
            number = np.arange(len(starts))
            cut |= (number - np.maximum.accumulate(np.where(cut, number, 0))) % PASSAGE == 0
            at = np.flatnonzero(cut)
            n = np.diff(np.append(at, len(starts)))
            first, owner = starts[at], rows[at]
            with np.errstate(over="ignore"):
                # The first and the last window cover a passage of up to PASSAGE windows.
                identity = mix(whole[first] * np.uint64(31) + whole[first + n - 1] + n.astype(np.uint64))
            columns = {
                "key": pa.array(anchors[at].view(np.int64)),
                "passage": pa.array(identity.view(np.int64)),
                "kid": part.column("kid").take(pa.array(owner)),
                "text_hash": part.column("text_hash").take(pa.array(owner)),
                "at": pa.array((first - w.first[owner]).astype(np.int32)),
                "n": pa.array(n.astype(np.int32)),
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))


_TEXTS = "key long, passage long, least long, offset int, hot boolean, words string"


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the passages listed beside each text; those under hot keys window by window."""
    for batch in batches:
        for part in chunks(batch, "text"):
            text, begins, ends = _joined(w := words_of(part.column("text")))
            out = []
            for row, (kid, wanted) in enumerate(zip(part.column("kid").to_pylist(), part.column("wanted").to_pylist())):
                for p in wanted:
                    a = int(w.first[row]) + p["at"]
                    if not p["hot"]:
                        out.append((p["key"], p["passage"], kid, 0, False, text[begins[a] : ends[a + p["n"] + WINDOW - 2]]))
                        continue
                    out += [(p["key"], p["passage"], kid, j, True, text[begins[a + j] : ends[a + j + WINDOW - 1]]) for j in range(p["n"])]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)]
            columns[5] = columns[5].cast(pa.string())
            yield pa.record_batch(columns, names=["key", "passage", "least", "offset", "hot", "words"])


def locate(passages: list[str], least: list[int]) -> list[list[int]]:
    """For each passage the offsets of its windows that a passage of an earlier document holds.
    ``least``: the first document of each passage."""
    numbers: dict[str, int] = {}
    rows = [tuple(numbers.setdefault(x, len(numbers)) for x in p.split(" ")) for p in passages]
    seen, recurring = set(), set()
    for row in rows:
        for s in range(len(row) - WINDOW + 1):
            (recurring if (window := row[s : s + WINDOW]) in seen else seen).add(window)
    out: list[list[int]] = [[] for _ in rows]
    if not recurring:
        return out
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, window in enumerate(recurring):
        automaton.add_word(window, i)
    automaton.make_automaton()
    owners: list[int | None] = [None] * len(recurring)
    for at in sorted(range(len(rows)), key=least.__getitem__):
        for end, i in automaton.iter(rows[at]):
            if owners[i] is None:
                owners[i] = least[at]
            elif owners[i] < least[at]:
                out[at].append(end - WINDOW + 1)
    return out


_OFFSETS = "key long, passage long, offsets array<int>"


def _shard(rows: pa.Table) -> pa.RecordBatch:
    """Repeats in whole groups of one key, sorted by key. A passage of a text that is there twice
    comes twice and counts once: both have the same first document."""
    found = locate(rows.column("words").to_pylist(), rows.column("least").to_pylist())
    columns = [rows.column("key").combine_chunks(), rows.column("passage").combine_chunks(), pa.array(found, pa.list_(pa.int32()))]
    out = pa.record_batch(columns, names=["key", "passage", "offsets"])
    return out.filter(pc.greater(pc.list_value_length(out.column("offsets")), 0))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Shards end between keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > SHARD:
            rows = pa.Table.from_batches(held)
            keys = np.asarray(rows.column("key"))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield _shard(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield _shard(pa.Table.from_batches(held))


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and hashes of what is left. ``starts``: windows to remove, null for none."""
    for batch in batches:
        for part in chunks(batch, "text"):
            w = words_of(part.column("text"))
            text, begins, ends = _joined(w)
            removed, digests = [], []
            for row in range(part.num_rows):
                a, b = int(w.first[row]), int(w.first[row + 1])
                windows = part.column("starts")[row].values
                if windows is None or a == b:
                    removed.append(0)
                    digests.append(hashlib.sha256(text[begins[a] : ends[b - 1]] if b > a else b"").hexdigest())
                    continue
                edge = np.zeros(b - a + 1, dtype=np.int64)
                at = np.unique(np.asarray(windows))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.flatnonzero(~gone) + a
                parts = [text[s:e] for s, e in zip(begins[kept].tolist(), ends[kept].tolist())]
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            columns = [part.column("kid"), pa.array(w.counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch(columns, names=["kid", "n_words", "n_removed", "kept_sha256"])


_KEPT = "kid long, n_words long, n_removed long, kept_sha256 string"


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``docs``: kid, text_hash, text. ``starts`` of all windows to remove, per kid and text_hash.
    Stages are deleted as soon as the next is written."""
    anchors = docs.select("kid", "text").mapInArrow(_anchor_rows, "anchor long, kid long")
    kept = anchors.groupBy(F.col("anchor").alias("key")).agg(F.min("kid").alias("low"), F.max("kid").alias("high")).where("low < high").select("key")
    kept = materialize(kept, "phrase-anchors")
    rows = docs.select("kid", "text_hash", "text").mapInArrow(_passage_rows, "key long, passage long, kid long, text_hash long, at int, n int")
    rows = materialize(rows.join(kept, "key"), "phrase-places")
    discard(kept)
    firsts = rows.groupBy("key", "passage").agg(F.min(F.struct("kid", "text_hash", "at", "n")).alias("o"), F.max("kid").alias("high"))
    firsts = materialize(firsts, "phrase-firsts")
    sizes = firsts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", (F.col("c") > HOT).alias("hot"))
    wanted = firsts.join(sizes, "key").select("o.kid", "o.text_hash", F.struct("key", "passage", "o.at", "o.n", "hot").alias("w"))
    wanted = materialize(wanted.groupBy("kid", "text_hash").agg(F.collect_list("w").alias("wanted")), "phrase-wanted")
    texts = docs.select("kid", "text_hash", "text").join(wanted, ["kid", "text_hash"]).mapInArrow(_text_rows, _TEXTS)
    texts = materialize(texts, "phrase-texts")
    discard(wanted)
    dealt = texts.where("not hot").repartition("key").sortWithinPartitions("key")
    located = dealt.select("key", "passage", "least", "words").mapInArrow(_located, _OFFSETS)
    single = texts.where("hot").withColumn("own", F.xxhash64("words"))
    low = single.groupBy("own", "words").agg(F.min("least").alias("low"))
    single = single.join(low, ["own", "words"]).where("least > low").groupBy("key", "passage").agg(F.collect_set("offset").alias("offsets"))
    located = materialize(located.unionByName(single), "phrase-located").dropDuplicates(["key", "passage"])
    known = firsts.select("key", "passage", F.col("o.kid").alias("least"), "high").join(located, ["key", "passage"], "left")
    known = known.where("high > least or offsets is not null").drop("high")
    whole = F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)
    inside = F.transform("offsets", lambda o: o + F.col("at"))
    marks = rows.join(known, ["key", "passage"]).where("kid > least or offsets is not null")
    marks = marks.select("kid", "text_hash", F.when(F.col("kid") > F.col("least"), whole).otherwise(inside).alias("s"))
    starts = materialize(marks.groupBy("kid", "text_hash").agg(F.flatten(F.collect_list("s")).alias("starts")), "phrase-starts")
    discard(rows, firsts, texts)
    return starts


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row."""
    text = F.col(text_column).cast("string")
    given = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("kid"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    starts = repeated_windows(given)
    kept = given.join(starts, ["kid", "text_hash"], "left").select("kid", "text", "starts").mapInArrow(_kept_rows, _KEPT)
    return kept.select(F.when(F.col("kid") != LAST, F.col("kid")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
