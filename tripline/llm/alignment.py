"""Alignment of two tokenizations of one text, and how often token pairs end together.

A text is encoded twice, with a blank before it: by a byte-level BPE vocabulary (A) and by a piece
model with byte fallback (B). Tokens are ranges of the same bytes. A dictionary leads from the byte
offset where a token of A ends to the token's index; the offsets where tokens of B end, in order,
are looked up in it. Those in both are the places where the text can be cut for both sides at
once: they slice both id lists into groups.
The last tokens of the two slices of a group are the only ones whose ranges end together: they are
its link.

Counts of linked id pairs over the corpus are one grouped sum over the distinct pairs of each
text, combined before the shuffle, so that a pair that every text holds is no hot group. They go
back to the texts by look-up: the ``LOOKUP`` most frequent pairs are broadcast, the others are
joined. ``LOOKUP`` changes which way a pair takes, never the result.

Encoding is that of the vocabulary file in json. Texts of characters whose classes have never
changed between Unicode versions take a faster encoder over the same vocabulary, if the file's
merges are in the order of its ids.

Null and empty texts have no tokens, nor have texts that either side does not give back byte for
byte: zeros and an empty string. All texts of a part are compared in one step. Nothing is cut,
however long the text. Repeated rows and rows with equal or null ids each count and return their
own row. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.tokens import chunks
from tripline.session import materialize

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how a byte-level vocabulary divides a text before merging.
DIVISION = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of unchanged class.
_SETTLED = re.compile("[\x00-ȟ]*")
#: Text bytes encoded at a time; one longer text is still taken whole.
_PART = 1 << 16
#: Pairs that may be broadcast, about 40 bytes each.
LOOKUP = 4_000_000
#: B ids are below this, so that a pair is one int.
_WIDTH = 1 << 15


def _byte_values() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both encoders, and the bytes and sizes of every token."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        path = os.path.join(folder, A_FILE)
        self._full = Tokenizer.from_file(path)
        self._full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        values = _byte_values()
        tokens = {bytes(values[c] for c in t): i for t, i in model["vocab"].items() if all(c in values for c in t)}
        self.a = [b""] * (max(model["vocab"].values()) + 1)
        for t, i in tokens.items():
            self.a[i] = t
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ranks = [model["vocab"][m] for m in merged]
        self._fast = None
        if ranks == list(range(256, 256 + len(ranks))):
            import tiktoken

            mergeable = {t: i for t, i in tokens.items() if i < 256 + len(ranks)}
            self._fast = tiktoken.Encoding("settled", pat_str=DIVISION, mergeable_ranks=mergeable, special_tokens={})
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        self.b = []
        for i in range(self._pieces.get_piece_size()):
            piece = self._pieces.id_to_piece(i)
            self.b.append(bytes([int(piece[3:5], 16)]) if self._pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes = np.array([len(t) for t in self.a], dtype=np.int64)
        self.b_sizes = np.array([len(t) for t in self.b], dtype=np.int64)
        #: The bytes of all tokens one behind the other.
        self.a_bytes, self.b_bytes = (np.frombuffer(b"".join(x), dtype=np.uint8) for x in (self.a, self.b))
        #: The name of each id as it stands inside and at the end of its slice of a group.
        self.names = np.array([f"{i}{c}" for i in range(len(self.a)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b)) for c in ",;"], dtype="S")

    def encode_a(self, text: str) -> np.ndarray:
        if self._fast is not None and _SETTLED.fullmatch(text):
            return self._fast.encode_to_numpy(text)
        return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def vocabularies(folder: str) -> Vocabularies:
    """Loaded once in each worker."""
    return Vocabularies(folder)


def common_cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side lie before each place where tokens of both end. Ends ascend,
    so one side's are looked up in the other's dictionary in the order of the cuts."""
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1)))
    found = np.fromiter(map(a_at.get, b_ends.tolist(), repeat(0)), np.int64, len(b_ends))
    y = np.flatnonzero(found)
    return found[y], y + 1


_NUMBERS = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>"
_LISTS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


def _given_back(tokens: np.ndarray, sizes: np.ndarray, ids: np.ndarray, begins: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray) -> np.ndarray:
    """Which texts are the bytes of their ids. ``tokens``: the bytes of all ids, each of its size."""
    spans = sizes[ids]
    fits = np.diff(np.append(0, np.cumsum(spans))[begins]) == raw_sizes
    # Those of the right size are compared byte by byte.
    compared = np.repeat(fits, np.diff(begins))
    ids, spans = ids[compared], spans[compared]
    shift = (np.cumsum(sizes) - sizes)[ids] - (np.cumsum(spans) - spans)
    differ = tokens[np.arange(spans.sum()) + np.repeat(shift, spans)] != raw[np.repeat(fits, raw_sizes)]
    fits[np.repeat(np.flatnonzero(fits), raw_sizes[fits])[differ]] = False
    return fits


def _encoded(v: Vocabularies, texts: list[str]) -> tuple[np.ndarray, ...]:
    """The ids of both sides of all texts, and where each text's ids begin."""
    wholes = [b" " + t.encode() for t in texts]
    raw, raw_sizes = np.frombuffer(b"".join(wholes), dtype=np.uint8), np.array(list(map(len, wholes)))
    a, b = [v.encode_a(" " + t) if t else np.zeros(0, np.uint32) for t in texts], v.encode_b(texts)
    n_a, n_b = (np.array(list(map(len, x))) for x in (a, b))
    a, b = np.concatenate(a).astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
    begins = [np.append(0, np.cumsum(n)) for n in (n_a, n_b)]
    fits = _given_back(v.a_bytes, v.a_sizes, a, begins[0], raw, raw_sizes) & _given_back(v.b_bytes, v.b_sizes, b, begins[1], raw, raw_sizes)
    if not fits.all():
        a, b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
        begins = [np.append(0, np.cumsum(n * fits)) for n in (n_a, n_b)]
    return a, b, *begins


def _digests(v: Vocabularies, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, begins: np.ndarray) -> list[str]:
    """Hashes of ``a1,a2|b1;a3|b2,b3`` (the slices of both id lists between cuts) of each text."""
    a_sizes, b_sizes = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    # Every id's place among all, and after it the mark that ends its slice or goes on with it.
    out = np.empty(len(a) + len(b), dtype=np.int64)
    out[np.arange(len(a)) + np.repeat(b_cuts - b_sizes, a_sizes)] = a * 2
    out[np.arange(len(b)) + np.repeat(a_cuts, b_sizes)] = len(v.a) * 2 + b * 2
    out[a_cuts + b_cuts - b_sizes - 1] += 1
    out[a_cuts + b_cuts - 1] += 1
    names, width = v.names[out].tobytes(), v.names.itemsize
    parts = [names[i * width : j * width].translate(None, b"\0")[:-1] for i, j in zip(begins[:-1].tolist(), begins[1:].tolist())]
    return [hashlib.sha256(p).hexdigest() if p else "" for p in parts]


def _list_array(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _aligned(folder: str, lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(folder)
        for batch in batches:
            for part in chunks(batch, "text", _PART):
                # The texts of a part stand one behind the other; where one ends, both sides end.
                a, b, a_begins, b_begins = _encoded(v, [t or "" for t in part.column("text").to_pylist()])
                x, y = common_cuts(np.cumsum(v.a_sizes[a]), np.cumsum(v.b_sizes[b]))
                row = np.searchsorted(a_begins, x - 1, side="right") - 1
                # A row and a pair in one number; sorted, those of a row are next to each other.
                found, times = np.unique(row << 31 | a[x - 1] * _WIDTH + b[y - 1], return_counts=True)
                n, sizes = (np.bincount(r, minlength=part.num_rows) for r in (row, found >> 31))
                columns = {"row": part.column("row"), "doc_id": part.column("doc_id")}
                columns |= {"n_a": pa.array(np.diff(a_begins)), "n_b": pa.array(np.diff(b_begins)), "n_groups": pa.array(n)}
                columns["groups_sha256"] = pa.array(_digests(v, a, b, x, y, a_begins + b_begins), pa.string())
                columns |= {"pairs": _list_array(found & (1 << 31) - 1, sizes), "times": _list_array(times, sizes)}
                if lists:
                    columns |= {"a_ids": _list_array(a, np.diff(a_begins)), "b_ids": _list_array(b, np.diff(b_begins))}
                    columns |= {"a_cuts": _list_array(x - a_begins[row], n), "b_cuts": _list_array(y - b_begins[row], n)}
                yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def align(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, lists: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a number of its own), ``doc_id``, ``n_a``, ``n_b``,
    ``n_groups``, ``groups_sha256``, and the linked id pairs (A id * 32768 + B id) with how often
    each is linked. ``lists`` adds both id lists and, per group, how many ids of either list end
    with it. ``folder`` must be there on all executors."""
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    given = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    extra = f", {_LISTS}" if lists else ""
    return given.mapInArrow(_aligned(folder, lists), f"row long, doc_id long, {_NUMBERS}{extra}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, its ``links`` over the corpus, and whether no other A id has more with its B id
    (``is_best``)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum(F.col("times").cast("long")).alias("links"))
    counts = materialize(counts, "align-counts")
    b = F.col("pair").bitwiseAND(F.lit(_WIDTH - 1))
    # One row for each B id: no more than the vocabulary has.
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("is_best"))


def _looked_up(each: DataFrame, counts: DataFrame) -> DataFrame:
    """Partial sums per row of row, pair, times, for the pairs that ``counts`` holds."""
    found = each.join(counts, "pair")
    best = F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best")
    return found.groupBy("row").agg(best, F.sum(F.col("times") * F.col("links")).alias("count_sum"))


def with_pair_counts(aligned: DataFrame) -> DataFrame:
    """Written rows of ``align`` with ``n_links``, ``n_best`` and ``count_sum``."""
    counts = materialize(pair_counts(aligned), "align-pairs")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    n = counts.count()
    if n <= LOOKUP:
        sums = _looked_up(each, F.broadcast(counts))
    else:
        # Over this count there are no more than LOOKUP pairs; what is left is seldom met.
        over = counts.agg(F.percentile("links", 1 - LOOKUP / n)).first()[0]
        often, seldom = counts.where(F.col("links") > over), counts.where(F.col("links") <= over)
        rest = each.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        both = _looked_up(each, F.broadcast(often)).unionByName(_looked_up(rest, seldom))
        sums = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = aligned.drop("pairs", "times").join(sums, "row", "left")
    return joined.select("*", F.col("n_groups").alias("n_links")).withColumns({c: zero(c) for c in ("n_best", "count_sum")})


def digest(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    aligned = materialize(align(docs, folder=folder), "align-rows")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return with_pair_counts(aligned).select(*names)
