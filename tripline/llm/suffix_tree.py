"""Language-model scores from a probabilistic suffix tree over words.

Tokens are lower-cased (A-Z) words and one end per text. The root gives token t the smoothed
probability (c + A) / (N + A * (V + 1)). A deeper state is a context of one to ``DEPTH`` tokens
with at least ``CONTEXT`` * N ** (2/3) occurrences (and ``LEAST``). A context is grown only from
contexts and followers that are frequent themselves (a longer run cannot be more frequent than
its parts), its counts are taken over the whole corpus, and it is *retained only if its followers
diverge* from what its suffix predicts: the divergence, weighted by the followers kept, must
reach ``DIVERGENCE``. Followers with at least ``FOLLOWER`` * N ** (2/3) occurrences are kept with
``DISCOUNT`` less each; all other tokens share the rest as the suffix state predicts them, so
every state sums to one. A text is scored with the longest suffix state at each token.

The bounds are one law for every size. The tree grows with the corpus, as its third root: a level
has at most N ** (1/3) / FOLLOWER followers (21.5 million, 345 MB, for 10 ** 13 tokens; the given
tables reach a tenth of that), which is what each task holds. Contexts and followers are counted together, by one grouped count a level.

So the score of a text is its root score plus adjustments that depend on frequent tokens alone.
Frequent tokens are counted in place; rare ones meet their counts in a join by 64-bit hash of the
word.

Null texts are empty: just the end. Rows with equal id and text are scored alike; null ids are
kept and count as training texts (the checksum of nothing decides as for the text "null").
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.llm.tokens import Words, chunks, mix, run_hashes, words_of
from tripline.session import materialize

A = 0.1
DEPTH = 3
CONTEXT = 0.001
FOLLOWER = 0.001
#: Fewer occurrences than this say nothing of what follows.
LEAST = 5
DISCOUNT = 0.75
DIVERGENCE = 0.003
#: Distinct keys a task gathers before it passes its counts on.
GATHER = 1_000_000
#: The end token; words hash to it with probability 2 ** -64.
END = 0x5851F42D4C957F2D


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 10 == 0


def _with_ends(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and where each text begins."""
    n = len(w.first) - 1
    out = np.full(len(w.starts) + n, END, dtype=np.uint64)
    out[np.arange(len(w.starts)) + w.rows()] = w.hashes()
    return out, w.first + np.arange(n + 1)


def _positions(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted table, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


class _Gathered:
    """Counts by key (one column or several), passed on when many keys have come together."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, [], 0

    def add(self, *keys: np.ndarray) -> None:
        self.parts.append((*_counted(keys, np.ones(len(keys[0]), np.int64)),))
        self.size += len(self.parts[-1][0])

    def batch(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.parts)] if self.parts else [np.zeros(0, np.uint64)] * len(self.names) + [np.zeros(0, np.int64)]
        *keys, n = _counted(columns[:-1], columns[-1])
        self.parts, self.size = [], 0
        return pa.record_batch([*(pa.array(k.view(np.int64)) for k in keys), pa.array(n)], names=[*self.names, "n"])


def _counted(keys, n: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and their summed counts."""
    order = np.lexsort(keys)
    keys, n = [k[order] for k in keys], n[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), np.add.reduceat(n, at) if len(at) else n]


def _counting(keys_of, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(names)
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                gathered.add(*keys_of(*_with_ends(words_of(part.column("text"), lower=True))))
                if gathered.size > GATHER:
                    yield gathered.batch()
        yield gathered.batch()

    return run


def _runs(tokens: np.ndarray, first: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray:
    """Start positions of runs of ``n`` frequent tokens inside one text."""
    ok = _positions(frequent, tokens) >= 0
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    good = ok[:m].copy()
    for k in range(1, n):
        good &= ok[k : k + m]
    left = np.repeat(first[1:], np.diff(first))[:m] - np.arange(m)
    return np.flatnonzero(good & (left >= n))


def run_key(tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The key of the run of ``n`` tokens at each start."""
    return run_hashes(tokens, n)[starts] if n > 1 else tokens[starts]


def path_keys(paths: np.ndarray) -> np.ndarray:
    """The run key of each row of tokens."""
    return run_hashes(paths.ravel(), paths.shape[1])[:: paths.shape[1]] if paths.shape[1] > 1 else paths[:, 0].copy()


def _counts(df: DataFrame, keys_of, names: tuple[str, ...] = ("key",)) -> DataFrame:
    names = list(names)
    emitted = df.mapInArrow(_counting(keys_of, names), ", ".join(f"{n} long" for n in names) + ", n long")
    return emitted.groupBy(*names).agg(F.sum("n").alias("n"))


def _taken(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table bounded by the caller; keys are unsigned."""
    table = df.select(*names).toPandas()
    return [table[n].to_numpy(np.int64).view(np.uint64 if n != "n" else np.int64) for n in names]


class Tree:
    """The root over frequent tokens, and the retained states of each length: sorted context keys
    with the rest's share, sorted run keys with the follower's log probability less the root's."""

    def __init__(self, total: int, distinct: int):
        self.total = total
        self.smooth = total + A * (distinct + 1)
        self.follower = max(LEAST, FOLLOWER * total ** (2 / 3))
        self.context = max(LEAST, CONTEXT * total ** (2 / 3))
        self.tokens, self.root = np.zeros(0, np.uint64), np.zeros(0)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def set_root(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.root = tokens[order], np.log10((counts[order] + A) / self.smooth)

    def predict(self, runs: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last token of each row after the others."""
        width = runs.shape[1]
        gain = adjustments(runs.ravel(), np.arange(len(runs) + 1) * width, self.levels)[width - 1 :: width]
        return self.root[_positions(self.tokens, runs[:, -1])] + gain

    def grow(self, paths: np.ndarray, sizes: np.ndarray, of: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Adds the level of the contexts ``paths`` (rows of tokens), which occur ``sizes`` times;
        the context ``of`` is followed by ``tokens`` ``counts`` times."""
        p = (counts - DISCOUNT) / sizes[of]
        runs = np.column_stack([paths[of], tokens])
        below = 10 ** self.predict(runs[:, 1:])
        total = lambda x: np.bincount(of, weights=x, minlength=len(paths))
        mass, suffix = total(p), total(below)
        kept = (np.bincount(of, minlength=len(paths)) > 0) & (mass < 1) & (suffix < 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = (1 - mass) / (1 - suffix)
            kept &= total(p * np.log(p / below)) + (1 - mass) * np.log(rest) >= DIVERGENCE
        mine = kept[of]
        keys, run_keys = path_keys(paths[kept]), path_keys(runs[mine])
        gains = np.log10(p[mine]) - self.root[_positions(self.tokens, tokens[mine])]
        k, r = np.argsort(keys), np.argsort(run_keys)
        self.levels.append((keys[k], np.log10(rest[kept])[k], run_keys[r], gains[r]))


def adjustments(tokens: np.ndarray, first: np.ndarray, compiled) -> np.ndarray:
    """What the longest suffix state adds to the root's log10 probability of each token."""
    out = np.zeros(len(tokens))
    since = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    # From short to long contexts: a longer state's follower replaces everything below it,
    # its rest share comes on top of what the shorter suffix predicts.
    for depth, (keys, rests, runs, gains) in enumerate(compiled, 1):
        at = np.flatnonzero(since >= depth)
        if not len(at) or not len(keys):
            continue
        state = _positions(keys, run_key(tokens, at - depth, depth))
        at, state = at[state >= 0], state[state >= 0]
        if not len(at):
            continue
        hit = _positions(runs, run_key(tokens, at - depth, depth + 1))
        out[at] = np.where(hit >= 0, gains[hit] if len(gains) else 0.0, out[at] + rests[state])
    return out


def fit(training: DataFrame) -> tuple[DataFrame, Tree, int]:
    """``training``: text. Returns token counts (key, n), the tree, and the number of tokens."""
    counts = materialize(_counts(training, lambda tokens, first: (tokens,)), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = Tree(total, distinct)
    tokens, n = _taken(counts.where(F.col("n") >= F.lit(float(tree.follower))), "key", "n")
    tree.set_root(tokens, n)
    often = n >= tree.context
    paths, sizes = tokens[often][:, None], n[often]
    for depth in range(1, DEPTH + 1):
        if not len(paths):
            break
        order = np.argsort(path_keys(paths))
        paths, sizes = paths[order], sizes[order]
        keys = path_keys(paths)
        shared = training.sparkSession.sparkContext.broadcast((keys, tree.tokens))

        def keys_of(t, first, depth=depth, shared=shared):
            """Frequent contexts of this length, each with a frequent follower."""
            known, followers = shared.value
            starts = _runs(t, first, depth + 1, followers)
            context = run_key(t, starts, depth)
            inside = _positions(known, context) >= 0
            return context[inside], t[starts[inside] + depth]

        pairs = _counts(training, keys_of, ("context", "token")).where(F.col("n") >= F.lit(float(tree.follower)))
        context, token, n = _taken(pairs, "context", "token", "n")
        of = _positions(keys, context)
        tree.grow(paths, sizes, of, token, n)
        often = n >= tree.context
        paths, sizes = np.column_stack([paths[of[often]], token[often]]), n[often]
    return counts, tree, total


def _own_scores(shared):
    """Per text: tokens, and the score of frequent tokens under root and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, root, compiled = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                tokens, first = _with_ends(words_of(part.column("text"), lower=True))
                at = _positions(frequent, tokens)
                known = at >= 0
                base = np.where(known, root[at] if len(root) else 0.0, 0.0)
                gain = adjustments(tokens, first, compiled)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, gain)]
                columns = [part.column("doc_id"), part.column("text_hash"), part.column("held_out"), pa.array(np.diff(first)), *map(pa.array, sums)]
                names = ["doc_id", "text_hash", "held_out", "n_tokens", "known", "base", "gain"]
                yield pa.record_batch(columns, names=names)

    return run


def _rare_rows(shared):
    """Distinct rare words of each text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, _, _ = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                tokens, first = _with_ends(words_of(part.column("text"), lower=True))
                rare = np.flatnonzero(_positions(frequent, tokens) < 0)
                rows = np.repeat(np.arange(part.num_rows), np.diff(first))[rare]
                keys = tokens[rare]
                order = np.lexsort((keys, rows))
                keys, rows = keys[order], rows[order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(new)
                row_key = np.asarray(part.column("row_key"))[rows[at]]
                times = np.diff(np.append(at, len(keys))).astype(np.int32)
                yield pa.record_batch([pa.array(keys[at].view(np.int64)), pa.array(row_key), pa.array(times)], names=["key", "row_key", "times"])

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10) of every row; learns from the rows not held out."""
    text = F.col(text_column).cast("string")
    given = docs.select(
        F.col(id_column).alias("doc_id"), is_held_out(F.col(id_column)).alias("held_out"),
        F.xxhash64(text).alias("text_hash"), text.alias("text"),
    )
    counts, tree, total = fit(given.where("not held_out").select("text"))
    shared = docs.sparkSession.sparkContext.broadcast((tree.tokens, tree.root, tree.levels))
    kind = given.schema["doc_id"].dataType.simpleString()
    own = given.mapInArrow(
        _own_scores(shared),
        f"doc_id {kind}, text_hash long, held_out boolean, n_tokens long, known long, base double, gain double",
    )
    keyed = given.select(F.xxhash64("doc_id", "text_hash").alias("row_key"), "text")
    rare = keyed.mapInArrow(_rare_rows(shared), "key long, row_key long, times int")
    found = rare.join(counts.where(F.col("n") < F.lit(float(tree.follower))), "key", "left")
    worth = F.log10((F.coalesce("n", F.lit(0)) + A) / F.lit(float(tree.smooth)))
    sums = found.groupBy("row_key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * worth).alias("rare_base"),
        F.sum("times").alias("rare_tokens"),
    )
    own = own.withColumn("row_key", F.xxhash64("doc_id", "text_hash"))
    joined = own.join(sums, "row_key", "left")
    # Rows of equal id and text share one key: each takes its part.
    share = F.coalesce(F.try_divide(F.col("n_tokens") - F.col("known"), F.col("rare_tokens")), F.lit(0.0))
    base = F.col("base") + F.coalesce(F.col("rare_base") * share, F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("rare_known") * share), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain")).alias("score"),
    )
