"""Toxicity from a weighted finite-state grammar over clauses.

A *lexical transducer* turns words into symbols: insult, threat, intent, target, negation,
report, other. Its word lists are fixed; insults are joined by *learned* ones: words and word
beginnings that labelled toxic texts have and clean ones lack. Five *clause transducers* read a
clause's symbols side by side (their product, built state by state as it is needed):

* insult and threat: what is attacked with; a threat weighs more after an intent;
* target: whether the clause addresses someone;
* negation: what follows within ``NEGATION_SPAN`` symbols counts ``NEGATED``;
* reported speech: what follows in the clause counts ``REPORTED``.

A clause's matched weight falls into one of a few outcomes (addressed, unaddressed, damped,
threat, learned), the outcomes of a text are its features, and a logistic model fitted on a
bounded sample of ``FIT_ROWS`` labelled rows (never held-out ones) makes them a score. A word
scores by the outcome of its clause: a threat without a target not at all, anything negated or
reported less. An insult or learned word in a clause without a target has outcomes of its own
(unaddressed, learned), the weight of which the labels decide.

Null and empty texts have no clause and get the score of a text without matches. Rows are scored
alone; repeated rows score alike. Of several labels of one id the greater counts; labels without
an id or value are left out. Without labels a fixed model is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.llm.tokens import NOT_LETTERS, Words, chunks, words_of
from tripline.session import materialize

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, LEARNED = range(8)

# The word lists of the lexical transducer.
LEXICON = {
    INSULT: "idiot idiots moron morons imbecile stupid dumb fool fools loser losers scum trash garbage "
    "worthless pathetic disgusting clown clowns filth vermin pig pigs bastard bastards jerk creep "
    "freak coward liar scumbag dirtbag lowlife parasite useless repulsive vile ugly "
    "idiota imbécil estúpido basura asqueroso inútil payaso dummkopf idioten abschaum müll wertlos "
    "widerlich versager dumm connard imbécile ordure minable dégoûtant crétin",
    THREAT: "kill murder hurt destroy burn stab shoot beat strangle punch crush hunt attack smash die "
    "matar destruir quemar töten vernichten schlagen tuer détruire frapper brûler",
    INTENT: "will gonna shall going must should deserve deserves ought soon werde wirst vais vas voy",
    TARGET: "you your you're yourself u ur he she they them him her his their these those people everyone "
    "du dich dir deine ihr euch sie tu toi vous ton votre ils elles tú te ti usted ustedes ellos",
    NEGATION: "not no never none neither nor isn't aren't wasn't don't doesn't didn't won't can't hardly "
    "nicht kein keine nie pas jamais aucun ne nunca ningún jamás",
    REPORT: "said says wrote writes called calls claimed reported quoted according alleged sagte schrieb "
    "behauptete écrit appelé dijo escribió llamó",
}
#: Bytes that end a clause.
CLAUSE_END = np.zeros(256, dtype=bool)
CLAUSE_END[list(b'.,;:!?\n\r"()')] = True

NEGATION_SPAN = 3
NEGATED = 0.3
REPORTED = 0.5
WITH_INTENT = 2.0

#: Labelled rows that the lexicon and the model are fitted on, at most.
FIT_ROWS = 20_000
#: Beginnings of these many bytes are learned next to whole words.
PREFIXES = (5, 6, 7, 8, 9)
LEAST_TOXIC = 5
LEAST_SHARE = 0.8
THRESHOLD = 0.3
OUTCOMES = ("addressed", "unaddressed", "damped", "threat", "learned")
#: Weights of the features and the bias where there is nothing to learn from.
DEFAULT = (2.0, 1.5, 0.3, 2.0, 1.0, 1.0, -3.0)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


class Transducer:
    """``step``: (state, symbol) to (state, output); unlisted symbols keep the state."""

    def __init__(self, start, step):
        self.start, self.step = start, lru_cache(maxsize=None)(step)


def _negation(left, symbol):
    if symbol == NEGATION:
        return NEGATION_SPAN, 1.0
    return max(0, left - 1), NEGATED if left else 1.0


def _report(state, symbol):
    return (True, 1.0) if symbol == REPORT else (state, REPORTED if state else 1.0)


def _target(state, symbol):
    return state or symbol == TARGET, 1.0


def _threat(intent, symbol):
    if symbol == INTENT:
        return True, 0.0
    return intent, (WITH_INTENT if intent else 1.0) if symbol == THREAT else 0.0


def _insult(state, symbol):
    return state, 1.0 if symbol in (INSULT, LEARNED) else 0.0


class Grammar:
    """The product of the clause transducers."""

    def __init__(self):
        self.parts = [Transducer(0, _negation), Transducer(False, _report), Transducer(False, _target), Transducer(False, _threat), Transducer(None, _insult)]

    def read(self, symbols) -> dict[str, float]:
        """The outcomes of one clause."""
        states = [p.start for p in self.parts]
        plain = damped = threat = learned = 0.0
        for symbol in symbols:
            outputs = []
            for i, part in enumerate(self.parts):
                states[i], out = part.step(states[i], symbol)
                outputs.append(out)
            factor = outputs[0] * outputs[1]
            if factor < 1:
                damped += factor * (outputs[3] + outputs[4])
            elif symbol == LEARNED:
                learned += outputs[4]
            else:
                plain += outputs[4]
                threat += outputs[3]
        addressed = states[2]
        # A threat needs someone it is meant for.
        return {
            "addressed": plain if addressed else 0.0,
            "unaddressed": 0.0 if addressed else plain,
            "damped": damped,
            "threat": threat if addressed else 0.0,
            "learned": learned,
        }


class Lexicon:
    """Sorted hashes of words, and of learned words and beginnings."""

    def __init__(self, learned: dict[int, np.ndarray] | None = None):
        pairs = [(word, symbol) for symbol, text in LEXICON.items() for word in text.split()]
        hashes = words_of(pa.array([w for w, _ in pairs]), lower=True, gaps=NOT_LETTERS).hashes()
        order = np.argsort(hashes)
        self.hashes, self.symbols = hashes[order], np.array([s for _, s in pairs], dtype=np.int8)[order]
        #: By length of the beginning; 0 stands for whole words.
        self.learned = {n: np.sort(v) for n, v in (learned or {}).items() if len(v)}

    def read(self, w: Words) -> np.ndarray:
        out = np.zeros(len(w.starts), dtype=np.int8)
        if not len(out):
            return out
        hashes = w.hashes()
        for n, known in self.learned.items():
            own = hashes if n == 0 else w.prefix_hashes([n])[0]
            out[_member(known, own)] = LEARNED
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        out[hit] = self.symbols[at[hit]]
        return out


def _member(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def features(texts: pa.Array, lexicon: Lexicon, grammar: Grammar) -> np.ndarray:
    """One row per text: the damped sums of all outcomes, and how many clauses matched."""
    w = words_of(texts, lower=True, gaps=NOT_LETTERS)
    sums = np.zeros((len(texts), len(OUTCOMES) + 1))
    symbols = lexicon.read(w)
    if len(symbols):
        rows = w.rows()
        ended = np.append(0, np.cumsum(CLAUSE_END[w.data]))[w.starts]
        cut = np.ones(len(rows), dtype=bool)
        cut[1:] = (ended[1:] != ended[:-1]) | (rows[1:] != rows[:-1])
        clause = np.cumsum(cut) - 1
        begins = np.append(np.flatnonzero(cut), len(rows))
        matched = np.unique(clause[np.isin(symbols, (INSULT, THREAT, LEARNED))])
        for c in matched.tolist():
            a, b = begins[c], begins[c + 1]
            result = grammar.read(symbols[a:b].tolist())
            sums[rows[a], : len(OUTCOMES)] += [result[k] for k in OUTCOMES]
            sums[rows[a], len(OUTCOMES)] += 1
    return np.log1p(sums)


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts have each word or beginning."""
    for batch in batches:
        for part in chunks(batch, "text"):
            w = words_of(part.column("text"), lower=True, gaps=NOT_LETTERS)
            rows, toxic = w.rows().astype(np.uint64), np.asarray(part.column("toxic")) == 1
            for n, keys in zip((0, *PREFIXES), [w.hashes(), *w.prefix_hashes(list(PREFIXES))]):
                ok = keys != 0
                pairs = np.unique(np.stack([keys[ok], rows[ok]]), axis=1)
                found, first, count = np.unique(pairs[0], return_index=True, return_counts=True)
                bad = np.add.reduceat(toxic[pairs[1].astype(np.int64)].astype(np.int64), first) if len(first) else count
                columns = [pa.array(found.view(np.int64)), pa.array(np.full(len(found), n, np.int32)), pa.array(bad), pa.array(count - bad)]
                yield pa.record_batch(columns, names=["stem", "length", "toxic", "clean"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings that mark toxic texts in ``sample`` (text, toxic): all of them, by one
    grouped count over at most FIT_ROWS texts."""
    counted = sample.select("text", "toxic").mapInArrow(_stem_rows, "stem long, length int, toxic long, clean long")
    sums = counted.groupBy("stem", "length").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # One clean text is taken off: labels are not free of error.
    share = F.col("toxic") / (F.col("toxic") + F.greatest(F.col("clean") - 1, F.lit(0)))
    learned: dict[int, list[int]] = {}
    for r in sums.where((F.col("toxic") >= LEAST_TOXIC) & (share >= LEAST_SHARE)).collect():
        learned.setdefault(r["length"], []).append(r["stem"])
    return Lexicon({n: np.array(v, dtype=np.int64).view(np.uint64) for n, v in learned.items()})


def _feature_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        grammar = Grammar()
        for batch in batches:
            for part in chunks(batch, "text"):
                x = features(part.column("text"), lexicon, grammar)
                if weights is None:
                    values = pa.array(list(x), pa.list_(pa.float64()))
                else:
                    values = pa.array(1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]))))
                yield pa.record_batch([*(part.column(c) for c in part.schema.names if c != "text"), values], names=[*(c for c in part.schema.names if c != "text"), "value"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias; Newton steps on the penalized likelihood."""
    if len(np.unique(y)) < 2:
        return np.array(DEFAULT)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and model from at most ``FIT_ROWS`` labelled rows, chosen by a hash of their id."""
    spark = docs.sparkSession
    given = labels.where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id")))
    some = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    # At most FIT_ROWS rows of two numbers.
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic"), "toxic-sample")
    lexicon = learn_lexicon(sample)
    shared = spark.sparkContext.broadcast((lexicon, None))
    rows = sample.select("toxic", "text").mapInArrow(_feature_rows(shared), "toxic int, value array<double>").collect()
    x = np.array([r["value"] for r in rows]).reshape(len(rows), len(OUTCOMES) + 1)
    return lexicon, fit_logistic(x, np.array([r["toxic"] for r in rows], dtype=float))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``held_out``, ``score`` and ``predicted`` of every row."""
    text = F.col(text_column).cast("string")
    given = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(given, labels))
    kind = given.schema["doc_id"].dataType.simpleString()
    scored = given.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _feature_rows(shared), f"doc_id {kind}, text_hash long, value double"
    )
    return scored.select(
        "doc_id",
        "text_hash",
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("value").alias("score"),
        (F.col("value") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays under ``least``."""
    lexicon, weights = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        grammar = Grammar()
        for batch in batches:
            for part in chunks(batch, "text"):
                x = features(part.column("text"), known, grammar)
                keep = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) < least
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", "predicted")
