from __future__ import annotations

import re
from functools import lru_cache

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripline.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(truth)[order]
    ranks = np.array([(np.searchsorted(s, v) + np.searchsorted(s, v, "right") + 1) / 2 for v in s])
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    rows = t.digest(t.score(docs, labels)).collect()
    assert len(rows) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert auc([r.score for r in held], [toxic[r.doc_id] for r in held]) > 0.8


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(t.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, t.digest(t.score(docs, x)).collect())) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize(
    "text,outcome",
    [
        ("you are an idiot", {"addressed": 1.0}),
        ("what an idiot", {"unaddressed": 1.0}),
        ("you are not an idiot", {"damped": t.NEGATED}),
        ("he said you are scum", {"damped": t.REPORTED}),
        ("I will kill you", {"threat": t.WITH_INTENT}),
        ("the plan will kill time", {}),
        ("you win, what a clown. Not bad", {"unaddressed": 1.0}),
        ("not at all today you idiot", {"addressed": 1.0}),
    ],
)
def test_clauses(text, outcome):
    x = np.expm1(t.features(pa.array([text]), t.Lexicon(), t.Grammar())[0])
    got = {k: v for k, v in zip(t.OUTCOMES, np.round(x, 9)) if v}
    assert got == outcome


def test_odd_rows(spark):
    long = "you idiot " * 9000
    rows = [(1, None), (2, ""), (None, "you idiot"), (3, long), (4, "you idiot, you clown"), (4, "you idiot, you clown"), (5, "😀 \x0b é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit(1)).withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (None, 1), (1, None), (2, 0), (3, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        got = t.score(docs, given).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        plain = {r.score for r in got if r.doc_id in (1, 2)}
        assert len(plain) == 1 and plain.pop() < [r.score for r in got if r.doc_id == 4][0]
        kept = t.clean(docs, given)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 3, 4, 5, None}
    assert t.score(docs.limit(0), labels).collect() == []


def test_learned_beginnings(spark):
    bad, good = [f"zyrxq{i}ab word" for i in range(9)], [f"zyrwq{i}ab word" for i in range(60)]
    sample = spark.createDataFrame([(x, 1) for x in bad] + [(x, 0) for x in good], "text string, toxic int")
    x = t.features(pa.array(["zyrxq77 here", "zyrwq77 here"]), t.learn_lexicon(sample), t.Grammar())
    assert x[0][t.OUTCOMES.index("learned")] > 0 and not x[1][: len(t.OUTCOMES)].any()


def plain_outcomes(text, learned):
    """The features by words and loops. ``learned`` tells of a word whether it was learned."""
    lists = {w: symbol for symbol, words in t.LEXICON.items() for w in words.split()}
    sums = dict.fromkeys((*t.OUTCOMES, "clauses"), 0.0)
    for clause in re.split(r"[.,;:!?\n\r\"()]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        symbols = [lists.get(w, t.LEARNED if learned(w) else t.OTHER) for w in re.findall(r"['a-zA-Z\u0080-\U0010ffff]+", clause)]
        if not {t.INSULT, t.THREAT, t.LEARNED} & set(symbols):
            continue
        sums["clauses"] += 1
        addressed = t.TARGET in symbols
        for i, s in enumerate(symbols):
            weight = {t.INSULT: 1.0, t.LEARNED: 1.0, t.THREAT: t.WITH_INTENT if t.INTENT in symbols[:i] else 1.0}.get(s, 0.0)
            factor = t.NEGATED if t.NEGATION in symbols[max(0, i - t.NEGATION_SPAN) : i] else 1.0
            factor *= t.REPORTED if t.REPORT in symbols[:i] else 1.0
            if factor < 1:
                sums["damped"] += factor * weight
            elif s == t.LEARNED:
                sums["learned"] += weight
            elif s == t.THREAT:
                sums["threat"] += weight * addressed
            elif s == t.INSULT:
                sums["addressed" if addressed else "unaddressed"] += weight
    return np.log1p(list(sums.values()))


def test_scores_against_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    texts = docs.select("doc_id", "text")
    lexicon, weights = t.fit(texts, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    assert lexicon.learned

    @lru_cache(maxsize=None)
    def learned(word):
        w = t.words_of(pa.array([word]), lower=True, gaps=t.NOT_LETTERS)
        return any(len(h := (w.hashes() if n == 0 else w.prefix_hashes([n])[0])) and h[0] in known for n, known in lexicon.learned.items())

    got = {r.doc_id: r.score for r in t.score(docs, labels).collect()}
    for r in texts.collect():
        x = plain_outcomes(r.text, learned)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]))), rel=1e-9), r.doc_id
