from __future__ import annotations

import math
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from tripline.llm import suffix_tree

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*brute.words(brute.lower(text)), None]


def brute_base(rows):
    held = [brute.crc("null" if d is None else d) % 10 == 0 for d, _ in rows]
    c = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for (d, x), h in zip(rows, held):
        t = tokens(x)
        out.append((d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)))
    return out, c


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, _ = brute_base(rows)
    got = suffix_tree.score(docs).collect()
    key = lambda r: (repr(r[:5]), round(r[5], 6))
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    return got


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    held = [r for r in got if r.held_out]
    gain = lambda rows: sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert held and gain(held) > 0.01


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "A b a B", "É é", "a b " * 9000, "a b a b c"])] + [(None, "a b"), (None, None), (3, "A b a B"), (3, "A b a B"), (9, "new words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    check(docs)
    assert suffix_tree.score(docs.limit(0)).collect() == []
    alone = spark.createDataFrame([(d, "x y") for d in range(2000) if brute.crc(d) % 10 == 0][:3], "doc_id long, text string")
    assert [(r.n_known, r.train_tokens, r.base_score) for r in suffix_tree.score(alone).collect()] == [(0, 0, 0.0)] * 3


def plain_tree(texts):
    """Counts of all runs, and the states by their definition; tokens are words, None the end."""
    t = suffix_tree
    rows = [tokens(x) for x in texts]
    runs = Counter(tuple(w[i : i + k]) for w in rows for k in range(1, t.DEPTH + 2) for i in range(len(w) - k + 1))
    total = sum(map(len, rows))
    distinct = sum(len(r) == 1 for r in runs)
    follower, context = (max(t.LEAST, x * total ** (2 / 3)) for x in (t.FOLLOWER, t.CONTEXT))
    root = lambda w: (runs[w,] + t.A) / (total + t.A * (distinct + 1))
    often = lambda w: runs[w,] >= follower
    states = {}

    def predict(path, w):
        for k in range(len(path) + 1):
            if path[k:] in states:
                kept, rest = states[path[k:]]
                return kept[w] if w in kept else rest * predict(path[k + 1 :], w)
        return root(w)

    for depth in range(1, t.DEPTH + 1):
        found = {}
        for path in [r for r in runs if len(r) == depth and runs[r] >= context and all(map(often, r))]:
            kept = {r[-1]: (n - t.DISCOUNT) / runs[path] for r, n in runs.items() if len(r) == depth + 1 and r[:-1] == path and n >= follower and often(r[-1])}
            below = {w: predict(path[1:], w) for w in kept}
            mass, suffix = sum(kept.values()), sum(below.values())
            if kept and mass < 1 and suffix < 1:
                diverges = sum(p * math.log(p / below[w]) for w, p in kept.items()) + (1 - mass) * math.log((1 - mass) / (1 - suffix))
                if diverges >= t.DIVERGENCE:
                    found[path] = (kept, (1 - mass) / (1 - suffix))
        states |= found
    return predict, states, sorted({w for r in runs if len(r) == 1 for w in r}, key=repr), root


def sentences(n):
    rng = random.Random(2)
    grammar = {"the": "cat dog mat big", "big": "cat dog", "cat": "sat ran and", "dog": "sat ran and", "sat": "on the", "ran": "to the", "on": "the", "to": "the", "mat": "and the", "and": "the"}
    out = []
    for i in range(n):
        words = ["the"]
        while len(words) < 60:
            words.append(rng.choice(grammar.get(words[-1], "the").split()))
        out.append((i, " ".join([*words, f"r{i}"])))
    return out


def test_scores_against_a_plain_tree(spark):
    rows = sentences(120)
    predict, states, _, _ = plain_tree([x for d, x in rows if brute.crc(d) % 10])
    assert {len(s) for s in states} == set(range(1, suffix_tree.DEPTH + 1))
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, x in rows:
        w = tokens(x)
        want = sum(math.log10(predict(tuple(w[max(0, i - suffix_tree.DEPTH) : i]), w[i])) for i in range(len(w)))
        assert got[d] == pytest.approx(want, rel=1e-9)


def test_states_sum_to_one(spark):
    """The distribution after any context, with the rest of the mass on an unknown word."""
    rows = [x for _, x in sentences(60)]
    predict, states, words, _ = plain_tree(rows)
    total = sum(len(tokens(x)) for x in rows)
    unknown = suffix_tree.A / (total + suffix_tree.A * (len(words) + 1))
    _, tree, _ = suffix_tree.fit(spark.createDataFrame([(x,) for x in rows], "text string"))
    assert sum(len(level[0]) for level in tree.levels) == len(states) > 5
    for path in [*states, ("the", "no"), ("cat", "mat", "big")]:
        p = sum(predict(path, w) for w in words)
        rest = 1.0
        for k in range(len(path)):
            if path[k:] in states:
                rest *= states[path[k:]][1]
        assert p + unknown * rest == pytest.approx(1.0, abs=1e-9)


def test_the_tree_grows_with_the_corpus(spark):
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        _, tree, _ = suffix_tree.fit(docs.select("text"))
        sizes.append((len(tree.tokens), sum(len(level[2]) for level in tree.levels)))
    assert sizes[0][0] < sizes[1][0] and sizes[0][1] < sizes[1][1]
