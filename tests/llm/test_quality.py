from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_toxicity import auc

from tripline.llm import quality as q

SF = "/root/testdata/sf0.01"


def bins(text):
    text = text or ""
    w, lines = brute.words(text), [x for x in text.split("\n") if x]
    cat = [unicodedata.category(c) for c in text]
    letters = sum(c[0] == "L" for c in cat)
    plain = sum(c[0] in "LN" or x in " \t\n\x0b\f\r" for c, x in zip(cat, text))
    share = lambda a, b: a / b if b else 0.0
    values = {
        "words": len(w), "symbols": share(len(text) - plain, len(text)), "capitals": share(cat.count("Lu"), letters),
        "digits": share(len(re.findall("[0-9]", text)), len(text)), "word_length": share(sum(map(len, w)), len(w)),
        "distinct": share(len(set(w)), len(w)), "distinct_lines": share(len(set(lines)), len(lines)),
    }
    return [next((i for i, b in enumerate(q.BINS[k]) if values[k] <= b), len(q.BINS[k])) for k in q.BINS]


def worth(groups, share):
    """groups: (n, good, prior)."""
    g = [(n, k / n, share(p)) for n, k, p in groups if n > 1]
    if not g:
        return q.MOST_WORTH
    weight = sum(n - 1 for n, _, _ in g)
    between = sum((n - 1) * ((o - p) ** 2 - o * (1 - o) / (n - 1)) for n, o, p in g) / weight
    if between <= 0:
        return q.MOST_WORTH
    return min(q.MOST_WORTH, max(q.LEAST_WORTH, sum((n - 1) * p * (1 - p) for n, _, p in g) / weight / between - 1))


def want(rows, labels):
    """rows: (doc_id, text, host, path)."""
    good = {}
    for d, y in labels:
        if d is not None and y in (0, 1) and brute.crc(d) % 4 != 2:
            good[d] = min(good.get(d, 1), y)
    train = [(bins(t), h, p, good[d]) for d, t, h, p in rows if d in good]
    n, k = len(train), sum(x[3] for x in train)
    overall = (k + 1) / (n + 2)
    table = defaultdict(lambda: [0, 0])
    hosts, paths = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for b, h, p, y in train:
        for c in [table[i, x] for i, x in enumerate(b)] + [hosts[h], paths[h, p]]:
            c[0] += 1
            c[1] += y
    m = worth([(*v, None) for v in hosts.values()], lambda _: overall)
    shrink = lambda v, prior, m: (v[1] + m * prior) / (v[0] + m)
    host = {h: shrink(v, overall, m) for h, v in hosts.items()}
    m = worth([(*v, host[h]) for (h, _), v in paths.items()], lambda p: p)
    sizes = [len(x) + 1 for x in q.BINS.values()]
    out = []
    for d, t, h, p in rows:
        e = 0.0
        for i, x in enumerate(bins(t)):
            a, g = table.get((i, x), (0, 0))
            e += math.log((g + 1) / (k + sizes[i]) * (n - k + sizes[i]) / (a - g + 1))
        prior = shrink(paths.get((h, p), (0, 0)), host.get(h, overall), m)
        out.append((d, e, prior, 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))))
    return sorted(out, key=repr)


def check(docs, labels):
    got = q.score(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    rows = [(r.doc_id, r.text, r.source, "/".join(x for x in (r.source, r.lang) if x is not None)) for r in docs.collect()]
    expect = want(rows, [(r.doc_id, r.quality) for r in labels.collect()])
    mine = sorted(((r.doc_id, r.evidence, r.prior, r.score) for r in got), key=repr)
    key = lambda r: (repr(r[0]), round(r[1], 6), round(r[2], 6))
    for a, b in zip(sorted(mine, key=key), sorted(expect, key=key), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-6, abs=1e-9)
    return got


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    got = check(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc([r.score for r in held], np.array([truth[r.doc_id] for r in held])) > 0.8


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (None, "Good text here.", "a", None), (3, "GOOD text\n\nGOOD text", "b", "en"), (4, "x " * 20000, "b", "de"), (4, "x 1 %% é", "b", "de"), (5, "One more.", "a", "en"), (7, "Two.", "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("host", F.lit("x")).withColumn("n", F.lit(1)).withColumn("good", F.lit(2))
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 8)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    check(docs, labels)
    assert {r.score for r in check(docs, labels.limit(0))} == {0.5}
    assert check(docs.limit(0), labels) == []
