from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tripline.llm import merkle

SF = "/root/testdata/sf0.01"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(nodes):
    """Levels from the leaves to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha(*level[i : i + 8]) for i in range(0, len(level), 8)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def brute_rows(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = grow([leaf_of(r) for r in langs[name]])
    over = grow([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(langs[name]):
            path = path_of(trees[name], i) + path_of(over, k)
            h = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                h = sha(*left, h, *right)
            proof = sha(*[s for left, right in path for s in (*left, *right)])
            out.append((r[0], leaf_of(r), trees[name][-1][0], over[-1][0], proof, h, h == over[-1][0]))
    return sorted(out, key=repr)


def check(docs):
    got = sorted((tuple(r) for r in merkle.digest(docs).collect()), key=repr)
    assert got == brute_rows([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    return got


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {r[-1] for r in got} == {True, False}


_KIND = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513, 520, 4097])
def test_sizes_of_a_group(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)] + [(-1, None, None, None, None)]
    check(spark.createDataFrame(rows, _KIND).repartition(5))


def test_more_groups_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", f"l{i % 83}é" if i % 83 else None, 0, "Aa" * i) for i in range(900)]
    check(spark.createDataFrame(rows, _KIND))


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None), (1, None, "en", None, ""), (1, "", "en", 0, ""), (2, "-", "", 1, "É A" * 100_000), (None, "a", None, 1, "X"), (None, "a", None, 1, "X"), (3, "1:a", "é", -5, "-"), (3, "1:a", "é", -5, "-")]
    docs = spark.createDataFrame(rows, _KIND).withColumn("key", F.lit(1)).withColumn("node", F.lit("x")).withColumn("path", F.lit(None).cast("int")).withColumn("position", F.lit(0))
    check(docs)
    assert check(docs.limit(0)) == []


def test_one_changed_row_breaks_its_own_proof_only(spark):
    rows = spark.createDataFrame([(i, "s", "en", 1, f"text {i}") for i in range(600)], _KIND)
    whole = merkle.manifest(rows).withColumn("ok", merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert whole.where("ok").count() == 600
    forged = whole.select(merkle.fold(F.sha2(F.lit("forged"), 256), F.col("path")).alias("r"), "root")
    assert forged.where("r = root").count() == 0
