from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.llm import alignment

SF = "/root/testdata/sf0.001"


def encodings():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    return a, b


def brute_rows(rows):
    """Every pair of tokens of every text compared by its range."""
    a, b = encodings()
    from tokenizers import decoders

    chars = {c: i for c, i in alignment._byte_values().items()}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a" and sorted(chars.values()) == list(range(256))
    out, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((doc_id, 0, 0, [], ""))
            continue
        ends = lambda raw: [sum(map(len, raw[: i + 1])) for i in range(len(raw))]
        ends_a, ends_b = (ends(raw_a), ends(raw_b)) if len(ids_a) < 200 else (running(raw_a), running(raw_b))
        links = [(ids_a[ends_a.index(e)], ids_b[j]) for j, e in enumerate(ends_b) if e in set(ends_a)] if len(ids_a) < 200 else linked(ids_a, ids_b, ends_a, ends_b)
        counts.update(links)
        groups, i, j = [], 0, 0
        common = sorted(set(ends_a) & set(ends_b))
        for e in common:
            x, y = i, j
            while i < len(ends_a) and ends_a[i] <= e:
                i += 1
            while j < len(ends_b) and ends_b[j] <= e:
                j += 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
        out.append((doc_id, len(ids_a), len(ids_b), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return sorted(
        (
            (d, n, m, g.count(";") + 1 if g else 0, len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), sha(g))
            for d, n, m, k, g in out
        ),
        key=repr,
    )


def running(raw):
    total, out = 0, []
    for r in raw:
        total += len(r)
        out.append(total)
    return out


def linked(ids_a, ids_b, ends_a, ends_b):
    at = dict(zip(ends_a, ids_a))
    return [(at[e], y) for e, y in zip(ends_b, ids_b) if e in at]


def check(docs):
    got = sorted((tuple(r) for r in alignment.digest(docs).collect()), key=repr)
    assert got == brute_rows([(r.doc_id, r.text) for r in docs.collect()])
    return got


@pytest.mark.parametrize("lookup", [alignment.LOOKUP, 50, 1])
def test_whole_table(spark, monkeypatch, lookup):
    monkeypatch.setattr(alignment, "LOOKUP", lookup)
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(r[4] for r in got) > 10_000 and any(0 < r[5] < r[4] for r in got)


def test_odd_rows(spark):
    long = "z" * 60_000 + " " + "pq " * 30_000
    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s></s><unk><0x41>"), (None, "naïve ½ 中文 \U0001f600‍"), (7, "a b"), (7, "a b"), (None, "a b"), (8, "ﬁ Å é  \t\n x "), (9, long), (10, "\x00 \x1c \x85 \xa0x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("pairs", F.lit("x")).withColumn("n_a", F.lit(None).cast("int"))
    got = check(docs)
    assert [r[1:] for r in got if r[0] == 4] == [(0, 0, 0, 0, 0, 0, "")]
    assert check(docs.limit(0)) == []


def test_both_encoders_of_the_byte_vocabulary_agree():
    v = alignment.vocabularies(alignment.FOLDER)
    assert v._fast is not None
    rng = random.Random(5)
    settled = [chr(i) for i in range(0x220)]
    for _ in range(3000):
        text = " " + "".join(rng.choice(settled if rng.random() < 0.5 else "ab '\n\t 1s\x85\xa0\x1c!?é") for _ in range(rng.randint(0, 30)))
        assert v._fast.encode_to_numpy(text).tolist() == v._full.encode(text, add_special_tokens=False).ids


def test_lists_give_the_groups_back(spark):
    docs = spark.createDataFrame([(1, "Straßenbahn, unalignable; words")], "doc_id long, text string")
    r = alignment.align(docs, lists=True).first()
    v = alignment.vocabularies(alignment.FOLDER)
    i = j = 0
    for x, y in zip(r.a_cuts, r.b_cuts):
        assert b"".join(v.a[t] for t in r.a_ids[i:x]) == b"".join(v.b[t] for t in r.b_ids[j:y])
        i, j = x, y
    assert (i, j) == (r.n_a, r.n_b) and sum(r.times) == r.n_groups


def test_texts_of_a_part_are_checked_together():
    """Ids give a text back, fall short of it, go over it, or differ inside; the others stay."""
    tokens, sizes = np.frombuffer(b"abcab", dtype=np.uint8), np.array([1, 0, 2, 2])
    texts = [(b"abcab", [0, 2, 3]), (b"ab", [0]), (b"a", [3]), (b"", []), (b" ", []), (b"bca", [2, 1, 0]), (b"bcab", [3, 2]), (b"ab", [3])]
    ids = np.array([i for _, own in texts for i in own])
    begins = np.cumsum([0] + [len(own) for _, own in texts])
    raw = np.frombuffer(b"".join(t for t, _ in texts), dtype=np.uint8)
    # "bc" is bytes 1 and 2 of the table: id 2.
    got = alignment._given_back(tokens, sizes, ids, begins, raw, np.array([len(t) for t, _ in texts]))
    assert got.tolist() == [True, False, False, True, False, True, False, True]


def test_texts_not_given_back_leave_their_neighbours_alone():
    v = alignment.vocabularies(alignment.FOLDER)
    texts = ["a b", "a▁b", "", "▁", " x", "▁▁", "naïve ½ 中文"]
    alone = [alignment._encoded(v, [t]) for t in texts]
    a, b, a_begins, b_begins = alignment._encoded(v, texts)
    assert [len(x[0]) > 0 for x in alone] == [True, False, False, False, True, False, True]
    for i, (x, y, *_) in enumerate(alone):
        assert a[a_begins[i] : a_begins[i + 1]].tolist() == x.tolist() and b[b_begins[i] : b_begins[i + 1]].tolist() == y.tolist()


def test_cuts_are_looked_up_in_one_dictionary():
    x, y = alignment.common_cuts(np.array([2, 3, 7, 9]), np.array([1, 3, 4, 9]))
    assert (x.tolist(), y.tolist()) == ([2, 4], [2, 4])
