"""Merkle manifest of a table: a tree of SHA-256 digests per group, one tree over the groups.

A leaf is the digest of a row's fields. In each group leaves are ordered; every run of ``FAN``
consecutive nodes (the last may be shorter, even one) has the digest of its concatenated digests
as parent, until one node is left, the group's subroot. The subroots, ordered by group, are the
leaves of one more such tree, whose top is the root.

Positions come from range pieces, so a group of any size is cut into aligned blocks of ``BLOCK``
nodes. A block keeps each of its levels as one string of concatenated hex digests: parents are
hashes of fixed-width substrings, and the siblings of a node are the substrings to its left and
right in its run. The tops of the blocks are the nodes of the next, ``BLOCK`` times smaller round;
the number of rounds is the logarithm of the largest group. Then the segments of each round are
put behind those of the round below, so that every row has its whole path: per level what stands
left and right of its own digest. All of it is Spark SQL; no task holds more than a block.

Null fields have a mark of their own, so a null and an empty text differ; texts of any length are
hashed whole. A null group is a group, before all others; a null key comes first in its group.
Rows with equal keys are ordered by their leaves; equal rows have equal leaves and each its own
place. An empty table has no rows and no root. Other columns are not looked at unless carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.ordered import number_rows
from tripline.session import discard, materialize

FAN = 8
#: Levels that a block climbs.
LEVELS = 3
BLOCK = FAN**LEVELS
#: Hex characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_PATH = "array<struct<left:binary,right:binary>>"


def field(c: Column) -> Column:
    """A field as text that tells null, empty and any two lists of fields apart."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _parents(level: Column) -> Column:
    """The next level of a string of digests."""
    run = FAN * WIDTH
    begins = F.sequence(F.lit(1), F.octet_length(level), F.lit(run))
    return F.array_join(F.transform(begins, lambda i: F.sha2(F.substring(level, i, F.lit(run)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """``nodes``: key, position (from 0), node and more; ``counts``: key, n. Blocks with their
    members in order, their levels, and their top."""
    more = [c for c in nodes.columns if c not in ("key", "position")]
    block = F.floor(F.col("position") / F.lit(BLOCK)).cast("long")
    members = F.sort_array(F.collect_list(F.struct("position", *more))).alias("members")
    out = nodes.groupBy("key", block.alias("block")).agg(members).join(counts, "key")
    out = out.withColumn("s0", F.array_join("members.node", "").cast("binary"))
    for k in range(LEVELS):
        # Nodes of this level in the whole group: over one, and there is a level above.
        out = out.withColumn(f"s{k + 1}", F.when(F.col("n") > FAN**k, _parents(F.col(f"s{k}"))))
    return out.withColumn("top", F.coalesce(*[F.col(f"s{k}") for k in range(LEVELS, -1, -1)]).cast("string")).drop(f"s{LEVELS}")


def _segments(k: int) -> Column:
    """What stands beside a member's ancestor on level ``k`` of its block; null without a level above."""
    slot = F.col("m.position") - F.col("block") * BLOCK
    at = F.floor(slot / F.lit(FAN**k)).cast("int")
    run = F.floor(at / F.lit(FAN)).cast("int")
    begin, own = run * (FAN * WIDTH), (at - run * FAN) * WIDTH
    level = F.col(f"s{k}")
    left = F.substring(level, begin + 1, own)
    right = F.substring(level, begin + own + WIDTH + 1, F.lit((FAN - 1) * WIDTH) - own)
    return F.when(F.col("n") > FAN**k, F.struct(left.alias("left"), right.alias("right")))


def _climb(nodes: DataFrame, counts: DataFrame) -> list[DataFrame]:
    """Rounds of blocks, until each group has one block."""
    rounds = []
    while True:
        blocks = materialize(_blocks(nodes, counts), "merkle-blocks")
        rounds.append(blocks)
        most = blocks.agg(F.max("n")).first()[0]
        if most is None or most <= BLOCK:
            return rounds
        nodes = blocks.select("key", F.col("block").alias("position"), F.col("top").alias("node"))
        counts = counts.select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("n"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``above``: key, path and more of each group's top. The members of the first round with
    their whole ``path``, and what else ``above`` has."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    more = [c for c in above.columns if c not in ("key", "path", "block")]
    for i, blocks in enumerate(reversed(rounds)):
        each = blocks.join(above, ["key", "block"]).withColumn("m", F.explode("members"))
        own = F.filter(F.array(*[_segments(k) for k in range(LEVELS)]), lambda p: p.isNotNull())
        path = F.concat(own.cast(_NO_PATH), F.col("path")).alias("path")
        if i + 1 == len(rounds):
            return each.select("key", "m.*", path, *more)
        above = each.select("key", F.col("m.position").alias("block"), path, *more)


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``key_value`` (of ``order``), ``leaf``, ``path`` (from the leaf up to the root,
    per level the digests to the left and to the right), ``subroot``, ``root``, and ``carry``."""
    carry = carry or {}
    # Null first, then by bytes; never null itself, so that it can be joined on.
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("key")
    leaves = docs.select(key, F.col(order).alias("key_value"), leaf([F.col(c) for c in fields]).alias("node"), *[c.alias(n) for n, c in carry.items()])
    leaves = materialize(leaves, "merkle-leaves")
    nodes = number_rows(leaves, ["key"], ["key_value", "node"]).withColumn("position", F.col("position").cast("long") - 1)
    counts = materialize(leaves.groupBy("key").agg(F.count("*").alias("n")), "merkle-counts")
    rounds = _climb(nodes, counts)
    discard(leaves, counts)
    subroots = rounds[-1].select(F.lit("").alias("all"), F.col("key").alias("group"), F.col("top").alias("node"))
    tops = number_rows(subroots, ["all"], ["group"]).select(
        F.col("all").alias("key"), (F.col("position").cast("long") - 1).alias("position"), "node", "group"
    )
    tops = materialize(tops, "merkle-subroots")
    over = _climb(tops, tops.groupBy("key").agg(F.count("*").alias("n")))
    discard(tops)
    start = over[-1].select("key", F.array().cast(_NO_PATH).alias("path"), F.col("top").alias("root"))
    above = _descend(over, start).select(F.col("group").alias("key"), "path", F.col("node").alias("subroot"), "root")
    rows = _descend(rounds, above)
    return rows.select("key_value", F.col("node").alias("leaf"), "path", "subroot", "root", *carry)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    up = lambda h, p: F.sha2(F.concat(p["left"], h.cast("binary"), p["right"]), 256)
    return F.aggregate(path, start, up)


def digest(docs: DataFrame) -> DataFrame:
    """Paths as one hash, and what they prove of rows of which some have been tampered with."""
    changed = F.translate("text", _CAPITALS, _CAPITALS.lower())
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf([changed if c == "text" else F.col(c) for c in FIELDS])
    )
    rows = manifest(docs, carry={"tampered": tampered})
    beside = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"]).cast("string")), "")
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select(
        F.col("key_value").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(beside, 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def oracle() -> str:
    """The same, level by level over single nodes."""

    def of(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def hashed(columns: Sequence[str]) -> str:
        return "sha256(" + " || ".join(of(c) for c in columns) + ")"

    changed = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
    grow = f"""SELECT {{k}} level + 1, position // {FAN}, sha256(string_agg(node, '' ORDER BY position)), (n + {FAN - 1}) // {FAN}
        FROM {{t}} WHERE n > 1 GROUP BY {{k}} level, position // {FAN}, n"""
    part = f"CAST((a.position // CAST(pow({FAN}, k.level) AS BIGINT)) % {FAN} AS BIGINT)"
    run = f"k.run = a.position // CAST(pow({FAN}, k.level + 1) AS BIGINT)"
    sides = f"array_to_string(k.kids[1:{part}], '') || '|' || array_to_string(k.kids[{part} + 2:], '')"
    return f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: {step})) AS t),
        d AS (SELECT doc_id, lang, {hashed(FIELDS)} AS leaf,
          CASE WHEN {crc} % 3 = 0 THEN {hashed([changed if c == "text" else c for c in FIELDS])} END AS tampered FROM documents, crc),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position,
          count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS rid FROM d),
        nodes(lang, level, position, node, n) AS (SELECT lang, 0, position, leaf, n FROM p UNION ALL {grow.format(k="lang,", t="nodes")}),
        tops AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS position, count(*) OVER () AS n FROM nodes WHERE n = 1),
        over(level, position, node, n) AS (SELECT 0, position, node, n FROM tops UNION ALL {grow.format(k="", t="over")}),
        runs AS (SELECT lang, level, position // {FAN} AS run, list(node ORDER BY position) AS kids FROM nodes WHERE n > 1 GROUP BY lang, level, position // {FAN}),
        over_runs AS (SELECT level, position // {FAN} AS run, list(node ORDER BY position) AS kids FROM over WHERE n > 1 GROUP BY level, position // {FAN}),
        segments AS (
          SELECT a.rid, k.level, {sides} AS s FROM p a JOIN runs k ON a.lang IS NOT DISTINCT FROM k.lang AND {run}
          UNION ALL SELECT r.rid, 1000 + k.level, {sides} AS s FROM p r JOIN tops a ON r.lang IS NOT DISTINCT FROM a.lang JOIN over_runs k ON {run}),
        paths AS (SELECT rid, list(s ORDER BY level) AS path FROM segments GROUP BY rid),
        rows AS (SELECT p.*, tops.node AS subroot, (SELECT node FROM over WHERE n = 1) AS root, coalesce(path, []) AS path
          FROM p JOIN tops ON p.lang IS NOT DISTINCT FROM tops.lang LEFT JOIN paths USING (rid)),
        folded AS (SELECT *, list_reduce(list_prepend(coalesce(tampered, leaf), path),
          lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM rows)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root,
          folded_root = root AS verified FROM folded"""
