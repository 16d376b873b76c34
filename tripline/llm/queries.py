"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm import alignment, decontam, merkle, mixing, phrases, quality, secrets, sharding, simhash, suffix_tree, suffixes, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(_table(spark, sf_dir, "embeddings"))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.place_rows(_table(spark, sf_dir, "documents"), 16))


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a host; its sections by language are its paths."""
    documents, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality.digest(quality.score(documents, labels, F.col("source"), F.concat_ws("/", "source", "lang")))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.score(*(_table(spark, sf_dir, name) for name in ("documents", "labels"))))


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontam.digest(decontam.contaminated(*tables))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(_table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    """Matches with their positions, and all windows of all candidates, each counted anew."""
    assign = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    quotes = "[\"'']?"
    base = (
        ("assign", f"({assign}){quotes}\\x20*[:=]\\x20*{quotes}([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]{32,}", 0, 32),
    )

    def matches(name: str, pattern: str, group: int, k: int) -> str:
        return f"""{name}_m AS (SELECT rid, {k} AS k, m, v, list_transform(g, lambda x: length(x)) AS gaps,
              list_transform(m, lambda x: length(x)) AS sizes, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
              string_split_regex(text, '{pattern}') AS g FROM d)),
        {name} AS (SELECT rid, k, v[i] AS v, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT) AS s,
              CAST(list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS BIGINT) AS e FROM {name}_m)"""

    # What RE2 has no back reference for: one character eight times.
    again = "|".join(f"[{c}]{{8}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")
    allowed = "|".join("(?:" + p.replace("|(.)\\1{7}", f"|{again}") + ")" for p in secrets.ALLOWED)
    w = secrets.WINDOW
    sums = [0]
    for step in secrets._STEPS[1:]:
        sums.append(sums[-1] + step)
    parts, extra, kept = [], [], []
    for k, (name, pattern, group, least) in enumerate(base):
        parts.append(matches(name, pattern, group, k))
        kept.append(f"SELECT rid, k, s, e FROM {name} WHERE length(v) >= {least}")
    for k, (name, pattern, needed, bits) in enumerate(secrets.CLASSES, len(base)):
        parts.append(matches(name, pattern, 0, k))
        wanted = " AND ".join(f"regexp_matches(v, '{n}')" for n in needed)
        extra.append(f"""SELECT rid, k, s + min(o) AS s, s + max(o) + {w} AS e FROM (
            SELECT rid, k, s, o, list_sum(list_transform(map_values(list_histogram(string_split(substr(v, o + 1, {w}), ''))), lambda c: {sums}[CAST(c AS BIGINT) + 1])) AS total
            FROM (SELECT *, unnest(range(length(v) - {w - 1})) AS o FROM {name} WHERE {wanted} AND NOT regexp_matches(v, '{allowed}')))
          WHERE total <= {secrets.most_repetition(bits)} GROUP BY rid, k, s""")
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    text = f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        {", ".join(parts)},
        base AS ({" UNION ALL ".join(kept)}),
        extra AS ({" UNION ALL ".join(extra)}),
        spans AS (SELECT * FROM base UNION ALL SELECT * FROM extra x WHERE NOT EXISTS (
          SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s <= x.s AND x.e <= b.e)),
        by_base AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS c,
          count(*) FILTER (WHERE k = 2) AS h, {text} AS t FROM base GROUP BY rid),
        by_all AS (SELECT rid, {text} AS t FROM spans GROUP BY rid)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
          sha256(coalesce(b.t, '')) AS base_sha256, coalesce(s.t, '') AS spans
        FROM d LEFT JOIN by_base b USING (rid) LEFT JOIN by_all s USING (rid)"""


QUERIES = {
    "op1_segment_topk": op1_segment_topk,
    "op5_entropy_mixing": op5_entropy_mixing,
    "op2_ring_sharding": op2_ring_sharding,
    "op3_quality_bayes": op3_quality_bayes,
    "op4_secret_scans": op4_secret_scans,
    "op6_toxicity_grammar": op6_toxicity_grammar,
    "op7_repeated_phrases": op7_repeated_phrases,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_suffix_tree_scores": op9_suffix_tree_scores,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_suffix_dedup": op13_suffix_dedup,
}

SQL: dict[str, str] = {
    "op4_secret_scans": _secrets_sql(),
    "op11_merkle_manifest": merkle.oracle(),
    "op1_segment_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20
    """,
}
