"""Quality by hierarchical empirical Bayes: document evidence on top of host and path priors.

*Document evidence* is a naive Bayes log-likelihood ratio over binned text statistics. *Priors*
come from the same training labels by site: a host's share of good documents is shrunk towards
the global share, a path's towards its host's. How strongly follows from the data: by moments,
the spread between groups that sampling does not explain says how many documents a prior is
worth, so sparse hosts and paths fall back on what lies above them. A document's score is the
posterior given its evidence and its path's prior.

All counts are grouped sums over all training rows; the driver sees a few numbers only. Groups
are joined back by equality; a host with a third of all rows is summed map-side first.

Null and empty texts have statistics of zero. A null host or path is a group of its own. Rows
are scored alone. Of several labels of one id the smaller counts; labels without an id or value
are left out. Without labels every score is one half.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.llm.tokens import WORD_PATTERN
from tripline.session import materialize

#: Upper bounds of the bins of each statistic; values beyond the last are one more bin.
BINS = {
    "words": (5, 10, 20, 50, 100, 200, 500, 1000, 3000),
    "symbols": (0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.15, 0.25),
    "capitals": (0.01, 0.02, 0.03, 0.05, 0.08, 0.15, 0.3, 0.6, 0.9),
    "digits": (0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3),
    "word_length": (2.5, 3.5, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "distinct_lines": (0.1, 0.3, 0.5, 0.7, 0.9, 0.99),
}
#: Documents a prior may be worth.
LEAST_WORTH, MOST_WORTH = 1.0, 10_000.0
SMOOTH = 1.0


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def statistics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    chars = F.length(text)
    return {
        "words": F.size(words).cast("double"),
        "symbols": _share(left("[\\p{L}\\p{N}\\s]+"), chars),
        "capitals": _share(left("[^\\p{Lu}]+"), left("[^\\p{L}]+")),
        "digits": _share(left("[^0-9]+"), chars),
        "word_length": _share(left("[\\x20\\x09-\\x0D]+"), F.size(words)),
        "distinct": _share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


def binned(value: Column, bounds: tuple[float, ...]) -> Column:
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], i).otherwise(out)
    return out


def _worth(groups: DataFrame, share: Column) -> float:
    """How many documents a prior is worth: share * (1 - share) / spread - 1, where the spread is
    what the groups' shares differ by beyond sampling. ``groups``: n, good."""
    own, weight = F.col("good") / F.col("n"), F.col("n") - 1
    # Within a group, own * (1 - own) * n / (n - 1) estimates the variance of one document.
    within = own * (1 - own) * F.col("n") / weight
    spread = F.pow(own - share, 2) - within / F.col("n")
    between, total = (
        groups.where("n > 1").agg(
            F.sum(weight * spread) / F.sum(weight), F.sum(weight * share * (1 - share)) / F.sum(weight)
        ).first()
    )
    if between is None or between <= 0:
        return MOST_WORTH
    return min(MOST_WORTH, max(LEAST_WORTH, total / between - 1))


def _shrunk(n: Column, good: Column, prior: Column, worth: float) -> Column:
    return (F.coalesce(good, F.lit(0)) + worth * prior) / (F.coalesce(n, F.lit(0)) + worth)


def score(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``held_out``, ``evidence`` (log-likelihood ratio), ``prior`` (of the path) and
    ``score`` of every row. ``labels``: doc_id, quality."""
    stats = statistics(F.col(text_column))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    rows = materialize(
        docs.select(
            F.col(id_column).alias("doc_id"), key(host).alias("host"), key(path).alias("path"),
            *[binned(stats[name], bounds).cast("int").alias(f"b_{name}") for name, bounds in BINS.items()],
        ),
        "quality-bins",
    )
    known = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("good"))
    )
    train = materialize(rows.join(known, "doc_id"), "quality-train")
    n, good = train.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    overall = (good + SMOOTH) / (n + 2 * SMOOTH)
    # Evidence: one small table of (statistic, bin), of a size fixed by BINS.
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b_{name}").alias("b")) for i, name in enumerate(BINS)]))
    counts = {(r["i"], r["b"]): (r["n"], r["good"]) for r in train.select("good", pairs.alias("p")).groupBy("p.i", "p.b").agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()}
    evidence = F.lit(0.0)
    for i, (name, bounds) in enumerate(BINS.items()):
        size = len(bounds) + 1
        ratios = []
        for b in range(size):
            own, own_good = counts.get((i, b), (0, 0))
            up = (own_good + SMOOTH) / (good + SMOOTH * size)
            ratios.append(math.log(up * (n - good + SMOOTH * size) / (own - own_good + SMOOTH)))
        evidence = evidence + F.element_at(F.array(*map(F.lit, ratios)), F.col(f"b_{name}") + 1)
    hosts = train.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    host_worth = _worth(hosts, F.lit(overall))
    hosts = hosts.select("host", _shrunk(F.col("n"), F.col("good"), F.lit(overall), host_worth).alias("host_prior"))
    paths = train.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")).join(hosts, "host")
    path_worth = _worth(paths, F.col("host_prior"))
    paths = paths.select("host", "path", "n", "good")
    joined = rows.join(hosts, "host", "left").join(paths, ["host", "path"], "left")
    prior = _shrunk(F.col("n"), F.col("good"), F.coalesce("host_prior", F.lit(overall)), path_worth)
    return joined.select("doc_id", evidence.alias("evidence"), prior.alias("prior")).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "evidence",
        "prior",
        (1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior"))))))).alias("score"),
    )


def digest(scored: DataFrame, least: float = 0.5) -> DataFrame:
    return scored.select("*", (F.col("score") >= least).alias("keep"))
