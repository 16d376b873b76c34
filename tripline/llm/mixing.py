"""Mixing sources to target sizes by entropy balancing.

Each document gets a rate: how often it is taken. Of all rates that meet every source's target
size, entropy balancing takes those closest to 1 in relative entropy, which are exponentially
tilted by document size, exp(lambda * size / mean size), cut at ``CAP``. One multiplier per
source solves the convex dual; all sources are solved at once by guarded Newton steps, each a
grouped sum over the histogram of (source, size), written once. Sums are of decimals, so the
order of additions cannot matter and reruns agree.

Rates become copies by systematic rounding: with documents in order of size, copies follow the
running sum of rates, so a source's total is off by about one document. Two more passes change
one document per source each to come nearer. No source or size is worked on in one task: ranks
are counted in salted pieces of at most ``PIECE`` rows. Spark SQL functions only.

A null text has size 0 and no words; a document of size 0 is kept once. A null source is a
source of its own, last in order. Repeated rows are rows of their own and may differ in copies;
null ids sort first. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.llm.tokens import WORD_PATTERN
from tripline.session import materialize

# Fixed values of the mix: weights by source order, share of all sizes, most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Rates are whole multiples of 2 ** -RATE_BITS.
RATE_BITS = 30
PIECE = 20_000
#: Newton stops when every source is this near its target, relative to it.
TOLERANCE = 1e-9
MOST_STEPS = 80


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``sid`` (order of the source) and ``target`` to one row per ``source``, ``source_size``.

    The level is the amount per unit of weight at which shares, cut at ``CAP`` times the
    source's size, add up to the whole: raising it source by source in order of cap per weight,
    the greatest level met is the one at which no share is above its cap."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("_ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    df = sizes.withColumn("sid", F.row_number().over(order) - 1)
    df = df.withColumn("_weight", F.element_at(weights, F.col("sid") % len(WEIGHTS) + 1))
    df = df.withColumn("_ratio", CAP * F.col("source_size") / F.col("_weight"))
    capped = F.coalesce(F.sum(CAP * F.col("source_size")).over(by_cap), F.lit(0))
    lighter = F.coalesce(F.sum("_weight").over(by_cap), F.lit(0.0))
    total, weight = F.sum("source_size").over(everything) * SHARE, F.sum("_weight").over(everything)
    df = df.withColumn("_level", (total - capped) / (weight - lighter))
    level = F.max("_level").over(everything)
    target = F.least(CAP * F.col("source_size").cast("double"), F.col("_weight") * level)
    return df.withColumn("target", target).select("sid", "source", "source_size", "target")


def _exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def solve(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """``sid`` and ``tilt`` (lambda) for every source.

    ``hist``: sid, size, n. ``goals``: sid, source_size, target, docs (documents with words).
    A source whose target is its cap needs no tilt: it gets a null one, for rate ``CAP``."""
    hist = hist.where("size > 0").join(goals.select("sid", F.try_divide("source_size", "docs").alias("_mean")), "sid")
    hist = materialize(hist.select("sid", "size", "n", (F.col("size") / F.col("_mean")).alias("x")), "mix-histogram")
    goals = goals.where("source_size > 0")
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    done = goals.where(full).select("sid", F.lit(None).cast("double").alias("tilt"))
    state = materialize(
        goals.where(~full).select(
            "sid", "target", F.log(F.col("target") / F.col("source_size")).alias("tilt"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off"),
        ),
        "mix-state",
    )
    for _ in range(MOST_STEPS):
        rate = F.exp(F.least(F.col("tilt") * F.col("x"), F.log(F.lit(float(CAP)))))
        inside = F.col("tilt") * F.col("x") < F.log(F.lit(float(CAP)))
        amount = F.col("n") * F.col("size") * rate
        sums = (
            hist.join(state.select("sid", "tilt"), "sid")
            .groupBy("sid")
            .agg(_exact_sum(amount).alias("g"), _exact_sum(F.when(inside, amount * F.col("x")).otherwise(0.0)).alias("slope"))
        )
        below = F.col("g") < F.col("target")
        step = state.join(sums, "sid").withColumns(
            {
                "low": F.when(below, F.col("tilt")).otherwise(F.col("low")),
                "high": F.when(below, F.col("high")).otherwise(F.col("tilt")),
                "off": F.abs(F.try_divide("g", "target") - 1),
            }
        )
        newton = F.when(F.col("slope") > 0, F.col("tilt") + (F.col("target") - F.col("g")) / F.col("slope"))
        # Outside the bracket: halve it or, where a side is still open, step out by a growing amount.
        reach = F.greatest(F.lit(1.0), F.abs("tilt"))
        guarded = F.when(
            newton.isNotNull()
            & (F.abs(newton - F.col("tilt")) <= 2 * reach)
            & (F.col("low").isNull() | (newton > F.col("low")))
            & (F.col("high").isNull() | (newton < F.col("high"))),
            newton,
        ).when(F.col("low").isNull(), F.col("tilt") - reach).when(F.col("high").isNull(), F.col("tilt") + reach).otherwise(
            (F.col("low") + F.col("high")) / 2
        )
        tilt = F.when(F.col("off") <= TOLERANCE, F.col("tilt")).otherwise(guarded)
        state = materialize(step.withColumn("tilt", tilt).select("sid", "target", "tilt", "low", "high", "off"), "mix-state")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("sid", "tilt").unionByName(done)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``text_hash``, ``size``, ``source_size``, ``target``, ``rate`` and
    ``copies`` (0 to ``CAP``) of every row."""
    text = F.col(text_column).cast("string")
    base = materialize(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "mix-sizes",
    )
    counted = materialize(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    per_source = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs")
    )
    goals = materialize(
        targets(per_source.select("source", "source_size")).alias("t")
        .join(per_source.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s"),
        "mix-targets",
    )
    hist = counted.join(
        goals.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))
    ).select("sid", "source", "size", "n")
    tilts = goals.select("sid", F.try_divide("source_size", "docs").alias("_mean")).join(
        solve(hist, goals), "sid", "left"
    )
    one = 1 << RATE_BITS
    tilted = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("_mean"), F.lit(1.0))), F.lit(float(CAP)))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.lit(float(CAP))).otherwise(tilted)
    rated = materialize(
        hist.join(tilts, "sid").select(
            "sid", "source", "size", "n", F.round(rate * one).cast("long").alias("_rate"),
            F.ceil(F.col("n") / PIECE).cast("int").alias("_salts"),
        ),
        "mix-rates",
    )
    return _rounded(base, rated, goals, one)


def _rounded(base: DataFrame, rated: DataFrame, goals: DataFrame, one: int) -> DataFrame:
    """Copies by systematic rounding in order of size, then two corrections per source."""
    same = F.col("b.source").eqNullSafe(F.col("r.source")) & (F.col("b.size") == F.col("r.size"))
    salted = base.alias("b").join(rated.alias("r"), same).select(
        "b.doc_id", "b.source", "b.text_hash", "b.size", "sid", "_rate",
        F.pmod(F.xxhash64("b.doc_id", "b.text_hash"), F.col("_salts")).alias("_salt"),
    )
    inside = Window.partitionBy("sid", "size", "_salt").orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash")
    ranked = materialize(salted.withColumn("_j", (F.row_number().over(inside) - 1).cast("long")), "mix-ranked")
    before = Window.partitionBy("sid").orderBy("size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranked.groupBy("sid", "size", "_salt", "_rate").agg(F.count("*").alias("n"))
    mass = (F.col("n") * F.col("_rate")).cast("decimal(38,0)")
    start = F.pmod(F.coalesce(F.sum(mass).over(before), F.lit(0).cast("decimal(38,0)")), F.lit(one).cast("decimal(38,0)"))
    starts = pieces.select("sid", "size", "_salt", start.cast("long").alias("_start"))
    at = lambda j: F.shiftright(F.col("_start") + one // 2 + j * F.col("_rate"), RATE_BITS)
    taken = materialize(
        ranked.join(starts, ["sid", "size", "_salt"]).withColumn("copies", (at(F.col("_j") + 1) - at(F.col("_j"))).cast("int")),
        "mix-copies",
    )
    identity = ["sid", "size", "_salt", "_j"]
    for _ in range(2):
        totals = taken.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"))
        gap = goals.join(totals, "sid").select("sid", (F.col("target") - F.col("_taken")).alias("_gap"))
        fits = F.when(F.col("_gap") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0)
        miss = F.abs(F.abs("_gap") - F.col("size"))
        # One document stands for all of its source, size and copies, so a hot source is a few rows.
        options = taken.groupBy("sid", "size", "copies").agg(F.min(F.struct("_salt", "_j")).alias("_first"))
        chosen = (
            options.join(gap, "sid")
            .where(fits & (F.col("size") > 0) & (miss < F.abs("_gap")))
            .groupBy("sid")
            .agg(F.min(F.struct(miss.alias("miss"), "size", "_first", F.signum("_gap").cast("int").alias("by"))).alias("c"))
            .select("sid", "c.size", "c._first._salt", "c._first._j", "c.by")
        )
        changed = taken.join(chosen, identity, "left")
        taken = materialize(
            changed.withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by"), "mix-copies"
        )
    return taken.join(goals.select("sid", "source_size", "target"), "sid").select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("_rate") / one).alias("rate"), "copies"
    )


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", "copies"
    )
