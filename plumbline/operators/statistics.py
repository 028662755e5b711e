"""Two-sample tests, correlations, effect sizes and quality targets as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scoring import KNOT_SHARES, PERCENTILE_KNOTS
from plumbline.operators import order

KNOTS = dict(zip([k for k, _ in PERCENTILE_KNOTS], KNOT_SHARES, strict=True))


def distribution(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Seven-point summary, exact, for groups of any size."""
    return order.percentiles(df, value, KNOTS, groups)


def corpus_stats(df: DataFrame, score: str, groups: list[str]) -> DataFrame:
    """Files, mean, median, sample deviation (0 for one file) and decision counts."""
    is_ = lambda d: F.count_if(F.col("decision") == d)
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_files"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
        is_("accept").alias("n_accept"), is_("warn").alias("n_warn"), is_("reject").alias("n_reject"),
    )
    return base.join(order.percentiles(df, score, {"median": 0.5}, groups).drop("n"), groups)


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: n1, n2, u of the rows where ``first`` holds, and tie_sum = sum of t^3 - t over tied values."""
    both = df.select(F.col(value).alias("v"), first.alias("f")).where("v IS NOT NULL AND f IS NOT NULL")
    split = both.groupBy("v").agg(F.count_if("f").alias("n1"), F.count_if(~F.col("f")).alias("n2"))
    ranks = order.midranks(both, "v")
    s = split.join(ranks, "v").agg(
        F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"), F.coalesce(F.sum("n2"), F.lit(0)).alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("tie_sum"),
    )
    return s.select("n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "tie_sum")


def mann_whitney_p(n1: int, n2: int, u: float, tie_sum: float) -> float:
    """Two-sided p by the normal approximation, corrected for ties and continuity."""
    n = n1 + n2
    if not n1 or not n2 or n < 2:
        return 1.0
    var = n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def harness_report(df: DataFrame, score: str, before: Column) -> dict:
    """Compare two corpora: means, change, U, p, whether it is significant, and an improvement if so and the loss fell."""
    m = df.select(F.avg(F.when(before, F.col(score))).alias("b"), F.avg(F.when(~before, F.col(score))).alias("a")).first()
    t = mann_whitney(df, score, before).first()
    p = mann_whitney_p(t["n1"], t["n2"], t["u"] or 0.0, t["tie_sum"] or 0.0)
    delta = (m["a"] or 0.0) - (m["b"] or 0.0)
    return {"mean_before": m["b"], "mean_after": m["a"], "delta": delta, "u": t["u"], "p_value": p, "significant": p < 0.05, "improvement": p < 0.05 and delta < 0}


def cohens_d(df: DataFrame, value: str, first: Column, groups: list[str] | None = None) -> DataFrame:
    """(mean of the others less mean of the first) over the pooled sample deviation; 0 with under two rows on a side or no spread."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    s = df.groupBy(*(groups or [])).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.coalesce(F.var_samp(a), F.lit(0.0)).alias("v1"), F.coalesce(F.var_samp(b), F.lit(0.0)).alias("v2")
    )
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    ok = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    return s.select(*(groups or []), "n1", "n2", F.when(ok & (pooled > 0), (F.col("m2") - F.col("m1")) / pooled).otherwise(0.0).alias("d"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and rho, from counts of value pairs and mean ranks; 0 with under two rows or no spread."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    rx, ry = (order.midranks(pairs, c).select(c, F.col("rank").alias(f"r{c}")) for c in "xy")
    s = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).join(rx, "x").join(ry, "y")
    n = F.sum("w")
    mid = (n + 1) / 2  # both mean ranks
    parts = s.agg(
        n.alias("n"), mid.alias("m"), F.sum(F.col("w") * F.col("rx") * F.col("ry")).alias("xy"), F.sum(F.col("w") * F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("w") * F.col("ry") * F.col("ry")).alias("yy")
    )
    square = lambda c: F.col(c) - F.col("n") * F.col("m") * F.col("m")
    spread = F.sqrt(square("xx") * square("yy"))
    return parts.select(F.coalesce("n", F.lit(0)).alias("n"), F.when((F.col("n") >= 2) & (spread > 0), square("xy") / spread).otherwise(0.0).alias("rho"))


def dimension_discrimination(df: DataFrame, category: str, dims: list[str], score: str, split_category: str = "implementation") -> DataFrame:
    """Per category and dimension: mean, population deviation, coefficient of variation; in the split category, of ten rows or more, an effect size between the halves of the score.

    The pooled deviation mixes population variances with sample weights; that is the definition.
    """
    medians = order.percentiles(df, score, {"median": 0.5}, [category]).select(category, "median", F.col("n").alias("_n"))
    named = df.join(medians, category).where("_n >= 2")
    long_ = named.select(category, "median", "_n", score, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("v")) for d in dims])).alias("e")).select(category, "median", "_n", score, "e.*")
    low, high = F.when(F.col(score) <= F.col("median"), F.col("v")), F.when(F.col(score) > F.col("median"), F.col("v"))
    s = long_.groupBy(category, "dimension").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.first("_n").alias("n"), F.count(low).alias("nl"), F.count(high).alias("nh"), F.avg(low).alias("ml"), F.avg(high).alias("mh"),
        F.var_pop(low).alias("vl"), F.var_pop(high).alias("vh"),
    )
    pooled = F.sqrt(F.try_divide(F.col("vl") * (F.col("nl") - 1) + F.col("vh") * (F.col("nh") - 1), F.col("nl") + F.col("nh") - 2))
    halves = (F.col(category) == split_category) & (F.col("n") >= 10) & (F.col("nl") >= 2) & (F.col("nh") >= 2)
    d = F.when(halves & (pooled > 0), (F.col("mh") - F.col("ml")) / pooled)
    return s.select(category, "dimension", "mean", "std", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0).alias("cv"), d.alias("cohens_d"))


# Quality targets (name, target, whether higher is better).
TARGETS = [
    ("sc_001_file_count", 500.0, True),
    ("sc_002_impl_vs_init_gap", 0.15, True),
    ("sc_003_dimension_discrimination", 2.0, True),
    ("sc_004_fp_rate", 0.20, False),
    ("sc_005_fn_rate", 0.40, False),
    ("sc_006_attribution_precision", 0.60, True),
    ("sc_007_noise_rate", 0.06, False),
]


def fp_fn(df: DataFrame, good: Column, decision: str = "decision") -> DataFrame:
    """One row: rejected share of the good, accepted share of the bad; null where there are none."""
    rate = lambda where, d: F.avg(F.when(where, (F.col(decision) == d).cast("double")))
    return df.agg(rate(good, "reject").alias("fp_rate"), rate(~good, "accept").alias("fn_rate"))


def targets(values: DataFrame) -> DataFrame:
    """(name, baseline, target, direction, met) from a row with a column a target's name; a value that is missing is not met."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("baseline"), F.lit(t).alias("target"), F.lit("higher_is_better" if up else "lower_is_better").alias("direction"),
                 F.coalesce((F.col(n) >= t) if up else (F.col(n) <= t), F.lit(False)).alias("met"))
        for n, t, up in TARGETS if n in values.columns
    ])
    return values.select(F.explode(rows).alias("t")).select("t.*")


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Targets that were met and fail now, or whose value worsened by over 10 %."""
    b = baseline.select("name", F.col("baseline").alias("previous_value"), F.col("met").alias("was_met"))
    j = current.join(b, "name")
    loss = F.when(F.col("direction") == "lower_is_better", F.col("baseline") - F.col("previous_value")).otherwise(F.col("previous_value") - F.col("baseline"))
    worse = F.try_divide(loss, F.abs("previous_value"))
    lost = F.col("was_met") & ~F.col("met")
    by_value = (F.col("previous_value") != 0) & (worse > 0.10)
    return j.where(lost | by_value).select("name", "previous_value", F.col("baseline").alias("current_value"), "target", "was_met", F.col("met").alias("now_met"), F.when(lost, "failing").otherwise("worse").alias("kind"))


def replay(files: DataFrame, commit: str, flagged: Column, implementation: Column) -> DataFrame:
    """Per commit: files, flagged, false positives, and whether all flags were noise."""
    s = files.groupBy(commit).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(flagged).alias("n_flagged"), F.count_if(flagged & ~implementation).alias("n_false_positive"))
    return s.withColumn("all_noise", (F.col("n_flagged") > 0) & (F.col("n_flagged") == F.col("n_false_positive")))


def noise_rate(commits: DataFrame) -> DataFrame:
    return commits.agg(F.count(F.lit(1)).alias("n_commits"), F.coalesce(F.avg(F.col("all_noise").cast("double")), F.lit(0.0)).alias("noise_rate"))


def majority(ratings: DataFrame, key: list[str], rating: str) -> DataFrame:
    """The most frequent rating of each key; ties go to the first by name."""
    counts = ratings.where(F.col(rating).isNotNull()).groupBy(*key, rating).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(rating).alias("r")))["r"].alias(rating))


def precision(directives: DataFrame, ratings: DataFrame, key: list[str], rating: str) -> DataFrame:
    """One row: counts by majority rating, precision (accurate or partial) and strict precision; 0 with nothing rated."""
    r = directives.select(*key).join(majority(ratings, key, rating), key, "left")
    is_ = lambda v: F.count_if(F.col(rating) == v)
    s = r.agg(F.count(F.lit(1)).alias("total"), is_("accurate").alias("accurate"), is_("partial").alias("partial"), is_("inaccurate").alias("inaccurate"))
    known = F.col("accurate") + F.col("partial") + F.col("inaccurate")
    share = lambda x: F.when(known > 0, x / known).otherwise(0.0)
    return s.select("*", (F.col("total") - known).alias("unannotated"), share(F.col("accurate") + F.col("partial")).alias("precision"), share(F.col("accurate")).alias("strict_precision"))


def kappa(ratings: DataFrame, key: list[str], rating: str, turn: str) -> DataFrame:
    """One row: pairs and Cohen's kappa of keys rated exactly twice, accurate and partial taken together; null under five pairs, 1 if chance explains all."""
    good = F.col(rating).isin("accurate", "partial").cast("int")
    both = ratings.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(turn, good.alias("g")))["g"].alias("a"), F.max(F.struct(turn, good.alias("g")))["g"].alias("b")).where("n = 2")
    s = both.agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg("a").alias("p1"), F.avg("b").alias("p2"))
    pe = F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))
    return s.select("pairs", F.when(F.col("pairs") < 5, None).when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def human_ratings(spark, path: str) -> DataFrame:
    """(file, function_name, language, human_rating, n_raters) of a rating file."""
    schema = "version string, description string, functions array<struct<file:string,function_name:string,language:string,human_rating:double,n_raters:int>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("functions").alias("f")).select("f.*")


def rating_report(rated: DataFrame, rating: str = "human_rating", score: str = "score") -> DataFrame:
    """One row: rho of rating and gain, decision counts, and excellent files (4.5 or more) that are rejected."""
    gain = rated.withColumn("_gain", 1 - F.col(score))
    rho = spearman(gain, rating, "_gain")
    counts = rated.agg(
        F.count_if(F.col("assessment") == "accept").alias("n_accept"), F.count_if(F.col("assessment") == "marginal").alias("n_marginal"), F.count_if(F.col("assessment") == "reject").alias("n_reject"),
        F.count_if((F.col(rating) >= 4.5) & (F.col("assessment") == "reject")).alias("excellent_rejected"),
    )
    return rho.join(F.broadcast(counts), F.lit(True))  # one row each


def discrimination(scored: DataFrame, score: str, in_corpus: Column, language: str) -> DataFrame:
    """Per language: effect size between units in and out of the corpus, and whether it is over 0.5."""
    return cohens_d(scored, score, in_corpus, [language]).withColumn("passed", F.col("d") > 0.5)
