"""Queries over part, supplier and documents for scoring branches: weights, damping, scorecards, anti-patterns, caches, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.operators import code, records, statistics
from plumbline.plans.stats_queries import _rounded
from plumbline.plans.text_queries import SCORED, scored, scored_once, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dimensions and a dominance flag of every part; drift and alignment unknown for every second one, the exemplar distance for every third."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    known, near = F.col("p_partkey") % 2 == 1, F.col("p_partkey") % 3 != 0
    return p.select(
        "p_partkey", "p_size", F.when(known, F.col("p_size") / 40.0).alias("drift"), F.when(known, F.col("p_retailprice") / 2500.0).alias("virtue"),
        (F.col("p_size") % 9).cast("double").alias("entropy"), (F.col("p_size") / 50.0).alias("order"), F.when(near, (F.col("p_partkey") % 100) / 100.0).alias("ncd"), (F.col("p_size") > 35).alias("dominant"),
    )


_MEASURED = """
    WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 1 THEN p_size / 40.0 END AS drift, CASE WHEN p_partkey % 2 = 1 THEN p_retailprice / 2500.0 END AS virtue,
            CAST(p_size % 9 AS DOUBLE) AS entropy, p_size / 50.0 AS ord, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 100) / 100.0 END AS ncd, p_size > 35 AS dominant FROM part),
    n AS (SELECT *, coalesce(least(drift, 1), 0) AS n0, coalesce(least(virtue, 1), 0) AS n1, greatest(0, least(1, 1 - entropy / 8)) AS n2, ord AS n3, coalesce(ncd, 0) AS n4,
            CASE WHEN drift IS NOT NULL AND ncd IS NOT NULL THEN [0.3, 0.3, 0.15, 0.15, 0.1] WHEN drift IS NOT NULL THEN [0.35, 0.35, 0.15, 0.15, 0] WHEN ncd IS NOT NULL THEN [0, 0, 0.3, 0.3, 0.4] ELSE [0, 0, 0.5, 0.5, 0] END AS w FROM p),
    l AS (SELECT *, greatest(0, least(1, n0 * w[1] + n1 * w[2] + n2 * w[3] + n3 * w[4] + n4 * w[5])) AS plain,
            greatest(0, least(1, n0 / 2 * w[1] + n1 / 2 * w[2] + n2 * w[3] + n3 * w[4] + n4 * w[5])) AS half FROM n)
"""


@query(_MEASURED + "SELECT p_partkey, round(plain, 6) AS plain_loss, round(CASE WHEN dominant THEN greatest(half, 0.4) ELSE plain END, 6) AS loss, CAST(w AS DOUBLE[])[1] AS weight_drift, CAST(w AS DOUBLE[])[5] AS weight_ncd FROM l")
def weighted_damped_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss under all four weight configurations, damped where declarations dominate."""
    m = _measured(spark, sf_dir)
    dims = scoring.dimensions(F.col("drift"), F.col("virtue"), F.col("entropy"), F.col("order"), F.col("ncd"), 1.0, 1.0)
    of = lambda i: F.get("dims", F.lit(i))["weight"]
    return m.withColumn("dims", dims).select(
        "p_partkey", F.round(scoring.loss(F.col("dims")), 6).alias("plain_loss"), F.round(scoring.damped_loss(F.col("dims"), F.col("dominant")), 6).alias("loss"), of(0).alias("weight_drift"), of(4).alias("weight_ncd")
    )


@query(_MEASURED + """, s AS (SELECT l.*, CAST(w AS DOUBLE[]) AS v FROM l),
    d AS (SELECT p_partkey, plain, unnest([struct_pack(place := 0, dimension := 'manifold_drift', k := n0 * v[1], w := v[1]), struct_pack(place := 1, dimension := 'manifold_alignment', k := n1 * v[2], w := v[2]),
        struct_pack(place := 2, dimension := 'token_entropy', k := n2 * v[3], w := v[3]), struct_pack(place := 3, dimension := 'compression_structure', k := n3 * v[4], w := v[4]),
        struct_pack(place := 4, dimension := 'ncd_exemplar_distance', k := n4 * v[5], w := v[5])]) AS x FROM s WHERE plain > 0),
    r AS (SELECT p_partkey, x.dimension AS dimension, round(x.k, 6) AS weighted, row_number() OVER (PARTITION BY p_partkey ORDER BY round(x.k / plain, 9) DESC, x.place) AS rank FROM d WHERE x.w > 0)
    SELECT p_partkey, rank, weighted FROM r WHERE rank <= 3""")
def violation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top three contributions of every part under its weight configuration."""
    m = _measured(spark, sf_dir)
    dims = scoring.dimensions(F.col("drift"), F.col("virtue"), F.col("entropy"), F.col("order"), F.col("ncd"), 1.0, 1.0)
    v = m.withColumn("v", scoring.violations(dims, scoring.loss(dims), 3)).select("p_partkey", F.posexplode("v").alias("pos", "x"))
    return v.select("p_partkey", (F.col("pos") + 1).cast("long").alias("rank"), F.round(F.col("x.weighted"), 6).alias("weighted"))


_CARD = [("m1_birkhoff", True), ("m2_compression_structure", True), ("m3_compression_ratio", True), ("m4_shannon_entropy", True), ("m5_ncd_exemplar", True),
         ("q1_birkhoff", False), ("q2_compression_structure", False), ("q3_token_entropy", False), ("q4_ncd_exemplar", False), ("q5_overall", False)]


@query(_MEASURED + """, c AS (SELECT CASE WHEN p_size % 4 <> 0 THEN ord END AS b, CASE WHEN p_size % 4 <> 0 THEN p_size / 30.0 END AS ratio, entropy AS e, ncd, plain FROM l),
    k AS (SELECT coalesce(b > 0.8, true) AS m1_birkhoff, coalesce(b < 0.5, true) AS m2_compression_structure, coalesce(ratio < 0.8, true) AS m3_compression_ratio, coalesce(e BETWEEN 3.5 AND 6.5, true) AS m4_shannon_entropy, coalesce(ncd < 0.5, true) AS m5_ncd_exemplar,
        coalesce(b, 0) AS q1_birkhoff, coalesce(b, 0) AS q2_compression_structure, 1 - least(coalesce(e, 0) / 8, 1) AS q3_token_entropy, coalesce(ncd, 0) AS q4_ncd_exemplar, plain AS q5_overall FROM c)
    """ + " UNION ALL ".join(
        f"SELECT '{n}' AS name, round(avg(CAST({n} AS DOUBLE)), 6) AS pass_rate, NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM k" if is_check
        else f"SELECT '{n}' AS name, NULL::DOUBLE AS pass_rate, round(avg({n}), 6) AS mean, round(CAST(min({n}) AS DOUBLE), 6) AS min, round(CAST(max({n}) AS DOUBLE), 6) AS max FROM k" for n, is_check in _CARD))
def scorecard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten columns of the scorecard, with metrics missing in every fourth size."""
    m = _measured(spark, sf_dir)
    dims = scoring.dimensions(F.col("drift"), F.col("virtue"), F.col("entropy"), F.col("order"), F.col("ncd"), 1.0, 1.0)
    there = F.col("p_size") % 4 != 0
    s = m.select(
        F.when(there, F.col("order")).alias("birkhoff"), F.lit(None).cast("double").alias("compression_structure"), F.when(there, F.col("p_size") / 30.0).alias("compression_ratio"),
        "entropy", "ncd", F.col("ncd").alias("ncd_shown"), scoring.loss(dims).alias("score"),
    )
    return _rounded(records.scorecard_summary(records.scorecard(s), [n for n, _ in _CARD]))


@query("""
    WITH u AS (SELECT p_partkey, p_retailprice * 1.5 AS volume, CAST(p_size AS DOUBLE) AS difficulty, (p_size % 5) / 100.0 AS density, p_partkey % 2 = 0 AS flat FROM part),
    a AS (SELECT p_partkey, 'phantom_authorship' AS name FROM u WHERE volume > 2000 AND flat UNION ALL SELECT p_partkey, 'builders_trap' FROM u WHERE density < 0.02 AND difficulty > 30)
    SELECT name, count(*) AS n FROM a GROUP BY name""")
def anti_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both anti-patterns over feature vectors made of parts: trees of four labels (entropy 2) and of 64 (entropy 6)."""
    few, many = [0.25] * 4 + [0.0] * 60, [1 / 64] * 64
    bins = F.when(F.col("p_partkey") % 2 == 0, F.array(*map(F.lit, few))).otherwise(F.array(*map(F.lit, many)))
    counts = F.array(F.col("p_retailprice") * 1.5, F.col("p_size").cast("double"), F.lit(0.0), F.lit(1.0), (F.col("p_size") % 5) / 100.0)
    units = table(spark, sf_dir, "part").select("p_partkey", F.concat(counts, bins).alias("features"))
    return records.anti_pattern_counts(code.anti_patterns(units, ["p_partkey"]))


@query("""
    WITH c AS (SELECT source AS path, 'old' AS h, count(*) AS n FROM documents WHERE source < 'src4' GROUP BY source),
    e AS (SELECT source AS path, 'new' AS h, count(*) AS n FROM documents WHERE source >= 'src2' GROUP BY source)
    SELECT * FROM c WHERE path NOT IN (SELECT path FROM e) UNION ALL SELECT * FROM e""")
def cache_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds the sources before src4; those from src2 on were evaluated anew."""
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    entry = lambda rows, h: rows.select("path", F.lit(h).alias("h"), "n")
    return records.refreshed(entry(s.where("path < 'src4'"), "old"), entry(s.where("path >= 'src2'"), "new"), "path")


@query("""
    SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size / 100.0 END, CASE WHEN p_partkey % 2 = 0 THEN 0.0 END, 0.4) AS accept FROM part""")
def threshold_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit, calibrated (0 is a value) and default thresholds."""
    p = table(spark, sf_dir, "part")
    explicit, calibrated = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 100.0), F.when(F.col("p_partkey") % 2 == 0, F.lit(0.0))
    return p.select("p_partkey", scoring.resolved(explicit, calibrated, scoring.ACCEPT).alias("accept"))


@query(SCORED + ", k AS (SELECT " + ", ".join(f"quantile_cont(score, {s}) AS x{i}" for i, s in enumerate(statistics.KNOTS.values())) + """ FROM scored),
    q AS (SELECT CASE WHEN x0 = x6 THEN 50 ELSE 100 - CASE WHEN score >= x6 THEN 100 WHEN score < x0 THEN 0
        WHEN score >= x5 THEN 90 + (score - x5) / (x6 - x5) * 10 WHEN score >= x4 THEN 75 + (score - x4) / (x5 - x4) * 15 WHEN score >= x3 THEN 50 + (score - x3) / (x4 - x3) * 25
        WHEN score >= x2 THEN 25 + (score - x2) / (x3 - x2) * 25 WHEN score >= x1 THEN 10 + (score - x1) / (x2 - x1) * 15 ELSE (score - x0) / (x1 - x0) * 10 END END AS p FROM scored, k)
    SELECT round(avg(p), 4) AS mean_percentile, count(*) AS n FROM q""")
def mean_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality percentile of all documents."""
    s = scored_once(spark, sf_dir)
    knots = statistics.distribution(s, "score").first()  # seven numbers
    p = scoring.quality_percentile(F.col("score"), {k: F.lit(float(knots[k])) for k in statistics.KNOTS})
    return s.agg(F.round(F.avg(p), 4).alias("mean_percentile"), F.count(p).alias("n"))


@query("""SELECT vec_id, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id % 7 <> 0 AS finite FROM embeddings""")
def finite_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without null, NaN or infinite values; every seventh is given one of them."""
    from plumbline.operators.model import finite

    bad = F.get(F.array(F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf"))), (F.col("vec_id") % 3).cast("int"))
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", finite(F.when(F.col("vec_id") % 7 == 0, F.array_append(v, bad)).otherwise(v)).alias("finite"))


#: Knots of a training distribution that some documents' scores lie beyond on both sides.  Scores have nine digits, so that percentiles of nine have no ties to round.
_TRAINED = {"min": 0.36, "p10": 0.4, "p25": 0.42, "median": 0.45, "p75": 0.48, "p90": 0.52, "max": 0.6}
_PERCENTILE = SCORED + """, k(a, b, ya, yb) AS (VALUES (0.36, 0.4, 0, 10), (0.4, 0.42, 10, 25), (0.42, 0.45, 25, 50), (0.45, 0.48, 50, 75), (0.48, 0.52, 75, 90), (0.52, 0.6, 90, 100)),
    p AS (SELECT doc_id, score, decision, 100 - CASE WHEN score >= 0.6 THEN 100 WHEN score < 0.36 THEN 0 ELSE CAST(ya AS DOUBLE) + (score - a) / (CAST(b AS DOUBLE) - a) * (yb - ya) END AS percentile
          FROM scored LEFT JOIN k ON score >= CAST(a AS DOUBLE) AND score < CAST(b AS DOUBLE)) """


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import reports

    return scored(spark, sf_dir).withColumn("percentile", F.round(reports.percentile(F.col("score"), _TRAINED), 9))


@query(_PERCENTILE + """SELECT doc_id, CASE decision WHEN 'accept' THEN 'note' WHEN 'warn' THEN 'warning' ELSE 'error' END AS level, round(percentile, 9) AS percentile,
    'Score: ' || printf('%.3f', score) || ' (p' || CAST(round_even(round(percentile, 9), 0) AS INTEGER) || ' — better than ' || CAST(round_even(round(percentile, 9), 0) AS INTEGER) || '% of training corpus) [' || decision || ']' AS message FROM p""")
def sarif_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, percentile and message of every document's SARIF result."""
    from plumbline.operators import reports

    return _placed(spark, sf_dir).select("doc_id", records.level(F.col("decision")).alias("level"), "percentile", reports.message(F.col("score"), F.col("percentile"), F.col("decision")).alias("message"))


@query(_PERCENTILE + """SELECT count(*) AS total_files, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'warn') AS warned, count(*) FILTER (decision = 'reject') AS rejected,
    round(avg(score), 6) AS mean_score, round(avg(round(percentile, 9)), 4) AS mean_percentile,
    CASE WHEN count(*) FILTER (decision = 'reject') > 0 THEN 'reject' WHEN count(*) FILTER (decision = 'warn') > 0 THEN 'warn' ELSE 'accept' END AS overall_decision FROM p""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a report, with the mean percentile."""
    from plumbline.operators import reports

    s = reports.summary(_placed(spark, sf_dir))
    return s.select("total_files", "accepted", "warned", "rejected", F.round("mean_score", 6).alias("mean_score"), F.round("mean_percentile", 4).alias("mean_percentile"), "overall_decision")
