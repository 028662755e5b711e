"""Queries over distributions, samples, ratings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.operators import statistics
from plumbline.plans.text_queries import SCORED, scored_once, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SEVEN = ", ".join(f"round(quantile_cont({{v}}, {s}), 6) AS \"{k}\"" for k, s in statistics.KNOTS.items())
_JOINED = SCORED + ", j AS (SELECT s.*, quality, toxic FROM scored s JOIN labels USING (doc_id))"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_once(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


@query(SCORED + "SELECT source, count(*) AS n, " + _SEVEN.format(v="score") + " FROM scored GROUP BY source")
def score_distribution_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.distribution(scored_once(spark, sf_dir), "score", ["source"]))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, " + _SEVEN.format(v="l_extendedprice") + " FROM lineitem GROUP BY ALL")
def price_distribution_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return _rounded(statistics.distribution(items, "l_extendedprice", ["l_returnflag", "l_linestatus"]))


@query(SCORED + "SELECT round(quantile_cont(score, 0.25), 6) AS accept, round(quantile_cont(score, 0.75), 6) AS reject, count(*) >= 10 AND quantile_cont(score, 0.25) < quantile_cont(score, 0.75) AS valid FROM scored")
def derive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = statistics.distribution(scored_once(spark, sf_dir), "score")
    return d.select(F.round("p25", 6).alias("accept"), F.round("p75", 6).alias("reject"), ((F.col("n") >= 10) & (F.col("p25") < F.col("p75"))).alias("valid"))


@query(SCORED + ", k AS (SELECT " + ", ".join(f'quantile_cont(score, {s}) AS x{i}' for i, s in enumerate(statistics.KNOTS.values())) + """ FROM scored)
    SELECT doc_id, round(CASE WHEN x0 = x6 THEN 50 ELSE 100 - CASE WHEN score >= x6 THEN 100 WHEN score < x0 THEN 0
        WHEN score >= x5 THEN 90 + (score - x5) / (x6 - x5) * 10 WHEN score >= x4 THEN 75 + (score - x4) / (x5 - x4) * 15 WHEN score >= x3 THEN 50 + (score - x3) / (x4 - x3) * 25
        WHEN score >= x2 THEN 25 + (score - x2) / (x3 - x2) * 25 WHEN score >= x1 THEN 10 + (score - x1) / (x2 - x1) * 15 ELSE (score - x0) / (x1 - x0) * 10 END END, 4) AS percentile
    FROM scored, k""")
def quality_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_once(spark, sf_dir)
    knots = statistics.distribution(s, "score").first()  # seven numbers
    values = {k: F.lit(float(knots[k])) for k in statistics.KNOTS}
    return s.select("doc_id", F.round(scoring.quality_percentile(F.col("score"), values), 4).alias("percentile"))


@query(_JOINED + """ SELECT quality, count(*) AS n_files, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(coalesce(stddev_samp(score), 0), 6) AS std,
    count(*) FILTER (decision = 'accept') AS n_accept, count(*) FILTER (decision = 'warn') AS n_warn, count(*) FILTER (decision = 'reject') AS n_reject FROM j GROUP BY quality""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.corpus_stats(judged(spark, sf_dir), "score", ["quality"]))


@query(_JOINED + """, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM j)
    SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality <> 1) AS n2,
           CAST(sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0 AS DOUBLE) AS u FROM r""")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.mann_whitney(judged(spark, sf_dir), "score", F.col("quality") == 1).select("n1", "n2", "u")


@query(_JOINED + """, s AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality <> 1) AS n2, avg(score) FILTER (quality = 1) AS m1, avg(score) FILTER (quality <> 1) AS m2,
        var_samp(score) FILTER (quality = 1) AS v1, var_samp(score) FILTER (quality <> 1) AS v2 FROM j)
    SELECT n1, n2, round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM s""")
def cohens_d_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.cohens_d(judged(spark, sf_dir), "score", F.col("quality") == 1))


@query("""
    WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS ry FROM part)
    SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice"))


@query(_JOINED + """, r AS (SELECT rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS rx, rank() OVER (ORDER BY 1 - score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ry FROM j)
    SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.spearman(judged(spark, sf_dir).withColumn("gain", 1 - F.col("score")), "quality", "gain"))


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 20000, F.lit(1.0)).alias("text_length"))
    j = judged(spark, sf_dir).join(docs, "doc_id")
    return j.select("doc_id", "score", "decision", F.when(F.col("quality") == 1, "implementation").otherwise("init").alias("category"), F.col("score").alias("token_entropy"), "text_length")


_DIMS = _JOINED + """, c AS (SELECT j.doc_id, score, decision, CASE WHEN quality = 1 THEN 'implementation' ELSE 'init' END AS category, score AS token_entropy, least(d.n_chars / 20000, 1) AS text_length FROM j JOIN documents d USING (doc_id)),
    m AS (SELECT category, median(score) AS med, count(*) AS n FROM c GROUP BY category),
    l AS (SELECT category, 'token_entropy' AS dimension, token_entropy AS v, score FROM c UNION ALL SELECT category, 'text_length', text_length, score FROM c),
    s AS (SELECT category, dimension, avg(v) AS mean, stddev_pop(v) AS std, any_value(n) AS n, count(*) FILTER (score <= med) AS nl, count(*) FILTER (score > med) AS nh, avg(v) FILTER (score <= med) AS ml, avg(v) FILTER (score > med) AS mh,
                 var_pop(v) FILTER (score <= med) AS vl, var_pop(v) FILTER (score > med) AS vh FROM l JOIN m USING (category) WHERE n >= 2 GROUP BY ALL),
    dd AS (SELECT category, dimension, mean, std, CASE WHEN mean > 0 THEN std / mean ELSE 0 END AS cv,
                  CASE WHEN category = 'implementation' AND n >= 10 AND nl >= 2 AND nh >= 2 THEN (mh - ml) / sqrt((vl * (nl - 1) + vh * (nh - 1)) / (nl + nh - 2)) END AS cohens_d FROM s)
"""


@query(_DIMS + """SELECT category, dimension, round(mean, 6) AS mean, round(std, 6) AS std, round(cv, 6) AS cv, round(cohens_d, 6) AS cohens_d,
    CASE WHEN abs(cohens_d) > 0.8 THEN 'strong' WHEN abs(cohens_d) > 0.5 THEN 'medium' WHEN abs(cohens_d) > 0.2 THEN 'weak' ELSE 'noise' END AS signal FROM dd""")
def dimension_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = statistics.dimension_discrimination(_dimensions(spark, sf_dir), "category", ["token_entropy", "text_length"], "score")
    return _rounded(d).withColumn("signal", scoring.signal(F.col("cohens_d")))


@query(_JOINED + "SELECT round(avg(CASE WHEN quality = 1 THEN CAST(decision = 'reject' AS DOUBLE) END), 6) AS fp_rate, round(avg(CASE WHEN quality <> 1 THEN CAST(decision = 'accept' AS DOUBLE) END), 6) AS fn_rate FROM j")
def fp_fn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.fp_fn(judged(spark, sf_dir), F.col("quality") == 1))


def _targets(df: DataFrame) -> DataFrame:
    """Targets of a set of scored files with category and quality."""
    medians = statistics.order.percentiles(df, "score", {"median": 0.5}, ["category"])
    gap = medians.agg((F.max(F.when(F.col("category") == "init", F.col("median"))) - F.max(F.when(F.col("category") == "implementation", F.col("median")))).alias("sc_002_impl_vs_init_gap"))
    strong = statistics.dimension_discrimination(df, "category", ["token_entropy", "text_length"], "score").agg(F.count_if(F.abs("cohens_d") > 0.5).cast("double").alias("sc_003_dimension_discrimination"))
    rates = statistics.fp_fn(df, F.col("category") == "implementation").select(F.col("fp_rate").alias("sc_004_fp_rate"), F.col("fn_rate").alias("sc_005_fn_rate"))
    count = df.agg(F.count(F.lit(1)).cast("double").alias("sc_001_file_count"))
    row = count.join(F.broadcast(gap), F.lit(True)).join(F.broadcast(strong), F.lit(True)).join(F.broadcast(rates), F.lit(True))  # one row each
    return statistics.targets(row)


_TARGET_SQL = """, g AS (SELECT max(med) FILTER (category = 'init') - max(med) FILTER (category = 'implementation') AS gap FROM m),
    v AS (SELECT CAST((SELECT count(*) FROM c) AS DOUBLE) AS a, (SELECT gap FROM g) AS b, CAST((SELECT count(*) FILTER (abs(cohens_d) > 0.5) FROM dd) AS DOUBLE) AS e,
        (SELECT avg(CASE WHEN category = 'implementation' THEN CAST(decision = 'reject' AS DOUBLE) END) FROM c) AS fp, (SELECT avg(CASE WHEN category = 'init' THEN CAST(decision = 'accept' AS DOUBLE) END) FROM c) AS fn)
"""


@query(_DIMS + _TARGET_SQL + """SELECT 'sc_001_file_count' AS name, round(a, 6) AS baseline, 500::DOUBLE AS target, 'higher_is_better' AS direction, a >= 500 AS met FROM v
    UNION ALL SELECT 'sc_002_impl_vs_init_gap', round(b, 6), 0.15, 'higher_is_better', coalesce(b >= 0.15, false) FROM v
    UNION ALL SELECT 'sc_003_dimension_discrimination', round(e, 6), 2, 'higher_is_better', e >= 2 FROM v
    UNION ALL SELECT 'sc_004_fp_rate', round(fp, 6), 0.2, 'lower_is_better', coalesce(fp <= 0.2, false) FROM v
    UNION ALL SELECT 'sc_005_fn_rate', round(fn, 6), 0.4, 'lower_is_better', coalesce(fn <= 0.4, false) FROM v""")
def quality_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_targets(_dimensions(spark, sf_dir)))


@query(_JOINED + """, r AS (SELECT lang = 'en' AS en, count(*)::DOUBLE AS n, avg(CASE WHEN quality = 1 THEN CAST(decision = 'reject' AS DOUBLE) END) AS fp, avg(CASE WHEN quality <> 1 THEN CAST(decision = 'accept' AS DOUBLE) END) AS fn FROM j GROUP BY 1),
    t AS (SELECT en, 'sc_001_file_count' AS name, n AS v, 500::DOUBLE AS target, true AS up FROM r UNION ALL SELECT en, 'sc_004_fp_rate', fp, 0.2, false FROM r UNION ALL SELECT en, 'sc_005_fn_rate', fn, 0.4, false FROM r),
    q AS (SELECT *, coalesce(CASE WHEN up THEN v >= target ELSE v <= target END, false) AS met FROM t),
    p AS (SELECT c.name, b.v AS pv, c.v AS cv, c.target, b.met AS was_met, c.met AS now_met, CASE WHEN c.up THEN (b.v - c.v) / abs(b.v) ELSE (c.v - b.v) / abs(b.v) END AS worse FROM q c JOIN q b ON c.name = b.name AND NOT c.en AND b.en)
    SELECT name, round(pv, 6) AS previous_value, round(cv, 6) AS current_value, target, was_met, now_met, CASE WHEN was_met AND NOT now_met THEN 'failing' ELSE 'worse' END AS kind
    FROM p WHERE (was_met AND NOT now_met) OR (pv <> 0 AND worse > 0.1)""")
def regression_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all other languages against the report over English."""
    j = judged(spark, sf_dir)

    def report(part: DataFrame) -> DataFrame:
        rates = statistics.fp_fn(part, F.col("quality") == 1).select(F.col("fp_rate").alias("sc_004_fp_rate"), F.col("fn_rate").alias("sc_005_fn_rate"))
        return statistics.targets(part.agg(F.count(F.lit(1)).cast("double").alias("sc_001_file_count")).join(F.broadcast(rates), F.lit(True)))

    return _rounded(statistics.regressions(report(j.where("lang <> 'en'")), report(j.where("lang = 'en'"))))


@query("""
    WITH c AS (SELECT user_id, count(*) AS n_files, count(*) FILTER (value > 30) AS n_flagged, count(*) FILTER (value > 30 AND event_type <> 'view') AS n_fp FROM events GROUP BY user_id)
    SELECT count(*) AS n_commits, round(coalesce(avg(CAST(n_flagged > 0 AND n_flagged = n_fp AS DOUBLE)), 0), 6) AS noise_rate FROM c""")
def commit_replay_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user stands for a commit, an event for a file of it, views for implementation files."""
    c = statistics.replay(table(spark, sf_dir, "events"), "user_id", F.col("value") > 30, F.col("event_type") == "view")
    return _rounded(statistics.noise_rate(c))


def _ratings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Directives: one a document; two ratings each of those with labels, by quality and by toxicity."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    one = F.when(F.col("quality") == 1, "accurate").otherwise("inaccurate")
    two = F.when(F.col("toxic") == 1, "inaccurate").otherwise("partial")
    rows = labels.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("rater"), one.alias("rating")), F.struct(F.lit(2).alias("rater"), two.alias("rating")))).alias("r")).select("doc_id", "r.*")
    return docs, rows


@query("""
    WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'accurate' ELSE 'inaccurate' END AS rating FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'inaccurate' ELSE 'partial' END FROM labels),
    c AS (SELECT doc_id, rating, count(*) AS n FROM r GROUP BY ALL),
    m AS (SELECT doc_id, rating FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rating) = 1),
    s AS (SELECT count(*) AS total, count(*) FILTER (rating = 'accurate') AS accurate, count(*) FILTER (rating = 'partial') AS partial, count(*) FILTER (rating = 'inaccurate') AS inaccurate FROM documents LEFT JOIN m USING (doc_id))
    SELECT *, total - accurate - partial - inaccurate AS unannotated, round((accurate + partial) / (accurate + partial + inaccurate), 6) AS precision, round(accurate / (accurate + partial + inaccurate), 6) AS strict_precision FROM s""")
def majority_vote_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    directives, ratings = _ratings(spark, sf_dir)
    return _rounded(statistics.precision(directives, ratings, ["doc_id"], "rating"))


@query("""
    WITH s AS (SELECT count(*) AS pairs, avg(CAST((quality = 1) = (toxic <> 1) AS DOUBLE)) AS po, avg(CAST(quality = 1 AS DOUBLE)) AS p1, avg(CAST(toxic <> 1 AS DOUBLE)) AS p2 FROM labels)
    SELECT pairs, round((po - (p1 * p2 + (1 - p1) * (1 - p2))) / (1 - (p1 * p2 + (1 - p1) * (1 - p2))), 6) AS kappa FROM s""")
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.kappa(_ratings(spark, sf_dir)[1], ["doc_id"], "rating", "rater"))
