"""Queries over documents and pages: entropy, loss, decisions, ranking, line and path classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lines, paths, scoring, text_metrics
from plumbline.operators import order

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, entropy, score, decision of every document."""
    docs = table(spark, sf_dir, "documents")
    e = docs.select("doc_id", "source", "lang", text_metrics.byte_entropy("text").alias("entropy"))
    e = e.withColumn("score", F.round(scoring.entropy_loss(F.col("entropy")), 9))
    return e.withColumn("decision", scoring.decision(F.col("score")))


def scored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for queries that pass over the scores several times: texts are read and counted once, and the scores are written to the checkpoint folder."""
    return order.once(scored(spark, sf_dir))


#: The same in SQL.
SCORED = r"""
    WITH bytes AS (
        SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b FROM documents),
    hist AS (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY ALL),
    h AS (SELECT doc_id, sum(c) AS n, sum(c * log2(c)) AS s FROM hist GROUP BY doc_id),
    ent AS (
        SELECT d.doc_id, d.source, d.lang, d.text, coalesce(CASE WHEN n > 0 THEN log2(n) - s / n END, 0) AS entropy
        FROM documents d LEFT JOIN h USING (doc_id)),
    sc AS (SELECT *, round(greatest(0, least(1, 1 - entropy / 8)), 9) AS score FROM ent),
    scored AS (SELECT *, CASE WHEN score < 0.4 THEN 'accept' WHEN score > 0.6 THEN 'reject' ELSE 'warn' END AS decision FROM sc)
"""


@query(SCORED + "SELECT doc_id, round(entropy, 6) AS entropy FROM scored")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.round("entropy", 6).alias("entropy"))


@query(SCORED + "SELECT doc_id, score, decision FROM scored")
def entropy_loss_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "score", "decision")


def highlighted(df: DataFrame, score: str, key: str, bottom: int | None = None, share: float | None = None) -> DataFrame:
    """Rank by score, best first, and mark the worst: ``bottom`` of them, a share in per cent, or the worst fifth up to three; ties at the edge count too, and none if all are alike."""
    total = df.agg(F.count(score).alias("n"), (F.max(score) - F.min(score)).alias("spread")).first()
    n, spread = total["n"], total["spread"] or 0.0
    most = bottom if bottom is not None else int(n * share / 100) if share is not None else min(3, int(n * 0.2))
    most = max(0, min(most, n))
    ranks = order.ranked(df, score, [F.col(key)])
    if not most or not spread:
        return ranks.withColumn("highlighted", F.lit(False))
    edge = ranks.where(F.col("rank") == n - most + 1).agg(F.max(score)).first()[0]
    return ranks.withColumn("highlighted", F.col(score) >= F.lit(edge))


@query(SCORED + """, r AS (
        SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS rank, count(*) OVER () AS n, max(score) OVER () - min(score) OVER () AS spread FROM scored),
    k AS (SELECT *, least(3, CAST(floor(n * 0.2) AS BIGINT)) AS m FROM r),
    edge AS (SELECT score AS cut FROM k WHERE rank = n - m + 1)
    SELECT doc_id, score, rank, CASE WHEN m = 0 OR spread = 0 THEN false ELSE score >= (SELECT cut FROM edge) END AS highlighted FROM k""")
def rank_bottom_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlighted(scored_once(spark, sf_dir), "score", "doc_id").select("doc_id", "score", F.col("rank").cast("long").alias("rank"), "highlighted")


@query("""
    SELECT lang AS language, false AS supported, count(*) AS n,
           'language not supported: ' || coalesce(lang, '?') AS warning
    FROM documents WHERE lower(coalesce(lang, '')) NOT IN ('python','javascript','typescript','go','rust','java','c','cpp','ruby','kotlin') GROUP BY lang""")
def language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang")
    known = paths.is_supported(F.col("lang"))
    warning = F.when(~known, F.concat(F.lit("language not supported: "), F.coalesce("lang", F.lit("?"))))
    return docs.groupBy(F.col("lang").alias("language"), known.alias("supported"), warning.alias("warning")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
    t AS (SELECT doc_id, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM l)
    SELECT d.doc_id, count(*) FILTER (x <> '' AND NOT starts_with(x, '#')) AS nbnc FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def nbnc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lines.code_lines(F.col("text"), "python").alias("nbnc"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
    t AS (SELECT doc_id, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM l),
    c AS (
        SELECT doc_id, regexp_matches(x, '^(import |from |__all__|["'']|#)') OR x IN (')', ']', '},', ');', '],')
               OR (NOT regexp_matches(x, '^(def |class |if |for |while |return |raise |try |with |async )')
                   AND regexp_matches(translate(regexp_replace(regexp_replace(regexp_replace(x, ',*$', ''), '\)*$', ''), '\]*$', ''), '"'' ', ''), '^[\p{L}_][\p{L}\p{N}_]*$')) AS imp
        FROM t WHERE x <> '')
    SELECT d.doc_id, round(avg(CAST(imp AS DOUBLE)), 6) AS import_share, count(imp) >= 2 AND coalesce(avg(CAST(imp AS DOUBLE)), 0) >= 0.8 AS is_barrel
    FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def barrel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(lines.import_share(F.col("text"), "python"), 6).alias("import_share"), lines.is_barrel(F.col("text"), "python").alias("is_barrel"))


#: Rules in their order; the last match wins with its whole pair.
RULES = [("*example.com*", 0.3, 0.7), ("*/fr/*", 0.35, None), ("*/en/*", None, 0.65), ("*page=2*", 0.2, 0.5)]


@query("""
    SELECT page_id, CASE WHEN url LIKE '%page=2%' THEN 3 WHEN url LIKE '%/en/%' THEN 2 WHEN url LIKE '%/fr/%' THEN 1 WHEN url LIKE '%example.com%' THEN 0 ELSE -1 END AS rule,
           CASE WHEN url LIKE '%page=2%' THEN 0.2 WHEN url LIKE '%/en/%' THEN NULL WHEN url LIKE '%/fr/%' THEN 0.35 WHEN url LIKE '%example.com%' THEN 0.3 ELSE 0.4 END::DOUBLE AS accept,
           CASE WHEN url LIKE '%page=2%' THEN 0.5 WHEN url LIKE '%/en/%' THEN 0.65 WHEN url LIKE '%/fr/%' THEN NULL WHEN url LIKE '%example.com%' THEN 0.7 ELSE 0.6 END::DOUBLE AS reject
    FROM pages""")
def path_rule_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return paths.path_thresholds(pages, "url", RULES, scoring.ACCEPT, scoring.REJECT).select("page_id", "rule", "accept", "reject")


#: A page stands for a file: its folder from its number, its content from its html.
_PATH = "concat(element_at(array('src', 'tests', 'gen', 'models', 'proto', 'pkg/types'), cast(page_id % 6 as int) + 1), '/', element_at(array('a.py', 'test_b.py', '__init__.py', 'c.toml', 'd.rs', 'e.txt', 'f_test.py'), cast(page_id % 7 as int) + 1))"


@query(r"""
    WITH p AS (SELECT page_id, (['src','tests','gen','models','proto','pkg/types'])[page_id % 6 + 1] || '/' || (['a.py','test_b.py','__init__.py','c.toml','d.rs','e.txt','f_test.py'])[page_id % 7 + 1] AS path,
                      page_id % 6 AS d, page_id % 7 AS f, html,
                      list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '' AND NOT starts_with(x, '#')) AS rows FROM pages),
    q AS (SELECT *, len(rows) AS n, len(list_filter(rows, lambda x: regexp_matches(x, '^(import |from |__all__)'))) AS imports,
                 len(list_filter(rows, lambda x: starts_with(x, 'class ') OR starts_with(x, 'type '))) AS kinds,
                 len(list_filter(rows, lambda x: starts_with(x, 'def ') AND NOT starts_with(x, 'def __'))) AS defs FROM p)
    SELECT page_id, path, CASE WHEN f = 3 THEN 'schema' WHEN f IN (1, 6) THEN 'test'
           WHEN f = 2 THEN CASE WHEN html IS NULL OR n = 0 OR (n < 50 AND imports > 0.5 * n) THEN 'init' ELSE 'implementation' END
           WHEN d = 1 THEN 'test' WHEN d IN (2, 4) THEN 'generated'
           WHEN d IN (3, 5) AND (html IS NULL OR n = 0 OR (kinds > 0 AND defs <= kinds) OR (n < 20 AND defs = 0)) THEN 'schema'
           WHEN f IN (0, 4) THEN 'implementation' ELSE 'unknown' END AS category FROM q""")
def categorize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"), "html")
    return pages.select("page_id", "path", paths.category(F.col("path"), F.col("html")).alias("category"))


@query(SCORED + "SELECT decision, count(*) AS n, round(avg(score), 6) AS mean_score FROM scored GROUP BY decision")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def summary(df: DataFrame) -> DataFrame:
    """One row: counts, mean score, overall decision and exit codes."""
    is_ = lambda d: F.count_if(F.col("decision") == d)
    s = df.agg(F.count(F.lit(1)).alias("total_files"), is_("accept").alias("accepted"), is_("warn").alias("warned"), is_("reject").alias("rejected"), F.avg("score").alias("mean"))
    r, w = F.col("rejected"), F.col("warned")
    return s.select(
        "total_files", "accepted", "warned", "rejected", F.round("mean", 6).alias("mean_score"), scoring.overall(r, w).alias("overall_decision"),
        scoring.exit_code(r, w).alias("exit_code"), scoring.exit_code(r, w, strict=True).alias("exit_strict"), scoring.exit_code(r, w, lenient=True).alias("exit_lenient"),
    )


_SUMMARY = SCORED + """, s AS (SELECT count(*) AS total_files, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'warn') AS warned,
                                     count(*) FILTER (decision = 'reject') AS rejected, round(avg(score), 6) AS mean_score FROM scored) """


@query(_SUMMARY + "SELECT total_files, accepted, warned, rejected, mean_score, CASE WHEN rejected > 0 THEN 'reject' WHEN warned > 0 THEN 'warn' ELSE 'accept' END AS overall_decision FROM s")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scored(spark, sf_dir)).drop("exit_code", "exit_strict", "exit_lenient")


@query(_SUMMARY + """SELECT CASE WHEN rejected > 0 THEN 2 WHEN warned > 0 THEN 1 ELSE 0 END AS exit_code,
    CASE WHEN rejected > 0 OR warned > 0 THEN 2 ELSE 0 END AS exit_strict, CASE WHEN rejected > 0 THEN 2 ELSE 0 END AS exit_lenient FROM s""")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scored(spark, sf_dir)).select("exit_code", "exit_strict", "exit_lenient")


@query(SCORED + """SELECT doc_id, CASE WHEN score > 0.5 THEN 'reject' WHEN score < 0.42 THEN 'accept' ELSE 'warn' END AS both_set,
    CASE WHEN score > 0.45 THEN 'reject' ELSE decision END AS reject_only, CASE WHEN score >= 0.5 THEN 'reject' WHEN score <= 0.42 THEN 'accept' ELSE 'warn' END AS inclusive FROM scored""")
def threshold_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d, none = F.col("score"), F.col("decision"), F.lit(None).cast("double")
    return scored(spark, sf_dir).select(
        "doc_id", scoring.overridden(d, s, F.lit(0.42), F.lit(0.5)).alias("both_set"), scoring.overridden(d, s, none, F.lit(0.45)).alias("reject_only"),
        scoring.overridden_inclusive(d, s, F.lit(0.42), F.lit(0.5)).alias("inclusive"),
    )


@query(None)
def zlib_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and packed bytes, ratio and order measure of every document."""
    docs = table(spark, sf_dir, "documents")
    m = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("raw_bytes"), text_metrics.byte_entropy("text").alias("entropy"), text_metrics.zlib_size("text").alias("compressed_bytes"))
    return m.select("doc_id", "raw_bytes", "compressed_bytes", F.round(text_metrics.compression_ratio(F.col("raw_bytes"), F.col("compressed_bytes")), 6).alias("compression_ratio"),
                    F.round(text_metrics.birkhoff(F.col("raw_bytes"), F.col("entropy"), F.col("compressed_bytes")), 6).alias("birkhoff"))


@query(None)
def birkhoff_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full scoring without a model: entropy and order count half each; empty texts are accepted with loss 0."""
    from plumbline.operators.evaluate import evaluate_texts

    return evaluate_texts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"), "decision", "assessment", "confidence", F.to_json("violations").alias("violations"))


@query(r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, rtrim(coalesce(text, ''), chr(10)) AS body FROM documents),
    s AS (SELECT doc_id, text, len(string_split(body, chr(10))) AS n FROM d)
    SELECT doc_id, n AS line_count, array_to_string(list_slice(string_split(text, chr(10)), 2, least(3, n)), chr(10)) AS lines_2_3 FROM s""")
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = lines.line_count(F.col("text"))
    return docs.select("doc_id", n.cast("long").alias("line_count"), lines.cut_lines(F.col("text"), F.lit(2), F.least(F.lit(3), n)).alias("lines_2_3"))
