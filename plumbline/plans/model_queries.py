"""Queries over vectors, the fixed model, sessions, ledgers and trees."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scoring, text_metrics
from plumbline.operators import attribution, model, records, wl
from plumbline.plans.stats_queries import _rounded
from plumbline.plans.text_queries import SCORED, scored, table
from plumbline.streaming import steer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


DIM, COMPONENTS = 64, 2


def weight(i: int, j: int) -> float:
    return math.cos((i + 1) * (j + 1) * 0.1) / 8


def fixed_model(vectors: DataFrame) -> model.Model:
    """Means and deviations of the data with a fixed matrix of weights."""
    mean, std = model.standard(vectors, "embedding")
    return model.Model(mean, std, [[weight(i, j) for j in range(COMPONENTS)] for i in range(DIM)], sigma_drift=8.0, sigma_virtue=8.0)


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return model.project(e, "embedding", fixed_model(e))


_X = """
    WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    st AS (SELECT pos, avg(v) AS mean, CASE WHEN stddev_samp(v) >= 1e-10 THEN stddev_samp(v) ELSE 1 END AS std, stddev_pop(v) AS pop FROM x GROUP BY pos)
"""
_P = _X + """,
    n AS (SELECT vec_id, label, pos, v, (v - mean) / std AS xn FROM x JOIN st USING (pos)),
    w AS (SELECT i AS pos, j, cos((i + 1) * (j + 1) * 0.1) / 8 AS w FROM range(64) a(i), range(2) b(j)),
    z AS (SELECT vec_id, j, sum(xn * w) AS z FROM n JOIN w USING (pos) GROUP BY ALL),
    r AS (SELECT vec_id, pos, sum(z * w) AS rec FROM z JOIN w USING (j) GROUP BY ALL),
    c AS (SELECT n.vec_id, n.label, n.pos, n.xn, rec, rec - xn AS err FROM n JOIN r ON n.vec_id = r.vec_id AND n.pos = r.pos),
    d AS (SELECT vec_id, sqrt(sum(err * err)) AS l_drift FROM c GROUP BY vec_id),
    u AS (SELECT vec_id, sqrt(sum(z * z)) AS l_virtue FROM z GROUP BY vec_id),
    q AS (SELECT pos, sum(w * w) AS ww FROM w GROUP BY pos),
    lim AS (SELECT 2 * sqrt(greatest(sum((1 - ww) * std * std), 1e-8)) AS lim FROM q JOIN st USING (pos)),
    p AS (SELECT d.vec_id, l_drift, l_virtue, least(l_drift / 8, 1) AS nd, least(l_virtue / 8, 1) AS nv, CASE WHEN l_drift > lim THEN 'high_drift' ELSE 'nominal' END AS quality_flag FROM d JOIN u USING (vec_id), lim)
"""


@query(_X + "SELECT CAST(pos AS INTEGER) AS pos, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def standardize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.moments(table(spark, sf_dir, "embeddings"), "embedding")
    return m.select("pos", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("std_samp") >= 1e-10, F.col("std_samp")).otherwise(1.0), 6).alias("std"))


@query("""
    WITH x AS (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings), t AS (SELECT vec_id, sum(v) AS t FROM x GROUP BY vec_id)
    SELECT vec_id, round(sum(CASE WHEN v > 0 THEN -(v / t) * log2(v / t) ELSE 0 END), 6) AS wl_entropy FROM x JOIN t USING (vec_id) GROUP BY vec_id""")
def wl_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    e = e.withColumn("t", F.aggregate("a", F.lit(0.0), lambda s, x: s + x))
    return e.select("vec_id", F.round(text_metrics.bin_entropy(F.transform("a", lambda x: x / F.col("t"))), 6).alias("wl_entropy"))


@query(_P + "SELECT vec_id, round(l_drift, 6) AS l_drift, round(l_virtue, 6) AS l_virtue, quality_flag, round(nd * 0.5 + nv * 0.5, 6) AS loss FROM p")
def project_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projected(spark, sf_dir)
    loss = F.least(F.col("l_drift") / 8.0, F.lit(1.0)) * 0.5 + F.least(F.col("l_virtue") / 8.0, F.lit(1.0)) * 0.5
    return p.select("vec_id", F.round("l_drift", 6).alias("l_drift"), F.round("l_virtue", 6).alias("l_virtue"), "quality_flag", F.round(loss, 6).alias("loss"))


_TOP = _P + """, l AS (SELECT vec_id, 'manifold_drift' AS dimension, pos, err AS contribution, xn FROM c UNION ALL SELECT vec_id, 'manifold_alignment', pos, rec, xn FROM c),
    t AS (SELECT *, row_number() OVER (PARTITION BY vec_id, dimension ORDER BY round(abs(contribution), 9) DESC, pos DESC) AS rank FROM l)
"""


@query(_TOP + "SELECT vec_id, dimension, CAST(pos AS INTEGER) AS feature_index, CAST(rank AS INTEGER) AS rank, round(contribution, 6) AS contribution, round(xn, 6) AS deviation FROM t WHERE rank <= 3")
def drift_decomposition_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.contributions(projected(spark, sf_dir), "vec_id")
    top = model.top_features(rows, "vec_id", 3)
    return top.select("vec_id", "dimension", "feature_index", "rank", F.round("contribution", 6).alias("contribution"), F.round("x_norm", 6).alias("deviation"))


@query(_P + """, v AS (SELECT vec_id, 'manifold_drift' AS dimension, 0 AS place, nd AS norm FROM p UNION ALL SELECT vec_id, 'manifold_alignment', 1, nv FROM p),
    s AS (SELECT *, norm * 0.35 / (sum(norm * 0.35) OVER (PARTITION BY vec_id)) AS share FROM v)
    SELECT vec_id, dimension, round(norm, 6) AS norm, round(share, 6) AS share, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, place) AS INTEGER) AS rank FROM s QUALIFY rank <= 1""")
def violations_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projected(spark, sf_dir)
    dims = scoring.dimensions(F.col("l_drift"), F.col("l_virtue"), F.lit(8.0), F.lit(0.0), F.lit(None).cast("double"), 8.0, 8.0)
    p = p.withColumn("dims", dims).withColumn("loss", scoring.loss(F.col("dims")))
    v = p.select("vec_id", F.posexplode(scoring.violations(F.col("dims"), F.col("loss"), 1)).alias("r", "v"))
    return v.select("vec_id", "v.dimension", F.round("v.norm", 6).alias("norm"), F.round("v.share", 6).alias("share"), (F.col("r") + 1).alias("rank"))


@query(_TOP + """, x1 AS (SELECT t.vec_id, t.dimension, t.pos, t.xn, CASE WHEN t.dimension = 'manifold_drift' THEN nd ELSE nv END AS norm FROM t JOIN p USING (vec_id) WHERE rank = 1)
    SELECT vec_id, dimension, CAST(pos AS INTEGER) AS feature_index, round(norm, 6) AS norm, CASE WHEN pos < 5 THEN 'reduce_complexity' WHEN xn > 0 THEN 'extract_repeated_logic' ELSE 'review_structure' END AS category,
           CASE WHEN norm >= 0.7 THEN 'high' WHEN norm >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM x1 WHERE norm > 0.3""")
def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projected(spark, sf_dir)
    top = model.top_features(model.contributions(p, "vec_id", ["l_drift", "l_virtue"]), "vec_id", 1)
    norm = F.least(F.when(F.col("dimension") == "manifold_drift", F.col("l_drift")).otherwise(F.col("l_virtue")) / 8.0, F.lit(1.0))
    rows = top.select("vec_id", "dimension", "feature_index", F.col("x_norm").alias("deviation"), norm.alias("norm"), F.lit(True).alias("available"), F.lit(None).cast("int").alias("line_count"), F.lit(False).alias("dominant"))
    return attribution.directives(rows).select("vec_id", "dimension", "feature_index", F.round("norm", 6).alias("norm"), "category", "severity")


@query(_P + """, zz AS (SELECT vec_id, max(CASE WHEN j = 0 THEN z END) AS z0, max(CASE WHEN j = 1 THEN z END) AS z1 FROM z GROUP BY vec_id),
    k AS (SELECT *, CASE WHEN abs(z0) >= abs(z1) THEN 0 ELSE 1 END AS cluster FROM zz), m AS (SELECT cluster, avg(z0) AS m0, avg(z1) AS m1 FROM k GROUP BY cluster),
    e AS (SELECT cluster, vec_id, round(sqrt((z0 - m0) ** 2 + (z1 - m1) ** 2), 9) AS distance FROM k JOIN m USING (cluster))
    SELECT CAST(cluster AS INTEGER) AS cluster, vec_id, round(distance, 6) AS distance FROM e QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) = 1""")
def exemplar_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(model.medoids(projected(spark, sf_dir), "vec_id"))


@query(_X + """, s AS (SELECT vec_id, label, pos, (v - mean) / CASE WHEN pop > 1e-12 THEN pop ELSE 1 END AS xs, pop FROM x JOIN st USING (pos)),
    ce AS (SELECT label, pos, avg(xs) AS c, count(*) AS n FROM s GROUP BY ALL),
    di AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) ** 2)) AS dist FROM ce a JOIN ce b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL),
    cn AS (SELECT label, any_value(n) AS n FROM ce GROUP BY label)
    SELECT (SELECT count(*) FROM cn) AS n_repos, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM st WHERE pop < 1e-6) AS dead_features,
           (SELECT round(min(dist), 6) FROM di) AS min_centroid_distance, (SELECT round(avg(dist), 6) FROM di) AS mean_centroid_distance,
           round((SELECT sum(n * c * c) FROM ce) / (SELECT count(*) FROM embeddings) / (SELECT sum(CASE WHEN pop > 1e-12 THEN 1 ELSE pop * pop END) FROM st), 6) AS between_repo_variance_ratio,
           (SELECT round(min(n) / max(n), 6) FROM cn) AS sample_balance""")
def diversity_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.diversity(table(spark, sf_dir, "embeddings"), "embedding", "label")
    keys = ["n_repos", "n_vectors", "dead_features"]
    more = ["min_centroid_distance", "mean_centroid_distance", "between_repo_variance_ratio", "sample_balance"]
    row = [tuple([d[k] for k in keys] + [round(d[k], 6) for k in more])]
    return spark.createDataFrame(row, ", ".join([f"{k} long" for k in keys] + [f"{k} double" for k in more]))


@query(None)
def pca_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, share explained and calibration of a model trained on the vectors."""
    e = table(spark, sf_dir, "embeddings")
    m = model.calibrate(e, "embedding", model.pca(e, "embedding"))
    rows = [(j, round(m.evr[j], 6), round(m.sigma_drift, 6), round(m.sigma_virtue, 6)) for j in range(m.k)]
    return spark.createDataFrame(rows, "component int, explained_variance double, sigma_drift double, sigma_virtue double")


_CARD = SCORED + ", k AS (SELECT doc_id, entropy BETWEEN 3.5 AND 6.5 AS m4, 1 - least(entropy / 8, 1) AS q3, score AS q5 FROM scored)"


@query(_CARD + """ SELECT 'm4_shannon_entropy' AS name, round(avg(CAST(m4 AS DOUBLE)), 6) AS pass_rate, NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM k
    UNION ALL SELECT 'm5_ncd_exemplar', 1.0, NULL, NULL, NULL UNION ALL SELECT 'q3_token_entropy', NULL, round(avg(q3), 6), round(min(q3), 6), round(max(q3), 6) FROM k
    UNION ALL SELECT 'q5_overall', NULL, round(avg(q5), 6), round(min(q5), 6), round(max(q5), 6) FROM k""")
def scorecard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    s = scored(spark, sf_dir).withColumns({"birkhoff": none, "compression_structure": none, "compression_ratio": none, "ncd": none, "ncd_shown": none})
    return _rounded(records.scorecard_summary(records.scorecard(s), ["m4_shannon_entropy", "m5_ncd_exemplar", "q3_token_entropy", "q5_overall"]))


@query(SCORED + """SELECT doc_id, 'quality/decision' AS rule_id, CASE decision WHEN 'accept' THEN 'note' WHEN 'warn' THEN 'warning' ELSE 'error' END AS level, 'file' AS kind FROM scored
    UNION ALL SELECT doc_id, 'directive/token-entropy', CASE WHEN score >= 0.7 THEN 'error' WHEN score >= 0.5 THEN 'warning' ELSE 'note' END, 'directive' FROM scored WHERE score > 0.3""")
def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    d = s.select("doc_id", F.lit("token_entropy").alias("dimension"), F.col("score").alias("norm"), F.lit(True).alias("available"), F.lit(None).cast("int").alias("feature_index"), F.lit(None).cast("double").alias("deviation"),
                 F.lit(None).cast("int").alias("line_count"), F.lit(False).alias("dominant"))
    return records.sarif_rows(s, attribution.directives(d), "doc_id")


@query("""
    WITH f AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h FROM documents), cache AS (SELECT DISTINCT source, h FROM f WHERE source < 'src2')
    SELECT doc_id, f.source AS path, f.h AS content_hash FROM f ANTI JOIN cache ON f.source = cache.source AND f.h = cache.h""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds the sources before src2."""
    f = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return records.cache_misses(f, f.where("path < 'src2'").select("path", "content_hash").distinct(), "path", "content_hash")


@query("""
    WITH e AS (SELECT DISTINCT split_part(url, '/', 3) AS name, split_part(url, '/', 4) AS ref FROM pages),
    h AS (SELECT name, ref, 'sha256:' || sha256('{"exclude":[],"include":["**"],"name":"' || name || '","ref":"' || ref || '","url":"https://' || name || '"}') AS entry_hash, 'https://' || name || '/archive/refs/tags/' || ref || '.tar.gz' AS archive_url FROM e)
    SELECT * FROM h WHERE ref <> 'en'""")
def sync_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by host and language of the pages; the ledger holds the English ones."""
    from plumbline.functions.paths import archive_url

    part = lambda k: F.element_at(F.split("url", "/"), k)
    e = table(spark, sf_dir, "pages").select(part(3).alias("name"), part(4).alias("ref")).distinct()
    url = F.concat(F.lit("https://"), F.col("name"))
    digest = records.entry_hash(F.col("name"), url, F.col("ref"), F.array(F.lit("**")), F.array().cast("array<string>"))
    h = e.select("name", "ref", digest.alias("entry_hash"), archive_url(url, F.col("ref")).alias("archive_url"))
    return records.pending(h, h.where("ref = 'en'"), ["name", "entry_hash"])


@query("""
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, CASE WHEN doc_id % 10 = 3 THEN sha256('other') ELSE sha256(coalesce(text, '')) END AS expected FROM documents)
    SELECT doc_id, h = expected AS intact FROM d""")
def integrity_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents against recorded digests, of which every tenth is wrong."""
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 == 3, F.sha2(F.lit("other"), 256)).otherwise(own).alias("expected"))
    return records.intact(d, "text", "expected").select("doc_id", "intact")


@query("SELECT 'sha256:' || sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS corpus_hash FROM documents")
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.corpus_hash(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
    WITH RECURSIVE bytes AS (SELECT conv_id, turn, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b FROM conversations),
    hist AS (SELECT conv_id, turn, b, count(*) AS c FROM bytes GROUP BY ALL),
    h AS (SELECT conv_id, turn, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM hist GROUP BY ALL),
    e AS (SELECT c.conv_id, c.turn, greatest(0, least(1, 1 - coalesce(entropy, 0) / 8)) AS error, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS k FROM conversations c LEFT JOIN h USING (conv_id, turn)),
    s AS (
        SELECT conv_id, turn, k, error, 0.2 * error AS f, greatest(-5, least(5, error)) AS i, 0.3 * error + 0.05 * greatest(-5, least(5, error)) + 0.1 * (0.2 * error) AS u,
               greatest(0.1, least(1.5, 0.7 - 0.1 * (0.3 * error + 0.05 * greatest(-5, least(5, error)) + 0.1 * (0.2 * error)))) AS tau,
               greatest(0.1, least(0.99, 0.9 - 0.05 * (0.3 * error + 0.05 * greatest(-5, least(5, error)) + 0.1 * (0.2 * error)))) AS p FROM e WHERE k = 1
        UNION ALL
        SELECT e.conv_id, e.turn, e.k, e.error, 0.2 * e.error + 0.8 * s.f, greatest(-5, least(5, s.i + e.error)), 0.3 * e.error + 0.05 * greatest(-5, least(5, s.i + e.error)) + 0.1 * (0.2 * e.error + 0.8 * s.f - s.f),
               greatest(0.1, least(1.5, s.tau - 0.1 * (0.3 * e.error + 0.05 * greatest(-5, least(5, s.i + e.error)) + 0.1 * (0.2 * e.error + 0.8 * s.f - s.f)))),
               greatest(0.1, least(0.99, s.p - 0.05 * (0.3 * e.error + 0.05 * greatest(-5, least(5, s.i + e.error)) + 0.1 * (0.2 * e.error + 0.8 * s.f - s.f))))
        FROM s JOIN e ON e.conv_id = s.conv_id AND e.k = s.k + 1)
    SELECT conv_id, turn, round(error, 5) AS error, round(u, 5) AS u, round(tau, 5) AS tau, round(p, 5) AS p FROM s""")
def steer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = c.select("conv_id", "turn", scoring.entropy_loss(text_metrics.byte_entropy("text")).alias("error"))
    return _rounded(steer.fold(e, "conv_id", "turn", "error"), 5)


@query("""
    WITH f AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
    b AS (SELECT doc_id, n, 2 AS s, 3 AS e FROM f WHERE n >= 4 UNION ALL SELECT doc_id, n, 6, 7 FROM f WHERE n >= 8)
    SELECT doc_id, 'test' AS label, s AS start_line, e AS end_line FROM b
    UNION ALL SELECT doc_id, 'production', 1, 1 FROM f WHERE n >= 4 UNION ALL SELECT doc_id, 'production', 4, 5 FROM f WHERE n >= 8
    UNION ALL SELECT doc_id, 'production', CASE WHEN n >= 8 THEN 8 WHEN n >= 4 THEN 4 ELSE 1 END, n FROM f""")
def region_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans between given test spans: lines 2-3 and 6-7 of documents that are long enough."""
    f = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    span = lambda s, e: F.struct(F.lit(s).alias("start_line"), F.lit(e).alias("end_line"))
    b = f.select("doc_id", F.explode(F.when(F.col("n_lines") >= 8, F.array(span(2, 3), span(6, 7))).when(F.col("n_lines") >= 4, F.array(span(2, 3)))).alias("s")).select("doc_id", "s.*")
    return records.spans(b, f, "doc_id")


@query("""
    WITH t AS (SELECT 0 AS tree, 'r' || r_regionkey AS node_id, 'root' AS parent_id, 'region' AS type FROM region UNION ALL SELECT 0, 'root', NULL, 'world'
        UNION ALL SELECT 0, 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation UNION ALL SELECT 0, 'c' || c_custkey, 'n' || c_nationkey, 'customer' FROM customer),
    l0 AS (SELECT node_id, parent_id, md5(type) AS label FROM t),
    k0 AS (SELECT parent_id, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS kids FROM (SELECT parent_id, label, count(*) AS n FROM l0 WHERE parent_id IS NOT NULL GROUP BY ALL) GROUP BY parent_id),
    l1 AS (SELECT l.node_id, l.parent_id, md5(label || '|' || coalesce(kids, '')) AS label FROM l0 l LEFT JOIN k0 k ON l.node_id = k.parent_id),
    k1 AS (SELECT parent_id, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS kids FROM (SELECT parent_id, label, count(*) AS n FROM l1 WHERE parent_id IS NOT NULL GROUP BY ALL) GROUP BY parent_id),
    l2 AS (SELECT l.node_id, l.parent_id, md5(label || '|' || coalesce(kids, '')) AS label FROM l1 l LEFT JOIN k1 k ON l.node_id = k.parent_id),
    a AS (SELECT label FROM l0 UNION ALL SELECT label FROM l1 UNION ALL SELECT label FROM l2),
    b AS (SELECT CAST(CAST('0x' || left(label, 8) AS BIGINT) % 64 AS INTEGER) AS bin FROM a)
    SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 6) AS share FROM b GROUP BY bin""")
def wl_histogram_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over the tree world, region, nation, customer."""
    node = lambda t, own, up, kind: table(spark, sf_dir, t).select(F.lit(0).alias("tree"), F.concat(F.lit(own[0]), F.col(own[1]).cast("string")).alias("node_id"), up.alias("parent_id"), F.lit(kind).alias("type"))
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = node("region", ("r", "r_regionkey"), F.lit("root"), "region").unionByName(node("nation", ("n", "n_nationkey"), ref("r", "n_regionkey"), "nation"))
    t = t.unionByName(node("customer", ("c", "c_custkey"), ref("n", "c_nationkey"), "customer")).unionByName(spark.createDataFrame([(0, "root", None, "world")], "tree int, node_id string, parent_id string, type string"))
    return wl.histogram(t, 2).select("bin", "n", F.round("share", 6).alias("share"))


@query(None)
def nearest_exemplar_ncd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exemplar at the smallest compression distance to each document; null under 50 bytes.

    Exemplars are the medoids of the fixed model, one a component at most: documents whose identifiers the medoid vectors have.
    """
    from plumbline.operators.exemplars import nearest

    docs = table(spark, sf_dir, "documents")
    chosen = exemplar_medoids(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    exemplars = docs.join(F.broadcast(chosen), "doc_id", "left_semi")
    return nearest(docs, "doc_id", "text", exemplars, "doc_id", "text").select("doc_id", "nearest_exemplar_id", F.round("ncd", 6).alias("ncd"))


@query(None)
def ast_metrics_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of small sources of our own, with their counts; the tables hold no code."""
    from plumbline.operators import code

    u = code.unit_table(code.samples(spark), "file_id")
    f = lambda i, n: F.round(F.get("features", F.lit(i)), 6).alias(n)
    return u.select("file_id", "unit_idx", "name", "start_line", "end_line", f(0, "volume"), f(1, "difficulty"), f(2, "effort"), f(3, "complexity"), f(4, "density"), "partial_parse", "warning")


@query(None)
def code_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the same sources with the synthetic model: declarations, first unit, projection, decision."""
    from plumbline.operators import code

    e = code.evaluate_files(code.samples(spark), "file_id", model.synthetic())
    return e.select("file_id", F.round("score", 6).alias("score"), "decision", "assessment", "confidence", F.size("violations").alias("n_violations"))


@query(None)
def code_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import code

    d = code.declaration_table(code.samples(spark), "file_id")
    return d.select("file_id", F.round("ratio", 6).alias("ratio"), "is_dominant", "is_pure_types", F.size("regions").alias("n_regions"))


@query(None)
def code_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import code

    return code.region_table(code.samples(spark), "file_id").select("file_id", "region_idx", "label", "start_line")
