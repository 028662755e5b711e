"""The use-case benchmark and evaluation by region, requests in bulk: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths, scoring
from plumbline.operators import code, statistics
from plumbline.operators.model import Model

MAX_FILE_BYTES = 1 << 20
REQUEST = "struct<files:array<struct<source:string,language:string,file_path:string,top_n:int,directive_threshold:double>>>"


def evaluated_projects(files: DataFrame, model: Model | None = None) -> DataFrame:
    """(file_path, category, score, decision and a column a dimension) of the files of projects."""
    kinds = files.select("file_path", paths.category(F.col("file_path"), F.col("source")).alias("category"))
    e = code.evaluate_files(files, "file_path", model)
    norm = lambda i, d: F.get("dimensions", F.lit(i))["norm"].alias(d)
    return e.select("file_path", "score", "decision", *[norm(i, d) for i, d in enumerate(scoring.DIMENSIONS)]).join(kinds, "file_path")


def run(evaluated: DataFrame) -> dict[str, DataFrame]:
    """Distributions by category, discrimination by dimension, targets."""
    dims = statistics.dimension_discrimination(evaluated, "category", scoring.DIMENSIONS, "score").withColumn("signal", scoring.signal(F.col("cohens_d")))
    by_category = statistics.distribution(evaluated, "score", ["category"])
    median = lambda c: F.max(F.when(F.col("category") == c, F.col("median")))
    gap = by_category.agg((median("init") - median("implementation")).alias("sc_002_impl_vs_init_gap"))
    strong = dims.agg(F.count_if(F.abs("cohens_d") > 0.5).cast("double").alias("sc_003_dimension_discrimination"))
    count = evaluated.agg(F.count(F.lit(1)).cast("double").alias("sc_001_file_count"))
    row = count.join(F.broadcast(gap), F.lit(True)).join(F.broadcast(strong), F.lit(True))  # one row each
    return {"categories": by_category, "dimensions": dims, "targets": statistics.targets(row)}


def evaluate_regions(files: DataFrame, key: str, model: Model | None = None) -> DataFrame:
    """Scores of production and test code apart, in the order in which they begin."""
    r = code.region_table(files, key).withColumn("_key", F.concat_ws(":", F.col(key).cast("string"), F.col("region_idx").cast("string")))
    e = code.evaluate_files(r.select("_key", "source", "language"), "_key", model).select("_key", "score", "decision")
    return r.select(key, "region_idx", "label", "start_line", "_key").join(e, "_key").drop("_key")


def evaluate_requests(requests: DataFrame, column: str, model: Model | None = None) -> DataFrame:
    """Bulk requests as JSON texts: a row a file with score and decision; files over MAX_FILE_BYTES get a warning and no score."""
    parsed = requests.select(F.monotonically_increasing_id().alias("request"), F.from_json(column, REQUEST).alias("r"))
    files = parsed.select("request", F.posexplode("r.files").alias("at", "f")).select(F.concat_ws(":", "request", "at").alias("_key"), "f.*")
    large = F.octet_length("source") > MAX_FILE_BYTES
    scored = code.evaluate_files(files.where(~large).select("_key", "source", "language"), "_key", model).select("_key", "score", "decision")
    out = files.select("_key", "file_path", F.when(large, "file too large").alias("warning")).join(scored, "_key", "left")
    return out.select("_key", "file_path", "score", "decision", "warning")
