"""Training of a reference model from a corpus of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import code, model, records, statistics
from plumbline.operators.syntax import PROVIDER

MIN_FILES, MIN_SCORES = 10, 10


def exemplars(units: DataFrame, m: model.Model) -> list[str]:
    """Texts of the medoid unit of every component that is the largest of some unit, in the order of the components."""
    keyed = units.withColumn("_unit", F.concat_ws("#", "file_path", F.col("unit_idx").cast("string")))
    chosen = model.medoids(model.project(keyed, "features", m, F.col("partial_parse")), "_unit")
    rows = keyed.select("_unit", "unit_source").join(F.broadcast(chosen), "_unit").select("cluster", "unit_source").collect()  # one a component
    return [r["unit_source"] for r in sorted(rows, key=lambda r: r["cluster"])]


def train(files: DataFrame, components: int | None = None, share: float = 0.9, language: str | None = None, corpus_class: str | None = None) -> model.Model:
    """One vector a unit; PCA, calibration of both distances, score distribution and thresholds (p25, p75), which may fail softly."""
    units = code.unit_table(files, "file_path").persist()
    good = units.where(F.col("warning").isNull() | ~F.col("warning").isin(code.WARN_UNSUPPORTED)).where(model.finite(F.col("features")))
    n = files.count()
    if n < MIN_FILES:
        raise ValueError(f"training needs {MIN_FILES} files, there are {n}")
    m = model.calibrate(good, "features", model.pca(good, "features", components, share))
    m.n_training, m.language, m.corpus_class, m.provider = n, language, corpus_class, PROVIDER
    m.corpus_hash = records.corpus_hash(files, "file_path", "source").first()[0]
    m.exemplars = exemplars(good, m)
    scores = code.evaluate_files(files, "file_path", m).select("score").persist()
    d = statistics.distribution(scores, "score").first()
    if d is not None and d["n"] >= MIN_SCORES:
        m.distribution = {k: float(d[k]) for k in statistics.KNOTS}
        if d["p25"] < d["p75"]:
            m.accept, m.reject = float(d["p25"]), float(d["p75"])
    scores.unpersist()
    units.unpersist()
    return m


def register(spark) -> None:
    """Make the text metrics, the sources and the provider callable from SQL."""
    from plumbline.functions import text_metrics
    from plumbline.sources.files import ArchiveSource

    spark.udf.register("byte_entropy", text_metrics.byte_entropy)
    spark.udf.register("zlib_size", text_metrics.zlib_size)
    spark.udf.register("zlib_size_best", text_metrics.zlib_size_best)
    spark.dataSource.register(ArchiveSource)
