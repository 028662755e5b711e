"""Scoring of whole texts without or with what a model knows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scoring, text_metrics
from plumbline.functions.lines import WHITE


def evaluate_texts(
    texts: DataFrame, key: str, text: str, top: int = 3, sigma_drift: float = 1.0, sigma_virtue: float = 1.0,
    drift: str | None = None, virtue: str | None = None, ncd: str | None = None, dominant: str | None = None,
    accept: float = scoring.ACCEPT, reject: float = scoring.REJECT,
) -> DataFrame:
    """Add metrics, dimensions, score, decision, assessment, confidence and the top violations.

    ``drift``, ``virtue``, ``ncd`` and ``dominant`` name columns of what is known beyond the text; without them
    their dimensions weigh nothing.  Blank texts have loss 0 and no violation.
    """
    null = F.lit(None).cast("double")
    col = lambda c: F.col(c) if c else null
    source = F.coalesce(F.col(text), F.lit(""))
    carried = [c for c in (drift, virtue, ncd, dominant) if c]
    m = texts.select(
        key, *carried, (F.trim(source, F.lit(WHITE + "\n")) == "").alias("blank"), F.octet_length(source).alias("raw_bytes"),
        text_metrics.byte_entropy(text).alias("entropy"), text_metrics.zlib_size(text).alias("compressed_bytes"),
    )
    m = m.withColumn("compression_ratio", text_metrics.compression_ratio(F.col("raw_bytes"), F.col("compressed_bytes")))
    m = m.withColumn("birkhoff", text_metrics.birkhoff(F.col("raw_bytes"), F.col("entropy"), F.col("compressed_bytes")))
    dims = scoring.dimensions(col(drift), col(virtue), F.col("entropy"), F.col("birkhoff"), col(ncd), sigma_drift, sigma_virtue)
    is_dominant = F.coalesce(F.col(dominant), F.lit(False)) if dominant else F.lit(False)
    m = m.withColumn("dimensions", F.when(is_dominant, scoring.damped(dims)).otherwise(dims))
    total = F.when(is_dominant, F.greatest(scoring.loss(F.col("dimensions")), F.lit(accept))).otherwise(scoring.loss(F.col("dimensions")))
    m = m.withColumn("raw_score", scoring.loss(F.col("dimensions"))).withColumn("score", F.when(F.col("blank"), 0.0).otherwise(total))
    return m.withColumns({
        "decision": F.when(F.col("blank"), "accept").otherwise(scoring.decision(F.col("score"), accept, reject)),
        "assessment": F.when(F.col("blank"), "accept").otherwise(scoring.assessment(F.col("score"))),
        "confidence": F.when(col(drift).isNotNull(), "high").otherwise("low"),
        "violations": F.when(F.col("blank"), F.slice(scoring.violations(F.col("dimensions"), F.lit(1.0), top), 1, 0)).otherwise(scoring.violations(F.col("dimensions"), F.col("score"), top)),
    })
