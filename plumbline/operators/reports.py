"""Evaluation results as JSON and SARIF documents and as text.

Every result becomes one JSON text in its task; documents are written by iterating over these texts, one partition at a time,
so no result set is held as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.operators import records

# Fixed values of the SARIF format.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
RULES = {
    "quality/decision": "Overall structural loss of a file",
    "directive/reduce_complexity": "Complexity over the corpus",
    "directive/review_token_distribution": "Unusual distribution of bytes",
    "directive/extract_repeated_logic": "Repeated structure",
    "directive/review_structure": "Structure unlike the corpus",
    "directive/improve_compression": "Redundant text",
}


def percentile(score: Column, distribution: dict[str, float] | None) -> Column:
    """Place of a score among the training corpus, null if the model has no distribution."""
    if not distribution:
        return F.lit(None).cast("double")
    return scoring.quality_percentile(score, {k: F.lit(float(distribution[k])) for k, _ in scoring.PERCENTILE_KNOTS})


def detailed(evaluated: DataFrame, distribution: dict[str, float] | None = None) -> DataFrame:
    """Add percentile, and violations and contributions with raw values, as the documents show them."""
    raw_of = {"manifold_drift": "l_drift", "manifold_alignment": "l_virtue", "token_entropy": "entropy", "compression_structure": "birkhoff", "ncd_exemplar_distance": "ncd"}
    raw = F.create_map(*[x for d, c in raw_of.items() for x in (F.lit(d), F.coalesce(F.col(c), F.lit(0.0)) if c in evaluated.columns else F.lit(0.0))])
    violation = lambda v: F.struct(
        v["dimension"].alias("dimension"), F.element_at(raw, v["dimension"]).alias("raw_value"), v["norm"].alias("normalized_value"), v["share"].alias("contribution")
    )
    part = lambda d: F.struct(
        d["dimension"].alias("dimension"), d["norm"].alias("normalized_value"), d["weight"].alias("weight"), (d["norm"] * d["weight"]).alias("weighted_contribution")
    )
    p = percentile(F.col("score"), distribution)
    return evaluated.withColumns({
        "percentile": p, "percentile_available": p.isNotNull(), "shown_violations": F.transform("violations", violation), "contributions": F.transform("dimensions", part),
    })


def fixed(x: Column, digits: int) -> Column:
    """A number as C, Python and SQL print it with so many digits: rounded by its exact binary value, ties to the even digit; the format string rounds its shortest decimal form, ties up."""
    shown = F.translate(F.format_number(x, digits), ",", "")
    # under the last digit, format_number takes the only decimal tie for an exact one, as the format string does not
    return F.when(F.abs(x) < F.lit(10.0**-digits), F.format_string(f"%.{digits}f", x)).otherwise(shown) if digits else shown


def message(score: Column, place: Column, decision: Column, violations: Column | None = None) -> Column:
    """What a result says: score, percentile if known, decision and the violations with their shares."""
    p = F.bround(place).cast("int").cast("string")
    of = F.when(place.isNull(), "").otherwise(F.concat(F.lit(" (p"), p, F.lit(" — better than "), p, F.lit("% of training corpus)")))
    head = F.concat(F.lit("Score: "), fixed(score, 3), F.coalesce(of, F.lit("")), F.lit(" ["), decision, F.lit("]"))
    if violations is None:
        return head
    listed = F.array_join(F.transform(violations, lambda v: F.concat(v["dimension"], F.lit(" ("), fixed(v["contribution"] * 100, 0), F.lit("%)"))), ", ")
    return F.concat(head, F.when(F.size(violations) > 0, F.concat(F.lit(". Violations: "), listed)).otherwise(". No violations."))


def json_results(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): a result as JSON."""
    item = F.struct(
        "decision", "score", F.col("confidence").alias("structural_confidence"), F.col("shown_violations").alias("violations"), F.col(key).cast("string").alias("file_path"),
        "percentile", "percentile_available", "contributions", "is_dominant",
    )
    return rows.select(key, F.to_json(item, {"ignoreNullFields": "false"}).alias("value"))


def json_document(rows: DataFrame, key: str, summary: dict) -> Iterator[str]:
    """Pieces of a document with results in the order of the key and the summary."""
    yield '{"results": ['
    for k, r in enumerate(json_results(rows, key).orderBy(key).toLocalIterator()):
        yield (",\n" if k else "\n") + r["value"]
    yield '],\n"summary": ' + json.dumps(summary) + "}"


def sarif_results(rows: DataFrame, key: str, directives: DataFrame | None = None) -> DataFrame:
    """(key, kind, value): a SARIF result a file and a directive.  Directives have key, dimension, norm, category, severity and may have start_line and end_line."""

    def place(first: Column, last: Column | None = None) -> Column:
        region = F.struct(first.alias("startLine"), *([last.alias("endLine")] if last is not None else []))
        return F.array(F.struct(F.struct(F.struct(F.col(key).cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))

    properties = F.struct("score", "decision", F.col("confidence").alias("structural_confidence"), F.col("shown_violations").alias("violations"), "percentile", "percentile_available", "contributions")
    text = message(F.col("score"), F.col("percentile"), F.col("decision"), F.col("shown_violations"))
    result = F.struct(
        F.lit("quality/decision").alias("ruleId"), records.level(F.col("decision")).alias("level"), F.struct(text.alias("text")).alias("message"), place(F.lit(1)).alias("locations"), properties.alias("properties")
    )
    out = rows.select(key, F.lit(0).alias("kind"), F.to_json(result, {"ignoreNullFields": "false"}).alias("value"))
    if directives is None:
        return out
    line = lambda c: F.coalesce(F.col(c), F.lit(1)) if c in directives.columns else F.lit(1)
    text = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("category"), F.lit(" ("), F.col("dimension"), F.lit(": "), fixed(F.col("norm"), 3), F.lit(")"))
    result = F.struct(
        F.concat(F.lit("directive/"), F.col("category")).alias("ruleId"), F.when(F.col("severity") == "high", "error").otherwise("warning").alias("level"),
        F.struct(text.alias("text")).alias("message"), place(line("start_line"), line("end_line")).alias("locations"),
    )
    return out.unionByName(directives.select(key, F.lit(1).alias("kind"), F.to_json(result).alias("value")))


def sarif_document(results: DataFrame, key: str, version: str = "1") -> Iterator[str]:
    """Pieces of a SARIF document, results in the order of key and kind."""
    rules = [{"id": i, "shortDescription": {"text": t}} for i, t in RULES.items()]
    head = json.dumps({"name": "plumbline", "version": version, "rules": rules})
    yield f'{{"version": "{SARIF_VERSION}", "$schema": "{SARIF_SCHEMA}", "runs": [{{"tool": {{"driver": {head}}}, "invocations": [{{"executionSuccessful": true}}], "results": ['
    for k, r in enumerate(results.orderBy(key, "kind", "value").toLocalIterator()):
        yield (",\n" if k else "\n") + r["value"]
    yield "]}]}"


def text_lines(rows: DataFrame, key: str, classify: bool = False, rank: str | None = None) -> DataFrame:
    """(key, value): a line a file; ``classify`` adds the decision with warnings called marginal, ``rank`` names a column of ranks shown first and ``highlighted`` is marked."""
    p = F.when(F.col("percentile").isNull(), "").otherwise(F.concat(F.lit("  p"), F.bround("percentile").cast("int").cast("string")))
    label = F.when(F.col("decision") == "warn", "marginal").otherwise(F.col("decision"))
    parts = [F.concat(fixed(F.col("score"), 4), p, F.lit("  "), F.col(key).cast("string"))]
    if classify:
        parts.insert(0, F.rpad(label, 8, " "))
    if rank:
        parts.insert(0, F.concat(F.when(F.col("highlighted"), "* ").otherwise("  "), F.lpad(F.col(rank).cast("string"), 6, " ")))
    return rows.select(key, *([rank] if rank else []), F.concat_ws("  ", *parts).alias("value"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: counts by decision, mean score, mean percentile of the files that have one, overall decision and exit codes."""
    n = lambda d: F.count_if(F.col("decision") == d)
    s = rows.agg(
        F.count(F.lit(1)).alias("total_files"), n("accept").alias("accepted"), n("warn").alias("warned"), n("reject").alias("rejected"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.avg("percentile").alias("mean_percentile"),
    )
    r, w = F.col("rejected"), F.col("warned")
    return s.select("*", scoring.overall(r, w).alias("overall_decision"), *[scoring.exit_code(r, w, **k).alias(name) for name, k in (("exit_code", {}), ("exit_strict", {"strict": True}), ("exit_lenient", {"lenient": True}))])
