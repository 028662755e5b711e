"""Results as JSON, SARIF and text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import records


def json_lines(results: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text a result."""
    return results.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(results: DataFrame, columns: list[str], path: str) -> None:
    json_lines(results, columns).write.mode("overwrite").text(path)


def sarif(files: DataFrame, directives: DataFrame, key: str, version: str = "1") -> str:
    """A SARIF document for a result small enough to read; the rows themselves are :func:`records.sarif_rows`."""
    rows = records.sarif_rows(files, directives, key).orderBy(key, "kind", "rule_id").collect()
    results = [{"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["rule_id"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": str(r[key])}}}]} for r in rows]
    rules = [{"id": i} for i in sorted({r["ruleId"] for r in results})]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "plumbline", "version": version, "rules": rules}}, "results": results}]}, indent=2)


def text_report(results: DataFrame, key: str, limit: int = 50) -> str:
    """The worst files, a line each, and a summary."""
    worst = results.orderBy(F.desc("score"), key).limit(limit).collect()
    s = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "reject").alias("r"), F.count_if(F.col("decision") == "warn").alias("w"), F.avg("score").alias("m")).first()
    out = [f"{r['decision']:7} {r['score']:.4f}  {r[key]}" for r in worst]
    return "\n".join([*out, f"{s['n']} files, {s['r']} rejected, {s['w']} warned, mean {0.0 if s['m'] is None else s['m']:.4f}"])


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)
