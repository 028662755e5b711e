"""Scorecards, SARIF rows, caches, sync ledgers, integrity and region spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Mandatory checks of the scorecard.
M1_MIN, M2_MAX, M3_MAX, M4_RANGE, M5_MAX = 0.8, 0.5, 0.8, (3.5, 6.5), 0.5
LEVELS = {"accept": "note", "warn": "warning", "reject": "error"}


def scorecard(df: DataFrame) -> DataFrame:
    """Add M1 to M5 and Q1 to Q5 from birkhoff, compression_structure, compression_ratio, entropy, ncd, ncd_shown and score; a metric that is missing passes."""
    c = F.col
    passed = lambda test: F.coalesce(test, F.lit(True))
    return df.withColumns({
        "m1_birkhoff": passed(c("birkhoff") > M1_MIN),
        "m2_compression_structure": passed(F.coalesce("compression_structure", "birkhoff") < M2_MAX),
        "m3_compression_ratio": passed(c("compression_ratio") < M3_MAX),
        "m4_shannon_entropy": passed(c("entropy").between(*M4_RANGE)),
        "m5_ncd_exemplar": passed(c("ncd") < M5_MAX),
        "q1_birkhoff": F.coalesce("birkhoff", F.lit(0.0)),
        "q2_compression_structure": F.coalesce("birkhoff", F.lit(0.0)),
        "q3_token_entropy": 1 - F.least(F.coalesce("entropy", F.lit(0.0)) / 8, F.lit(1.0)),
        # shown only if the distance is among the listed violations
        "q4_ncd_exemplar": F.coalesce("ncd_shown", F.lit(0.0)),
        "q5_overall": c("score"),
    })


def scorecard_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, pass_rate, mean, min, max): a row a column; booleans have a pass rate, numbers the rest."""
    kinds = dict(df.dtypes)
    null = F.lit(None).cast("double")
    one = lambda n: (F.avg(F.col(n).cast("double")), null, null, null) if kinds[n] == "boolean" else (null, F.avg(n), F.min(n), F.max(n))
    packed = df.agg(*[F.struct(*[x.alias(k) for x, k in zip(one(n), ("pass_rate", "mean", "min", "max"), strict=True)]).alias(n) for n in columns])
    return packed.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}.pass_rate"), F.col(f"{n}.mean"), F.col(f"{n}.min"), F.col(f"{n}.max")) for n in columns])).alias("r")).select("r.*")


def anti_pattern_counts(found: DataFrame) -> DataFrame:
    """(name, n): how many units show each anti-pattern."""
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def level(decision: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), decision)


def rule_id(dimension: Column, kind: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.replace(dimension, F.lit("_"), F.lit("-")))


def sarif_rows(files: DataFrame, directives: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, level, kind): one result a file and one a directive."""
    a = files.select(key, F.lit("quality/decision").alias("rule_id"), level(F.col("decision")).alias("level"), F.lit("file").alias("kind"))
    strength = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    b = directives.select(key, rule_id(F.col("dimension"), "directive").alias("rule_id"), strength.alias("level"), F.lit("directive").alias("kind"))
    return a.unionByName(b)


def cache_misses(files: DataFrame, cache: DataFrame, path: str, digest: str) -> DataFrame:
    """Files whose path and content are not in the cache; a cache of another configuration holds nothing."""
    return files.join(cache.select(path, digest), [path, digest], "left_anti")


def refreshed(cache: DataFrame, evaluated: DataFrame, path: str) -> DataFrame:
    """The cache after an evaluation: new entries replace those of their paths."""
    return cache.join(evaluated.select(path), path, "left_anti").unionByName(evaluated)


def entry_hash(name: Column, url: Column, ref: Column, include: Column, exclude: Column) -> Column:
    """SHA-256 of an entry's canonical JSON: sorted keys, no blanks."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = F.concat(F.lit('{"exclude":'), F.to_json(exclude), F.lit(',"include":'), F.to_json(include), F.lit(',"name":'), quoted(name), F.lit(',"ref":'), quoted(ref), F.lit(',"url":'), quoted(url), F.lit("}"))
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def pending(entries: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that the sync ledger does not have in this form."""
    return entries.join(log.select(*keys), keys, "left_anti")


def intact(df: DataFrame, content: str, expected: str) -> DataFrame:
    return df.withColumn("intact", F.sha2(F.coalesce(F.col(content), F.lit("")), 256) == F.col(expected))


def corpus_hash(files: DataFrame, path: str, content: str) -> DataFrame:
    """One row: SHA-256 over the contents' SHA-256 in the order of the paths.  Contents stay on their executors; only 64 characters a file meet."""
    digests = files.select(path, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path, "d"))), lambda x: x["d"]), "")
    return digests.agg(F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("corpus_hash"))


def spans(boundaries: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, label, start_line, end_line): the given test spans and the production spans between them, up to ``n_lines`` of the file."""
    w = Window.partitionBy(key).orderBy("start_line", "end_line")
    merged = boundaries.withColumn("_m", F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gaps = merged.select(key, (F.coalesce("_m", F.lit(0)) + 1).alias("start_line"), (F.col("start_line") - 1).alias("end_line"))
    last = boundaries.groupBy(key).agg(F.max("end_line").alias("_e"))
    tail = files.join(last, key, "left").select(key, (F.coalesce("_e", F.lit(0)) + 1).alias("start_line"), F.col("n_lines").alias("end_line"))
    production = gaps.unionByName(tail).where("start_line <= end_line").withColumn("label", F.lit("production"))
    return production.unionByName(boundaries.select(key, "start_line", "end_line").withColumn("label", F.lit("test"))).select(key, "label", "start_line", "end_line")
