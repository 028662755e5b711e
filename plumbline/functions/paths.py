"""Paths, globs, languages and file categories as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages and their suffixes.
SUFFIX = {
    "python": ".py", "javascript": ".js", "typescript": ".ts", "go": ".go", "rust": ".rs",
    "java": ".java", "c": ".c", "cpp": ".cpp", "ruby": ".rb", "kotlin": ".kt",
}
LANGUAGE_OF = {v: k for k, v in SUFFIX.items()}
# Directories that scans leave out.
EXCLUDED_DIRS = [".git", "__pycache__", ".venv", "venv", "env", "node_modules", ".pytest_cache", "dist", "build"]
PROJECT_EXCLUDED_DIRS = EXCLUDED_DIRS + [".tox", ".eggs"]
# Fixed values of the file categoriser.
CONFIG_SUFFIXES = [".toml", ".yaml", ".yml", ".json", ".cfg", ".ini"]
TEST_DIRS, SCHEMA_DIRS = ["tests", "test", "testing"], ["models", "schemas", "types"]
GENERATED_DIRS = ["generated", "proto", "_generated", "gen"]
GENERATED_MARK = r"(?i)^\s*#\s*(Generated\s+by|@generated)"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last dot and what follows it in the file's name; empty for names that begin with their only dot."""
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def language_of(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """Language by suffix, an override first; null if none is known."""
    table = LANGUAGE_OF | (overrides or {})
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), suffix_of(path))


def is_supported(language: Column) -> Column:
    return F.coalesce(F.lower(language).isin(list(SUFFIX)), F.lit(False))


def excluded(path: Column, directories: list[str] = EXCLUDED_DIRS) -> Column:
    """Whether any folder of the path is one of those left out."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, directories)))


def fnmatch_regex(glob: str) -> str:
    """A shell pattern as a regular expression; a star crosses slashes."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        k += 1
        end = glob.find("]", k + 1)
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            body = glob[k:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            k = end + 1
        else:
            out += re.escape(c)
    return f"^(?s:{out})$"


def path_glob_regex(glob: str) -> str:
    """A path pattern in which ``**`` stands for any number of folders and other parts for one name each."""
    names = glob.split("/")
    parts = [p for k, p in enumerate(names) if k == 0 or p != "**" or names[k - 1] != "**"]
    out = ""
    for k, part in enumerate(parts):
        last = k + 1 == len(parts)
        if part == "**":
            out = out[:-1] + "(?:/.*)?" if last and out else out + (".*" if last else "(?:[^/]+/)*")
        else:
            inner = fnmatch_regex(part)[5:-2].replace(".*", "[^/]*")
            out += inner + ("" if last else "/")
    return f"^{out}$"


def matches(path: Column, glob: str) -> Column:
    return path.rlike(fnmatch_regex(glob))


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether the path or its last name matches one of the patterns."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | matches(path, g) | matches(name_of(path), g)
    return hit


def rules_table(spark: SparkSession, rules: list[tuple[str, float | None, float | None]]) -> DataFrame:
    rows = [(k, g, fnmatch_regex(g), a, r) for k, (g, a, r) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, glob string, regex string, accept double, reject double")


def path_thresholds(files: DataFrame, path: str, rules: list[tuple[str, float | None, float | None]], accept: float | None, reject: float | None) -> DataFrame:
    """Add rule, accept, reject of the last rule that matches, whole; without a match the global pair.  The rules are a plan-time list, so they are one expression and no join."""
    chosen = F.struct(F.lit(-1).alias("rule"), F.lit(accept).cast("double").alias("accept"), F.lit(reject).cast("double").alias("reject"))
    for k, (g, a, r) in enumerate(rules):
        own = F.struct(F.lit(k).alias("rule"), F.lit(a).cast("double").alias("accept"), F.lit(r).cast("double").alias("reject"))
        chosen = F.when(matches(F.col(path), g), own).otherwise(chosen)
    return files.withColumn("_rule", chosen).select("*", "_rule.*").drop("_rule")


def _init_category(content: Column) -> Column:
    rows = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: (x != "") & ~x.startswith("#"))
    imports = F.filter(rows, lambda x: x.rlike(r"^(import |from |__all__)"))
    return F.when(content.isNull() | (F.size(rows) == 0), "init").when((F.size(rows) < 50) & (F.size(imports) / F.size(rows) > 0.5), "init").otherwise("implementation")


def _schema_like(content: Column) -> Column:
    rows = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: (x != "") & ~x.startswith("#"))
    kinds = F.size(F.filter(rows, lambda x: x.startswith("class ") | x.startswith("type ")))
    functions = F.size(F.filter(rows, lambda x: x.startswith("def ") & ~x.startswith("def __")))
    return (F.size(rows) == 0) | ((kinds > 0) & (functions <= kinds)) | ((F.size(rows) < 20) & (functions == 0))


def category(path: Column, content: Column, overrides: dict[str, str] | None = None) -> Column:
    """init, implementation, schema, test, generated or unknown, by name, folder and content (null if unread), in this order."""
    name, suffix, parts = name_of(path), suffix_of(path), F.split(path, "/")
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    marked = F.exists(F.slice(F.split(content, "\n"), 1, 10), lambda x: x.rlike(GENERATED_MARK))
    out = F.when(F.lit(False), "")
    for p, c in (overrides or {}).items():
        out = out.when(path == p, c)
    return (
        out.when(suffix.isin(CONFIG_SUFFIXES), "schema")
        .when(name.startswith("test_") | name.endswith("_test.py"), "test")
        .when(name == "__init__.py", _init_category(content))
        .when(has(TEST_DIRS), "test")
        .when(has(GENERATED_DIRS), "generated")
        .when(content.isNotNull() & marked, "generated")
        .when(has(SCHEMA_DIRS) & (content.isNull() | _schema_like(content)), "schema")
        .when(suffix.isin(list(LANGUAGE_OF)), "implementation")
        .otherwise("unknown")
    )


def archive_url(repository: Column, ref: Column) -> Column:
    """Archive of a commit (40 hex digits) or a tag."""
    return F.when(ref.rlike("^[0-9a-fA-F]{40}$"), F.concat(repository, F.lit("/archive/"), ref, F.lit(".tar.gz"))).otherwise(F.concat(repository, F.lit("/archive/refs/tags/"), ref, F.lit(".tar.gz")))
