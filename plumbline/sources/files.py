"""Sources of files: directory and corpus scans, git ranges, standard input, archives."""

from __future__ import annotations

import subprocess
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions import lines, paths

COLUMNS = "file_path string, language string, source string"


def scan(spark: SparkSession, root: str, overrides: dict[str, str] | None = None, exclude_globs: list[str] | None = None, excluded: list[str] | None = paths.EXCLUDED_DIRS, binary: str = "skip") -> DataFrame:
    """(file_path, language, source, content_sha256) of the source files under ``root``; ``excluded`` folders may be None for none.

    The suffixes known to the language map narrow the listing before anything is read.  Files that are
    not UTF-8 are skipped, or decoded with replacement characters (``binary="replace"``).
    """
    suffixes = sorted(set(paths.LANGUAGE_OF) | set(overrides or {}))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    top = F.regexp_replace(F.lit(root), "^[a-z]+:(//)?", "")
    full = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", "")
    rel = F.regexp_replace(F.substr(full, F.char_length(top) + 1), "^/+", "")
    files = raw.select(rel.alias("file_path"), "content").withColumn("language", paths.language_of(F.col("file_path"), overrides)).where(F.col("language").isNotNull())
    if excluded:
        files = files.where(~paths.excluded(F.col("file_path"), excluded))
    if exclude_globs:
        files = files.where(~paths.matches_any(F.col("file_path"), exclude_globs))
    text = F.try_validate_utf8("content") if binary == "skip" else F.make_valid_utf8("content")
    out = files.withColumn("source", text).where(F.col("source").isNotNull())
    return out.select("file_path", "language", "source", F.sha2("content", 256).alias("content_sha256"))


def ignore_list(text: str | None) -> list[str]:
    """The default folders and those of an ignore file: a name a line, comments after a hash."""
    own = [x.strip() for x in (text or "").splitlines() if x.strip() and not x.startswith("#")]
    return list(dict.fromkeys([*paths.EXCLUDED_DIRS, *own]))


def pre_filtered(files: DataFrame) -> DataFrame:
    """Without barrel files and files of types only; the native filter comes first."""
    from plumbline.operators.code import declaration_table

    barrel = F.lit(False)
    for language in lines.IMPORT_PREFIX:
        barrel = barrel | ((F.col("language") == language) & lines.is_barrel(F.col("source"), language))
    kept = files.where(~barrel)
    return kept.join(declaration_table(kept, "file_path").where("is_pure_types").select("file_path"), "file_path", "left_anti")


def _git(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, check=True).stdout


def changed_paths(repository: str, revisions: str | None = None) -> list[str]:
    """Files added, copied, modified or renamed in a range, or staged if there is none."""
    what = ["--cached"] if revisions is None else [revisions]
    return [p for p in _git(repository, "diff", "--name-only", "--diff-filter=ACMR", *what).splitlines() if p]


def changed(spark: SparkSession, repository: str, revisions: str | None = None, overrides: dict[str, str] | None = None, exclude_globs: list[str] | None = None) -> DataFrame:
    wanted = spark.createDataFrame([(p,) for p in changed_paths(repository, revisions)], "file_path string")
    return scan(spark, repository, overrides, exclude_globs).join(F.broadcast(wanted), "file_path", "left_semi")  # a list the driver made


def history(spark: SparkSession, repository: str, commits: int) -> DataFrame:
    """(sha, file_path, language, source) of the files of the last ``commits``; the listing is the driver's, the texts are read by the tasks."""
    shas = _git(repository, "log", f"-{commits}", "--format=%H").split()
    rows = [(s, p) for s in shas for p in _git(repository, "diff-tree", "--root", "--no-commit-id", "--name-only", "--diff-filter=ACMR", "-r", s).splitlines()]

    def read(batches):
        for b in batches:
            b["source"] = [subprocess.run(["git", "-C", repository, "show", f"{s}:{p}"], capture_output=True).stdout.decode("utf-8", "replace") for s, p in zip(b["sha"], b["file_path"], strict=True)]
            yield b

    listed = spark.createDataFrame(rows, "sha string, file_path string").withColumn("language", paths.language_of(F.col("file_path"))).where(F.col("language").isNotNull())
    return listed.mapInPandas(read, "sha string, file_path string, language string, source string")


def one(spark: SparkSession, text: str, language: str) -> DataFrame:
    """An anonymous file, as from standard input."""
    return spark.createDataFrame([("<stdin>", language, text)], COLUMNS)


class _Member(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.include = [x for x in options.get("include", "**").split(";") if x]
        self.exclude = [x for x in options.get("exclude", "").split(";") if x]

    def partitions(self) -> list[_Member]:
        return [_Member(p) for p in self.paths]

    def read(self, partition: _Member) -> Iterator[tuple]:
        import re

        take, leave = ([re.compile(paths.path_glob_regex(g)) for g in globs] for globs in (self.include, self.exclude))
        with tarfile.open(partition.path, "r|*") as tar:  # a stream: never the whole archive at once
            for m in tar:
                name = m.name.split("/", 1)[-1]
                if not m.isfile() or name.startswith("/") or ".." in name.split("/"):
                    continue
                if any(p.match(name) for p in take) and not any(p.match(name) for p in leave):
                    yield partition.path, name, tar.extractfile(m).read().decode("utf-8", "replace")


class ArchiveSource(DataSource):
    """``format("plumbline_archive")``: files of tar archives (options path, include, exclude); the top folder is taken off, and names that lead out of it are passed over."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_archive"

    def schema(self) -> str:
        return "archive string, file_path string, source string"

    def reader(self, schema) -> _ArchiveReader:
        return _ArchiveReader(self.options)
