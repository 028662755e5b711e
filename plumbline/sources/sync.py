"""Corpus sync: the files of manifest targets' archives as a table of files, with a ledger of what was taken.

A target is a row, and an archive is read as a stream by one task.  The files of a target replace those it had; a target is in the
ledger only once its files are written, so a run that was stopped is taken up by the next.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators import order, records
from plumbline.sources import config

FILES = "name string, file_path string, language string, source string, error string"
LEDGER = "name string, entry_hash string, ref string, n_files long"
#: Rows a task hands on at once.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def location(url: str, ref: str) -> str:
    """Where a target's archive is: a local path or file URL as it stands, else the archive of the repository's commit or tag."""
    local = url.removeprefix("file://")
    if local.startswith("/"):
        return local
    kind = "" if re.fullmatch("[0-9a-fA-F]{40}", ref) else "refs/tags/"
    return f"{url}/archive/{kind}{ref}.tar.gz"


def _opened(where: str) -> io.IOBase:
    if where.startswith("/"):
        return open(where, "rb")
    import urllib.request

    return urllib.request.urlopen(where, timeout=60)


def _members(where: str, include: list[str], exclude: list[str]) -> Iterator[tuple[str, bytes]]:
    take, leave = ([re.compile(paths.path_glob_regex(g)) for g in globs] for globs in (include, exclude))
    with _opened(where) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for m in tar:
            name = m.name.split("/", 1)[-1]
            if not m.isfile() or "/" not in m.name or name.startswith("/") or ".." in name.split("/"):
                continue
            if any(p.match(name) for p in take) and not any(p.match(name) for p in leave):
                yield name, tar.extractfile(m).read()


def _language(name: str) -> str | None:
    at = name.rfind(".")
    return paths.LANGUAGE_OF.get(name[at:]) if at > name.rfind("/") + 1 else None


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in FILES.split(", ")]
    for b in batches:
        for t in b.itertuples():
            rows, size = [], 0
            try:
                for name, data in _members(location(t.url, t.ref), list(t.include), list(t.exclude)):
                    rows.append((t.name, name, _language(name), data.decode("utf-8", "replace"), None))
                    size += len(data)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            except (OSError, tarfile.TarError, EOFError, ValueError) as e:  # a target's failure is its own
                rows.append((t.name, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def sync(spark: SparkSession, targets: list[dict], out: str, force: bool = False) -> DataFrame:
    """(name, status, n_files, error) of every target; files are in ``out``/files by target, the ledger in ``out``/ledger.

    Targets whose entry is in the ledger unchanged are skipped, unless ``force``.  A target of which anything fails keeps
    what it had and is not entered.  Archives without a matching file count as synced with none.
    """
    table = config.targets_table(spark, targets)
    log = _ledger(spark, out)
    due = order.once(table if force else records.pending(table, log, ["name", "entry_hash"]))
    n = due.count()
    read = order.once(due.select("name", "url", "ref", "include", "exclude").repartition(max(n, 1), "name").mapInPandas(_extracted, FILES))
    outcome = due.join(read.groupBy("name").agg(F.count("file_path").alias("n_files"), F.max("error").alias("error")), "name", "left").select(
        "name", F.when(F.col("error").isNull(), "synced").otherwise("failed").alias("status"), F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), "error", "entry_hash", "ref"
    )
    done = order.once(outcome).where("status = 'synced'")
    if n:
        # the folders of the synced targets alone are replaced
        read.join(F.broadcast(done.select("name")), "name", "left_semi").drop("error").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(f"{out}/files")
        kept = log.join(done.select("name"), "name", "left_anti").unionByName(done.select("name", "entry_hash", "ref", "n_files"))
        order.once(kept).write.mode("overwrite").parquet(f"{out}/ledger")
    skipped = table.join(due.select("name"), "name", "left_anti").select("name", F.lit("skipped").alias("status"), F.lit(None).cast("long").alias("n_files"), F.lit(None).cast("string").alias("error"))
    return outcome.drop("entry_hash", "ref").unionByName(skipped).orderBy("name")


def _ledger(spark: SparkSession, out: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(f"{out}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
