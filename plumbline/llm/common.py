"""Shared folder, written tables and skew-safe lookups for the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds over 1/HOT_SHARE of the rows; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, options: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors, and lets Spark delete the shuffle files at once."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**(options or {})).parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._plumbline_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that this module has written in the shared folder, once their readers are done."""
    delete(spark, f"{shared_dir(spark)}/plumbline")


def hot_keys(counted: DataFrame, n: str, total: int) -> DataFrame:
    """Rows of ``counted`` (one a key, ``n`` its rows of ``total``) whose key is hot: fewer than HOT_SHARE rows, whatever the input, so they can be broadcast."""
    return counted.where(F.col(n) > max(HOT_SHARE, total // HOT_SHARE))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (unique ``keys``); the rows of hot keys stay where they are and meet the few hot rows by broadcast."""
    hot = F.broadcast(hot.select(*right.columns))
    near = left.join(hot, keys, "inner")
    far = left.join(hot.select(*keys), keys, "left_anti").join(right, keys, how)
    return near.unionByName(far)


def total_rows(df: DataFrame, n: str | None = None) -> int:
    got = df.agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n")).first()["n"]
    return int(got or 0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, at whose end the worker gives unused memory back: idle workers live on beside the executor's heap while later stages run."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    """Give what this process's allocators hold unused back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def need(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def named(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, ``row``: beside it, keys of any name clash with nothing."""
    return F.struct(*map(named, docs.columns)).alias("row")


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes, u1 and u2, that name a row by identifier and text."""
    text = text_of(text_col)
    return F.xxhash64(named(id_col), text).alias("u1"), F.xxhash64(text, named(id_col), F.lit(1)).alias("u2")


#: Bits of a :func:`sifted` filter: broadcast, 8 MB at any size of the input.
FILTER_BITS = 1 << 26
_BUCKET = 32768


def sifted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Drop rows whose 64-bit ``key`` can't be among ``wanted``, by a broadcast bit map of FILTER_BITS.

    The map has one size and the plan one form, however many keys are wanted; with m of them it lets
    1 - exp(-m / FILTER_BITS) of the others pass.  The join that follows decides.
    """
    place = F.pmod(key, F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("p")).groupBy((F.col("p") / _BUCKET).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % _BUCKET).alias("bits"))
    at = (place % _BUCKET).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.lit(1) + (at / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("bucket", (place / _BUCKET).cast("long"))
    return placed.join(F.broadcast(bits), "bucket").where(F.getbit(byte, at % 8) == 1).drop("bucket", "bits")
