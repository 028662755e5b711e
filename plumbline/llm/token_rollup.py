"""Token counts as delta-maintained rollups.

The rollup is a ledger of additive totals by source, language and tokenizer version.  A batch
of changes (inserts, deletes, revised counts) is reduced to signed sums and written as one
folder of the ledger, named by the batch's identifier.  A batch counts once its folder is
complete, and a batch that is there already is not written again: so commits are
idempotent, and one that broke off is simply repeated.  Totals are the sum over the folders;
compaction replaces the folders it has summed by one, and remembers their names in a table.
Readers and compactions list the folders once and sum exactly those, so a batch that is committed meanwhile counts
once: one compaction at a time, any number of commits beside it.

Edge cases.  Null sources and languages are groups of their own.  A null text counts as
empty.  Repeated rows count as often as they occur.  Groups whose documents have all been deleted go.
An empty batch or table commits and adds nothing.  Very long texts are encoded as a whole.  Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        """Names of the complete folders, compacted ones included."""
        fs, top = self._fs("")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()]
        return sorted(n for n in names if self._complete(n))

    def _complete(self, name: str) -> bool:
        fs, p = self._fs(f"{name}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit signed sums of ``changes`` (see :func:`inserts`, :func:`deletes`, :func:`revisions`); False if the batch is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError("a batch's name has letters, digits and dashes only")
        if self._complete(f"batch_{batch}") or self._merged(self._newest(self.committed()), [batch]):
            return False
        sums = changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.mode("overwrite").parquet(f"{self.path}/batch_{batch}")
        return True

    @staticmethod
    def _newest(names: list[str]) -> str | None:
        """The newest compacted folder of a listing."""
        return max((n for n in names if n.startswith("merged_")), default=None)

    def _merged(self, newest: str | None, batches: list[str]) -> set[str]:
        """Those of ``batches`` that the compacted folder has summed; the table of all names ever committed is only searched."""
        if newest is None or not batches:
            return set()
        names = self.spark.read.schema("batch string").parquet(f"{self.path}/{newest.replace('merged_', 'names_')}")
        return {r["batch"] for r in names.where(F.col("batch").isin(batches)).collect()}

    def _live(self) -> tuple[str | None, list[str]]:
        """One listing: the newest compacted folder, and the batches that it has not summed."""
        names = self.committed()
        newest = self._newest(names)
        batches = [n.removeprefix("batch_") for n in names if n.startswith("batch_")]
        done = self._merged(newest, batches)
        return newest, [n for n in batches if n not in done]

    def _sums(self, newest: str | None, batches: list[str]) -> DataFrame:
        folders = [newest] * (newest is not None) + [f"batch_{n}" for n in batches]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        all_ = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{n}" for n in folders])
        return all_.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 OR n_tokens <> 0 OR n_bytes <> 0")

    def totals(self) -> DataFrame:
        return self._sums(*self._live())

    def compact(self) -> None:
        """Sum all committed batches into one folder.  The list of their names is complete before the sums are, and the newest complete pair counts; so a break leaves the old state."""
        newest, batches = self._live()
        if batches:
            number = 1 + (int(newest.split("_")[1]) if newest else 0)
            names = self.spark.createDataFrame([(n,) for n in batches], "batch string")
            if newest:
                names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/{newest.replace('merged_', 'names_')}"))
            names.write.mode("overwrite").parquet(f"{self.path}/names_{number:09d}")
            self._sums(newest, batches).write.mode("overwrite").parquet(f"{self.path}/merged_{number:09d}")
        for n in batches:
            common.delete(self.spark, f"{self.path}/batch_{n}")


def _signed(counted: DataFrame, docs: int, sign: int) -> DataFrame:
    return counted.select(*KEYS, F.lit(docs).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_bytes") * sign).alias("n_bytes"))


def inserts(counted: DataFrame) -> DataFrame:
    return _signed(counted, 1, 1)


def deletes(counted: DataFrame) -> DataFrame:
    return _signed(counted, -1, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """A text or a tokenizer version changed: take away what was counted and add what is counted now."""
    return deletes(before).unionByName(inserts(after))


def counted(docs: DataFrame, tokenizer_path: str, version: str, text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """source, lang, tokenizer_version, n_tokens, n_bytes and the ``carried`` columns of every row; the tokenizer runs over whole texts.  n_words is the number of words: a count to go by until the tokenizer has run."""
    carried = carried or []
    common.need(docs, ["source", "lang", text_col, *carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.packing import token_pool

        pool = token_pool(tokenizer_path)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [t or "" for t in part.column(0).to_pylist()]
                counts = ([len(x) for x in pool.encode_batch(texts)], [len(t.encode("utf-8", "surrogatepass")) for t in texts], [len(t.split()) for t in texts])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(1, part.num_columns)), *(pa.array(c, pa.int64()) for c in counts)], names=[*own, "n_tokens", "n_bytes", "n_words"])
        pool.rest()

    types = dict(docs.dtypes)
    own = ["source", "lang", *(f"c{k}" for k in range(len(carried)))]
    rows = docs.select(common.named(text_col).alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"), *[common.named(c).alias(f"c{k}") for k, c in enumerate(carried)])
    schema = ", ".join(["source string, lang string", *(f"c{k} {types[c]}" for k, c in enumerate(carried)), "n_tokens long, n_bytes long, n_words long"])
    out = rows.mapInArrow(run, schema).withColumn("tokenizer_version", F.lit(version))
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carried)})
