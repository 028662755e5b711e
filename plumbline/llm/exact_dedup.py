"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Documents are flushed from memtables: one scan reduces a batch to digests, which each task sorts and writes
as files of at most MEMTABLE rows with Parquet min/max statistics and a Bloom filter on the digest.  The files
of a batch make RUNS runs of level 0.  FANOUT runs of a level are merged into one of the next, which keeps, per digest, the
smallest identifier and the number of rows; the answer to all rows merges what is left.

A point lookup asks every live run, of which statistics and filters let only those files be read that may have the digest.
Hits, rows whose digest is repeated, are verified on the bytes: a filter of fixed size, made from the repeated digests, lets
their texts pass; of each digest the smallest and the largest text must be equal.

Edge cases.  A null text counts as empty.  Null identifiers sort after all
others.  Of rows that repeat an identifier and a text, exactly one is kept.  An
empty table gives an empty result.  Very long texts are hashed and compared as a whole.  Columns beyond id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a memtable, which becomes a file; runs of a batch; runs of a level that are merged into one of the next.
MEMTABLE, RUNS, FANOUT = 1_000_000, 8, 4
_FILTER = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(common.text_of(column), SPACES, " ")


class DedupIndex:
    """LSM index of text digests in one folder of the shared storage."""

    def __init__(self, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32):
        self.spark, self.id_col, self.text_col, self.digest_bytes = spark, id_col, text_col, digest_bytes
        self.batches: list[DataFrame] = []
        self.flushed: list[DataFrame] = []  # all rows, a table a batch
        self.levels: list[list[DataFrame]] = [[]]  # live runs: digest, first (the row with the smallest identifier), n
        self.runs = 0

    def _digest(self, text: Column) -> Column:
        return F.substring(F.unhex(F.sha2(text, 256)), 1, self.digest_bytes)

    def insert(self, docs: DataFrame) -> None:
        """Flush a batch to sorted runs of level 0 and merge full levels."""
        common.need(docs, [self.id_col, self.text_col])
        run = F.pmod(F.spark_partition_id(), F.lit(RUNS)) + self.runs
        rows = docs.select(
            self._digest(normalised(self.text_col)).alias("digest"), common.named(self.id_col).alias("id"), F.monotonically_increasing_id().alias("row"), run.alias("run")
        ).sortWithinPartitions("run", "digest", "id", "row")
        table = common.written(rows, "dedup-runs", _FILTER | {"maxRecordsPerFile": str(MEMTABLE)}, by="run")
        self.batches.append(docs.select(common.named(self.id_col).alias("id"), common.named(self.text_col).alias("text")))
        self.flushed.append(table)
        first = F.struct(F.col("id").isNull().alias("none"), "id", "run", "row").alias("first")
        for k in range(self.runs, self.runs + RUNS):
            self.levels[0].append(table.where(F.col("run") == k).select("digest", first, F.lit(1).cast("long").alias("n")))
            self._fill()
        self.runs += RUNS

    def _fill(self) -> None:
        """Merge every level that has FANOUT runs."""
        for k, level in enumerate(self.levels):
            if len(level) < FANOUT:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._merge(level))
            self.levels[k] = []

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """One sorted run of several: per digest the smallest identifier, null ones last, and the number of rows.  Each task first sums what it reads."""
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        out = rows.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        out = common.written(out.sortWithinPartitions("digest"), "dedup-level", _FILTER)
        for r in runs:
            if hasattr(r, "_plumbline_path"):
                common.dropped(r)
        return out

    def compact(self) -> DataFrame:
        """Merge all live runs into one, the last level."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            raise ValueError("the index is empty: insert a batch first")
        if len(runs) > 1 or not hasattr(runs[0], "_plumbline_path"):
            self.levels = [[] for _ in self.levels] + [[self._merge(runs)]]
        return self.levels[-1][0]

    def _rows(self) -> DataFrame:
        out = self.flushed[0]
        for t in self.flushed[1:]:
            out = out.unionByName(t)
        return out

    def _texts(self) -> DataFrame:
        out = None
        for b in self.batches:
            text = b.select("id", normalised("text").alias("norm"))
            out = text if out is None else out.unionByName(text)
        return out.withColumn("digest", self._digest(F.col("norm")))

    def find(self, digests: list[bytes]) -> DataFrame:
        """Point lookup in every live run: the pushed-down equality reads only files whose statistics and Bloom filter admit the digest."""
        hits = [r.where(F.col("digest").isin([bytearray(d) for d in digests])) for level in self.levels for r in level]
        out = hits[0]
        for h in hits[1:]:
            out = out.unionByName(h)
        return out.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))

    def collisions(self) -> DataFrame:
        """Digests of unequal texts: of every repeated digest the smallest and the largest text are compared byte by byte.

        Copies are reduced to two texts a digest in each task before anything moves; a text that the filter lets pass
        by chance is alone under its digest.
        """
        repeated = self.compact().where("n > 1").select(F.xxhash64("digest").alias("hash"))
        texts = self._texts().select("digest", "norm", F.xxhash64("digest").alias("hash"))
        passed = common.sifted(texts, repeated, "hash")
        return passed.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest")

    def assign(self) -> DataFrame:
        """A row per flushed row: id, keep_id, group_size, kept, digest."""
        merged = self.compact()
        bad = common.written(self.collisions(), "dedup-collisions")
        hot = common.hot_keys(merged, "n", common.total_rows(merged, "n"))
        found = common.lookup(self._rows(), merged, ["digest"], hot)
        kept = (F.col("run") == F.col("first.run")) & (F.col("row") == F.col("first.row"))
        out = found.select("id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest"))
        if bad.isEmpty():
            return out
        # unequal texts under one digest: those rows are grouped by the bytes themselves
        clash = self._texts().join(bad, "digest")
        same = Window.partitionBy("digest", "norm")
        first = same.orderBy(F.col("id").isNull(), "id")
        apart = clash.select(
            "id",
            F.first("id").over(first).alias("keep_id"),
            F.count(F.lit(1)).over(same).alias("group_size"),
            (F.row_number().over(first) == 1).alias("kept"),
            "digest",
        )
        return out.join(bad, "digest", "left_anti").select(*apart.columns).unionByName(apart)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    index = DedupIndex(docs.sparkSession, id_col, text_col)
    index.insert(docs)
    return index.assign().select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
