"""Nearest exemplar by normalised compression distance.

Compressed sizes of texts and exemplars are computed once each, so a pair costs one
compression.  The exemplars are a model's, one a component at most; their total size is
checked against MAX_BYTES before they travel to the tasks, and a larger set goes in blocks,
each a scan whose minima combine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text_metrics import MIN_BYTES, NCD_LEVEL

MAX_BYTES = 64 << 20


def joint_size(begun, y: bytes) -> int:
    """Size of x and y compressed together, from a compressor that has taken x."""
    c = begun.copy()
    return len(c.compress(y)) + len(c.flush())


def distance(joint: int, cx: int, cy: int) -> float:
    """Normalised compression distance from the joint size, x first."""
    most = max(cx, cy)
    return max(0.0, min(1.0, (joint - min(cx, cy)) / most)) if most else 0.0


def ncd(x: bytes, y: bytes, cx: int, cy: int) -> float:
    return distance(len(zlib.compress(x + y, NCD_LEVEL)), cx, cy)


def _blocks(exemplars: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in exemplars.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).orderBy("k").toLocalIterator():
        raw = r["t"].encode("utf-8")
        held.append((r["k"], raw))
        size += len(raw)
        if size > MAX_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def nearest(texts: DataFrame, key: str, text: str, exemplars: DataFrame, exemplar_key: str, exemplar_text: str) -> DataFrame:
    """(key, nearest_exemplar_id, ncd) of every row, repeated keys included; the first exemplar wins ties; null under MIN_BYTES bytes or without exemplars."""
    kinds = dict(texts.dtypes)[key], dict(exemplars.dtypes)[exemplar_key]
    spark = texts.sparkSession
    out = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lit(None).cast(kinds[1]).alias("e"), F.lit(None).cast("double").alias("d"))
    sent = []
    for block in _blocks(exemplars, exemplar_key, exemplar_text):
        # the tasks see exemplars by their number in the block, so keys may be of any type
        sent.append(spark.sparkContext.broadcast([(raw, len(zlib.compress(raw, NCD_LEVEL))) for _, raw in block]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent[-1]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, ds = [], []
                for t, before in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                    raw, best = (t or "").encode("utf-8"), (None, before)
                    if len(raw) >= MIN_BYTES:
                        begun = zlib.compressobj(NCD_LEVEL)
                        head = len(begun.compress(raw))
                        cx = len(zlib.compress(raw, NCD_LEVEL))
                        for i, (y, cy) in enumerate(sent.value):
                            d = distance(head + joint_size(begun, y), cx, cy)
                            if best[1] is None or d < best[1]:
                                best = (i, d)
                    at.append(best[0])
                    ds.append(best[1])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(at, pa.int32()), pa.array(ds, pa.float64())], names=["k", "t", "e", "at", "d"])

        names = F.array(*[F.lit(e).cast(kinds[1]) for e, _ in block])
        part = out.mapInArrow(run, f"k {kinds[0]}, t string, e {kinds[1]}, at int, d double")
        out = part.select("k", "t", F.when(F.col("at").isNull(), F.col("e")).otherwise(F.get(names, F.col("at"))).alias("e"), "d")
    return out.select(F.col("k").alias(key), F.col("e").alias("nearest_exemplar_id"), F.col("d").alias("ncd"))
