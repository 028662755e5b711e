"""Information-theoretic text metrics.

Byte histograms and zlib have no built-in counterpart, so they are Arrow UDFs that
work on whole record batches; all that follows from them is column arithmetic.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Below so many bytes a compression ratio says nothing and is null.
MIN_BYTES = 50
SCORE_LEVEL, NCD_LEVEL = 6, 9
MAX_ENTROPY = 8.0


def _bytes(texts: pa.Array):
    return (b"" if t is None else t.encode("utf-8") for t in texts.to_pylist())


@F.arrow_udf(T.DoubleType())
def byte_entropy(texts: pa.Array) -> pa.Array:
    """Shannon entropy in bits of the UTF-8 bytes; 0 for empty or null."""
    out = []
    for raw in _bytes(texts):
        counts = np.bincount(np.frombuffer(raw, np.uint8))
        p = counts[counts > 0] / max(1, len(raw))
        out.append(float(-(p * np.log2(p)).sum()) + 0.0 if len(raw) else 0.0)
    return pa.array(out, pa.float64())


@F.arrow_udf(T.LongType())
def zlib_size(texts: pa.Array) -> pa.Array:
    """Bytes of the text after zlib at level 6; empty gives 0."""
    return pa.array([len(zlib.compress(raw, SCORE_LEVEL)) if raw else 0 for raw in _bytes(texts)], pa.int64())


@F.arrow_udf(T.LongType())
def zlib_size_best(texts: pa.Array) -> pa.Array:
    """Bytes after zlib at level 9, the size that compression distances use."""
    return pa.array([len(zlib.compress(raw, NCD_LEVEL)) for raw in _bytes(texts)], pa.int64())


def compression_ratio(size: Column, packed: Column) -> Column:
    """Packed over raw bytes; null under MIN_BYTES bytes."""
    return F.when(size >= MIN_BYTES, packed / size)


def birkhoff(size: Column, entropy: Column, packed: Column) -> Column:
    """Order over complexity: ((N H) - K) / (N H), within 0 and 1; 0 if N H is 0."""
    nh = size * entropy
    return F.when(nh <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (nh - packed) / nh)))


def distance(joint: Column, x: Column, y: Column) -> Column:
    """Normalised compression distance from compressed sizes."""
    most = F.greatest(x, y)
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (joint - F.least(x, y)) / most)))


def bin_entropy(vector: Column) -> Column:
    """Shannon entropy of a vector of shares; 0 if all are 0."""
    term = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    return F.aggregate(vector, F.lit(0.0), lambda a, p: a + term(p.cast("double")))
