"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in three bits or fewer have a value between them, at
distance one from the one and at most two from the other.  Every distinct
fingerprint emits such values (variants), they are shuffled, and what meets on a
variant is verified.  Two facts keep the balls small and lose no pair:

* fingerprints at distance three or one differ in the parity of their ones, those
  at distance two do not.  So everyone emits its 64 neighbours (that covers
  distance two), and only the odd ones emit themselves (distance one) and
  values at distance two (distance three);
* of three differing bits two lie in the same half of the word; so an odd one
  flips only pairs of bits of one half: 2 * C(32, 2) = 992 instead of 2016.

That is 64 variants of an even and 1057 of an odd fingerprint.  A variant is met by
1057 distinct fingerprints at most, so no meeting point can grow hot.

All but the pair flippers of a meeting are within distance two of each other and
within three of the pair flippers: linking each to the least of them keeps every
component, with as many links as members and never all pairs.

Edge cases.  Null texts count as empty; no words give fingerprint zero, linked
like any other.  Null identifiers have component null unless another member has
an identifier.  Repeated rows stay.  An empty table gives an empty result.  A very long
text is summed in blocks of hashes.  Further columns are not read; :func:`drop_near_copies` returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.components import connected_components
from plumbline.llm.near_copies import near_copies

WORDS, RADIUS, SEED = 3, 3, 42
#: Variants that one group of the meeting may hold on average: 10 bytes each.
GROUP_ROWS = 1_000_000
#: Variants that one task emits on average.
TASK_ROWS = 4_000_000
#: Fingerprints expanded at once in a task.
CHUNK = 2_048

_SINGLE = np.array([1 << k for k in range(64)], np.uint64)
_PAIRS = np.array([(1 << a) | (1 << b) for half in (range(32), range(32, 64)) for a, b in combinations(half, 2)], np.uint64)
#: All flips by their number: 64 single bits, none, pairs.  A variant and the number of its flip give its fingerprint.
_FLIPS = np.concatenate([_SINGLE, np.zeros(1, np.uint64), _PAIRS])
_INNER = 65


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the three-word shingles of ASCII-lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = counts * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    narrow = docs.select(common.named(id_col).alias("id"), common.named(text_col).alias("text"))
    return narrow.mapInArrow(compute, f"id {dict(docs.dtypes)[id_col]}, fp long")


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, number of the flip that made it) of all fingerprints."""
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    few, many = fps[~odd], fps[odd]
    v = np.concatenate([(few[:, None] ^ _SINGLE).ravel(), (many[:, None] ^ _FLIPS).ravel()])
    flip = np.concatenate([np.tile(np.arange(64, dtype=np.uint16), len(few)), np.tile(np.arange(len(_FLIPS), dtype=np.uint16), len(many))])
    return v, flip


def meetings(v: np.ndarray, flip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (hub, member) of all that meet on equal variants."""
    order = np.argsort(v, kind="stable")
    v, flip = v[order], flip[order]
    new = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
    shared = ~new
    shared[:-1] |= ~new[1:]
    v, flip, new = v[shared], flip[shared], new[shared]
    group = np.cumsum(new) - 1
    f, inner = v ^ _FLIPS[flip], flip < _INNER
    n = int(group[-1]) + 1 if len(group) else 0
    hub = np.full(n, np.uint64(2**64 - 1))
    np.minimum.at(hub, group[inner], f[inner])
    has = np.zeros(n, bool)
    has[group[inner]] = True
    a, b = hub[group], f
    good = has[group] & (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    links = np.unique(np.stack([a[good], b[good]], axis=1), axis=0)
    return links[:, 0], links[:, 1]


def links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between the ``n`` distinct fingerprints of ``fps`` such that exactly the linked ones are connected.

    Variants travel as binary blocks, one a group of variants and chunk of fingerprints: 10 bytes
    a variant, without a row's overhead.  The number of groups grows with ``n``.
    """
    groups = max(1, math.ceil(n * 561 / GROUP_ROWS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(all_), CHUNK):
                v, flip = variants(all_[k : k + CHUNK])
                part = (((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(groups)).astype(np.uint32)
                order = np.argsort(part, kind="stable")
                v, flip, part = v[order], flip[order], part[order]
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
                end = np.append(cut[1:], len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[cut].astype(np.int32)),
                        pa.array([v[s:e].tobytes() for s, e in zip(cut, end, strict=True)], pa.binary()),
                        pa.array([flip[s:e].tobytes() for s, e in zip(cut, end, strict=True)], pa.binary()),
                    ],
                    names=["part", "v", "flip"],
                )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        a, b = meetings(join("v", np.uint64), join("flip", np.uint16))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    tasks = max(1, math.ceil(n * 561 / TASK_ROWS))
    blocks = fps.select("fp").repartition(tasks, "fp").mapInArrow(common.trimmed(emit), "part int, v binary, flip binary")
    return blocks.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links)."""
    common.need(docs, [id_col, text_col])
    rows = common.written(with_fingerprint(docs, id_col, text_col), "simhash-rows")
    distinct = common.written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    found = common.written(links(distinct, common.total_rows(distinct)), "simhash-links")
    roots = connected_components(found)  # fp -> root, for linked fingerprints
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(rooted.join(lowest, "root").select("fp", "component_id", "n"), "simhash-components")
    hot = common.hot_keys(named, "n", common.total_rows(named, "n"))
    return common.lookup(rows, named, ["fp"], hot).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of each component of :func:`near_copies`, the one with the smallest identifier stays, and of those without identifier, which copy each other only, one too.

    Rows are told apart by identifier and text; of rows equal in both, the one stays whose columns have the least hash."""
    rows = common.written(near_copies(docs, id_col, text_col), "near-components")
    none = F.col("id").isNull()
    stay = rows.groupBy("component", none.alias("none")).agg(F.min(F.struct("id", "u1", "u2")).alias("least")).select("least.u1", "least.u2")
    keyed = docs.select(*common.row_keys(id_col, text_col), F.xxhash64(*map(common.named, docs.columns)).alias("u3"), common.whole_row(docs))
    left = keyed.join(stay, ["u1", "u2"], "left_semi").groupBy("u1", "u2").agg(F.min_by("row", "u3").alias("row"))
    return left.select("row.*")
