"""Document fingerprints by a threshold-scaled sketch, in DataFrame operations only.

The fingerprint of a text holds every distinct hash of its five-word shingles that
lies below a fixed fraction (1/SCALE) of the hash space, and its LEAST smallest ones in any case, so that a short text
has a fingerprint too.  Both parts merge: the hashes of two texts below the bound are the union's, and the union's
LEAST smallest are among theirs; so :func:`merged` gives exactly the fingerprint of both texts' shingles together.

A sketch of fewer than LEAST hashes holds all of its text's; any other holds all up to the bound or up to
its own greatest hash, whichever is higher.  Two sketches are compared up to the lower of these two limits only, where both are
whole: the share of one's hashes found in the other estimates its containment, however unequal the texts are.

Edge cases.  A null text counts as empty; a text without words has the empty
fingerprint, which is like itself (1) and unlike any other (0).  A text of one to
four words is one shingle.  Identifiers may be of any type that has an order.  Null identifiers come after all others; equal identifiers are
ordered by a hash of their texts.  An empty table gives an empty result.  Very long texts are hashed as a whole.  Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common

WORDS = 5
SCALE, LEAST = 16, 8
BREAK = r"[\x20\x09-\x0D]+"
#: Rows a range of the order of identifiers has, about.  There are SIDE * SIDE ranges at most, whose first keys are broadcast; beyond that they grow.
RANGE_ROWS, SIDE = 10_000, 1_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of ``words`` words, repeats included: a word is hashed once, a shingle from its words' hashes."""
    hashed = F.transform(F.filter(F.split(text, BREAK), lambda w: w != ""), lambda w: F.xxhash64(w))
    # an array of one element binds the word hashes, so that they are computed once a text
    per_text = lambda h: F.when(
        F.size(h) >= words,
        F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])),
    ).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(hashed), per_text))


def _bound(scale: int) -> Column:
    """Hashes are signed: the lowest 1/scale of the space begins at the least value."""
    return F.lit(-(2**63) + 2**64 // scale)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE, least: int = LEAST) -> Column:
    """The retained hashes, sorted."""
    return _retained(shingle_hashes(text, words), scale, least)


def _retained(hashes: Column, scale: int, least: int) -> Column:
    """Of an array of hashes those below the bound, or the least ones if these are fewer; sorted, once each."""
    # arrays of one element bind what is used twice, so that it is computed once
    low = lambda all_: F.struct(all_.alias("all"), F.array_sort(F.array_distinct(F.filter(all_, lambda x: x < _bound(scale)))).alias("low"))
    keep = lambda b: F.when(F.size(b["low"]) >= least, b["low"]).otherwise(F.slice(F.array_sort(F.array_distinct(b["all"])), 1, least))
    return F.flatten(F.transform(F.transform(F.array(hashes), low), keep))


def merged(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of two texts' shingles together."""
    return _retained(F.array_union(a, b), scale, least)


def _limit(s: Column, scale: int, least: int) -> Column:
    """Up to this hash a sketch is whole."""
    return F.when(F.size(s) < least, F.lit(2**63 - 1)).otherwise(F.greatest(F.element_at(s, -1), _bound(scale) - 1))


def _compared(a: Column, b: Column, scale: int, least: int, share) -> Column:
    """``share`` of both sketches as far as both are whole; 1 for two empty ones, 0 if only one is, or if nothing can be compared."""

    def cut(s: Column) -> Column:
        limit = F.least(_limit(s["a"], scale, least), _limit(s["b"], scale, least))
        return F.struct(F.filter(s["a"], lambda x: x <= limit).alias("a"), F.filter(s["b"], lambda x: x <= limit).alias("b"))

    both = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), cut)
    found = F.get(F.transform(both, lambda s: share(s["a"], s["b"])), 0)
    return F.when(F.size(a) * F.size(b) == 0, (F.size(a) == F.size(b)).cast("double")).otherwise(F.coalesce(found, F.lit(0.0)))


def contained(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimate of the share of a's shingles that b has."""
    return _compared(a, b, scale, least, lambda x, y: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)))


def likeness(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimate of the share of the smaller text's shingles that the other has: 0 to 1, symmetric, 1 for equal sketches."""
    return _compared(a, b, scale, least, lambda x, y: F.when(F.least(F.size(x), F.size(y)) > 0, F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))))


def encoded(s: Column) -> Column:
    """A sketch as text: its hashes in 16 hex digits each."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def decoded(s: Column) -> Column:
    """The sketch of a text made by :func:`encoded`."""
    return F.transform(
        F.filter(F.split(F.regexp_replace(s, "(.{16})", "$1 "), " "), lambda x: x != ""),
        # the upper and the lower half, as conv() has no signed 64-bit result
        lambda x: F.shiftleft(F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring(x, 9, 8), 16, 10).cast("bigint")),
    )


def with_next(docs: DataFrame, id_col: str, carried: list[str], text_col: str) -> DataFrame:
    """Add ``next``: a struct of the next row's ``carried`` columns by ascending id; after the last, the first row's.

    The order (null last, identifier, hash of the text) is cut into even ranges, however the identifiers lie, and each
    range is ordered in one window; a range's first row also goes to the range before it, as that one's last neighbour.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    keys = common.written(docs.select(key.alias("key")), "sketch-keys")
    n = common.total_rows(keys)
    ranges = max(1, min(SIDE * SIDE, n // RANGE_ROWS))
    starts = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("start"))
    starts = [] if not n else common.written(starts, "sketch-starts")
    number = n and starts.count()  # ranges without a row have no start
    side = max(1, math.ceil(math.sqrt(number)))
    if number:
        # two levels of SIDE starts each, so that a row's range is found by two short searches
        rank = F.row_number().over(Window.orderBy("start")) - 1  # at most SIDE * SIDE rows
        level = starts.select("start", rank.alias("r")).withColumn("k", F.floor(F.col("r") / side).cast("int"))
        level = common.written(level.groupBy("k").agg(F.array_sort(F.collect_list("start")).alias("starts")), "sketch-levels")
        tops = level.select(F.get("starts", 0).alias("top")).orderBy("top").collect()  # SIDE keys at most
        kind = dict(docs.dtypes)[id_col]
        tops = F.array(*[F.struct(F.lit(r["top"]["none"]).alias("none"), F.lit(r["top"]["id"]).cast(kind).alias("id"), F.lit(r["top"]["hash"]).alias("hash")) for r in tops])
        at = lambda some, x: F.size(F.filter(some, lambda s: s <= x)) - 1
        own = docs.withColumn("key", key).withColumn("k", at(tops, F.col("key"))).join(F.broadcast(level), "k")
        own = own.withColumn("at", at(F.col("starts"), F.col("key"))).withColumn("head", F.get("starts", F.col("at")) == F.col("key")).withColumn("b", F.col("k") * side + F.col("at"))
    else:
        own = docs.withColumns({"key": key, "k": F.lit(0), "at": F.lit(0), "starts": F.lit(0), "head": F.lit(False), "b": F.lit(0)})
    # order inside a range: group 0 its own rows, group 1 the head of the next one; the first range's head goes to the last
    here = F.struct(F.col("b").alias("b"), F.lit(0).alias("g"))
    prior = F.struct(F.when(F.col("b") == 0, max(number - 1, 0)).otherwise(F.col("b") - 1).alias("b"), F.lit(1).alias("g"))
    dealt = own.withColumn("spot", F.explode(F.when(F.col("head"), F.array(here, prior)).otherwise(F.array(here)))).drop("b", "k", "at", "starts", "head")
    w = Window.partitionBy("spot.b").orderBy("spot.g", "key")
    out = dealt.withColumn("next", F.lead(F.struct(*carried)).over(w))
    return out.where("spot.g = 0").drop("spot", "key")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprint of every text, of its text edited with the next document's beginning, and their likenesses."""
    common.need(docs, [id_col, text_col])
    base = docs.select(common.named(id_col).alias("id"), common.text_of(text_col).alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
    known = base.withColumn("own", sketch(F.col("text"), scale=scale))
    near = with_next(known, "id", ["text", "own"], "text")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    keep = (F.col("n_chars") - cut).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), keep), F.substring(F.col("next.text"), F.lit(1), cut)))
    seen = edited.withColumn("changed", sketch(F.col("edited"), scale=scale))
    return seen.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        encoded(F.col("own")).alias("fingerprint"),
        encoded(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), scale).alias("near_edited"),
        likeness(F.col("own"), F.col("next.own"), scale).alias("near_next"),
    )
