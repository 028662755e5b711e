"""Suffix-array dedup: bytes covered by a T-byte string that starts anywhere else are removed.

Prefix doubling over a sparse set of positions.  A rank is the 64-bit name of a
prefix (equal prefixes, equal names); Spark sorts names, counts them and drops the
positions whose name is unique, at growing lengths:

1. K = 64 bytes.  Only anchors (about one position in 70) are ranked: every
   T-byte window owns one, at a place that depends on its bytes alone (see
   ``suffix_windows``), so equal windows own anchors of equal rank.  Anchors of unique rank go.
2. The span of an anchor, which is all that its windows cover.  Equal
   spans settle all their windows at once.
3. Of spans that share an anchor's rank but are unequal, one of each kind is unfolded into its
   positions.  A position's rank pair is (rank of T/2 bytes here, rank of T/2 bytes at offset T/2); the
   pairs are sorted and positions of equal pairs are past the threshold.

Pairs that repeat inside a task are settled there and one of them goes on, so that a
passage which very many texts share doesn't meet in one place.  Equal texts are
reduced to one with a count at the start: of T bytes or more, they go as a whole.

Names are 64-bit hashes, not verified on the bytes.  Spans are known by two of them.  Rank pairs are compared within one
group of about GROUP_ROWS positions only, so a false match of two pairs has a chance of 3 in 10^8 a group.

Edge cases.  A null text counts as empty.  Texts under T bytes match nothing.
Repeated rows are equal texts.  Null identifiers stay as they are; an empty table gives an
empty result; further columns are not touched, whatever their names.  A very long text is unfolded CHUNK positions at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.suffix_windows import K, T, Rolling, anchors, mix

_PER_WORD = 60
_MASKS = -(-(T - K + 1) // _PER_WORD)
#: Positions a group of the pair sort holds on average (16 bytes each), and positions that a task combines at once.
GROUP_ROWS, CHUNK = 1_000_000, 1_000_000


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _keys(text):
    return F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t1, t2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out, held = [], 0
        for k, text in enumerate(b.column(2)):
            found = anchors(text.as_py().encode("utf-8", "surrogatepass"))
            if found is not None:
                out.append((np.full(len(found[0]), t1[k]), np.full(len(found[0]), t2[k]), *found))
                held += len(found[0])
            if out and (held > 200_000 or k + 1 == b.num_rows):
                c = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(_signed, c[:4]), pa.array(c[4].astype(np.int32)), pa.array(c[5].astype(np.int32))], names=["t1", "t2", "seed", "span", "lo", "hi"])
                out, held = [], 0
        if out:
            c = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(_signed, c[:4]), pa.array(c[4].astype(np.int32)), pa.array(c[5].astype(np.int32))], names=["t1", "t2", "seed", "span", "lo", "hi"])


def _combine(name: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, owners) with one row a name, and the owners of names that repeat here."""
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    new = np.concatenate(([True], name[1:] != name[:-1]))
    repeated = ~new
    repeated[:-1] |= ~new[1:]
    return name[new], owner[new], owner[repeated]


def _emitter(groups: int):
    """Unfold spans into rank pairs; blocks (part, names, owners), those of settled owners without names.

    Equal windows own anchors of equal rank, so a rank's spans meet in one group; a rank with very many kinds of
    spans is dealt to ``subs`` groups by its names.
    """
    half = T // 2

    def cut_up(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        end = np.append(cut[1:], len(part))[: len(cut)]  # nothing may repeat in a chunk: then there is no block
        dealt = [c[order] for c in columns]  # once, not once a group: there are as many groups as millions of positions
        return part[cut], [[c[s:e].tobytes() for s, e in zip(cut, end, strict=True)] for c in dealt]

    def blocks(name: np.ndarray, owner: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(name, kind="stable")
        name, owner, part = name[order], owner[order], part[order]
        new = np.concatenate(([True], name[1:] != name[:-1]))
        repeated = ~new
        repeated[:-1] |= ~new[1:]
        parts, (names, owners) = cut_up(part[new], name[new], owner[new])
        more, (settled,) = cut_up(part[repeated], owner[repeated])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([parts, more]), pa.int32()), pa.array(names + [b""] * len(more), pa.binary()), pa.array(owners + settled, pa.binary())], names=["part", "names", "owners"]
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        part: list[np.ndarray] = []
        held = 0
        for b in batches:
            for k in range(b.num_rows):
                raw = np.frombuffer(b.column(0)[k].as_py().encode("utf-8", "surrogatepass"), np.uint8)
                for s in b.column(1)[k].as_py():
                    lo, hi = s["lo"], s["hi"]
                    cut = raw[lo : hi + T]
                    a, c = Rolling(cut, 0).every(half), Rolling(cut, 1).every(half)
                    n = hi - lo + 1
                    seed = np.uint64(s["seed"] % 2**64)
                    pair = mix(a[:n] ^ mix(c[half : half + n] + seed))
                    name.append(pair)
                    part.append(((seed + (pair >> np.uint64(20)) % np.uint64(s["subs"])) % np.uint64(groups)).astype(np.int32))
                    owner.append(np.uint64(s["rep"]) * np.uint64(256) + np.arange(n, dtype=np.uint64))
                    held += n
                    if held >= CHUNK:
                        yield blocks(np.concatenate(name), np.concatenate(owner), np.concatenate(part))
                        name, owner, part, held = [], [], [], 0
        if held:
            yield blocks(np.concatenate(name), np.concatenate(owner), np.concatenate(part))

    return emit


def _settle(key: tuple, table: pa.Table) -> pa.Table:
    """Owners whose name is met again, as (rep, bit masks of its positions)."""
    names, owners = table.column("names").to_pylist(), table.column("owners").to_pylist()
    own = np.frombuffer(b"".join(o for n, o in zip(names, owners, strict=True) if n), np.uint64)
    done = [np.frombuffer(o, np.uint64) for n, o in zip(names, owners, strict=True) if not n]
    if len(own):
        done.append(_combine(np.frombuffer(b"".join(names), np.uint64), own)[2])
    own = np.unique(np.concatenate(done)) if done else np.zeros(0, np.uint64)
    rep, at = own >> np.uint64(8), (own & np.uint64(255)).astype(np.int64)
    reps, where = np.unique(rep, return_inverse=True)
    masks = np.zeros((_MASKS, len(reps)), np.int64)
    np.bitwise_or.at(masks, (at // _PER_WORD, where), np.int64(1) << (at % _PER_WORD))
    return pa.table({"rep": pa.array(reps.astype(np.int64)), **{f"m{k}": pa.array(masks[k]) for k in range(_MASKS)}})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, lo, hi) of the runs of settled positions of each span."""
    for b in batches:
        t1, t2, lo = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        masks = np.stack([b.column(3 + k).to_numpy(zero_copy_only=False) for k in range(_MASKS)], axis=1).astype(np.int64)
        bits = ((masks[:, :, None] >> np.arange(_PER_WORD)) & 1).reshape(len(lo), -1).astype(np.int8)
        edge = np.diff(np.pad(bits, ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(t1[row]), pa.array(t2[row]), pa.array((lo[row] + start).astype(np.int32)), pa.array((lo[row] + stop - 1).astype(np.int32))], names=["t1", "t2", "lo", "hi"]
        )


def remove(raw: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal runs removed) for runs lo..hi of starts of repeated windows."""
    if not starts:
        return raw, 0, 0
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, [s for s, _ in starts], 1)
    np.add.at(change, [e + T for _, e in starts], -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _cutter(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                cols: list[list] = [[], [], [], [], []]
                for text, copies, starts in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    if copies > 1 and len(raw) >= T:
                        kept, removed, spans = b"", len(raw), 1
                    else:
                        kept, removed, spans = remove(raw, [(s["lo"], s["hi"]) for s in starts or []])
                    row = (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text and removed else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def removed_spans(docs: DataFrame, text_col: str, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per distinct text (t1, t2): n_bytes, n_removed, n_spans, kept_sha256, kept (null if nothing goes); and the texts' row counts."""
    text = docs.select(common.text_of(text_col).alias("text"))
    # one row a distinct text; copies fall together in each task before they move
    texts = common.written(text.select(*_keys(F.col("text")), "text").groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "suffix-texts")
    ranked = common.written(texts.select("t1", "t2", "text").mapInArrow(common.trimmed(_anchor_rows), "t1 long, t2 long, seed long, span long, lo int, hi int"), "suffix-anchors")

    # 64-byte ranks: drop the unique ones
    seeds = ranked.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), (F.min("span") != F.max("span")).alias("mixed")).where("n > 1").select("seed", "mixed")
    seeds = common.written(seeds, "suffix-seeds")  # so that the join below is one that Spark can split where a seed is frequent
    left = common.written(ranked.join(seeds, "seed"), "suffix-left")
    common.dropped(ranked, seeds)
    # spans: equal ones are settled; one of each kind under a mixed rank is unfolded
    kinds = left.groupBy("seed", "span").agg(
        F.count(F.lit(1)).alias("n"), F.first("mixed").alias("mixed"), *[F.first(c).alias(c) for c in ("t1", "t2", "lo", "hi")]
    )
    kinds = common.written(kinds.where("n > 1 OR mixed").withColumn("rep", F.monotonically_increasing_id()), "suffix-kinds")
    # a passage that very many texts share has one span: its rows stay where they are
    often = kinds.where("n > 1").select("seed", "span", "n")
    settled = common.lookup(left.select("seed", "span", "t1", "t2", "lo", "hi"), often, ["seed", "span"], common.hot_keys(often, "n", common.total_rows(left))).select("t1", "t2", "lo", "hi")
    unfold = kinds.where("mixed")
    # ranks of so many positions that they would fill a group for themselves
    crowd = unfold.groupBy("seed").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("p")).where(F.col("p") > GROUP_ROWS)
    crowd = common.written(crowd.select("seed", F.ceil(F.col("p") / GROUP_ROWS).alias("subs")), "suffix-crowd")
    dealt = unfold.join(crowd, "seed", "left").withColumn("subs", F.coalesce("subs", F.lit(1)).cast("long"))
    wanted = dealt.groupBy("t1", "t2").agg(F.collect_list(F.struct("seed", "lo", "hi", "rep", "subs")).alias("spans"))
    positions = int(unfold.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0)
    groups = max(1, math.ceil(positions / GROUP_ROWS))
    blocks = texts.select("t1", "t2", "text").join(wanted, ["t1", "t2"]).select("text", "spans").mapInArrow(common.trimmed(_emitter(groups)), "part int, names binary, owners binary")
    schema = "rep long, " + ", ".join(f"m{k} long" for k in range(_MASKS))
    found = blocks.groupBy("part").applyInArrow(_settle, schema).groupBy("rep").agg(*[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(_MASKS)])
    single = unfold.where("n = 1").select("rep", "t1", "t2", "lo").join(found, "rep")
    edges = single.select("t1", "t2", "lo", *[f"m{k}" for k in range(_MASKS)]).mapInArrow(common.trimmed(_runs), "t1 long, t2 long, lo int, hi int")
    starts = settled.unionByName(edges).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    starts = common.written(starts, "suffix-starts")
    common.dropped(left, kinds)
    out = texts.join(starts, ["t1", "t2"], "left").select("t1", "t2", "text", "copies", "starts").mapInArrow(
        common.trimmed(_cutter(with_text)), "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )
    out = common.written(out, "suffix-out")
    counts = common.written(texts.select("t1", "t2", "copies"), "suffix-counts")
    common.dropped(texts, starts)
    return out, counts


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256.  With ``rewrite``, ``docs`` with the remaining text instead; a character that is cut in two goes."""
    common.need(docs, [id_col, text_col])
    out, counts = removed_spans(docs, text_col, rewrite)
    out = out.join(counts, ["t1", "t2"])
    hot = common.hot_keys(out, "copies", common.total_rows(counts, "copies"))
    if rewrite:
        keyed = docs.select(*_keys(common.text_of(text_col)), common.whole_row(docs))
        right = out.where("n_removed > 0").select("t1", "t2", "kept", "copies")
        hot = common.hot_keys(right, "copies", common.total_rows(counts, "copies"))
        found = common.lookup(keyed, right, ["t1", "t2"], hot, "left")
        column = F.col("row").getField
        return found.select(*[(F.coalesce("kept", column(c)) if c == text_col else column(c)).alias(c) for c in docs.columns])
    rows = docs.select(common.named(id_col).alias("id"), *_keys(common.text_of(text_col)))
    right = out.select("t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "copies")
    return common.lookup(rows, right, ["t1", "t2"], hot.select(*right.columns)).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
