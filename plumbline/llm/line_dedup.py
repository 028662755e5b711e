"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines (parts of a text between newlines) are compared with all lines of all
documents, in the order of document identifier and line number.  A line goes if
an equal line is earlier, or if its characters number MIN_CHARS or more and an
earlier line, of any length, differs from it by one edit (one character inserted, deleted or
replaced).  Lines are judged on the input, not on what is left.  Blank lines stay.

How near lines are found, without pairs:

1. Distinct lines are known by 128-bit hashes and their first place.
2. Lines one edit apart share their first or their last half.  Hashes of both
   halves leave only lines that share one with another line.
3. Those emit their deletion neighbourhood, at the places where the edit can be:
   the hash of the line without its character ``j``.  It is put together from the
   hash of what precedes the block of BLOCK characters around ``j``, the block without
   ``j``, and the hash of what follows, so a long line costs no more a character than
   a short one.  Lines with one variant at one ``j`` are replacements of each other:
   of such a group only the earliest matters.  A line equal to another's variant is an
   insertion or deletion away from it: such lines meet the shorter one's own hash.
4. The earliest line of each meeting is a rival of the others; every pair of a line and a rival is verified by its edit distance.

Lines shared by very many documents fall together in each task before they move; halves shared by
very many lines meet by broadcast (see ``common.lookup``).

Edge cases.  A null text counts as empty.  Null identifiers come last; rows of equal
identifier are ordered by a hash of their texts; wholly equal rows count as one document
and all get its result.  An empty table gives an empty result.  Very long texts and lines are split and hashed like any other.
Other columns are untouched, whatever their names; own columns n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common

MIN_CHARS = 16
BLOCK = 64
#: A line of these alone is blank; a trim ends at the first other character.
BLANK = " \t\r\x0b\x0c"
#: Characters of the lines whose neighbourhoods one task emits.
TASK_CHARS = 200_000
_PLACE = ["none", "id", "doc", "pos"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, u1, u2, text): u1, u2 name a row by identifier and text."""
    return docs.select(common.named(id_col).alias("id"), *common.row_keys(id_col, text_col), common.text_of(text_col).alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """(u1, u2, id, pos, line, h1, h2) of every line that is not blank."""
    out = rows.select("u1", "u2", "id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.ltrim("line", F.lit(BLANK)) != "")
    return out.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit(1)))


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and the last half, as the shorter line of a pair has ``n`` or ``n - 1`` characters."""
    out = []
    for least in (n, n - 1):
        p = (least / 2).cast("int")
        out.append(F.xxhash64(F.substring(line, F.lit(1), p), least, F.lit(0)))
        out.append(F.xxhash64(F.substring(line, n - (least - p) + 1, least - p), least, F.lit(1)))
    return out


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("u1").alias("doc"), F.col("pos"))


def _variants(near: DataFrame, carried: list[str]) -> DataFrame:
    """(carried, key, spot, kind): keys of the deletion neighbourhoods of ``near`` lines.

    Kind 0 is the line without its character ``spot``; kind 1 the same for any place (spot -1); kind 2 the line itself
    as what is left of a longer one.  ``front``, ``back`` tell whether the edit can be in the first, the last half.
    """
    n, line, i = F.char_length("line"), F.col("line"), F.col("i")
    begin = i * BLOCK
    # positions (from 0) at which an edit can be: a half, with one position to spare on either side
    low = F.when(F.col("front"), F.lit(0)).otherwise(F.greatest(F.lit(0), ((n - 1) / 2).cast("int") - 1))
    high = F.when(F.col("back"), n).otherwise(F.least(n, (n / 2).cast("int") + 2))
    blocks = near.select(*carried, "line", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1)).alias("i"))
    mid = F.substring(line, begin + 1, F.lit(BLOCK))
    frame = F.xxhash64(F.substring(line, F.lit(1), begin), F.substring(line, begin + BLOCK + 1, n), n - 1, i)
    framed = blocks.select(
        *carried, begin.alias("begin"), mid.alias("mid"), frame.alias("frame"), F.greatest(F.col("low") - begin, F.lit(0)).alias("lo"), (F.least(F.col("high") - begin, F.char_length(mid)) - 1).alias("hi")
    ).where("lo <= hi")
    each = framed.select(*carried, "begin", "mid", "frame", F.explode(F.sequence("lo", "hi")).alias("j"))
    key = F.xxhash64(F.concat(F.substring(F.col("mid"), F.lit(1), F.col("j")), F.substring(F.col("mid"), F.col("j") + 2, F.lit(BLOCK))), F.col("frame"))
    cut = each.select(*carried, key.alias("key"), F.explode(F.array(F.col("begin") + F.col("j"), F.lit(-1))).alias("spot"))
    cut = cut.withColumn("kind", F.when(F.col("spot") >= 0, 0).otherwise(1))
    own = near.select(*carried, "line", F.explode(F.sequence(F.lit(0), F.ceil((n + 1) / BLOCK).cast("int") - 1)).alias("i"))
    whole = F.xxhash64(F.substring(line, begin + 1, F.lit(BLOCK - 1)), F.xxhash64(F.substring(line, F.lit(1), begin), F.substring(line, begin + BLOCK, n), n, i))
    return cut.unionByName(own.select(*carried, whole.alias("key"), F.lit(-1).alias("spot"), F.lit(2).alias("kind")))


def _ends(*columns: str) -> list[Column]:
    """Least and greatest of each column: UNLIKE if two rows differ in one of them."""
    return [f(c).alias(f"{at}_{c}") for c in columns for f, at in ((F.min, "min"), (F.max, "max"))]


UNLIKE = "min_h1 <> max_h1 OR min_h2 <> max_h2"


def _gone(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line one edit away."""
    long_ = known.where(F.col("n") >= MIN_CHARS - 1)  # the earlier line of a pair may be the shorter one
    halves = long_.select("h1", "h2", "n", F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("k"), F.lit(i % 2).alias("side")) for i in range(4)])).alias("half")).select("h1", "h2", "n", "half.k", "half.side")
    shared = halves.groupBy("k").agg(*_ends("h1", "h2"), F.count(F.lit(1)).alias("lines")).where(UNLIKE).select("k", "lines")
    shared = common.written(shared, "lines-shared")
    hot = common.hot_keys(shared, "lines", common.total_rows(shared, "lines"))
    met = common.lookup(halves, shared, ["k"], hot).groupBy("h1", "h2").agg(F.first("n").alias("n"), F.max(F.col("side") == 1).alias("front"), F.max(F.col("side") == 0).alias("back"))
    found = common.written(met, "lines-met")
    common.dropped(shared)
    tasks = common.total_rows(found, "n") // TASK_CHARS + 1
    # copies of a line fall together in each task before anything moves
    texts = common.sifted(lines.select("h1", "h2", "line"), found, "h1").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    near = texts.join(found, ["h1", "h2"]).join(known.select("h1", "h2", "first"), ["h1", "h2"])
    near = common.written(near, "lines-near")
    # dealt after reading: a scan puts many small files in one task
    dealt = near.repartition(tasks, "h1")
    # replacements meet at one spot; deletions (kind 1) meet the shorter line's own keys (kind 2)
    clash = _variants(dealt, ["h1", "h2"]).groupBy("key", "spot").agg(*_ends("h1", "h2"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    clash = common.written(clash.where(f"({UNLIKE}) AND (spot >= 0 OR (lo = 1 AND hi = 2))").select("key", "spot"), "lines-clash")
    members = _variants(dealt, ["h1", "h2", "first"]).join(clash, ["key", "spot"])
    members = common.written(members.withColumn("self", F.struct("first", "h1", "h2")), "lines-members")
    first = members.groupBy("key", "spot").agg(
        F.min("self").alias("any"), F.min(F.when(F.col("kind") == 1, F.col("self"))).alias("cut"), F.min(F.when(F.col("kind") == 2, F.col("self"))).alias("own")
    )
    rival = F.when(F.col("kind") == 0, F.col("any")).when(F.col("kind") == 1, F.col("own")).otherwise(F.col("cut"))
    pairs = members.join(first, ["key", "spot"]).select("h1", "h2", "first", rival.alias("rival")).where("rival.first < first")
    pairs = pairs.select("h1", "h2", F.col("rival.h1").alias("r1"), F.col("rival.h2").alias("r2")).distinct()
    going = near.select("h1", "h2", "line").where(F.char_length("line") >= MIN_CHARS)
    other = near.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("line").alias("earlier"))
    return pairs.join(going, ["h1", "h2"]).join(other, ["r1", "r2"]).where(F.levenshtein("line", "earlier", 1) >= 0).select("h1", "h2").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` less the lines that go, and n_lines, n_dropped (in place of own columns of these names)."""
    common.need(docs, [id_col, text_col])
    rows = _rows(docs, id_col, text_col)
    lines = _lines(rows)
    n = F.char_length("line")
    narrow = lines.select("h1", "h2", _place().alias("place"), n.alias("n"), *[h.alias(f"k{i}") for i, h in enumerate(_halves(F.col("line"), n))])
    known = common.written(
        narrow.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), *[F.first(f"k{i}").alias(f"k{i}") for i in range(4)]),
        "lines-known",
    )
    gone = common.written(_gone(lines, known), "lines-gone").withColumn("gone", F.lit(True))
    judged = known.join(gone, ["h1", "h2"], "left").where("copies > 1 OR gone").select("h1", "h2", "first", "copies", F.coalesce("gone", F.lit(False)).alias("gone"))
    judged = common.written(judged, "lines-judged")
    hot = common.hot_keys(judged, "copies", common.total_rows(known, "copies"))
    # most lines are met by nothing: they end where they are read
    some = common.sifted(lines.select("u1", "u2", "id", "pos", "h1", "h2"), judged, "h1")
    places = common.lookup(some.select("u1", "u2", "h1", "h2", _place().alias("place")), judged, ["h1", "h2"], hot)
    drop = places.where(F.col("gone") | (F.col("place") != F.col("first"))).groupBy("u1", "u2").agg(F.array_sort(F.collect_set("place.pos")).alias("drop"))
    drop = common.written(drop, "lines-drop")
    parts = F.split(common.text_of(text_col), "\n")
    keyed = docs.select(*common.row_keys(id_col, text_col), F.size(parts).cast("long").alias("n_lines"), common.whole_row(docs))
    joined = keyed.join(drop, ["u1", "u2"], "left")
    # an array of one element binds the lines, so that a text is split once
    left = lambda b: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(b["parts"]) - 1), b["drop"]), lambda i: F.get(b["parts"], i)), "\n")
    text = F.col("row").getField(text_col)
    bound = F.array(F.struct(F.split(text.cast("string"), "\n").alias("parts"), F.col("drop")))
    own = {
        text_col: F.when(F.col("drop").isNull(), text).otherwise(F.get(F.transform(bound, left), 0)),
        "n_lines": F.col("n_lines"),
        "n_dropped": F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long"),
    }
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in [*kept, "n_lines", "n_dropped"]])
