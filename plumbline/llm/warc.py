"""WARC records and their Merkle fixity audit.

Pages become WARC/1.1 response records, written one after another to compressed files of
FILE_RECORDS page identifiers each; an index has every record's byte range in its file, and the last record of a file
lists the ranges too.  For an audit the files are read back and every record is cut out by its range where its file is read.  The leaves of a
file's tree are its records' SHA-256; a node above hashes its FANOUT children in order,
together with the byte range that they cover.  A tree over the files' roots, in the order
of their numbers, ends in the replica's root.

An audit compares the roots of two replicas and descends level by level: only children of
nodes that differ are looked at, so the work below the top follows the corruption and not the archive.

Edge cases.  Null url or html count as empty.  Records without page identifier are dealt to files of about
FILE_RECORDS (numbers -1 and below) by a hash of their content.  Bytes that are not UTF-8 are hashed as they are; parsing replaces them.  A very long
page is one record; a file has to fit in a task's memory.  Further columns are not read.  Rows that repeat an identifier follow each other in the order of their bytes.  A record that one replica lacks
is reported as missing there, with its place in the other; records are matched by identifier and hash, what is left by identifier in order.  An empty table has no tree and no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common

FANOUT = 16
FILE_RECORDS = 1_024
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Begins the record that ends a file and lists the others' ranges.
INDEX_HEAD = "WARC/1.1\r\nWARC-Type: metadata\r\nContent-Type: text/plain\r\n"
RANGE = ["idx", "begin", "size"]
#: The files are read back once and deleted: deflating fast costs less than it saves in bytes.
WRITING = {"lineSep": END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def record(url: Column, html: Column) -> Column:
    """A response record as bytes: header lines, blank line, the payload, two line ends."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(body, 256)),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    )
    return F.concat(F.encode(F.concat(head, F.lit("\r\n\r\n")), "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def parse(data: Column) -> Column:
    """(url, payload, digest_ok) of a record's bytes; bytes that are not UTF-8 are replaced in url and payload, and count in the digest."""
    text = F.decode(data, "ISO-8859-1")  # a character a byte, whatever the bytes
    cut = F.instr(text, END)
    head = F.substring(text, F.lit(1), cut - 1)
    size = F.regexp_extract(head, r"Content-Length: (\d+)", 1).cast("int")
    body = F.substring(data, cut + len(END), size)
    return F.struct(
        F.make_valid_utf8(F.encode(F.regexp_extract(head, r"WARC-Target-URI: ([^\r]*)", 1), "ISO-8859-1").cast("string")).alias("url"),
        F.make_valid_utf8(body.cast("string")).alias("payload"),
        (F.regexp_extract(head, r"sha256:([0-9a-f]{64})", 1) == F.sha2(body, 256)).alias("digest_ok"),
    )


def laid_out(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", null_files: int = 1) -> DataFrame:
    """(file_no, idx, page_id, begin, size, hash): every record's place in its file, and its hash.  Bytes are hashed where they are read; only the digests are shuffled and ordered."""
    common.need(pages, [id_col, url_col, html_col])
    data = record(common.named(url_col).cast("string"), common.named(html_col).cast("string"))
    rows = pages.select(common.named(id_col).alias("page_id"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("hash"), _file_no(id_col, data, null_files))
    order = Window.partitionBy("file_no").orderBy("page_id", "hash")
    return rows.select(
        "file_no", (F.row_number().over(order) - 1).cast("long").alias("idx"), "page_id",
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("begin"), "size", "hash",
    )


def _file_no(id_col: str, data: Column, null_files: int) -> Column:
    page = common.named(id_col)
    return F.coalesce(F.floor(page / FILE_RECORDS), -1 - F.pmod(F.xxhash64(data), F.lit(null_files))).cast("long").alias("file_no")


def write_files(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", null_files: int = 1, index: DataFrame | None = None
) -> None:
    """Write the records in the order of :func:`laid_out` (``index``, if it is at hand): one compressed WARC file in each folder ``file_no=...`` of ``path``.

    The last record of a file lists the ranges of the others, so that a file can be cut up where it is read.
    """
    data = record(common.named(url_col).cast("string"), common.named(html_col).cast("string"))
    # the writer ends every row with the two line ends that end a record
    body = F.substring(data, F.lit(1), F.octet_length(data) - len(END)).cast("string")
    rows = pages.select(_file_no(id_col, data, null_files), F.lit(False).alias("last"), common.named(id_col).alias("page_id"), F.sha2(data, 256).alias("hash"), body.alias("value"))
    if index is None:
        index = laid_out(pages, id_col, url_col, html_col, null_files)
    ranges = index.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("idx", "begin", "size"))).alias("ranges"))
    lines = F.array_join(F.transform("ranges", lambda r: F.concat_ws(" ", *[r[c].cast("string") for c in RANGE])), "\n")
    listed = F.concat(F.lit(INDEX_HEAD + "Content-Length: "), F.octet_length(lines).cast("string"), F.lit(END), lines)
    last = ranges.select("file_no", F.lit(True).alias("last"), F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("hash"), listed.alias("value"))
    placed = rows.unionByName(last).repartition("file_no").sortWithinPartitions("file_no", "last", "page_id", "hash")
    placed.select("value", "file_no").write.partitionBy("file_no").options(**WRITING).text(path)


def cut_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, idx, begin, size, data): the records of the files under ``path``, cut out by the ranges that each file lists, in the task that reads it.  A file without a legible list has no records."""
    files = spark.read.schema("value string, file_no long").text(path, wholetext=True)
    lines = F.split(F.get(F.split(F.substring_index("value", INDEX_HEAD, -1), END), 1), "\n")
    ranges = F.transform(lines, lambda line: F.struct(*[F.get(F.split(line, " "), i).try_cast("long").alias(c) for i, c in enumerate(RANGE)]))

    def cut(file: Column) -> Column:
        part = lambda r: F.substring(file["bytes"], (r["begin"] + 1).cast("int"), r["size"].cast("int")).alias("data")
        return F.transform(file["ranges"], lambda r: F.struct(*[r[c].alias(c) for c in RANGE], part(r)))

    # an array of one element binds the file's bytes, so that they are not copied for every record
    file = F.array(F.struct("bytes", "ranges"))
    cuts = files.select("file_no", F.col("value").cast("binary").alias("bytes"), ranges.alias("ranges"))
    return cuts.select("file_no", F.explode(F.flatten(F.transform(file, cut))).alias("r")).select("file_no", "r.*")


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """``index`` (file_no, idx, page_id, begin, size) with each record's bytes, cut out of its file by its range."""
    return index.select("file_no", "idx", "page_id", "begin", "size").join(cut_records(spark, path).select("file_no", "idx", "data"), ["file_no", "idx"])


def archived(pages: DataFrame, null_files: int = 1, columns: tuple[str, str, str] = ("page_id", "url", "html")) -> DataFrame:
    """The leaves of a replica: its pages are written to files, cut out of them again and hashed; only the hashes meet the index.  A record that can't be read has no hash."""
    spark = pages.sparkSession
    path = common.fresh_path(spark, "warc-files")
    index = common.written(laid_out(pages, *columns, null_files).drop("hash"), "warc-index")
    if index.isEmpty():
        return common.written(laid_out(pages, *columns), "warc-leaves")
    write_files(pages, path, *columns, null_files, index)
    found = cut_records(spark, path).select("file_no", "idx", F.sha2("data", 256).alias("hash"))
    out = common.written(index.join(found, ["file_no", "idx"], "left").select("file_no", "idx", "page_id", "begin", "size", "hash"), "warc-leaves")
    common.delete(spark, path)
    common.dropped(index)
    return out


def _parents(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The level above: FANOUT neighbours in order, with the range they cover."""
    up = nodes.withColumn("up", F.floor(F.col("idx") / FANOUT)).groupBy(*keys, "up").agg(
        F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"), F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("size")).alias("end")
    )
    digest = F.sha2(F.concat_ws("|", F.array_join(F.transform("kids", lambda k: k["hash"]), ""), F.col("begin").cast("string"), F.col("end").cast("string")), 256)
    return up.select(*keys, F.col("up").cast("long").alias("idx"), "begin", (F.col("end") - F.col("begin")).alias("size"), digest.alias("hash"))


class MerkleTree:
    """``levels``: tables from the records up to one node a file, then from the files up to one root."""

    def __init__(self, records: DataFrame, beside: DataFrame | None = None):
        """Over written ``records``; with ``beside`` as high as a tree over these, so that the two can be compared level by level."""
        self.records, self.files = records, [records.select("file_no", "idx", "begin", "size", "hash")]
        both = [r for r in (records, beside) if r is not None]
        most, last, least = 0, 0, 0
        for r in both:
            n = r.groupBy("file_no").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max("file_no"), F.min("file_no")).first()
            most, last, least = max(most, n[0] or 0), max(last, (n[1] or 0) + 1), min(least, (n[2] or 0) + 1)
        while most > 1:
            self.files.append(common.written(_parents(self.files[-1], ["file_no"]), "warc-nodes"))
            most = -(-most // FANOUT)
        # file numbers, from 0 on, are the order of the roots; the file without identifiers has -1
        top = self.files[-1].select((F.col("file_no") + 1).alias("idx"), "begin", "size", "hash")
        self.tops = [common.written(top, "warc-roots")]
        while last > 0 or least < -1:  # nodes from 0 on end in node 0, negative ones in node -1
            self.tops.append(common.written(_parents(self.tops[-1], []), "warc-roots"))
            last, least = last // FANOUT, least // FANOUT

    def root(self) -> str | None:
        """The hash of the top node; with negative file numbers there may be two, joined."""
        return "|".join(r["hash"] for r in self.tops[-1].orderBy("idx").collect()) or None


def audit(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """Records in which the replicas differ: file_no, idx, page_id, begin and size in a, hash_a, hash_b, finding."""
    suspects = a.tops[-1].select("idx").unionByName(b.tops[-1].select("idx")).distinct()
    for x, y in zip(reversed(a.tops), reversed(b.tops), strict=True):
        suspects = _differing(x, y, suspects, ["idx"])
        if x is not a.tops[0]:
            suspects = suspects.select(F.explode(F.sequence(F.col("idx") * FANOUT, F.col("idx") * FANOUT + FANOUT - 1)).alias("idx"))
    suspects = common.written(suspects.select((F.col("idx") - 1).alias("file_no"), F.lit(0).cast("long").alias("idx")), "warc-suspects")
    for x, y in zip(reversed(a.files[1:]), reversed(b.files[1:]), strict=True):
        found = _differing(x, y, suspects, ["file_no", "idx"])
        suspects = common.written(found.select("file_no", F.explode(F.sequence(F.col("idx") * FANOUT, F.col("idx") * FANOUT + FANOUT - 1)).alias("idx")), "warc-suspects")
    columns = a.records.columns
    left, right = (x.join(suspects, ["file_no", "idx"], "left_semi") for x in (a.records, b.records))
    # equal records meet wherever they are in the file, so a record that one replica lacks does not shift the others
    left, right = (t.withColumn("_k", F.row_number().over(Window.partitionBy("file_no", "page_id", "hash").orderBy("idx"))) for t in (left, right))
    only_a, only_b = _without(left, right, ["file_no", "page_id", "hash", "_k"]), _without(right, left, ["file_no", "page_id", "hash", "_k"])
    turn = F.row_number().over(Window.partitionBy("file_no", "page_id").orderBy("idx"))
    x, y = only_a.withColumn("_k", turn), only_b.withColumn("_k", turn).select([F.col(c).alias(f"{c}_b") for c in [*columns, "_k"]])
    same = (F.col("file_no") == F.col("file_no_b")) & F.col("page_id").eqNullSafe(F.col("page_id_b")) & (F.col("_k") == F.col("_k_b"))
    finding = F.when(F.col("hash").isNull(), "missing in a").when(F.col("hash_b").isNull(), "missing in b").otherwise("differs")
    return x.join(y, same, "full").select(
        F.coalesce("file_no", "file_no_b").alias("file_no"), F.coalesce("idx", "idx_b").alias("idx"), F.coalesce("page_id", "page_id_b").alias("page_id"),
        "begin", "size", F.col("hash").alias("hash_a"), "hash_b", finding.alias("finding"),
    )


def _without(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``x`` whose keys, null equal to null, are not in ``y``."""
    other = y.select([F.col(k).alias(f"{k}_y") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_y"))
    return x.join(other, same, "left_anti")


def _differing(x: DataFrame, y: DataFrame, suspects: DataFrame, keys: list[str]) -> DataFrame:
    """Of the suspected nodes, those whose hashes differ or that one tree lacks."""
    x, y = (t.join(suspects, keys, "left_semi").select(*keys, F.col("hash").alias(h)) for t, h in ((x, "ha"), (y, "hb")))
    return x.join(y, keys, "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select(*keys)


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Write both replicas' files and audit them: every record of ``pages`` with its place, its hash and what the audit against ``replica`` found: ok, differs, missing in b; and the records that only the replica has."""
    nulls = common.total_rows(pages.where(F.col("page_id").isNull()))
    left, right = (archived(x, 1 + nulls // FILE_RECORDS) for x in (pages, replica))
    a, b = MerkleTree(left, right), MerkleTree(right, left)
    if a.root() == b.root():
        return a.records.select("file_no", "idx", "page_id", "begin", "size", F.col("hash").alias("record_sha256"), F.col("hash").alias("replica_sha256"), F.lit("ok").alias("finding"))
    found = common.written(audit(a, b), "warc-found")
    wrong = found.select("file_no", "idx", "page_id", "begin", "size", F.col("hash_a").alias("record_sha256"), F.col("hash_b").alias("replica_sha256"), "finding")
    right = a.records.join(found.where("hash_a IS NOT NULL").select("file_no", "idx"), ["file_no", "idx"], "left_anti")
    return right.select("file_no", "idx", "page_id", "begin", "size", F.col("hash").alias("record_sha256"), F.col("hash").alias("replica_sha256"), F.lit("ok").alias("finding")).unionByName(wrong)
