"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.exact_dedup import exact_dedup
from plumbline.llm.language_id import identify
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.packing import pack
from plumbline.llm.segment_bpe import encode_documents
from plumbline.llm.simhash import simhash_components
from plumbline.llm.sketch import fingerprints
from plumbline.llm.suffix_dedup import suffix_dedup
from plumbline.llm.token_rollup import TokenRollup, counted, deletes, inserts, revisions
from plumbline.llm.warc import fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op5_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents by source, language and tokenizer version, reached by signed batches.

    All documents are inserted with a provisional count (their words), twice, which counts once; all counts are revised to
    the tokenizer's; labelled documents are deleted; the ledger is compacted; they are inserted again; it is compacted again.
    """
    import public_tokenizers

    rows = counted(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k-1", carried=["doc_id"])
    rows = common.written(rows, "token-counts")
    provisional = rows.withColumns({"n_tokens": F.col("n_words"), "tokenizer_version": F.lit("words")})
    labelled = rows.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    rollup = TokenRollup(spark, common.fresh_path(spark, "token-rollup"))
    for _ in range(2):
        rollup.commit("load-1", inserts(provisional))
    rollup.commit("revise-1", revisions(provisional, rows))
    rollup.commit("withdraw-1", deletes(labelled))
    rollup.compact()
    rollup.commit("restore-1", inserts(labelled))
    rollup.compact()
    common.dropped(rows)
    return rollup.totals()


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay."""
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity of all pages' records against a replica in which the first character of every 97th page, from 13 on, is overwritten."""
    pages = _table(spark, sf_dir, "pages")
    flipped = F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 1))
    replica = pages.withColumn("html", F.when(F.col("page_id") % 97 == 13, flipped).otherwise(F.col("html")))
    return fixity(pages, replica)


_ALL = (op1_exact_dedup, op2_suffix_dedup, op3_packing, op4_language_id, op5_segment_bpe, op6_token_rollup, op7_simhash, op8_line_dedup, op9_scaled_sketch, op10_warc_fixity)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op10_warc_fixity": r"""
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a,
                   CASE WHEN page_id % 97 = 13 THEN '#' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS b
            FROM pages),
        r AS (
            SELECT page_id, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: response', 'WARC-Target-URI: ' || url, 'WARC-Date: 2024-01-01T00:00:00Z',
                       'WARC-Payload-Digest: sha256:' || sha256(a), 'Content-Type: text/html', 'Content-Length: ' || strlen(a), '', a, '', '') AS a,
                   concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: response', 'WARC-Target-URI: ' || url, 'WARC-Date: 2024-01-01T00:00:00Z',
                       'WARC-Payload-Digest: sha256:' || sha256(b), 'Content-Type: text/html', 'Content-Length: ' || strlen(b), '', b, '', '') AS b
            FROM p),
        h AS (SELECT page_id, page_id // 1024 AS file_no, strlen(a) AS size, sha256(a) AS ha, sha256(b) AS hb FROM r)
        SELECT file_no, row_number() OVER w - 1 AS idx, page_id,
               CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS begin, size,
               ha AS record_sha256, hb AS replica_sha256, CASE WHEN ha = hb THEN 'ok' ELSE 'differs' END AS finding
        FROM h WINDOW w AS (PARTITION BY file_no ORDER BY page_id)""",
}
