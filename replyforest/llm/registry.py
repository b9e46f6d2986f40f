"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from replyforest.llm import (
    byte_bpe,
    exact_dedup,
    line_dedup,
    near_dedup,
    neighbours,
    packing,
    private_data,
    quality,
    secret_scan,
    sharding,
    spelling,
    warc,
    whitening,
)
from replyforest.llm.common import table, vocabulary
from replyforest.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), as_loaded=True)


@query
def op4_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents and the one of each that stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op5_exact_dedup"] = r"""
WITH plain AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), grouped AS (
    SELECT *, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size FROM plain WINDOW g AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of at least 75 percent of shared shingles."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


# Every pair of documents that share a shingle, compared on whole sets; then the links walked to their ends.
ORACLES["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT c.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM components c LEFT JOIN sizes s ON s.doc_id = c.doc_id
"""


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every page that its site does not repeat."""
    return line_dedup.site_lines(table(spark, sf_dir, "pages"))


ORACLES["op6_line_dedup"] = r"""
WITH seen AS (
    SELECT row_number() OVER () AS r, page_id,
        lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
        list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
            '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'),
            '(?i)</?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|title|head|body|html|table|tr|td|th|h[1-6])(?:\s[^>]*)?/?>',
            chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
    FROM pages
), single AS (
    SELECT DISTINCT r, host, line FROM (SELECT r, host, unnest(lines) AS line FROM seen)
), totals AS (
    SELECT host, count(*) AS pages FROM seen GROUP BY host
), often AS (
    SELECT s.host, s.line FROM single s JOIN totals t ON t.host = s.host
    GROUP BY s.host, s.line, t.pages HAVING count(*) >= 2 AND count(*) > t.pages * 0.1
), known AS (
    SELECT host, list(line) AS drops FROM often GROUP BY host
), kept AS (
    SELECT page_id, s.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(drops, []), x)) AS stay
    FROM seen s LEFT JOIN known k ON k.host = s.host
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped,
    sha256(array_to_string(stay, chr(10))) AS kept_sha256
FROM kept
"""


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors["vec_id"] % 20 == 0)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by byte-level BPE and decoded again."""
    import public_tokenizers

    return byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return private_data.find_private_data(table(spark, sf_dir, "documents"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return warc.archive(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by rules and by a network that learned from what the rules find."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.find_secrets(docs, secret_scan.learn(secret_scan.labelled_findings(docs)))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its commoner spelling."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the four leading components of all distinct ones."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
