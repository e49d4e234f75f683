"""The operators' registered queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .decontamination import contaminated
from .langid import predict_languages
from .licenses import licenses
from .mixing import mix
from .mixing import oracle as mix_oracle
from .near_dup import near_duplicates
from .packing import token_output
from .pii import surrogate_texts
from .quality_classifier import classify_quality
from .quality_rules import quality_rules
from .warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer small files than there are cores is dealt over all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item of the benchmark that it holds a window of, at 0.8 or more."""
    return contaminated(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell, probability and draw of every document; half of the tokens are wanted."""
    return mix(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licenses of all documents, a row for each place, at a Dice coefficient of 0.8 or more."""
    return licenses(_table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text; the key is for tests, production keys are secrets."""
    return surrogate_texts(_table(spark, sf_dir, "documents"), key=b"example key")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from two thirds of the documents by crc32 of doc_id, predicts all."""
    docs = _table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    held_out = F.coalesce(third == 1, F.lit(False)).alias("held_out")
    found = predict_languages(docs, F.col("doc_id").isNotNull() & (third != 1))
    return found.select("doc_id", held_out, "lang_pred", "score", "phrases_per_symbol", "n_symbols")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior and score of every document; kept at a score of 0.5 or more."""
    return classify_quality(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log-likelihood ratio and verdict of every document."""
    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by the index; payloads of any size may be revisits."""
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity 0.85 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words_per_shingle=3, percent=85)


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into files, and start, number and crc32 of them read back."""
    return token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_source_mixing": op2_source_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc_index": op8_warc_index,
    "op10_token_packing": op10_token_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
}

#: Words of a text as DuckDB lists; chr() keeps the separators readable.
SQL_WORDS = (
    "list_filter(string_split(translate({text}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '')"
)

#: Base-32 digits of a SHA-1: of each five hexadecimal digits, four groups of five bits.
SQL_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')"

SQL = {
    "op8_warc_index": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS f FROM p)
SELECT page_id, payload_bytes, {SQL_BASE32} AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to FROM d
""",
    "op2_source_mixing": mix_oracle(),
    "op9_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {SQL_WORDS.format(text="coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')")} AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
  FROM w),
c AS (SELECT md5(array_to_string(list_sort(sh), '|')) AS cls, min(doc_id) AS node, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY 1),
u AS (SELECT node, len(sh) AS n, unnest(sh) AS g FROM c),
links AS (
  SELECT x.node AS a, y.node AS b FROM u x JOIN u y ON x.g = y.g AND x.node < y.node
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(comp.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.sh) > 0 AND md5(array_to_string(list_sort(s.sh), '|')) = c.cls LEFT JOIN comp ON comp.node = c.node
""",
}
