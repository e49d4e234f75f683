"""The corpus pipeline: documents in, packed token ids out.

Each stage works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontamination import contaminated
from tessella.llm.langid import predict_languages
from tessella.llm.mixing import sample_documents
from tessella.llm.near_dup import near_duplicates
from tessella.llm.packing import token_output
from tessella.llm.shared import BROADCAST_IDS, discard, folders, materialize, workdir
from tessella.session import spread

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A text is foreign if it needs more phrases a symbol in its best language than this, and one over the root
#: of its symbols more: the fewer the symbols, the less the rate says.
MOST_PHRASES, MARGIN = 0.5, 1.0
#: Rows without doc_id come after all others, by a hash of their text.
NO_ID = 1 << 62


def _without(docs: DataFrame, rejected: DataFrame, folder: str) -> DataFrame:
    """docs but for rows of a rejected(doc_id, mark), mark being the hash of their text.

    Texts are only shuffled if the rejected are too many to broadcast.
    """
    names = docs.columns
    rejected = materialize(rejected.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), folder)
    if rejected.count() <= BROADCAST_IDS:
        rejected = F.broadcast(rejected)
    same = F.col("doc_id").cast("long").eqNullSafe(rejected["_id"]) & (F.xxhash64(F.col("text").cast("string")) == rejected["_mark"])
    return docs.join(rejected, same, "left_anti").select(names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or a text, and those that no learnt language explains.

    All documents with a lang may be learnt from. If none has one, only the first rule applies. Rows are
    judged by their texts, with or without a doc_id, however short or long.
    """
    found = predict_languages(docs, F.col("lang").isNotNull(), mark=True)
    over = F.col("phrases_per_symbol") - MOST_PHRASES
    strange = (F.col("lang_pred") != "und") & (over * F.sqrt("n_symbols") > MARGIN)
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    return _without(lettered, found.filter(strange).select("doc_id", "mark"), workdir(spark, "language-rejects"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id, rows without one last.

    Rows of one doc_id with different texts are one document; of rows that repeat both, or that repeat a text
    without an id, one stays.
    """
    names, folder = docs.columns, workdir(spark, "near-dup-rejects")
    mark = F.xxhash64(F.col("text").cast("string"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(mark, 2))
    rows = docs.withColumns({"_number": number, "_mark": mark})
    found = near_duplicates(rows.select(F.col("_number").alias("doc_id"), "text"), mark=True)
    rejected = materialize(found.filter("not kept").select("doc_id", "mark").distinct(), f"{folder}/rejected")
    repeated = materialize(rows.groupBy("_number", "_mark").count().filter("count > 1").select("_number", "_mark"), f"{folder}/repeated")
    small = [F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in (rejected.toDF("_number", "_mark"), repeated)]
    kept = rows.join(small[0], ["_number", "_mark"], "left_anti")
    alone = kept.join(small[1], ["_number", "_mark"], "left_anti")
    once = kept.join(small[1], ["_number", "_mark"], "left_semi").dropDuplicates(["_number", "_mark"])
    return alone.select(names).union(once.select(names))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their doc_id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contaminated(docs, benchmark, mark=True), workdir(spark, "benchmark-rejects"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, calibrated to the raked shares of sources, languages and topics."""
    return sample_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of every document; (doc_id, start, n_tokens, ids_crc32) read back from the files."""
    return token_output(docs, TOKENIZER)


STAGES = [
    ("5 language ID", language_id),
    ("9 MinHash near-dedup", near_dedup),
    ("1 benchmark decontamination", decontaminate),
    ("2 mixing sources to target weights", mix_sources),
    ("10 token-ID output", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed once the next one's output is written."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = folders(spark)
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        if (name, stage) == STAGES[-1]:
            return found
        folder = workdir(spark, "pipeline")
        docs = materialize(found, folder)
        discard(spark, *(x for x in folders(spark) if x not in before and x != folder))
    return docs
