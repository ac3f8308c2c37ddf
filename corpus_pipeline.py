"""A training corpus from ``documents``: stages that each work on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cathodyne.llm.common import column_free_of, keep
from cathodyne.llm.decontaminate import find_leaks
from cathodyne.llm.language import identify, train
from cathodyne.llm.mixing import apply_mix, mix_sources
from cathodyne.llm.packing import pack_tokens
from cathodyne.llm.simhash import drop_near_duplicates, simhash_groups

#: Least share of a document's letters in its language.
LEAST_SCORE = 0.5
#: Bits within which fingerprints of shingles are candidates, words of a shingle, and the similarity that confirms a pair.
BITS, SHINGLE, SIMILARITY = 4, 5, 0.8
#: Rows and bytes that a task hands to Python at once, and rows that it reads from a file at once.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "1m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def small_batches(spark: SparkSession) -> None:
    """Sets ``BATCH`` for the session, and leaves it set, as what a stage returns runs later.

    By default a batch has 10,000 rows, which are copied in the executor's direct memory and in each of its
    Python workers, beside the heap, and 4,096 rows are read at once, whose texts lie in the heap as one array that
    doubles as it grows. No result depends on the size of a batch.
    """
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language of their own; fills in missing labels.

    Null, empty and letterless texts have none and go. Repeated rows have equal languages and stay; null
    ids are no matter. Texts are scored whole, ties go to the language that sorts first. An empty
    table, or one without labels, gives an empty one. Other columns stay, whatever their names.
    """
    small_batches(spark)
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    name = column_free_of(docs, "found_language")
    found = docs.withColumn(name, identify(F.col("text"), model))
    kept = found.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", F.col(name)["lang"])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of least id, nulls last, then of least text key.

    Null and empty texts are one group. Rows that repeat an id and its text are one document; rows that
    share an id, or have none, are told apart by their texts. Texts are compared whole. An empty table
    gives an empty one. Other columns stay, whatever their names.
    """
    small_batches(spark)
    return drop_near_duplicates(docs, keep(simhash_groups(docs, max_bits=BITS, width=SHINGLE, similarity=SIMILARITY), "groups"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, wherever in their texts.

    Null and empty texts hold none. Repeated rows fare alike, null ids are no matter, and an item's ties
    within a text change nothing. An empty table gives an empty one, an empty benchmark drops nothing.
    Other columns stay, whatever their names.
    """
    small_batches(spark)
    name = column_free_of(docs, "found_leaks")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=name)
    return found.where(F.size(name) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, cuts and drops documents so that sources meet their targets.

    A null source is a source of its own. Texts without words, null ones too, are taken once. Rows that
    share an id are decided each by itself; rows that repeat an id and its text are decided alike, and
    share the words where a budget ends among them. Long texts may be cut where a budget ends. An empty
    table gives an empty one. Other columns stay, whatever their names.
    """
    small_batches(spark)
    return apply_mix(docs, keep(mix_sources(docs), "mix"), chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids, with nothing lost; see ``pack_tokens``.

    Null and empty texts are one end token, null ids stay null, repeated rows are packed each, long
    texts are split over rows, ties of length go by order. An empty table gives no rows. Other columns are not read.
    """
    small_batches(spark)
    return pack_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), width=2048)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("pack", pack)]

#: Language, near copies and packing have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
