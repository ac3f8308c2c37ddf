"""The registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cathodyne.llm.common import new_path
from cathodyne.llm.decontaminate import find_leaks
from cathodyne.llm.language import identify, train
from cathodyne.llm.license_texts import TEMPLATES
from cathodyne.llm.licenses import scan_licenses
from cathodyne.llm.line_dedup import line_classes
from cathodyne.llm.mixing import MIX_SQL, mix_sources
from cathodyne.llm.packing import pack_tokens
from cathodyne.llm.passages import PASSAGES_SQL, remove_passages
from cathodyne.llm.simhash import simhash_groups
from cathodyne.llm.spelling import spelling_variants
from cathodyne.llm.surrogates import KINDS, replace_entities
from cathodyne.llm.token_counts import count_tokens
from cathodyne.llm.vector_dedup import audited_vectors
from cathodyne.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BYTES, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), width=2048)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATES)
    return found.select("doc_id", F.explode("licenses").alias("found")).select("doc_id", "found.*")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so every distinct text is encoded in this run."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), new_path(spark, "token-counts"), limit=4096)


def held_out() -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    out = docs.select("doc_id", held_out().alias("held_out"), identify(F.col("text"), model).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates-1")
    return out.select("doc_id", "text", *[F.coalesce(F.col("pii_counts")[k], F.lit(0)).alias(f"n_{k}") for k in KINDS])


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``recall``, which the audit measures on the rows whose id is divisible by 20."""
    return audited_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Fewer edits in shorter lines, as two of them make another word; below 9 characters exact repeats only.
    lines = line_classes(_table(spark, sf_dir, "documents"), tau=((9, 1), (17, 2)), min_chars=9, exact_chars=1)
    dropped = F.when(F.col("kept"), 0).otherwise(1)
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(dropped).alias("n_dropped"), F.sum(dropped * F.col("n_chars")).alias("chars_dropped"), F.sum("n_links").alias("n_links")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(_table(spark, sf_dir, "documents"), max_bits=4, width=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), min_chars=7, min_count=2, ratio=10, every=31)


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=16)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(_table(spark, sf_dir, "documents"), width=50, texts=False).drop("kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_mix": op2_mix,
    "op3_licenses": op3_licenses,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_decontaminate": op6_decontaminate,
    "op7_surrogates": op7_surrogates,
    "op8_vectors": op8_vectors,
    "op9_lines": op9_lines,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_whiten": op12_whiten,
    "op13_passages": op13_passages,
}

VECTORS_SQL = """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (
  select vec_id, vec_id as other from embeddings
  union
  select r.vec_id, l.b from reach r join links l on l.a = r.other),
components as (select vec_id, min(other) as component_id from reach group by vec_id),
degrees as (select a as vec_id, count(*) as n_links from links group by a)
select c.vec_id, coalesce(d.n_links, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept, 1.0::double as recall
from components c left join degrees d using (vec_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_mix": MIX_SQL,
    "op8_vectors": VECTORS_SQL,
    "op13_passages": PASSAGES_SQL,
}
