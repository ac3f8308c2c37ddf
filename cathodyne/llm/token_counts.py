"""Token counts with a digest cache (operator 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cathodyne.llm.common import keep
from cathodyne.llm.tokenizers import Encoder, file_bytes, version_digest

#: Texts encoded in one call.
ENCODE_ROWS = 64
#: A text that more than one row in so many has is counted by broadcast: there are fewer than this of them.
OFTEN = 1000
#: Missing digests that are sent to the texts; more of them meet the texts in a shuffle.
FEW = 20_000

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer version, a row per digest. A cache that isn't there is empty; one that cannot be read is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one per row of ``docs``.

    Texts are known by their SHA-256 together with the digest of model and library version. Digests
    that the cache at ``cache_path`` lacks are encoded once each and appended to it. The only
    normalisation under which counts stay true for any tokenizer is null to empty. A cache that has every
    digest is not written to, and no text is read twice, sent or encoded.
    Null and empty texts have no tokens. Repeated rows and null ids keep their rows; other columns
    are not read. Two runs that append the same digests do no harm, as reading takes one row of each.
    """
    spark = docs.sparkSession
    model = file_bytes(model_path)
    tokenizer = version_digest(model_path, model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marked = keep(base.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    # One row stands for each missing digest.
    missing = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(read_cache(spark, cache_path, tokenizer), "digest", "left_anti")
    missing = keep(missing, "missing")
    if n := missing.count():
        # Where few are missing no text travels but theirs; else all texts meet them in a shuffle.
        m, b = (F.broadcast(missing) if n <= FEW else missing.hint("shuffle_hash")).alias("m"), base.alias("b")
        texts = b.join(m, F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.digest") == F.col("m.digest"))).select("b.digest", "b.text")
        counted = texts.mapInArrow(_encoder(model_path, model), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counted.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    out = _with_counts(marked, read_cache(spark, cache_path, tokenizer))
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _encoder(model_path: str, model: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(model_path, model), set()
        for batch in batches:
            for start in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(start, ENCODE_ROWS)
                new = {d: i for i, d in enumerate(part.column(0).to_pylist()) if d not in seen}
                seen.update(new)
                counts = [len(ids) for ids in encoder.encode(part.column(1).take(pa.array(new.values(), pa.int64())).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return encode


def _with_counts(marked: DataFrame, known: DataFrame) -> DataFrame:
    """``marked`` with the counts of its digests. Rows of the digests that many rows share do not meet in one task."""
    often = marked.groupBy("digest").count().where(F.col("count") > marked.count() / OFTEN).select("digest")
    often = F.broadcast(keep(often.join(known, "digest"), "often"))  # fewer than OFTEN rows
    return marked.join(often, "digest").unionByName(marked.join(often, "digest", "left_anti").join(known, "digest"))
