"""The pipeline's stages on planted cases, each on what the one before kept."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cathodyne.llm import simhash
from cathodyne.llm.tokenizers import Encoder, file_bytes


def say(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(40)
    make = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = {"en": make("etaoinshr"), "ru": make("оеаинтсрв")}
    items = [(k, say(rng, words["en"], 40)) for k in range(6)]
    rows = []
    for k in range(120):
        lang = "ru" if k % 4 == 0 else "en"
        rows.append((k, say(rng, words[lang], rng.randint(150, 300)), lang if k % 10 else None, f"s{k % 3}"))
    copies = [(200 + k, rows[k][1] if k % 2 else rows[k][1].replace(rows[k][1].split()[30], "edited", 1), rows[k][2], "s0") for k in range(10)]
    leaked = [(300 + k, f"{say(rng, words['en'], 50)} {items[k][1]} {say(rng, words['en'], 30)}", "en", "s1") for k in range(6)]
    odd = [(400, None, "en", "s1"), (401, "", None, None), (402, "12 34 !!", "en", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + copies + leaked + odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, tables), name)
        assert docs.columns == columns
        ids[name] = sorted(r.doc_id for r in docs.collect())
    clean = list(range(120))
    assert ids["language"] == clean + list(range(200, 210)) + list(range(300, 306))
    assert ids["near_dedup"] == clean + list(range(300, 306))
    assert ids["decontaminate"] == clean
    assert docs.where("lang is null").isEmpty() and set(ids["mix"]) <= set(clean)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    before = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 120").collect()
    assert abs(words(docs.collect()) - words(before)) <= 3
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = Encoder(path, file_bytes(path))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sum(p.n_tokens for p in packed) == sum(len(e.encode([r.text])[0]) + 1 for r in docs.collect())
    run = corpus_pipeline.run(spark, tables)
    assert sum(r.n_tokens for r in run.collect()) == sum(p.n_tokens for p in packed)
    assert all(len(np.frombuffer(r.input_ids, e.dtype)) == 2048 for r in run.collect())


def test_empty_corpus(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_pairs_of_copies_at_the_promised_similarity_are_found(spark):
    rng = random.Random(41)
    words = [str(k) for k in range(10_000)]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    rows, shares = [], []
    for k in range(300):
        text = [rng.choice(words) for _ in range(200)]
        edited = list(text)
        for at in rng.sample(range(5, 195, 10), k % 4 + 1):
            edited[at] = "edited"
        a, b = shingles(" ".join(text)), shingles(" ".join(edited))
        shares.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited))]
    assert min(shares) < 0.83 and all(s >= 0.8 for s in shares)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 600, 2))


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    def few(texts):
        assert len(texts) <= 2000
        return texts

    profile = simhash.shingle_profile
    monkeypatch.setattr(simhash, "shingle_profile", lambda text, width: profile(F.pandas_udf(few, "string")(text), width))
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 5000
