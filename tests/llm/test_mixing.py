"""Operator 2: mixing, against the SQL form and its own rules."""

import collections
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cathodyne.llm.mixing import MIX_SQL, apply_mix, mix_sources, prefix_sums


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def sample():
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(1))), rng.choice(["a", "a", "a", "b", "c", "é", "Z", None])) for k in range(300)]
    return rows + [(300, None, "a"), (301, "", "b"), (302, " \t\x0b ", None), (303, "x y z", "tiny"), (304, None, "empty"), (None, "n u l l", "a"), (7, rows[7][1], rows[7][2])]


def test_matches_sql(spark):
    rows = sample()
    got = mix_sources(documents(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(MIX_SQL).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_budgets_are_exact_and_capped(spark):
    rows = sample()
    got = mix_sources(documents(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for part in by.values():
        assert sum(r.size for r in part) == part[0].source_size
        assert abs(sum(r.taken for r in part) - part[0].target) <= 0.5
        assert part[0].target <= 3 * part[0].source_size + 1e-9
    total = sum(r.size for r in got)
    assert sum(p[0].target for p in by.values()) == pytest.approx(total)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one two", "only"), (2, "x", "only")]])
def test_small_tables(spark, rows):
    got = mix_sources(documents(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(r.size for r in got)


def test_mixed_documents(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 7 + 1)), "ab"[k % 2]) for k in range(60)]
    docs = documents(spark, rows).withColumn("size", F.lit("clash")).withColumn("n_chars", F.length("text"))
    mix = mix_sources(docs)
    got = apply_mix(docs, mix, chars_col="n_chars")
    assert got.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mix.collect()}
    words = collections.Counter()
    for r in got.collect():
        assert r.n_chars == len(r.text) and rows[r.doc_id][1].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == collections.Counter({k: v for k, v in taken.items() if v})


def test_prefix_sums_carry_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v")).repartition(5)
    got = {r.k: r.before for r in prefix_sums(df, [F.col("k")], {"v": "before"}).collect()}
    values = sorted((k * 7919 % 1000, k % 13) for k in range(1000))
    total = 0
    for k, v in values:
        assert got[k] == total
        total += v
