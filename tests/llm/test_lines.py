"""Operator 9 against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cathodyne.llm import line_dedup, queries
from cathodyne.llm.line_dedup import bag_distance, letter_bag, line_classes, line_links, positions, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits, letters="abé🙂"):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4 or not out:
            out.insert(at, rng.choice(letters))
        elif kind < 0.7:
            out.pop(min(at, len(out) - 1))
        else:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rng = random.Random(tau)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 25)))
        b = edited(rng, a, rng.randint(0, 5))
        rows.append((a, b, distance(a, b) <= tau))
    df = spark.createDataFrame(rows, "a string, b string, near boolean")
    assert df.where(within(F.col("a"), F.col("b"), tau) != F.col("near")).isEmpty()


def test_bags_bound_the_distance(spark):
    rng = random.Random(25)
    rows = [(a := "".join(rng.choice("etaoinshxyzé") for _ in range(rng.randint(0, 90))), edited(rng, a, rng.randint(0, 4), "etaoinshx")) for _ in range(300)]
    df = spark.createDataFrame([(a, b, distance(a, b)) for a, b in rows], "a string, b string, d int")
    assert df.where(bag_distance(letter_bag(F.col("a")), letter_bag(F.col("b"))) > 2 * F.col("d")).isEmpty()
    apart = df.limit(1).select(bag_distance(letter_bag(F.lit("e" * 5)), letter_bag(F.lit("r" * 3))).alias("x"))
    assert apart.first().x == 8


def test_few_substrings_are_looked_up():
    assert len(positions(2, own=False)) == 12 and len(positions(2, own=True)) == 3


@pytest.mark.parametrize("tau, crowd", [(1, 500), (2, 500), (1, 2), (2, 2), (((5, 0), (9, 1), (17, 2)), 500), (((5, 0), (9, 1), (17, 2)), 2)])
def test_links_are_all_pairs(spark, monkeypatch, tau, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    steps = [(1, tau)] if isinstance(tau, int) else tau
    most = steps[-1][1]
    rng = random.Random(20 + most)
    lines = set()
    for _ in range(40):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.randint(9, 30)))
        lines |= {edited(rng, base, rng.randint(0, 4), "abcdé ") for _ in range(8)}
    lines = sorted(x for x in lines if len(x) > max(4, 2 * most))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "h long, line string").withColumn("n", F.length("line")).withColumn("bag", letter_bag(F.col("line")))
    want = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and distance(a, b) <= max(t for least, t in steps if min(len(a), len(b)) >= least)}
    assert {tuple(r) for r in line_links(df, tau).collect()} == want and want


def test_classes_of_lines(spark):
    rng = random.Random(23)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(40)).strip() + "x" * 8 for _ in range(12)]
    rows = [(d, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 3]), "abc") if rng.random() < 0.7 else "short" for _ in range(rng.randint(1, 6)))) for d in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, base[0]), (103, base[0]), (None, f"  {base[1]} "), (104, "y" * 100_000), (105, "y" * 99_999)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, line string, h int").repartition(3)
    got = [(r.doc_id, r.line_no, r.n_chars, r.class_id, r.n_links, r.kept) for r in line_classes(docs).collect()]
    places = [(d, k, x.strip(" ")) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    assert sorted((d is None, d or 0, k, n) for d, k, n, *_ in got) == sorted((d is None, d or 0, k, len(x)) for d, k, x in places)
    texts = sorted({x for *_, x in places if len(x) >= 32})
    near = {x: [y for y in texts if x != y and abs(len(x) - len(y)) <= 2 and (x[:-1] == y or y[:-1] == x or (len(x) < 1000 and distance(x, y) <= 2))] for x in texts}
    label = {}
    for x in texts:
        todo = [x] if x not in label else []
        while todo:
            y = todo.pop()
            label[y] = x
            todo += [z for z in near[y] if z not in label]
    first = {}
    order = lambda d, k: (d is not None, d or 0, k)
    for d, k, x in places:
        if x in label:
            first[label[x]] = min(order(d, k), first.get(label[x], (9,)))
    want = sorted((order(d, k), len(near.get(x, [])), x not in label or first[label[x]] == order(d, k)) for d, k, x in places)
    assert sorted((order(d, k), n, kept) for d, k, _, _, n, kept in got) == want
    classes = {}
    text_at = {(d, k): x for d, k, x in places}
    for d, k, _, c, *_ in got:
        if (x := text_at[d, k]) in label:
            classes.setdefault(label[x], set()).add(c)
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)


def test_no_documents(spark):
    assert line_classes(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_the_query_classes_short_lines(spark, tmp_path):
    rows = [(1, "ab\nshort line\n\nab"), (2, "ab\nshort lime\n"), (3, "xy\nlonger than that"), (4, "az")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.chars_dropped, r.n_links) for r in queries.op9_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 1, 2, 1), 2: (3, 2, 12, 1), 3: (2, 0, 0, 0), 4: (1, 0, 0, 0)}


def test_rows_without_an_id_are_told_apart(spark):
    rows = [(None, "the same first line\none"), (None, "the same first line\ntwo"), (None, "the same first line\nthree"), (7, "again\nx"), (7, "again\ny"), (7, "again\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.line_no, r.kept) for r in line_classes(docs, min_chars=5, exact_chars=1).collect()]
    assert sorted(k for d, n, k in got if d is None and n == 0) == [False, False, True]
    kept = sum(k for d, n, k in got if d == 7 and n == 0)
    assert kept in (1, 2)  # two rows are one place


def test_many_variants_of_a_line_do_not_all_meet(spark, monkeypatch):
    """Lines that share a segment in great numbers give rows in proportion, not pairs."""
    rng = random.Random(29)
    made = {}
    real = line_dedup.keep

    def noted(df, name="step"):
        made.setdefault(name, []).append(kept := real(df, name))
        return kept

    monkeypatch.setattr(line_dedup, "keep", noted)
    monkeypatch.setattr(line_dedup, "CROWD", 50)
    lines = sorted({"the order has the number " + "".join(rng.choice("bcfjkqvwxz") for _ in range(20)) for _ in range(900)})
    df = spark.createDataFrame(list(enumerate(lines)), "h long, line string").withColumn("n", F.length("line")).withColumn("bag", letter_bag(F.col("line")))
    assert line_links(df, 2).isEmpty() and [c.isEmpty() for c in made["crowded"]] == [False, False, True] and made["pairs"][0].count() < len(lines)


def test_short_lines_need_more_in_common(spark, tmp_path):
    rows = [(1, "Rend.\nThing.\nTo to.\nBe to."), (2, "La, ra.\nLa, ja."), (3, "a line of mid\na line of mud\na lime of mad"), (4, "a line of some length\na lime of same length")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in queries.op9_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0), 2: (2, 0), 3: (3, 1), 4: (2, 1)}


def test_letters_are_counted_only_where_a_segment_is_shared(spark, monkeypatch):
    """Lines that share no segment with another are known by keys and hashes; they are read once for all steps."""
    rng = random.Random(31)
    made = {}
    real = line_dedup.keep

    def noted(df, name="step"):
        made[name] = kept = real(df, name)
        return kept

    monkeypatch.setattr(line_dedup, "keep", noted)
    lines = ["".join(rng.choice("bcfjkqvwxz") for _ in range(rng.randint(30, 60))) for _ in range(300)]
    lines += [lines[0][:9] + "e" + lines[0][10:], lines[1] + "eee"]
    df = spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(lines)], "h long, line string, n int")
    assert [tuple(r) for r in line_links(df, ((9, 1), (17, 2))).collect()] == [(0, 300)]
    assert 2 <= made["texts"].count() <= 4 and "bag" in made["texts"].columns
    keyed = line_dedup.segments(df.selectExpr("0L as key", "h", "line", "n", "n as whole"), line_dedup.by_length(((9, 1), (17, 2))), False)
    assert "Union" not in keyed._jdf.queryExecution().optimizedPlan().toString()


def test_ends_of_lines(spark):
    ends = ["", " ", "\t", "\r", "\x0b", "\x0c", " \r", "\t \x0c", " ", "x "]
    lines = [a + body + b for a in ends for b in ends for body in ("", "a", "one two")]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    got = [r.line for r in line_dedup.lines_of(docs, "doc_id", "text").orderBy("line_no").collect()]
    assert got == [x.strip(" \t\r\x0b\x0c") for x in lines]
