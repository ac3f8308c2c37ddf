"""Operator 11 against all pairs of words."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cathodyne.llm import spelling
from cathodyne.llm.queries import QUERIES
from cathodyne.llm.spelling import PositionIndex, _letters, spelling_variants

DATA = "/root/testdata/sf0.001"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def counted(rows, min_chars, min_count, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def plain(counts, ratio=10, near=None):
    near = near or {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


def by_pieces(counts):
    """Near words by what is left when one letter goes."""
    gone = {}
    for w in counts:
        for k in range(len(w)):
            gone.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    near = {w: set() for w in counts}
    for (_, piece), some in gone.items():
        for w in some:
            near[w].update(x for x in some if x != w)
            if piece in counts:
                near[w].add(piece)
                near[piece].add(w)
    return {w: sorted(x) for w, x in near.items()}


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(4)


def corpus(rng, n):
    stems = ["abcdefgh", "abcdefgi", "banananana", "aaaaaaaa", "Éléphantesque", "éléphantesque", "xyxyxyxyx", "ab×cd÷efÿ", "colourful", "colorful"]
    rows = []
    for k in range(n):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.5)), len(stems) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeéZ") + w[i:], w[:i] + rng.choice("aeéZ") + w[i + 1 :]])
            words.append(w)
        rows.append((k, "".join(w + rng.choice([" ", "-", "1", "日"]) for w in words)))
    return rows


@pytest.mark.parametrize("crowd", [20_000, 5])
def test_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rows = corpus(random.Random(11), 120)
    want = plain(counted(rows, 7, 2, 31))
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)
    assert sorted((tuple(r) for r in spelling_variants(table(spark, rows)).collect()), key=str) == want


def test_other_parameters_and_odd_rows(spark):
    rows = [(None, "Abc abc abcd"), (1, None), (2, ""), (3, "1 2 3"), (4, "abc abd " * 50), (4, "abc abd " * 50), (5, "abde"), (5, "abde"), (6, "x" * 3000), (6, "x" * 3001), (None, "Abc abc abcd")]
    want = plain(counted(rows, 3, 1, 3), ratio=2)
    assert sorted((tuple(r) for r in spelling_variants(table(spark, rows), 3, 1, 2, 3).collect()), key=str) == want
    assert spelling_variants(table(spark, rows).limit(0)).isEmpty()
    for bad in ({"ratio": 1}, {"min_chars": 1}):
        with pytest.raises(ValueError):
            spelling_variants(table(spark, rows), **bad)


def test_index_steps(monkeypatch):
    monkeypatch.setattr(spelling, "STEP", 8)
    rng = random.Random(12)
    words = np.array(sorted({"".join(rng.choice("abé") for _ in range(5)) for _ in range(400)}), object)
    longer = np.array(sorted({"".join(rng.choice("abéq") for _ in range(6)) for _ in range(200)}), object)
    index = PositionIndex(_letters(words, 5))
    for queries in (words, longer):
        q, w = index.near(_letters(queries, len(queries[0])))
        assert sorted((queries[a], words[b]) for a, b in zip(q, w)) == sorted((a, b) for a in queries for b in words if one_apart(a, b))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    counts = counted(rows, 7, 2, 31)
    near = by_pieces(counts)
    some = sorted(counts)[::97]
    assert all(near[w] == sorted(x for x in counts if one_apart(w, x)) for w in some)
    got = sorted((tuple(r) for r in QUERIES["op11_spelling"](spark, DATA).collect()), key=str)
    assert got == plain(counts, near=near)
