"""Operator 6 against planted passages."""

import random
from collections import Counter
from functools import cache

import numpy as np
import pytest

from cathodyne.llm import decontaminate
from cathodyne.llm.decontaminate import find_leaks, item_blocks, lcs_length, randomised_svd


def test_longest_common_subsequence():
    rng = random.Random(14)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 12))] for _ in range(2))

        @cache
        def lcs(i, j, a=a, b=b):
            return 0 if i == len(a) or j == len(b) else 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

        assert lcs_length(a, b) == lcs(0, 0)


def test_svd_spans_the_leading_directions(spark):
    rng = np.random.default_rng(2)
    topics = [rng.choice(60, 12, replace=False) for _ in range(4)]
    rows = [rng.choice(topics[k % 4], 8).tolist() for k in range(400)]
    a = np.zeros((400, 60))
    for k, r in enumerate(rows):
        np.add.at(a[k], r, 1.0)
    v = randomised_svd(spark.createDataFrame([(r,) for r in rows], "ids array<int>").repartition(3), 60, np.ones(60), 4)
    best = np.linalg.svd(a)[1]
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    assert np.linalg.norm(a @ v) ** 2 >= 0.995 * (best[:4] ** 2).sum()


def corpus():
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    vocabulary = [word() for _ in range(3000)]
    say = lambda n: [rng.choice(vocabulary[: 50 if rng.random() < 0.5 else 3000]) for _ in range(n)]
    items = [say(rng.randint(15, 70)) for _ in range(40)]
    docs, want = [], set()
    for d in range(300):
        words = say(rng.randint(5, 300))
        if d % 3 == 0:
            k = rng.randrange(40)
            copy = list(items[k])
            if d % 2:  # a paraphrase: every eighth word is another
                copy[::8] = say(len(copy[::8]))
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
            want.add((d, k))
        docs.append((d, " ".join(words).capitalize() + "."))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)], want


@pytest.mark.parametrize("item_chars", [1_000_000, 3000])
def test_planted_items_are_found_and_nothing_else(spark, monkeypatch, item_chars):
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", item_chars)
    docs, items, want = corpus()
    odd = [(900, None), (901, ""), (902, "?!"), (903, "word " * 200_000), (None, items[0][1]), (904, items[1][1]), (904, items[1][1])]
    docs_df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs + odd], "doc_id long, text string, item_id string, lcs int").repartition(3)
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    out = find_leaks(docs_df, bench)
    assert out.columns == [*docs_df.columns, "leaks"]
    rows = out.collect()
    assert len(rows) == len(docs) + len(odd)
    got = {(r.doc_id, m.item_id) for r in rows for m in r.leaks}
    assert got == want | {(None, 0), (904, 1)}
    assert all(len(r.leaks) == 1 for r in rows if r.doc_id == 904)


def test_items_of_every_length_are_found_where_they_stand(spark):
    rng = random.Random(16)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(2000)]
    say = lambda n: [rng.choice(vocabulary[: 40 if rng.random() < 0.5 else 2000]) for _ in range(n)]
    items = [say(2 + k % 20) for k in range(100)]
    docs, want = [], {}
    for d in range(400):
        words = say(rng.randint(0, 120))
        at = rng.randrange(len(words) + 1)
        words[at:at] = items[d % 100]
        docs.append((d, " ".join(words)))
        want[d, d % 100] = at
    clean = [(1000 + d, " ".join(say(80))) for d in range(100)]
    out = find_leaks(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, m.item_id): m for r in out.collect() for m in r.leaks}
    assert set(want) <= set(got)
    texts = {d: t.split() for d, t in docs + clean}
    for (d, k), m in got.items():  # by brute force: the words at the place are the item's
        n = len(items[k])
        assert lcs_length(items[k], texts[d][m.start_word : m.start_word + 2 * n + 24]) >= 0.6 * n - 1e-9
    assert sum(got[key].start_word == at for key, at in want.items()) >= 0.9 * len(want)


def test_answers(spark):
    q = "Which river runs through the old town of the seven bridges and past the mill at the northern gate"
    bench = spark.createDataFrame([(1, q, "the silver brook")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, f"so {q} it is the silver brook"), (2, f"so {q[: len(q) * 3 // 4]} nobody knows")], "doc_id long, text string")
    got = {r.doc_id: [m.answer_found for m in r.leaks] for r in find_leaks(docs, bench, answer="answer").collect()}
    assert got[1] == [True] and got[2] == []
    (block,) = item_blocks(bench, "item_id", "text", None)
    assert block[0].answer == block[0].words


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in find_leaks(docs, none).collect()] == [[]]
    bench = spark.createDataFrame([(1, "some item of words")], "item_id long, text string")
    assert find_leaks(docs.limit(0), bench).isEmpty()
    with pytest.raises(ValueError, match="leaks"):
        find_leaks(docs.withColumnRenamed("doc_id", "leaks"), bench)


def test_every_passage_is_in_the_fit(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 5)
    rng = random.Random(17)
    known = {w.encode(): k for k, w in enumerate("abcdefgh")}
    docs = ["", None] + [" ".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(1, 130))) for _ in range(60)]
    want, df = np.zeros((8, 8), int), np.zeros(8, int)
    for words in ((t or "").split() for t in docs):
        df += [w in words for w in "abcdefgh"]
        for a in range(0, len(words), decontaminate.FIT_WORDS):
            n = np.array([words[a : a + decontaminate.FIT_WORDS].count(w) for w in "abcdefgh"])
            want += np.outer(n, n)
    rows = decontaminate._statistics(spark.createDataFrame([(t,) for t in docs], "text string").repartition(3), "text", known).collect()
    got = np.zeros((8, 8), int)
    for r in rows:
        if r.first >= 0:
            got[r.first, r.second] = got[r.second, r.first] = r.n
    assert (got == want).all()
    assert {r.second: r.n for r in rows if r.first < 0} == {**dict(enumerate(df.tolist())), -1: len(docs)}


def test_pairs_are_given_away_in_small_batches():
    rng = np.random.default_rng(8)
    blocks = [rng.integers(-1, 4000, (3000, 20)) for _ in range(2)]
    out = list(decontaminate._pairs_of(iter(blocks), 4000))
    assert max(b.num_rows for b in out) <= 1 << 15 < sum(b.num_rows for b in out)
    found = Counter()
    for b in out:
        for first, second, n in zip(*(c.to_pylist() for c in b.columns)):
            found[first, second] += n
    plain = Counter()
    for ids in np.concatenate(blocks).tolist():
        known = [x for x in ids if x >= 0]
        for k, a in enumerate(known):
            plain[a, a] += 1
            for b in known[:k]:
                plain[min(a, b), max(a, b)] += 1 + (a == b)
    assert found == plain
