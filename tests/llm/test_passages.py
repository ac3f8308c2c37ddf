"""Operator 13 against a plain scan of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from cathodyne.llm import passages
from cathodyne.llm.passages import Hashes, Text, covered, least_phrases, remove_passages


def plain(rows, width):
    """Rows (id, words, removed, digest of what stays) by the definition."""
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    owner = {}
    for k, w in words:
        for i in range(len(w) - width + 1):
            if k is not None:
                s = tuple(w[i : i + width])
                owner[s] = min(k, owner.get(s, k))
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if k is not None and owner[tuple(w[i : i + width])] < k:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def table(spark, rows, parts=4):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, phrase string, block int").repartition(parts)


def corpus(rng, width, n=60):
    """Texts with shared passages of about ``width`` words, at the ends, overlapping and within one text."""
    word = lambda: rng.choice(["a", "b", "ab", "é", "日本", "x.y", "A"]) + str(rng.randrange(40))
    shared = [[word() for _ in range(rng.choice([width - 1, width, width + 1, 3 * width]))] for _ in range(8)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rng.randrange(5)):
            text += [word() for _ in range(rng.randrange(2 * width))]
            if rng.random() < 0.6:
                p = rng.choice(shared)
                a = rng.randrange(len(p))
                text += p if rng.random() < 0.5 else p[a : a + width + rng.randrange(4)]
        rows.append((k * 7 % n, "".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in text)))
    return rows


@pytest.mark.parametrize("width", [3, 12, 50])
def test_against_all_windows(spark, width, monkeypatch):
    rng = random.Random(width)
    monkeypatch.setattr(passages, "BLOCK_BYTES", 3000)
    rows = corpus(rng, width)
    want = plain(rows, width)
    assert sum(r[2] for r in want) > 0
    assert result(remove_passages(table(spark, rows), width)) == want


def test_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(9)}" for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n "), (None, long), (None, long), (4, long), (4, long), (4, f"{long} more"), (5, long), (5, f"  {long}"), (6, "a " * 5000), (7, "a " * 70), (8, "a"), (9, "one\x85two\xa0three " * 60), (10, "one\x85two\xa0three " * 60)]
    want = plain(rows, 50)
    assert result(remove_passages(table(spark, rows), 50)) == want
    by = {r[0]: r[2] for r in want}
    assert by[None] == 0 and by[4] == 0 and by[5] == 60 and by[6] == 0 and by[7] == 70 and by[10] == 60
    assert remove_passages(table(spark, rows).limit(0), 50).isEmpty()
    assert {r.kept_text for r in remove_passages(table(spark, rows), 50, texts=False).collect()} == {None}


def test_equal_windows_have_equal_phrases():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 1 << 62, n).astype(np.uint64), shared, rng.integers(0, 1 << 62, 30).astype(np.uint64)]) for n in (0, 7, 100)]
    picked = []
    for n, t in zip((0, 7, 100), texts):
        at = least_phrases(Hashes().grams(t, 10), 41)
        picked.append({int(a) - n for a in at if n <= a <= n + 40})
    assert set.intersection(*picked)


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    texts = ["aa b ccc aa b ccc a", "ccc aa b ccc x", "x" * 50 + " aa b ccc"]
    want = {}
    for stretch in (1 << 20, 4):
        monkeypatch.setattr(passages, "STRETCH", stretch)
        for text in texts:
            t, h = Text(text), Hashes()
            words = h.words(t.joined, t.starts, t.ends)
            for size in (1, 3):
                for at, value in enumerate(h.grams(words, size).tolist()):
                    assert want.setdefault(tuple(text.split()[at : at + size]), value) == value
    assert len(set(want.values())) == len(want)


def test_covered():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, width = int(rng.integers(1, 40)), int(rng.integers(1, 12))
        starts = np.flatnonzero(rng.random(max(0, n - width + 1)) < 0.1)
        want = np.zeros(n, bool)
        for s in starts:
            want[s : s + width] = True
        assert (covered(starts, n, width) == want).all()
