"""Operator 10 against plain fingerprints and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cathodyne.llm import buckets, simhash
from cathodyne.llm.simhash import allocate, drop_near_duplicates, fingerprint, hamming_links, partition_bits, probe, simhash_groups, unite_alike


def plain(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(values, bits):
    values, label = list(values), {}
    for v in values:
        if v not in label:
            todo, label[v] = [v], v
            while todo:
                x = todo.pop()
                for y in values:
                    if y not in label and (x ^ y).bit_count() <= bits:
                        label[y] = v
                        todo.append(y)
    return label


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_fingerprints(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    texts = [None, "", "  ", "One", "a B c", "É é Ä x", "x\x0by\x0cz\r\nq w"] + [" ".join(rng.choice(["a", "Bb", "ccc", "é"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        for width in (1, 4, 5):
            assert fingerprint(t, width) % (1 << 64) == plain(t, width)


def joined(pairs):
    """Smallest value reachable of each linked value."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("bits", [1, 4, 10])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, bits):
    rng = random.Random(bits)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64) & rng.getrandbits(64)
        values |= {base ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, 12))) for _ in range(6)}
    values = sorted(simhash._signed(v) for v in values)
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= bits
    want = joined((a, b) for i, a in enumerate(values) for b in values[i + 1 :] if near(a, b))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = lambda found: [tuple(r) for r in found.collect()]
    assert joined(links(hamming_links(df, bits))) == want
    groups = [list(range(k, 64, 3)) for k in range(3)]
    for thresholds in ([3, 3, 2], [2, 3, 3]) if bits == 10 else ([bits - 2, 0, 0],) if bits > 2 else ([-1, 0, 0],):
        assert sum(thresholds) >= bits - 2
        assert joined(links(probe(df, groups, thresholds, bits))) == want
    # Crowded buckets, in one block and in many.
    assert joined(links(probe(df, groups, [2, 3, 3], bits, crowd=3))) == want
    blocks = lambda members, link: buckets.bucket_links(members, link, most_rows=7)
    monkeypatch.setattr(simhash, "bucket_links", blocks)
    assert joined(links(probe(df, groups, [2, 3, 3], bits, crowd=3))) == want


def test_sets_are_united_as_all_pairs_are():
    rng = np.random.default_rng(3)
    sets = [np.zeros(0, np.int64), np.array([5])]
    for size in (1, 4, 9, 60, 300, 2500):
        base = rng.integers(-(2**63), 2**63 - 1, size)
        for _ in range(25):
            s = np.concatenate([base[rng.random(size) > rng.choice([0, 0.05, 0.12, 0.4])], rng.integers(-(2**63), 2**63 - 1, rng.integers(0, size // 8 + 1))])
            sets.append(np.unique(s))
    rng.shuffle(sets)
    root = np.arange(len(sets))
    unite_alike(sets, root, 0.8)
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    want = joined((i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i].tolist(), sets[j].tolist()))
    assert root.tolist() == [want.get(k, k) for k in range(len(sets))]


def test_bits_are_grouped_and_thresholds_add_up():
    rng = np.random.default_rng(0)
    bits = rng.random((2000, 64)) < 0.5
    bits[:, 40] = bits[:, 3]
    both = bits.T.astype(float) @ bits
    groups = partition_bits(2000, both, 4)
    assert sorted(j for g in groups for j in g) == list(range(64)) and any({3, 40} <= set(g) for g in groups)
    for n in (10, 10**5, 10**9):
        _, thresholds = allocate(n, both * n / 2000, groups, [1.0] * 4, 6)
        assert sum(thresholds) >= 6 - 4 + 1 and min(thresholds) >= -1


def test_groups_of_documents(spark):
    rng = random.Random(8)
    rows = []
    for k in range(25):
        words = [f"w{rng.randrange(300)}" for _ in range(200)]
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(200)] = "new"
    rows += [(900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (None, rows[5][1]), (None, "alone here"), (903, "word " * 50_000)]
    docs = spark.createDataFrame([(d, t, 5, b"") for d, t in rows], "doc_id long, text string, fp int, least binary").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint % (1 << 64), r.component_id) for r in simhash_groups(docs).collect())
    prints = [plain(t, 4) for _, t in rows]
    label = components(prints, 4)
    least = {}
    for (d, _), f in zip(rows, prints):
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    assert got == sorted((d is None, d or 0, f, least.get(label[f])) for (d, _), f in zip(rows, prints))
    assert simhash_groups(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("blocks", [8, 0])
def test_verified_groups_keep_one_document(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "MOST_BLOCKS", blocks)
    small = lambda members, link, payload=None: buckets.bucket_links(members, link, payload, most_rows=1000 if blocks else 5)
    monkeypatch.setattr(simhash, "bucket_links", small)
    rng = random.Random(9)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(150)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 3, 12):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(150)] = f"n{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    rows.append((0, rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = simhash_groups(docs, max_bits=4, width=5, similarity=0.8)
    by = {r.doc_id: r.component_id for r in groups.collect()}
    text = dict(rows)
    alike = lambda s, t: len(s & t) >= 0.8 * len(s | t)
    want = joined((a, b) for a in text for b in text if a < b and alike(shingles(text[a]), shingles(text[b])))
    assert by == {d: want.get(d, d) for d in text}
    kept = drop_near_duplicates(docs, groups)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({want.get(d, d) for d in text})


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f", "x", "y", 1), (2, "a b c d e f", "x", "y", 2), (None, "g", "x", "y", 3), (None, "g h", None, "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other_id string, text_key string, other_key int")
    kept = drop_near_duplicates(docs, simhash_groups(docs, max_bits=4, width=5, similarity=0.8))
    assert kept.columns == docs.columns and sorted(r.other_key for r in kept.collect()) == [1, 3, 4]


def test_a_copy_with_a_repeated_passage_is_a_copy(spark):
    rng = random.Random(10)
    words = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:70]))]
    groups = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=4, width=5, similarity=0.8)
    assert {r.component_id for r in groups.collect()} == {1}


def test_one_fingerprint_is_not_one_text(spark):
    rng = random.Random(11)
    other = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(190))
    a, b, c, d = ("pad " * 260 + other() for _ in range(4))
    assert len({plain(t, 5) for t in (a, b, c, d)}) == 1
    near = b + " more"
    rows = [(1, a), (2, b), (3, c), (4, near), (None, d), (None, c), (5, a), (6, "p q r s t u"), (6, "v w x y z o"), (6, "v w x y z o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = simhash_groups(docs, max_bits=4, width=5, similarity=0.8)
    by = {(r.doc_id, r.text_key): r.component_id for r in groups.collect()}
    assert sorted((d or 0, c or 0) for (d, _), c in by.items()) == [(0, 0), (0, 3), (1, 1), (2, 2), (3, 3), (4, 2), (5, 1), (6, 6), (6, 6)]
    kept = sorted((r.doc_id or 0, r.text) for r in drop_near_duplicates(docs, groups).collect())
    assert kept == sorted([(1, a), (2, b), (3, c), (0, d), (6, "p q r s t u"), (6, "v w x y z o")])


def test_the_same_pairs_count_in_small_and_large_sets(spark, monkeypatch):
    rng = random.Random(13)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(80)] = f"n{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    # With two bands only many alike pairs share no bucket.
    nodes = docs.withColumn("p", simhash.shingle_profile(F.col("text"), 5)).select("doc_id", "text_key", "p.fp", "p.size", F.slice("p.bands", 1, 2).alias("bands"), "p.node").dropDuplicates(["node"])
    nodes = simhash.keep(nodes, "nodes")
    known = nodes.collect()
    by_print = components([r.fp % (1 << 64) for r in known], 4)
    text = dict(rows)
    shingles = {r.node: {tuple(w[i : i + 5]) for w in [text[r.doc_id].split()] for i in range(len(w) - 4)} for r in known}
    alike = lambda s, t: len(s & t) >= 0.8 * len(s | t)
    meet = lambda a, b: by_print[a.fp % (1 << 64)] == by_print[b.fp % (1 << 64)] or any(x == y for x, y in zip(a.bands, b.bands))
    similar = [(a, b) for a in known for b in known if a.node < b.node and alike(shingles[a.node], shingles[b.node])]
    want = joined((a.node, b.node) for a, b in similar if meet(a, b))
    assert want != joined((a.node, b.node) for a, b in similar)
    for blocks in (8, 0):
        monkeypatch.setattr(simhash, "MOST_BLOCKS", blocks)
        links = simhash.verified_links(docs, nodes, 4, 5, 0.8).collect()
        got = joined((r.a, r.b) for r in links)
        assert {r.node: got.get(r.node, r.node) for r in known} == {r.node: want.get(r.node, r.node) for r in known}
