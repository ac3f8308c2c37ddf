"""Operators 1 and 4: packing and token counts."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest

from cathodyne.llm.packing import Capacities, best_fit_decreasing, pack_tokens
from cathodyne.llm import token_counts
from cathodyne.llm.token_counts import count_tokens, read_cache
from cathodyne.llm.tokenizers import Encoder, file_bytes, version_digest

PIECES, BYTES, JSON = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"))
TEXTS = [(1, "the quick brown fox"), (2, None), (3, ""), (4, "  two  spaces\n\nand <s> </s> <|endoftext|> é 日本 🙂\t"), (None, "no id"), (5, "the quick brown fox"), (1, "the quick brown fox"), (6, "long word " * 30_000)]


def test_best_fit_matches_a_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        width = rng.choice([7, 16, 100])
        sizes = [rng.randint(1, width) for _ in range(rng.randint(0, 80))]
        rooms, rows = [], []
        for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [r for r in range(len(rows)) if rooms[r] >= sizes[item]]
            if not fits:
                rows.append([])
                rooms.append(width)
                fits = [len(rows) - 1]
            tight = min(rooms[r] for r in fits)
            row = [r for r in fits if rooms[r] == tight][-1]
            rows[row].append(item)
            rooms[row] -= sizes[item]
        got = best_fit_decreasing(sizes, width)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert sorted(width - sum(sizes[i] for i in r) for r in got) == sorted(rooms)


def test_capacities_take_the_tightest():
    c = Capacities(10)
    for room, row in ((3, 0), (9, 1), (4, 2)):
        c.add(room, row)
    assert [c.take(4), c.take(4), c.take(4), c.take(1), c.take(1)] == [(4, 2), (9, 1), None, (3, 0), None]


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_packing_loses_nothing(spark, path):
    width, e = 64, Encoder(path, file_bytes(path))
    docs = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, pack_id int").repartition(2)
    found, packs = collections.defaultdict(list), pack_tokens(docs, path, width).collect()
    assert len({p.pack_id for p in packs}) == len(packs)
    for p in packs:
        ids, positions = np.frombuffer(p.input_ids, e.dtype), np.frombuffer(p.position_ids, "<u2")
        assert len(ids) == len(positions) == width and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens
        assert (ids[p.n_tokens :] == e.end).all() and len(p.cu_seqlens) == len(p.doc_ids) + 1
        for a, b, doc, start in zip(p.cu_seqlens, p.cu_seqlens[1:], p.doc_ids, p.doc_starts):
            assert positions[a:b].tolist() == list(range(b - a))
            found[doc].append((start, ids[a:b].tolist()))
    want = collections.defaultdict(list)
    for doc, text in TEXTS:
        ids = [*e.encode([text or ""])[0], e.end]
        want[doc] += [(s, ids[s : s + width]) for s in range(0, len(ids), width)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert e.decode([t for _, part in sorted(found[4]) for t in part][:-1]).strip() == TEXTS[3][1].strip()


def test_packing_of_nothing(spark):
    assert pack_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES).isEmpty()


@pytest.mark.parametrize("path", [PIECES, JSON])
def test_counts_and_cache(spark, tmp_path, path):
    docs = spark.createDataFrame([(*r, 7, b"x") for r in TEXTS], "doc_id long, text string, n_tokens int, digest binary").repartition(3)
    cache = str(tmp_path / "cache")
    e = Encoder(path, file_bytes(path))
    want = sorted((d or -1, len((t or "").encode()), len(e.encode([t or ""])[0]), len(e.encode([t or ""])[0]) > 8) for d, t in TEXTS)
    for _ in range(2):
        got = count_tokens(docs, path, cache, limit=8)
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
        assert spark.read.parquet(cache).count() == 5  # each different text once, and nothing on the second run


@pytest.mark.parametrize("few", [20_000, 0])
def test_cache_is_used_and_grows(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    cache = str(tmp_path / "cache")
    version = version_digest(PIECES, file_bytes(PIECES))
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    count_tokens(one, PIECES, cache)
    spark.read.parquet(cache).selectExpr("digest", "tokenizer", "n_tokens + 100 as n_tokens").write.parquet(f"{cache}-planted")
    two = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(two, PIECES, f"{cache}-planted").collect()}
    e = Encoder(PIECES, file_bytes(PIECES))
    assert got == {1: 100 + len(e.encode(["a b c"])[0]), 2: len(e.encode(["d"])[0])}
    assert read_cache(spark, f"{cache}-planted", version).count() == 2
    assert read_cache(spark, f"{cache}-planted", "another version").isEmpty()


def test_counts_of_nothing(spark, tmp_path):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PIECES, str(tmp_path / "c")).isEmpty()


def test_long_runs_of_blanks_have_the_librarys_ids():
    e, model = Encoder(BYTES, file_bytes(BYTES)), file_bytes(BYTES)
    import base64

    import tiktoken

    from cathodyne.llm.tokenizers import BYTE_PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model.splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(60):
        pieces = [rng.choice(["x", "ab 1", "!", " y", "\x1c"]) if rng.random() < 0.5 else "".join(rng.choice(" \n\t　") for _ in range(rng.choice([3, 999, 1000, 1001, 5000]))) for _ in range(6)]
        text = "".join(pieces)
        assert e.encode([text])[0] == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 10_000_000, "a\n" + "\n" * 10_000_000 + "b", "abc" * 3_000_000], ids=["spaces", "newlines", "letters"])
def test_huge_texts_pack_without_loss(spark, text):
    e = Encoder(BYTES, file_bytes(BYTES))
    rows = pack_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES, width=2048).collect()
    pieces = {start: np.frombuffer(r.input_ids, e.dtype)[a:b] for r in rows for start, a, b in zip(r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:])}
    ids = np.concatenate([pieces[k] for k in sorted(pieces)])
    assert e.decode(ids[:-1].tolist()) == text and ids[-1] == e.end


def test_copies_and_single_texts_are_all_counted(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(1200)] + [(k, "a copy") for k in range(1200, 1500)] + [(None, "a copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = count_tokens(docs, PIECES, str(tmp_path / "cache")).collect()
    e = Encoder(PIECES, file_bytes(PIECES))
    want = [(d is None, d or 0, len(t), len(e.encode([t])[0])) for d, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_a_broken_cache_is_an_error(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_cache(spark, str(tmp_path / "cache"), "any").collect()


def test_a_warm_cache_needs_no_texts(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "doc_id long, text string")
    want = sorted(tuple(r) for r in count_tokens(docs, PIECES, str(tmp_path / "cache")).collect())
    files = sorted(p.name for p in (tmp_path / "cache").iterdir())

    def refuse(*_):
        raise AssertionError("nothing is to be encoded")

    monkeypatch.setattr(token_counts, "_encoder", refuse)
    assert sorted(tuple(r) for r in count_tokens(docs, PIECES, str(tmp_path / "cache")).collect()) == want
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == files
