"""The registered queries over a whole small scale of the given tables, against plain versions of what they return."""

import os
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import xxhash

from cathodyne.llm.queries import ORACLE_SQL, QUERIES
from cathodyne.llm.tokenizers import Encoder, file_bytes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_op1_packs_every_id(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = Encoder(path, file_bytes(path))
    got = QUERIES["op1_pack"](spark, DATA).collect()
    want = {d: len(e.encode([r.text or ""])[0]) + 1 for d, r in docs.items()}
    assert sum(r.n_tokens for r in got) == sum(want.values()) and all(r.n_tokens <= 2048 and r.cu_seqlens[-1] == r.n_tokens for r in got)


def test_op4_counts_as_the_library_does(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = Encoder(path, file_bytes(path))
    for r in QUERIES["op4_token_counts"](spark, DATA).collect():
        text = docs[r.doc_id].text or ""
        n = len(e.encode([text])[0])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)


def test_op5_tells_languages_of_held_out_texts(spark, docs):
    got = QUERIES["op5_language"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and docs[r.doc_id].text]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_op6_rows_name_items_that_are_there(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    squeeze = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, DATA).collect()}
    verbatim = {(d, k) for d, r in docs.items() for k, t in items.items() if t and squeeze(t) in squeeze(r.text)}
    assert verbatim <= got


def test_op10_by_all_pairs(spark, docs):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

    prints = {d: fingerprint(r.text) for d, r in docs.items()}
    label = {}
    for d in sorted(prints):
        todo = [] if d in label else [d]
        while todo:
            x = todo.pop()
            label.setdefault(x, d)
            todo += [y for y in prints if y not in label and (prints[x] ^ prints[y]).bit_count() <= 4]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, DATA).collect()}
    assert got == {d: (f"{prints[d]:016x}", label[d]) for d in prints}


def _within(a, b, tau):
    """Whether two strings are within ``tau`` edits, by the rows of a band."""
    row = {j: j for j in range(min(len(b), tau) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - tau), min(len(b), i + tau) + 1):
            new[j] = min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (a[i - 1] != b[j - 1]) if j else 99)
        row = new
    return row.get(len(b), 99) <= tau


def test_op9_by_all_pairs(spark):
    data = DATA.replace("0.001", "0.01")  # the smallest scale with lines that link
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    places = [(d, k, line.strip(" \t\r\x0b\x0c")) for d, text in docs if text is not None for k, line in enumerate(text.split("\n"))]
    lines = sorted({x for *_, x in places if x}, key=len)
    bags = [Counter(x) for x in lines]
    near = {x: [] for x in lines}
    for i, a in enumerate(lines):
        tau = 2 if len(a) >= 17 else 1 if len(a) >= 9 else 0
        for j in range(i + 1, len(lines)):
            b = lines[j]
            if len(b) - len(a) > tau:
                break
            if tau and ((bags[i] - bags[j]).total() <= tau and (bags[j] - bags[i]).total() <= tau) and _within(a, b, tau):
                near[a].append(b)
                near[b].append(a)
    label = {}
    for x in lines:
        todo = [] if x in label else [x]
        while todo:
            y = todo.pop()
            label.setdefault(y, x)
            todo += [z for z in near[y] if z not in label]
    first, want = {}, {}
    for d, k, x in places:
        kept = not x or first.setdefault(label[x], (d, k)) == (d, k)
        n, dropped, chars, links = want.get(d, (0, 0, 0, 0))
        want[d] = (n + 1, dropped + (not kept), chars + len(x) * (not kept), links + len(near.get(x, [])))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.chars_dropped, r.n_links) for r in QUERIES["op9_lines"](spark, data).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 0


@pytest.mark.parametrize("name, columns", [("op3_licenses", {"doc_id", "license", "line_no"}), ("op7_surrogates", {"doc_id", "text"}), ("op9_lines", {"doc_id", "n_lines", "n_dropped", "chars_dropped", "n_links"})])
def test_the_others_run(spark, docs, name, columns):
    rows = QUERIES[name](spark, DATA)
    assert columns <= set(rows.columns)
    got = rows.collect()
    if name == "op7_surrogates":
        assert len(got) == len(docs)
    if name == "op9_lines":
        assert {r.doc_id: r.n_lines for r in got} == {d: len(r.text.split("\n")) for d, r in docs.items() if r.text is not None}
