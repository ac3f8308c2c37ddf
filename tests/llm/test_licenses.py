"""Operator 3 against known notices."""

import os
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from cathodyne.llm.license_texts import TEMPLATES
from cathodyne.llm.licenses import Templates, blocks_of, scan, scan_licenses, wording, words_of
from cathodyne.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def templates():
    return Templates(TEMPLATES)


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_every_template_is_found_in_other_text(templates):
    rng = random.Random(30)
    for name, text in TEMPLATES:
        half = len(text) // 2
        cut = text.index(" ", half)
        for notice in (text, text[:cut] + "\n" + text[cut + 1 :], text.upper()):
            found = scan(f"{filler(rng, 30)}\n{filler(rng, 9)}\n\n\n\n{notice}\n\n\n\n{filler(rng, 30)}", templates)
            assert [f["license"] for f in found][:1] == [name], (name, found)
            assert found[0]["line_no"] == 5 and found[0]["coverage"] == 1.0 and found[0]["differences"] == []


def test_wordings_tell_versions_apart(templates):
    found = scan("This work is licensed under the GNU General Public License, version 2.", templates)
    assert [(f["license"], f["differences"]) for f in found] == [("GPL-2.0", [])]
    found = scan("This work is licensed under the GNU General Public License, version 9.", templates)
    assert len(found) == 1 and found[0]["license"].startswith("GPL") and found[0]["differences"] == [f"replace {found[0]['license'][4]} -> 9"]


def test_wording_counts_words_in_order():
    t = words_of("one two three four five")
    assert wording(t, words_of("zero one two X four five six"))[:2] == (0.8, ["replace three -> x"])
    assert wording(t, words_of("nothing alike")) == (0.0, [], (0, 0))


def test_clean_text_has_no_licence(templates):
    rng = random.Random(31)
    assert scan(filler(rng, 500) + " copyright of permission and licence\nfree software", templates) == []


def test_every_cue_lies_in_a_block_with_its_neighbours():
    rng = random.Random(35)
    for _ in range(200):
        n, reach = rng.randint(1, 300), rng.choice([8, 16, 64])
        cues = sorted((a, min(a + rng.randint(1, 2), n)) for a in rng.sample(range(n), rng.randint(0, min(n, 40))))
        blocks = list(blocks_of(cues, reach, n))
        assert all(any(f <= max(a - reach, 0) and min(b + reach, n) <= l for f, l in blocks) for a, b in cues)
        assert all(l - f <= 3 * reach + 3 for f, l in blocks)


def verbatim(text, templates):
    """Licences whose wording stands in a text word for word, but for places within a longer such wording."""
    words, places = words_of(text), []
    for name, t in zip(templates.names, templates.words):
        places += [(i, i + len(t), name) for i in range(len(words) - len(t) + 1) if words[i] == t[0] and words[i : i + len(t)] == t]
    return {name for a, b, name in places if not any(c <= a and b <= d and d - c > b - a for c, d, _ in places)}


@pytest.mark.parametrize("n", [10, 100, 400, 2000, 10_000])
def test_notices_in_prose_of_any_length(templates, n):
    rng = random.Random(36 + n)
    for name, text in TEMPLATES if n < 2000 else rng.sample(TEMPLATES, 12):
        whole = f"{filler(rng, n)} {text} {filler(rng, n)}"
        assert [(f["license"], f["coverage"]) for f in scan(whole, templates)] == [(name, 1.0)]


def test_a_notice_on_every_line(templates):
    found = scan("\n".join(["Released under the MIT License."] * 300), templates)
    assert [(f["license"], f["line_no"]) for f in found] == [("MIT", k) for k in range(300)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_query_finds_what_a_word_scan_finds(spark, templates):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {(r.doc_id, r.license) for r in QUERIES["op3_licenses"](spark, DATA).collect()}
    want = {(d, name) for d, t in docs.items() for name in verbatim(t or "", templates)}
    assert want <= got and len(want) > 20


def test_table_with_odd_rows(spark):
    rng = random.Random(32)
    mit = TEMPLATES[0][1]
    deep = filler(rng, 3000) + f" {mit} " + filler(rng, 3000) + f" {TEMPLATES[5][1]}"
    rows = [(1, mit), (1, mit), (2, None), (3, ""), (None, f"x\n{mit}"), (4, filler(rng, 50)), (5, deep), (6, "license " * 20_000)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, license string, rank int").repartition(3)
    out = scan_licenses(docs, TEMPLATES)
    assert out.columns == [*docs.columns, "licenses"]
    got = sorted(((r.doc_id or -1), [f.license for f in r.licenses]) for r in out.collect())
    assert got == [(-1, ["MIT"]), (1, ["MIT"]), (1, ["MIT"]), (2, []), (3, []), (4, []), (5, ["MIT", "Apache-2.0"]), (6, [])]
    assert scan_licenses(docs.limit(0), TEMPLATES).isEmpty()
    assert out.where((F.col("doc_id") == 1) & (F.col("licenses")[0]["saved"] <= 0)).isEmpty()


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_whole(templates, mark):
    rng = random.Random(33)
    for name, text in TEMPLATES:
        for width in (30, 45, 72):
            notice = "\n".join(mark + line for line in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))
            found = scan(f"{filler(rng, 30)}\n{notice}\n{filler(rng, 30)}", templates)
            assert [(f["license"], f["line_no"], f["coverage"]) for f in found] == [(name, 1, 1.0)], (name, width, found)


def test_adjacent_notices_are_all_found(templates):
    rng = random.Random(34)
    short = [(name, text) for name, text in TEMPLATES if len(words_of(text)) < 20]
    for _ in range(60):
        notices = rng.sample(short, 3) if rng.random() < 0.8 else [rng.choice(short)] * 3
        found = scan("\n".join(text for _, text in notices), templates)
        assert [f["license"] for f in found] == [name for name, _ in notices], (notices, found)
