"""Operator 5 against labelled texts and a plain Viterbi."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cathodyne.llm import language
from cathodyne.llm.language import identify, label_texts, train, viterbi

WORDS = {
    "en": "the of and to in that with from this which there would their about could other".split(),
    "de": "der die und das nicht mit sich auf eine auch werden durch wurde über können".split(),
    "es": "que los una por para con más como pero sus este cuando también entre está".split(),
    "ru": "и в не на что он как это по но они все она так его только был".split(),
}


def say(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(10)
    rows = [(k, say(rng, lang, 60), lang) for k, lang in enumerate(list(WORDS) * 30)] + [(-1, None, "en"), (-2, "x", None), (None, say(rng, "de", 9), "de")]
    return train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(0, 6, 5)
        scores = rng.normal(0, 3, (int(counts.sum()), 3)).astype(np.float32)
        labels, at = viterbi(scores, counts, 2.0), 0
        for n in counts:
            part = scores[at : at + n]
            value = lambda p: sum(part[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
            assert value(labels[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
            at += n


def test_held_out_texts_and_odd_rows(spark, model):
    rng = random.Random(11)
    rows = [(k, say(rng, lang, 12), lang) for k, lang in enumerate(list(WORDS) * 10)]
    odd = [(100, None, "und"), (101, "", "und"), (102, "123 ... !!", "und"), (103, say(rng, "de", 200_000), "de"), (104, say(rng, "en", 8).upper(), "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:3]], "doc_id long, text string, want string, lang int").repartition(3)
    got = docs.select("want", identify(F.col("text"), model).alias("f"), F.col("doc_id"))
    assert got.count() == len(rows) + len(odd) + 3
    wrong = got.where("f.lang != want").collect()
    assert not wrong
    assert got.where("f.score < 0 or f.score > 1 or (want = 'und' and (f.score != 0 or size(f.spans) > 0))").isEmpty()


def test_spans_of_mixed_text(model):
    rng = random.Random(12)
    parts = [("en", say(rng, "en", 15)), ("ru", say(rng, "ru", 15)), ("de", say(rng, "de", 15))]
    text = " -- ".join(p for _, p in parts)
    ((lang, score, spans),) = label_texts([text], model, 12.0)
    assert [s[2] for s in spans] == ["en", "ru", "de"] and [text[a:b] for a, b, _ in spans] == [p for _, p in parts]
    assert lang in WORDS and 0.3 < score < 0.5


def test_blocks_join_up(model, monkeypatch):
    rng = random.Random(13)
    text = say(rng, "en", 300)
    whole = label_texts([text], model, 12.0)
    monkeypatch.setattr(language, "BLOCK", 200)
    assert label_texts([text], model, 12.0) == whole


def test_lower_case_of_odd_letters(model):
    ((_, _, spans),) = label_texts(["İİ der die und"], model, 12.0)
    assert spans[-1][1] == len("İİ der die und")


def test_training_on_nothing(spark):
    empty = train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert label_texts(["some text"], empty, 12.0) == [("und", 0.0, [])]


def test_sample_has_a_bound(spark):
    rows = [(k, "the and of", "en") for k in range(4000)]
    m = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=100)
    assert m.languages == ["en"]


def test_marks_go_on_words_but_start_none(model):
    got = label_texts(["́", "́̂ 12", "été con", "́que los"], model, 12.0)
    assert [r[:2] for r in got[:2]] == [("und", 0.0)] * 2 and all(r[0] in WORDS for r in got[2:])
    assert got[3][2][0][0] == 1
