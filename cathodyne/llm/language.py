"""Language identification of mixed-language texts (operator 5)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First code points of script ranges (fixed values of Unicode's blocks) and their scripts; "other" ends a range.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_STARTS = np.array([s for s, _ in SCRIPT_RANGES])
_SCRIPT_AT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])

BUCKETS = 1 << 16
#: Characters whose words are scored at once.
BLOCK = 1 << 20
#: Score a word loses in a language that does not use its script.
WRONG_SCRIPT = 50.0


@dataclass(frozen=True)
class LanguageModel:
    """Trigram scores (BUCKETS x languages), and which language uses which script (SCRIPTS x languages)."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point 2 for a letter, 1 for a mark, else 0."""
    return np.array([" ML".find(unicodedata.category(chr(c))[0]) for c in range(0x110000)]).clip(0).astype(np.int8)


def _codes(text: str) -> np.ndarray:
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the trigram bucket of each letter, word edges as zero. Marks go on a word, but start none."""
    kind, at = _letters()[codes], np.arange(len(codes))
    before = [np.maximum.accumulate(np.where(kind == k, at, -1)) if len(at) else at for k in (2, 0)]
    letter = (kind == 2) | ((kind == 1) & (before[0] > before[1]))
    edges = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    x = np.where(letter, codes, 0).astype(np.uint64)
    before, after = np.concatenate(([0], x[:-1])), np.concatenate((x[1:], [0]))
    with np.errstate(over="ignore"):
        mixed = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (x * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), (mixed[letter] >> np.uint64(48)).astype(np.int64)


def _script_of(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT_AT[np.searchsorted(_STARTS, codes, "right") - 1]


def train(labelled: DataFrame, max_rows: int = 20_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Counts trigrams and scripts of labelled rows.

    Of each language, about ``max_rows`` rows chosen by a hash of their id are read: the documented
    bound of this training sample. A row without language or text is left out. Without any rows the
    model has no languages, and every prediction is ``und``.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # a row per language, as in the model
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, max_rows / n)])
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    rows = known.where(drawn < share[F.col(lang_col)]).select(lang_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = found.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for _, part in _parts(text.as_py()):
                    codes = _codes(part)
                    starts, _, grams = _words(codes)
                    if len(starts):
                        counts[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                        counts[BUCKETS:] += np.bincount(_script_of(codes[starts]), minlength=len(SCRIPTS))
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], names=["lang", "at", "n"])

    # One row per language and bucket: at most languages x 65,560, however large the table.
    sums = rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    counts[sums["at"], np.searchsorted(languages, sums["lang"]) if len(sums) else []] = sums["n"]
    grams, scripts = counts[:BUCKETS] + 0.1, counts[BUCKETS:]
    scores = np.log(grams / grams.sum(0))
    uses = scripts > 0.01 * np.maximum(scripts.sum(0), 1)
    return LanguageModel(languages, (scores - scores.mean(1, keepdims=True)).astype(np.float32), uses)


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """``text`` in blocks, cut behind a character that is no letter where there is one."""
    start = 0
    while start < len(text):
        end = min(len(text), start + BLOCK)
        if end < len(text):
            cut = next((k for k in range(end, max(start, end - 1000), -1) if not text[k - 1].isalpha()), end)
            end = cut
        yield start, text[start:end]
        start = end


def _word_scores(codes: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, grams = _words(codes)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    scores = np.empty((len(starts), len(model.languages)), np.float32)
    step = max(1, (1 << 22) // len(model.languages))
    for a in range(0, len(starts), step // 8 or 1):
        b = min(len(starts), a + (step // 8 or 1))
        scores[a:b] = np.add.reduceat(model.scores[grams[first[a] : first[b - 1] + lengths[b - 1]]], first[a:b] - first[a], axis=0)
    script = _script_of(codes[starts])
    uses = model.uses | ~model.uses.any(1, keepdims=True)  # a script that no language uses narrows nothing
    scores -= np.where(uses[script], np.float32(0), np.float32(WRONG_SCRIPT))
    return starts, ends, scores


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; texts of ``counts`` words each follow one another. A change of label costs ``penalty``.

    All texts step together, longest first, so each step is one operation on the texts that still have words.
    """
    offsets = np.concatenate(([0], np.cumsum(counts)[:-1]))
    order = np.argsort(-counts, kind="stable")
    offsets, sizes = offsets[order], counts[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    came = np.empty(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t, k in enumerate(active):
        at, v = offsets[:k] + t, value[:k]
        if t:
            top = v.argmax(1)
            switch = v[np.arange(k), top][:, None] - np.float32(penalty)
            moves = switch > v
            came[at] = np.where(moves, top[:, None].astype(np.int16), own)
            v = np.where(moves, switch, v)
        value[:k] = v + scores[at]
    labels = np.empty(len(scores), np.int64)
    state = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = offsets[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return labels


def label_texts(texts: list[str | None], model: LanguageModel, penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text its language, score and spans (start, end, language) in characters."""
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = [("und", 0.0, [])] * len(texts)
    if not model.languages:
        return out
    n, waiting, size = len(model.languages), [], 0
    weights: dict[int, np.ndarray] = {}
    spans: dict[int, list[list[int]]] = {}

    def flush() -> None:
        scored = [(_word_scores(_codes(part), model)) for _, _, part in waiting]
        counts = np.array([len(s[0]) for s in scored], np.int64)
        if counts.sum():
            labels = np.split(viterbi(np.concatenate([s[2] for s in scored]), counts, penalty), np.cumsum(counts)[:-1])
            for (row, start, _), (starts, ends, _), label in zip(waiting, scored, labels):
                if len(label):
                    weights[row] = weights.get(row, 0) + np.bincount(label, ends - starts, n)
                    turns = np.flatnonzero(np.diff(label)) + 1
                    firsts, lasts = np.append(0, turns), np.append(turns, len(label)) - 1
                    known = spans.setdefault(row, [])
                    for a, b in zip(firsts.tolist(), lasts.tolist()):
                        if known and known[-1][2] == label[a]:
                            known[-1][1] = start + int(ends[b])
                        else:
                            known.append([start + int(starts[a]), start + int(ends[b]), int(label[a])])
        waiting.clear()

    for row, text in enumerate(texts):
        for start, part in _parts(text or ""):
            waiting.append((row, start, part))
            size += len(part)
            if size >= BLOCK:
                flush()
                size = 0
    flush()
    for row, weight in weights.items():
        best = int(weight.argmax())
        out[row] = (model.languages[best], float(weight[best] / weight.sum()), [(a, b, model.languages[k]) for a, b, k in spans[row]])
    return out


def identify(text: Column, model: LanguageModel, penalty: float = 12.0) -> Column:
    """A struct (lang, score, spans) of a text column.

    The script of a word, told by ranges of code points, narrows its languages to those that use the
    script; trigrams score the word in each; Viterbi with a switching penalty labels the words.
    ``lang`` is the label with most letters, ``score`` its share of the letters, ``spans`` the runs of
    one label. Null and empty texts and those without letters, of marks alone too, are ``und`` with score
    0 and no spans. Ties go to the language that sorts first. Texts are read whole, in blocks; repeated
    rows get equal structs, an empty table gives none. Other columns are not read.
    """

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>")
    def of(texts: pa.Array) -> pa.Array:
        rows = label_texts(texts.to_pylist(), model, penalty)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        spans = pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in r[2]] for r in rows], pa.list_(span))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), spans], names=["lang", "score", "spans"])

    # Not deterministic to the optimiser, so that a filter on the result doesn't run it again.
    return of.asNondeterministic()(text)
