"""Licence scan by conditional compression (operator 3)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a line of a notice may hold; only documents with such a line are looked at further.
CUE = r"(?i)licen[cs]e|copyright|creative\W+commons|\bCC[\s-]+(?:BY|0)|public\W+domain|SPDX-|redistribut|free\W+software|permission|without\W+warrant"
#: Least reduction, as a share of what the template takes by itself, and least share of a template's words.
LEAST_SAVED, COVERAGE = 0.1, 0.8

#: Level of compression. Below 12 a short block is at times stored as it is though a template would shrink it.
LEVEL = 12
#: Bytes on either side of a template in its dictionary; no text has them, as texts have single spaces.
MARGIN = b"\n" * 16

FINDING = "struct<line_no:int,license:string,template:int,plain_size:int,saved:int,rank:int,coverage:double,differences:array<string>>"

_CUE, _WORD = re.compile(CUE), re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


class Templates:
    """Templates as raw dictionaries, with the words that tell their wordings apart."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words = [words_of(text) for _, text in templates]
        self.counts = [Counter(words) for words in self.words]
        # Templates of about one length are looked for in blocks of their own.
        by_reach: dict[int, list[int]] = {}
        for t, words in enumerate(self.words):
            by_reach.setdefault(max(8, 1 << (len(words) - 1).bit_length()), []).append(t)
        self.classes = sorted(by_reach.items())
        # Any dictionary takes some bytes, so what a template saves is measured against one that says nothing.
        self.plain = _with_dictionary(b"")
        plain_texts = [spaced(text) for _, text in templates]
        self.alone = [len(self.plain.compress(text)) for text in plain_texts]
        self.with_template = [_with_dictionary(text) for text in plain_texts]

    def rank(self, block: str, among: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
        """Compressed size of a block, and (saved, template) of those templates that save enough, most first."""
        raw = spaced(block)
        size = len(self.plain.compress(raw))
        saved = [(size - len(self.with_template[t].compress(raw)), t) for t in among]
        return size, sorted(((s, t) for s, t in saved if s >= LEAST_SAVED * min(self.alone[t], size)), key=lambda x: (-x[0], x[1]))


def _with_dictionary(text: bytes) -> zstandard.ZstdCompressor:
    """A compressor with a raw dictionary. Matches begin neither at a dictionary's first byte nor in its last few, so it has margins."""
    dictionary = zstandard.ZstdCompressionDict(MARGIN + text + MARGIN, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False)


def spaced(text: str) -> bytes:
    """What is compressed: lower case, single spaces."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def wording(template: list[str], block: list[str]) -> tuple[float, list[str], tuple[int, int]]:
    """Share of the template's words found in order, what differs where it matches, and that place in the block."""
    matcher = SequenceMatcher(None, template, block, autojunk=False)
    pairs = [m for m in matcher.get_matching_blocks() if m.size]
    if not pairs:
        return 0.0, [], (0, 0)
    core = max(pairs, key=lambda m: m.size)
    low, high = core.b - core.a - len(template) // 4, core.b + len(template) - core.a + len(template) // 4
    pairs = [m for m in pairs if low <= m.b and m.b + m.size <= high]
    first, last = pairs[0], pairs[-1]
    place = (max(0, first.b - first.a), min(len(block), last.b + len(template) - last.a))
    matcher = SequenceMatcher(None, template, block[place[0] : place[1]], autojunk=False)
    same = sum(m.size for m in matcher.get_matching_blocks())
    ops = [f"{op} {' '.join(template[a:b])} -> {' '.join(block[place[0] + c : place[0] + d])}" for op, a, b, c, d in matcher.get_opcodes() if op != "equal"]
    return same / len(template), ops, place


def cues_of(text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """First word and the one behind the last of each cue, by the words' ``spans``."""
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    return [(bisect_right(ends, cue.start()), bisect_left(starts, cue.end())) for cue in _CUE.finditer(text)]


def blocks_of(cues: Sequence[tuple[int, int]], reach: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of the ``n`` words that hold all words within ``reach`` of a cue, each about three times that at most.

    Whatever has ``reach`` words or fewer and a cue among them lies in one of the blocks as a whole.
    """
    k = 0
    while k < len(cues):
        first, last = cues[k]
        while k < len(cues) and cues[k][0] - first <= reach:
            last = max(last, cues[k][1])
            k += 1
        yield max(first - reach, 0), min(last + reach, n)


def _claims(text: str, spans: Sequence[tuple[int, int]], first: int, last: int, templates: Templates, among: Sequence[int]) -> list[dict]:
    """Every template confirmed among the words from ``first`` to ``last``, at its best place."""
    piece = text[spans[first][0] : spans[last - 1][1]]
    words = words_of(piece)
    there = Counter(words)
    # Words that are there at all bound those in order, so that no other template can be confirmed.
    able = {t for t in among if sum(min(n, there[w]) for w, n in templates.counts[t].items()) >= COVERAGE * len(templates.words[t])}
    if not able:
        return []
    size, ranked = templates.rank(piece, among)
    out = []
    for rank, (saved, t) in enumerate(ranked, 1):
        if t in able:
            coverage, differences, (a, b) = wording(templates.words[t], words)
            if coverage >= COVERAGE:
                out.append({"place": (first + a, first + b), "license": templates.names[t], "template": t, "plain_size": size, "saved": saved, "rank": rank, "coverage": coverage, "differences": differences})
    return out


def scan(text: str, templates: Templates) -> list[dict]:
    """Confirmed licences of a text; places that two templates claim go to the one with more words found, less its differences.

    What is left beside the confirmed places is looked at again, until nothing more is confirmed.
    """
    spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    cues = cues_of(text, spans)
    todo = [(first, last, k) for k, (reach, _) in enumerate(templates.classes) for first, last in blocks_of(cues, reach, len(spans)) if first < last]
    found: list[dict] = []
    while todo:
        claims = [(c, block) for block in todo for c in _claims(text, spans, *block[:2], templates, templates.classes[block[2]][1])]
        winners, taken = [], sorted(f["place"] for f in found)
        for claim, _ in sorted(claims, key=lambda c: (len(c[0]["differences"]) - c[0]["coverage"] * len(templates.words[c[0]["template"]]), c[0]["rank"], c[0]["place"])):
            a, b = claim["place"]
            at = bisect_left(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                winners.append(claim)
        found += winners
        # Blocks whose claims met a taken place, their own or another's, are cut at what is taken and looked at again.
        rest, again = set(), {block for c, block in claims if _meets(taken, *c["place"])}
        for first, last, k in again:
            edges = [first, *(min(max(x, first), last) for place in taken[_from(taken, first) :] if place[0] < last for x in place), last]
            rest |= {(a, b, k) for a, b in zip(edges[::2], edges[1::2]) if a < b and (a, b) != (first, last)}
        todo = sorted(rest)
    rows = []
    for f in sorted(found, key=lambda f: f["place"]):
        rows.append({"line_no": text.count("\n", 0, spans[f["place"][0]][0])} | {k: v for k, v in f.items() if k != "place"})
    return sorted(rows, key=lambda f: (f["line_no"], f["template"]))


def _from(taken: Sequence[tuple[int, int]], first: int) -> int:
    """The first of the places, which do not overlap, that ends behind ``first``."""
    return bisect_right(taken, first, key=lambda place: place[1])


def _meets(taken: Sequence[tuple[int, int]], a: int, b: int) -> bool:
    at = _from(taken, a)
    return at < len(taken) and taken[at][0] < b


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]], text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """``docs`` with an array of the licences found in each: line, licence, template, sizes, rank, coverage, differences.

    Cues with the words around them make candidate blocks, of a few times a template's length: short
    templates are looked for in short blocks, so that what one saves shows in any text. Each block is
    compressed alone and with each template of the length as a raw dictionary; the templates that shrink it are
    compared word by word, and one counts if at least ``COVERAGE`` of its words stand there in order. ``differences`` are the exact changes of wording.

    Null and empty texts, and texts without cues, get empty arrays. Repeated rows get equal arrays.
    Texts of any length are looked at whole. Ties go to the better rank, then the first place. Other columns stay; ``out_col`` must be free.
    """
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is a column already")
    wordings = list(templates)

    @F.arrow_udf(f"array<{FINDING}>")
    def of(texts: pa.Array) -> pa.Array:
        known = Templates(wordings)
        fields = [("line_no", pa.int32()), ("license", pa.string()), ("template", pa.int32()), ("plain_size", pa.int32()), ("saved", pa.int32()), ("rank", pa.int32()), ("coverage", pa.float64()), ("differences", pa.list_(pa.string()))]
        return pa.array([scan(t.as_py(), known) if t.is_valid else [] for t in texts], pa.list_(pa.struct(fields)))

    candidate = F.when(F.col(text_col).rlike(CUE), F.col(text_col))  # other texts do not go to Python
    # Not deterministic to the optimiser, so that a filter on the result doesn't run it again.
    return docs.withColumn(out_col, of.asNondeterministic()(candidate))
