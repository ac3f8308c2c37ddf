"""Repeated passages by sharded automata of recurring phrases (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cathodyne.llm.common import bucketed, discard, keep

#: Words of a phrase. Of each window's phrases the one of least hash stands for it.
PHRASE = 10
#: Bytes of text in a block of documents; a block's phrases make one automaton.
BLOCK_BYTES = 8 << 20
#: Bytes or words that are hashed at once.
STRETCH = 1 << 20
#: Two odd multipliers drawn once: of bytes within a word, and of words within a phrase or window.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_WRAP = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 to n - 1, modulo 2^64."""
    out = np.full(max(n, 1), base % _WRAP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all of it; one to one."""
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of words and of runs of words, from sums that each position weighs by a power of a base."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _weights(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of ``base`` and of its inverse, at least ``n`` of each."""
        if base not in self.known or len(self.known[base][0]) < n:
            size = 1 << max(12, n.bit_length())
            self.known[base] = _powers(base, size), _powers(pow(base, -1, _WRAP), size)
        return self.known[base]

    def _runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
        """Hashes of the runs of ``values`` from ``starts`` to before ``ends``, both rising; a stretch of values at a time."""
        out, a = np.empty(len(starts), np.uint64), 0
        while a < len(starts):
            low = int(starts[a])
            b = max(a + 1, int(np.searchsorted(starts, low + STRETCH)))
            part = values[low : int(ends[b - 1])].astype(np.uint64) + np.uint64(1)
            up, down = self._weights(base, len(part) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
            first = starts[a:b] - low
            out[a:b] = _mixed((sums[ends[a:b] - low] - sums[first]) * down[first])
            a = b
        return out

    def words(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._runs(np.frombuffer(joined, np.uint8), starts, ends, BYTE_BASE)

    def grams(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words."""
        at = np.arange(max(0, len(words) - size + 1))
        return self._runs(words, at, at + size, WORD_BASE)


class Text:
    """A text's words joined by single spaces, and where each starts and ends."""

    def __init__(self, text: str | None):
        self.joined = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
        gaps = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)
        some = int(len(self.joined) > 0)
        self.starts = np.concatenate([np.zeros(some, np.int64), gaps + 1])
        self.ends = np.concatenate([gaps, np.full(some, len(self.joined), np.int64)])

    def __len__(self) -> int:
        return len(self.starts)


def least_phrases(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the phrases that are the first of least hash among some ``span`` neighbouring ones."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    first = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(1)
    return np.unique(first + np.arange(len(first)))


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` that begins at one of ``starts``."""
    edges = np.bincount(starts, minlength=n + width + 1)[: n + 1].astype(np.int64)
    edges[width:] -= edges[: n + 1 - width].copy() if n >= width else 0
    return np.cumsum(edges)[:n] > 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of the block that they are in: neighbouring rows of a task, about ``BLOCK_BYTES`` together."""
    task, number, held = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        sizes = pc.coalesce(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        blocks = np.empty(len(sizes), np.int64)
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > BLOCK_BYTES:
                number, held = number + 1, 0
            held += size
            blocks[k] = task | number
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks)], names=["doc_id", "text", "block"])


def phrases_of(dealt: DataFrame, width: int) -> DataFrame:
    """Rows (phrase, block, least, most): the phrases that stand for windows, and the ids in each block that have them.

    Equal windows have equal phrases. A task holds the phrases of one block at a time, so a phrase gives
    a row per block whatever the number of its documents.
    """
    size = min(PHRASE, width)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, here, found = Hashes(), None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                ids = list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.binary()), pa.array([here] * len(ids), pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64())],
                    names=["phrase", "block", "least", "most"],
                )
                found.clear()

        for batch in batches:
            for doc_id, text, block in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "block"))):
                if block != here:
                    yield from flush()
                    here = block
                t = Text(text)
                if len(t) < width:
                    continue
                grams = hashes.grams(hashes.words(t.joined, t.starts, t.ends), size)
                for at in least_phrases(grams, width - size + 1).tolist():
                    phrase = t.joined[t.starts[at] : t.ends[at + size - 1]]
                    low, high = found.get(phrase, (doc_id, doc_id))
                    found[phrase] = (min(low, doc_id), max(high, doc_id))
        yield from flush()

    return dealt.where("doc_id is not null").mapInArrow(of, "phrase binary, block long, least long, most long")


def _automaton(phrases: list[bytes]) -> ahocorasick.Automaton:
    """Finds phrases between spaces; a byte is a letter."""
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        found.add_word(f" {phrase.decode('latin-1')} ")
    found.make_automaton()
    return found


def windows_of(dealt: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """Rows (h, block, least, most): hashes of the windows that hold one of their block's ``phrases`` (block, phrase), and the ids that have them."""
    size = min(PHRASE, width)

    def of(docs: pa.Table, own: pa.Table) -> pa.Table:
        schema = pa.schema([("h", pa.int64()), ("block", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])
        if not len(docs) or not len(own):
            return schema.empty_table()
        automaton, hashes, parts = _automaton(own.column("phrase").to_pylist()), Hashes(), []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            t = Text(text)
            if len(t) < width:
                continue
            # An occurrence ends with the space behind its last word: at that word's end, counted with the space in front.
            ends = np.fromiter((end for end, _ in automaton.iter(f" {t.joined.decode('latin-1')} ")), np.int64)
            if not len(ends):
                continue
            first = np.searchsorted(t.ends, ends - 1) - size + 1  # the phrase's first word
            reach = width - size
            starts = np.zeros(len(t) + 1, np.int64)
            np.add.at(starts, np.maximum(first - reach, 0), 1)
            np.add.at(starts, first + 1, -1)
            candidates = np.flatnonzero(np.cumsum(starts)[: len(t) - width + 1])
            h = hashes.grams(hashes.words(t.joined, t.starts, t.ends), width)[candidates]
            parts.append((np.unique(h), doc_id))
        if not parts:
            return schema.empty_table()
        h = np.concatenate([p for p, _ in parts])
        ids = np.concatenate([np.full(len(p), i, np.int64) for p, i in parts])
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = np.append(first[1:], len(h)) - 1
        block = np.full(len(first), docs.column("block")[0].as_py(), np.int64)
        return pa.table([h[first].view(np.int64), block, ids[first], ids[last]], schema=schema)

    left = dealt.where("doc_id is not null").groupBy("block")
    return left.cogroup(phrases.groupBy("block")).applyInArrow(of, "h long, block long, least long, most long")


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key two ids or more have, with the least of them all as ``owner``; a key has a row per block."""
    by = Window.partitionBy(key)
    whole = rows.select("*", F.min("least").over(by).alias("owner"), F.max("most").over(by).alias("last"))
    return whole.where("owner < last").drop("last")


def remove_passages(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256, kept_text), one per row of ``docs``; ``kept_text`` is null without ``texts``.

    A word goes if one of the windows of ``width`` words that hold it has a word sequence which also starts in
    a document of smaller id; windows are judged on the input. Of the phrases of each window the one of least
    hash stands for it. Phrases that two ids or more have are confirmed by their words, each block
    of documents gets those it holds as an automaton, and all its texts are streamed through it. The windows around
    each occurrence are known by 64-bit hashes: of ten billion different windows, about 1 in 10^9 of them shares one with another.

    Null and empty texts have no words, and texts of fewer than ``width`` words lose none. Rows that share an id are not
    smaller than one another. Null ids are neither smaller nor larger: their texts stay whole. Ids are
    longs. Texts of any length are read whole. Repeated rows have equal results. An empty table gives an empty
    one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Dealt out by block once, so that the texts are not shuffled to meet what is found.
    dealt = bucketed(rows.mapInArrow(_blocks, "doc_id long, text string, block long"), "block", rows_together=True)
    phrases = keep(_recurring(phrases_of(dealt, width), "phrase").select("block", "phrase"), "phrases")
    confirmed = keep(_recurring(windows_of(dealt, phrases, width), "h").where("owner < most").select("block", "h", "owner"), "confirmed")
    discard(phrases)

    def of(part: pa.Table, own: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
        known = own.column("h").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, owners, hashes, out = known[order], own.column("owner").to_numpy()[order], Hashes(), []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            t = Text(text)
            kept, gone = t.joined, 0
            if doc_id is not None and len(known) and len(t) >= width:
                h = hashes.grams(hashes.words(t.joined, t.starts, t.ends), width)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                removed = covered(np.flatnonzero((known[at] == h) & (owners[at] < doc_id)), len(t), width)
                if gone := int(removed.sum()):
                    kept = b" ".join(_pieces(t, ~removed))
            out.append((doc_id, len(t), gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
        columns = list(zip(*out)) or [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    result = dealt.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(of, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    kept = keep(result.withColumnRenamed("doc_id", id_col), "kept-texts")
    discard(dealt)
    discard(confirmed)
    return kept


def _pieces(t: Text, stays: np.ndarray) -> Iterator[bytes]:
    """The runs of words that stay."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], stays.astype(np.int8), [0]])))
    for first, behind in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield t.joined[t.starts[first] : t.ends[behind - 1]]


PASSAGES_SQL = """
with docs as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as words from documents),
windows as (
  select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from docs where len(words) >= 50)),
shared as (select h, min(doc_id) as owner from windows group by h having min(doc_id) < max(doc_id)),
gone as (
  select distinct doc_id, i + unnest(range(50)) as at
  from (select doc_id, i from windows join shared using (h) where owner < doc_id)),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.at) as text, count(*) as n
  from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as at from docs) w anti join gone g on w.doc_id = g.doc_id and w.at = g.at
  group by w.doc_id)
select d.doc_id, len(d.words)::bigint as n_words, (len(d.words) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join kept k using (doc_id)
"""
