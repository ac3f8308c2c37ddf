"""Spelling variants by a bit-sliced position index over the vocabulary (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.common import discard, keep, let

#: A run of letters, in Java's notation.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Words of one key that are indexed together; the words of a larger key get longer keys.
CROWD = 20_000
#: Machine words of bitsets that are held for the queries of one step.
STEP = 1 << 19

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def words_of(doc_id: Column, text: Column, min_chars: int, every: int) -> Column:
    """The runs of at least ``min_chars`` letters of a text, A-Z in lower case; where ``every`` divides the crc32 of ``<id>:<run>``, the letter it points at is gone."""

    def written(run: Column) -> Column:
        low = F.translate(run, _UPPER, _LOWER)
        name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low)

        def cut(c: Column) -> Column:
            at = (c["h"] % F.length(c["low"])).cast("int")
            return F.when(c["h"] % every != 0, c["low"]).otherwise(F.concat(F.substring(c["low"], F.lit(1), at), F.substring(c["low"], at + 2, F.length(c["low"]))))

        return let(F.struct(low.alias("low"), F.crc32(name).alias("h")), cut)

    return F.transform(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0)), written)


def vocabulary(docs: DataFrame, min_chars: int, min_count: int, every: int) -> DataFrame:
    """Rows (word, n): words of at least ``min_chars`` letters and how often they occur, if ``min_count`` times or more."""
    words = docs.select(F.explode(words_of(F.col("doc_id"), F.col("text"), min_chars, every)).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Two rows of each, with keys that also fix the first or the last half of what is free of the word.

    A row (key, word, n, size, start, free, longer) has a word of ``size`` letters, or one ``longer``, whose letters before
    ``start`` and behind the ``free`` ones from there are those of the key. Of two words that differ by one letter within
    the free part, one half agrees.
    """
    end, half = F.col("start") + F.col("free") + F.col("longer").cast("int"), F.floor(F.col("free") / 2).cast("int")
    first = F.struct(F.lit(0).alias("side"), F.substring("word", F.col("start") + 1, half).alias("fixed"), (F.col("start") + half).alias("start"), (F.col("free") - half).alias("free"))
    behind = F.col("free") - half
    last = F.struct(F.lit(1).alias("side"), F.substring("word", end - behind + 1, behind).alias("fixed"), F.col("start").alias("start"), half.alias("free"))
    both = rows.withColumn("to", F.explode(F.array(first, last)))
    key = F.xxhash64("key", "size", "to.side", "to.fixed")
    return both.select(key.alias("key"), "word", "n", "size", F.col("to.start").alias("start"), F.col("to.free").alias("free"), "longer")


def keyed(words: DataFrame, min_chars: int) -> DataFrame:
    """Rows (key, word, n, longer): words that differ by one letter share a key, and no key has more than ``CROWD`` words by far.

    Words of a length, and those of one letter more, meet by either half of the shorter length. The words of a key
    that has more than ``CROWD`` are halved again, down to a single free letter, where the alphabet bounds them.
    """
    size = F.length("word")
    sizes = F.array(F.struct(size.alias("size"), F.lit(False).alias("longer")), F.struct((size - 1).alias("size"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(sizes).alias("as")).where(F.col("as.size") >= min_chars)
    level = _halves(rows.select(F.lit(0).cast("long").alias("key"), "word", "n", "as.size", F.lit(0).alias("start"), F.col("as.size").alias("free"), "as.longer"))
    done = None
    while True:
        crowded = keep(level.groupBy("key").agg(F.count("*").alias("rows"), F.max("free").alias("free")).where(f"rows > {CROWD} and free > 1").select("key"), "crowded")
        last = crowded.isEmpty()
        part = (level if last else level.join(crowded, "key", "left_anti")).select("key", "word", "n", "longer")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        level = keep(_halves(level.join(crowded, "key", "left_semi")), "halves")


class PositionIndex:
    """A bitset of words for each position and letter; all words have the same length."""

    def __init__(self, letters: np.ndarray):
        self.n, self.size = letters.shape
        self.alphabet = np.unique(letters)
        width = -(-self.n // 64)
        self.bits = np.zeros((self.size, len(self.alphabet) + 1, width), np.uint64)  # a last letter that no word has
        padded = np.zeros((len(self.alphabet), width * 64), bool)
        for k in range(self.size):
            padded[:, : self.n] = letters[:, k] == self.alphabet[:, None]
            self.bits[k, :-1] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def _codes(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at, len(self.alphabet))

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) that differ by one letter; the queries are as long as the words, or one letter longer.

        The words that agree with a query so far, and those with one error so far, are bitsets that a
        letter moves on, all words at once. For longer queries the words with an error are behind by a
        position, so they meet the query's next letter there.
        """
        codes, longer = self._codes(letters), letters.shape[1] > self.size
        step = max(1, STEP // self.bits.shape[2])
        found = [self._step(codes[a : a + step], longer) for a in range(0, len(codes), step)]
        return np.concatenate([q + k * step for k, (q, _) in enumerate(found)]), np.concatenate([w for _, w in found])

    def _step(self, codes: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        exact = np.full((len(codes), self.bits.shape[2]), np.iinfo(np.uint64).max)
        error = exact.copy() if longer else np.zeros_like(exact)
        for k in range(self.size):
            same = self.bits[k, codes[:, k]]
            if longer:
                error &= self.bits[k, codes[:, k + 1]]
                exact &= same
                error |= exact
            else:
                error &= same
                error |= exact & ~same
                exact &= same
        query, place = np.nonzero(error)
        bits = np.unpackbits(error[query, place].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        word = place[at] * 64 + bit
        real = word < self.n
        return query[at][real], word[real]


def _letters(words: np.ndarray, size: int) -> np.ndarray:
    return words.astype(f"<U{size}").view(np.uint32).reshape(len(words), size)


def _pairs_of(words: np.ndarray, counts: np.ndarray, longer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near words of one key as (word, near, near_n), each pair both ways."""
    short, long = np.flatnonzero(~longer), np.flatnonzero(longer)
    if not len(short):
        return
    size = len(words[short[0]])
    # Words whose lengths differ share a key only where hashes collide.
    short = short[[len(w) == size for w in words[short]]]
    long = long[[len(w) == size + 1 for w in words[long]]]
    index = PositionIndex(_letters(words[short], size))
    if len(short) > 1:
        q, w = index.near(_letters(words[short], size))
        yield words[short[q]], words[short[w]], counts[short[w]]
    if len(long):
        q, w = index.near(_letters(words[long], size + 1))
        yield words[long[q]], words[short[w]], counts[short[w]]
        yield words[short[w]], words[long[q]], counts[long[q]]


def near_words(words: DataFrame, min_chars: int) -> DataFrame:
    """Rows (word, near, near_n) of different words (word, n) that differ by one inserted, deleted or replaced letter, both ways, each once."""
    rows = keyed(words, min_chars)
    parts = 4 * words.sparkSession.sparkContext.defaultParallelism

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = part.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            yield from _of_keys(part.slice(0, cut))
            rest = part.slice(cut)
        if rest is not None:
            yield from _of_keys(rest)

    found = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(of, "word string, near string, near_n long")
    return found.distinct()


def _of_keys(part: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = part.column("key").to_numpy()
    words, counts, longer = part.column("word").to_pandas().to_numpy(object), part.column("n").to_numpy(), part.column("longer").to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    some = np.flatnonzero(np.diff(edges) > 1)
    out = [found for k in some.tolist() for found in _pairs_of(*(x[edges[k] : edges[k + 1]] for x in (words, counts, longer)))]
    if out:
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NEAR)], schema=_NEAR)


def _last(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form): the end of each chain. A step multiplies the count, so chains are short."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = keep(roots.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(roots)
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        roots = stepped


def spelling_variants(docs: DataFrame, min_chars: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per word of the corpus.

    Words are runs of letters, A-Z in lower case, of at least ``min_chars`` letters that occur ``min_count`` times or
    more in all texts; one run in ``every`` is written without one of its letters, which its crc32 picks. Two words are
    near if they differ by one inserted, deleted or replaced code point. A word's ``form`` is its near word of
    largest count, ties to the first in code-point order, if that count is at least ``ratio`` times its own. ``root`` is
    the last form, or the word itself.

    Near words are looked up in bitsets by position and letter, over all words that share half of their letters with the
    word: every near pair shares a half, and crowded halves are halved again, so no index outgrows ``CROWD`` by far and
    no pair is lost. Null and empty texts have no words; texts are read whole. Null ids count as empty ones where the crc32 is
    taken. Repeated rows count each. An empty table gives an empty one. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms do not go round in circles")
    if min_chars < 2:
        raise ValueError("min_chars must be 2 or more, so that words have halves")
    words = keep(vocabulary(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_chars, min_count, every), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = keep(near_words(words, min_chars).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= ratio * F.col("n")
    formed = keep(joined.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")), "forms")
    discard(near)
    roots = _last(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
