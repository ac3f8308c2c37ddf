"""Benchmark decontamination by latent semantic retrieval (operator 6)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.common import keep

#: Sizes of items and how they are searched: least words of an item, words of a passage, from one passage's start to the next, and the
#: least cosine of a candidate, which is less for short items, as one word besides counts for more.
SCALES = [(12, 20, 10, 0.5), (6, 10, 5, 0.4), (3, 5, 2, 0.3), (1, 2, 1, 0.3)]
#: Words of the document passages that the decomposition is fitted on, which follow one another through each text.
FIT_WORDS = 20
#: Pairs of words that a task holds before it gives them away, those it gives away at once, and features of a block of their matrix.
PAIRS, PAIR_ROWS, BLOCK = 500_000, 1 << 15, 512
#: Features the decomposition keeps apart; a larger vocabulary shares them.
FEATURES = 1 << 15
RANK, EXTRA, ROUNDS = 128, 10, 2
#: Least share of a passage's squared weights that lies in benchmark words.
SHARE = 0.3
#: Share of an item's words that must return in order: with the answer found, and without, as for items below so many words.
LCS, LCS_ALONE, SHORT = 0.6, 0.8, 12
#: Characters of the benchmark that one index holds.
ITEM_CHARS = 4_000_000
#: Words of texts searched at once, passages of them and of items that are multiplied at once, and tasks that sum up a product.
BATCH_WORDS, ROWS, COLUMNS, SVD_TASKS = 100_000, 2048, 4096, 32

_ASCII = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))

MATCHES = "array<struct<item_id:long,start_word:int,cosine:double,lcs:double,answer_found:boolean>>"


def normal(text: str | None) -> bytes:
    """Lower-cased runs of letters and digits; other ASCII characters are blanks."""
    return (text or "").lower().encode("utf-8", "replace").translate(_ASCII)


def words_of(text: str | None) -> list[bytes]:
    return normal(text).split()


def _starts(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of the passages of ``n`` words; the last ends at the end."""
    if n <= window:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - window, stride), n - window)


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


@dataclass
class Scale:
    """The passages of the items of one range of sizes."""

    window: int
    stride: int
    cosine: float
    queries: np.ndarray  # passages x rank, unit rows
    item: np.ndarray
    start: np.ndarray


@dataclass
class Index:
    """What every task gets: bounded by the benchmark block, not by the documents."""

    item_ids: list[int]
    words: list[np.ndarray]  # of each item, as numbers
    answers: list[np.ndarray]
    vocabulary: pa.Array
    weights: np.ndarray  # by word, the last for words outside
    latent: np.ndarray  # words x rank, weighted; the last, for words outside, is zero
    marks: np.ndarray  # words x 4: one of 256 bits each, none for words outside
    item_marks: np.ndarray  # the bits of each item's words
    scales: list[Scale]


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence; one bit for each word of ``a``, one step for each of ``b``."""
    return lcs_place(a, b)[0]


def lcs_place(a: Sequence, b: Sequence) -> tuple[int, int]:
    """The same length, and the place in ``b`` behind which it grows no more."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, place = full, 0
    for k, w in enumerate(b):
        if m := at.get(w):
            u = row & m
            new = (row + u | row - u) & full
            if new.bit_count() < row.bit_count():
                place = k + 1
            row = new
    return len(a) - row.bit_count(), place


def _answer(text: str, answer: str | None) -> list[bytes]:
    """Words of the answer: as given, else of what follows the last mark that ends a sentence before the end."""
    if answer is not None:
        return words_of(answer)
    body = text.rstrip().rstrip(".!?")
    return words_of(body[max(body.rfind(c) for c in ".!?\n") + 1 :])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> Iterator[list[Item]]:
    """The benchmark in blocks of at most about ``ITEM_CHARS`` characters."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col), answer).orderBy(id_col).toLocalIterator()
    block, size = [], 0
    for item_id, text, given in rows:
        if words := words_of(text):
            block.append(Item(item_id, words, _answer(text, given)))
            size += len(text)
        if size >= ITEM_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def pair_counts(passages: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of the numbers that stand together in a row of ``passages`` (below 0: none), and how often.

    A pair is ``least * words + greatest``; a number also meets itself, and equal ones at two places meet both ways.
    """
    size = np.int32 if words * words < 1 << 31 else np.int64
    # The known numbers of each row move to its front, so short rows end the loop early.
    known = passages >= 0
    row, _ = np.nonzero(known)
    held = known.sum(1)
    at = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    ids = passages[known].astype(size)
    keys = [ids * (words + 1)]
    for lag in range(1, passages.shape[1]):
        p = np.flatnonzero(at[lag:] >= lag)  # the number ``lag`` before stands in the same row
        a, b = ids[p], ids[p + lag]
        keys += [np.minimum(a, b) * words + np.maximum(a, b), a[a == b] * (words + 1)]
    keys = np.concatenate(keys)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key once, with its sum of ``n``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def _pairs_of(blocks: Iterator[np.ndarray], words: int) -> Iterator[pa.RecordBatch]:
    """Rows (first, second, n) of the pairs in all blocks of passages; a pair may come in several rows."""
    found, held = [], 0
    for passages in blocks:
        if (passages >= 0).any():
            found.append(pair_counts(passages, words))
            held += len(found[-1][0])
        if held >= 2 * PAIRS:
            found = [_summed(*map(np.concatenate, zip(*found)))]
            held = len(found[0][0])
            if held >= PAIRS:
                yield from _rows_of(*found[0], words)
                found, held = [], 0
    if found:
        yield from _rows_of(*_summed(*map(np.concatenate, zip(*found))), words)


def _rows_of(keys: np.ndarray, n: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``PAIR_ROWS`` rows, each of which the executor copies outside its heap."""
    for a in range(0, len(keys), PAIR_ROWS):
        part = keys[a : a + PAIR_ROWS].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part // words), pa.array(part % words), pa.array(n[a : a + PAIR_ROWS])], names=["first", "second", "n"])


_PAIRS = "first long, second long, n long"


def _statistics(docs: DataFrame, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One pass over all words of all documents: rows (first, second, n).

    With a ``first`` of -1 they are document frequencies by word, word -1 the documents; else how often two words stand together
    in a passage, where passages of ``FIT_WORDS`` words follow one another from a document's first word to its last.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, known = np.zeros(len(vocabulary), np.int64), 0, pa.array(vocabulary, pa.string())

        def passages() -> Iterator[np.ndarray]:
            nonlocal n
            for texts in _by_words(value for batch in batches for value in batch.column(0)):
                n += len(texts)
                ids, base = numbers(texts, known)
                ids[ids == len(known)] = -1
                lengths = np.diff(base)
                doc = np.repeat(np.arange(len(texts)), lengths)
                df[:] += np.bincount(np.unique((doc * len(known) + ids)[ids >= 0]) % len(known), minlength=len(known))
                rows = -(-lengths // FIT_WORDS)
                out = np.full(rows.sum() * FIT_WORDS, -1, np.int64)
                out[np.arange(len(ids)) - base[doc] + ((np.cumsum(rows) - rows) * FIT_WORDS)[doc]] = ids
                yield out.reshape(-1, FIT_WORDS)

        yield from _pairs_of(passages(), len(vocabulary))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, -1)), pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["first", "second", "n"])

    return keep(docs.select(text_col).mapInArrow(count, _PAIRS).groupBy("first", "second").agg(F.sum("n").alias("n")), "statistics")


def passage_pairs(rows: DataFrame, words: int) -> DataFrame:
    """Rows (first, second, n) of the pairs of numbers in the arrays ``ids``, each of which is a passage."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids, lengths = batch.column(0).flatten().to_numpy(), pc.list_value_length(batch.column(0)).to_numpy()
            out = np.full((len(lengths), max(lengths, default=0)), -1, np.int64)
            out[np.arange(out.shape[1]) < lengths[:, None]] = ids
            yield out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pairs_of(passages(batches), words)

    return rows.select("ids").mapInArrow(of, _PAIRS)


def randomised_svd(rows: DataFrame, features: int, weights: np.ndarray, rank: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Right singular vectors (features x rank) of the sparse matrix with one row per array ``ids``."""
    return singular_vectors(passage_pairs(rows, len(weights)), features, weights, rank, rounds, seed)


def singular_vectors(pairs: DataFrame, features: int, weights: np.ndarray, rank: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Right singular vectors (features x rank) of a matrix A of passages, from the pairs (first, second, n) of words in them.

    The weighted pairs are the cells of A'A, kept in blocks: their number is set by the features, not by the passages. Each round multiplies the
    blocks, which are dealt over the tasks, by a thin matrix Q; the products are summed by key, and only
    that sum, of a size set by features and rank, comes back to be made orthonormal.
    """
    spark, size = pairs.sparkSession, min(features, rank + EXTRA)
    n_blocks = -(-features // BLOCK)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, n = (c.to_numpy() for c in batch.columns)
            value, other = n * weights[i].astype(np.float64) * weights[j], i != j
            a, b = np.append(i, j[other]) % features, np.append(j, i[other]) % features
            columns = [a // BLOCK, b // BLOCK, a % BLOCK * BLOCK + b % BLOCK, np.append(value, value[other])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "other", "at", "value"])

    cells = pairs.select("first", "second", "n").mapInArrow(weigh, "block long, other long, at long, value double")
    cells = cells.groupBy("block", "other", "at").agg(F.sum("value").alias("value"))
    blocks = keep(cells.groupBy("block", "other").agg(F.collect_list(F.struct("at", "value")).alias("cells")), "blocks")

    def product(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(np.vstack([q, np.zeros((n_blocks * BLOCK - features, size))]))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, out = shared.value, {}
            for batch in batches:
                for k in range(batch.num_rows):
                    block, other = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    at, value = (c.to_numpy() for c in batch.column(2)[k].values.flatten())
                    dense = np.bincount(at, value, BLOCK * BLOCK).reshape(BLOCK, BLOCK)
                    out[block] = out.get(block, 0) + dense @ q[other * BLOCK : (other + 1) * BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([p.tobytes() for p in out.values()], pa.binary())], names=["block", "part"])

        def add(_: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p) for p in parts["part"])
            return pd.DataFrame({"block": parts["block"].iloc[:1], "part": [np.asarray(total).tobytes()]})

        schema = "block int, part binary"
        # Blocks are few beside passages, so few tasks add them up, and few parts meet to be summed.
        few = blocks.coalesce(min(SVD_TASKS, spark.sparkContext.defaultParallelism))
        out = np.zeros((n_blocks * BLOCK, size))
        for r in few.mapInArrow(partial, schema).groupBy("block").applyInPandas(add, schema).collect():
            out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.part).reshape(-1, size)
        return out[:features]

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, size)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    return q @ vectors[:, np.argsort(-values)[:rank]]


def build_index(docs: DataFrame, items: list[Item], text_col: str) -> Index:
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for item in items for w in [*item.words, *item.answer]}))}
    stats = _statistics(docs, text_col, vocabulary)
    df = np.zeros(len(vocabulary) + 1)
    for r in stats.where("first = -1").collect():  # a row per benchmark word
        df[r.second] = r.n
    n, df = df[-1], df[:-1]
    weights = np.log((n + 1) / (df + 1)) + 0.1
    weights = np.append(weights, weights.mean()).astype(np.float32)

    words = [np.array([vocabulary[w] for w in item.words]) for item in items]
    passages = []
    for k, ids in enumerate(words):
        scale, (_, window, stride, _) = next((x, y) for x, y in enumerate(SCALES) if len(ids) >= y[0])
        passages += [(scale, k, s, ids[s : s + window]) for s in _starts(len(ids), window, stride).tolist()]
    own = spark.createDataFrame([(p[3].tolist(),) for p in passages], "ids array<int>")
    features = min(len(vocabulary), FEATURES)
    fit = stats.where("first >= 0").unionByName(passage_pairs(own, len(vocabulary)))
    v = singular_vectors(fit, features, weights, RANK)
    latent = (weights[:-1, None] * v[np.arange(len(vocabulary)) % features]).astype(np.float32)
    scales = []
    for scale, (_, window, stride, least) in enumerate(SCALES):
        if own_passages := [p for p in passages if p[0] == scale]:
            queries = np.stack([latent[p[3]].sum(0) for p in own_passages])
            queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
            scales.append(Scale(window, stride, least, queries, np.array([p[1] for p in own_passages]), np.array([p[2] for p in own_passages])))
    bit = np.arange(len(vocabulary)) * 0x9E3779B1 >> 7 & 255
    marks = np.zeros((len(vocabulary) + 1, 4), np.uint64)
    marks[np.arange(len(vocabulary)), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
    item_marks = np.stack([np.bitwise_or.reduce(marks[ids]) for ids in words])
    answers = [np.array([vocabulary[w] for w in item.answer], np.int64) for item in items]
    latent = np.vstack([latent, np.zeros((1, latent.shape[1]), np.float32)])
    return Index([item.item_id for item in items], words, answers, pa.array(vocabulary, pa.string()), weights, latent, marks, item_marks, scales)


def _by_words(texts: Iterable[pa.Scalar]) -> Iterator[list[str | None]]:
    """The texts in lists of about ``BATCH_WORDS`` words."""
    batch, size = [], 0
    for value in texts:
        batch.append(value.as_py())
        size += len(batch[-1] or "") // 6
        if size >= BATCH_WORDS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def numbers(texts: list[str | None], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, those outside as one more, and where each text begins and ends among them."""
    # A text without words is one empty word to the split; it matches nothing.
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array([normal(t) for t in texts], pa.string())))
    ids = pc.fill_null(pc.index_in(split.flatten(), vocabulary), len(vocabulary)).to_numpy(zero_copy_only=False).astype(np.int64)
    base = split.offsets.to_numpy()
    return ids, (base - base[0]).astype(np.int64)


def search(texts: list[str | None], index: Index) -> list[list[dict]]:
    """Confirmed matches of each text, the best of each item."""
    out: list[list[dict]] = [[] for _ in texts]
    ids, base = numbers(texts, index.vocabulary)
    best: dict[tuple[int, int], dict] = {}
    for scale in index.scales:
        for d, k, low, high, cosine in _candidates(ids, base, index, scale):
            words, segment = index.words[k].tolist(), ids[low:high].tolist()
            length, end = lcs_place(words, segment)
            share = length / len(words)
            if share < (LCS if len(words) >= SHORT else LCS_ALONE):
                continue
            found = not len(index.answers[k]) or lcs_length(index.answers[k].tolist(), segment) >= 0.5 * len(index.answers[k])
            if (found or share >= LCS_ALONE) and share > best.get((d, k), {"lcs": 0})["lcs"]:
                start = end - lcs_place(words[::-1], segment[end - 1 :: -1] if end else [])[1]
                best[d, k] = {"item_id": index.item_ids[k], "start_word": int(low - base[d]) + start, "cosine": cosine, "lcs": share, "answer_found": found}
    for (d, _), match in sorted(best.items(), key=lambda x: (x[0][0], x[1]["item_id"])):
        out[d].append(match)
    return out


def _candidates(ids: np.ndarray, base: np.ndarray, index: Index, scale: Scale) -> Iterator[tuple[int, int, int, int, float]]:
    """Places (document, item, first word, behind the last, cosine) whose passage is close to one of the item's."""
    outside, window, stride = len(index.weights) - 1, scale.window, scale.stride
    starts = [_starts(n, window, stride) for n in np.diff(base).tolist()]
    doc = np.repeat(np.arange(len(starts)), np.array([len(s) for s in starts], np.int64))
    if not len(doc):
        return
    first = np.concatenate(starts) + base[doc]
    last = np.minimum(first + window, base[doc + 1])
    inside = ids != outside
    if window == SCALES[0][1]:
        squares = index.weights[ids].astype(np.float64) ** 2
        total, known = (np.append(0, np.cumsum(x)) for x in (squares, np.where(inside, squares, 0)))
        close = np.flatnonzero(known[last] - known[first] >= SHARE * (total[last] - total[first]))
    else:
        number = np.append(0, np.cumsum(inside))
        close = np.flatnonzero(3 * (number[last] - number[first]) >= last - first)
    hits = []
    for a in range(0, len(close), ROWS):
        part = close[a : a + ROWS]
        at = first[part][:, None] + np.arange(window)
        y = index.latent[np.where(at < last[part][:, None], ids[np.minimum(at, len(ids) - 1)], outside)].sum(1)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
        for c in range(0, len(scale.queries), COLUMNS):
            cosines = y @ scale.queries[c : c + COLUMNS].T
            i, j = np.nonzero(cosines >= scale.cosine)
            hits.append((part[i], j + c, cosines[i, j]))
    if not any(len(h[0]) for h in hits):
        return
    i, j, cosine = map(np.concatenate, zip(*hits))
    d, k = doc[i], scale.item[j]
    # Passages a stride apart point to the same place of the item; one try covers them.
    spot = (first[i] - base[d] - scale.start[j]) // window
    order = np.lexsort((-cosine, spot, k, d))
    d, k, spot, cosine = d[order], k[order], spot[order], cosine[order]
    new = np.append(True, (np.diff(d) != 0) | (np.diff(k) != 0) | (np.diff(spot) != 0))
    d, k, spot, cosine = d[new], k[new], spot[new], cosine[new]
    sizes = np.array([len(w) for w in index.words])[k]
    low = base[d] + np.maximum(0, spot * window - stride)
    high = np.minimum(base[d + 1], base[d] + spot * window + window + sizes + stride)
    marks = index.marks[ids]
    for a in range(0, len(d), ROWS):
        b = slice(a, a + ROWS)
        lengths = high[b] - low[b]
        behind = np.cumsum(lengths)
        at = np.arange(behind[-1]) + np.repeat(low[b] - behind + lengths, lengths)
        there = np.bitwise_or.reduceat(marks[at], behind - lengths)
        # A word of the item that isn't there costs the subsequence one at least; different words may share a bit.
        missing = np.bitwise_count(index.item_marks[k[b]] & ~there).sum(1, dtype=np.int64)
        for x in np.flatnonzero(missing <= (1 - LCS) * sizes[b]) + a:
            yield int(d[x]), int(k[x]), int(low[x]), int(high[x]), float(cosine[x])


def leak_column(text: Column, index: Index, spark) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(MATCHES)
    def of(texts: pa.Array) -> pa.Array:
        index, out = shared.value, []
        for batch in _by_words(texts):
            out += search(batch, index)
        fields = [("item_id", pa.int64()), ("start_word", pa.int32()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer_found", pa.bool_())]
        return pa.array(out, pa.list_(pa.struct(fields)))

    # Not deterministic to the optimiser, so that a filter on the result doesn't run it again.
    return of.asNondeterministic()(text)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, out_col: str = "leaks"
) -> DataFrame:
    """``docs`` with an array of the benchmark items found in each, with place, cosine and confirmed share.

    Documents and items are cut into overlapping passages, whose words follow the size of the items (``SCALES``).
    TF-IDF weights, with document frequencies over all documents, and a randomised SVD give latent
    vectors; passages close to an item's passage are candidates. A candidate counts if the longest
    common subsequence of the item's words and the place holds 0.8 of the item, or, for items of ``SHORT``
    words or more, 0.6 of it with its answer (the ``answer`` column, or the item's last sentence).
    ``start_word`` is where that subsequence starts. The decomposition is fitted on the benchmark and on
    all passages of all documents; frequencies, search and confirmation cover all of every text, too.

    Null and empty texts, and an empty or wordless benchmark, give empty arrays. Texts are searched whole,
    whatever their length. Repeated rows get equal arrays. Of an item's places in a text the one of the
    longest subsequence is given, the first of ties. Columns of ``docs`` stay; ``out_col`` must not be
    one of them. A benchmark of more than ``ITEM_CHARS`` characters is searched block by block.
    """
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is a column already")
    found = [leak_column(F.col(text_col), build_index(docs, block, text_col), docs.sparkSession) for block in item_blocks(benchmark, item_id, item_text, answer)]
    return docs.withColumn(out_col, F.concat(*found) if found else F.array().cast(MATCHES))
