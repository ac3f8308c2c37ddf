"""SimHash near-duplicates by the generalised pigeonhole principle (operator 10)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.buckets import UNIT_LOAD, UNIT_ROWS, bucket_links, unite
from cathodyne.llm.common import column_free_of, connected_components, keep

SEED = 42
BITS = 64
#: Cost of shuffling one signature row, in checks of one candidate pair.
ROW_COST = 30.0
#: Pairs of two longs that are sent to every task at most.
BROADCAST_ROWS = 500_000
#: Most signatures of a bucket whose pairs a join gives.
CROWD = 300
#: Bands of least hashes and the hashes of each: at a similarity of 0.8 one pair in 14,000 shares no band.
BANDS, ROWS = 24, 5
#: Blocks of a connected set of texts that are looked at together; a larger set is looked at bucket by bucket.
MOST_BLOCKS = 8
#: Rows and cells of a tile of pairs.
TILE, CELLS = 512, 1 << 20
#: Bytes of text whose words are held at once.
BLOCK = 1 << 20

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of ``raw`` in blocks, cut at white space."""
    start = 0
    while start < len(raw):
        end = start + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[start:end].split()
        start = end


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, in blocks. Fewer words than ``width`` make one shingle, none make none."""
    digest, carry, some = xxhash.xxh64_intdigest, [], False
    for words in _blocks((text or "").encode("utf-8", "replace").lower()):
        words = carry + words
        if len(words) >= width:
            joined = b" ".join(words)
            gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            starts = np.concatenate(([0], gaps[: len(words) - width] + 1)).tolist()
            ends = np.append(gaps[width - 1 :], len(joined)).tolist()
            yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
            some = True
        carry = words[-(width - 1) :] if width > 1 else []
    if carry and not some:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def _all_hashes(text: str | None, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)])


def fingerprint(text: str | None, width: int) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    counts, n = np.zeros((8, 256), np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += _lanes(hashes)
        n += len(hashes)
    ones = (counts @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 8 bytes of the hashes has each value."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    return np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)


def fingerprint_column(text: Column, width: int) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return F.pandas_udf(of, "long")(text)


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] << np.uint64(1) | np.uint64(1)


def band_keys(different: np.ndarray) -> np.ndarray:
    """A key for each band: texts share it with the probability that ``ROWS`` least hashes of their shingles agree."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(different), 1024):
        np.minimum(least, ((different[at : at + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return np.array([xxhash.xxh32_intdigest(row.tobytes(), SEED) for row in least.reshape(BANDS, ROWS)], np.uint32).view(np.int32)


def shingle_profile(text: Column, width: int) -> Column:
    """Struct of a text's fingerprint ``fp``, number of different shingles ``size``, ``bands`` and ``node``, a digest of fingerprint and shingles."""

    def one(text: str | None) -> tuple[int, int, np.ndarray, int]:
        fp, different = fingerprint(text, width), np.unique(_all_hashes(text, width))
        node = xxhash.xxh64_intdigest(different.tobytes(), fp % (1 << 64))
        return fp, different.size, band_keys(different), _signed(node)

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["fp", "size", "bands", "node"]).astype({"fp": "int64", "size": "int64", "node": "int64"})

    return F.pandas_udf(of, "fp long, size long, bands array<int>, node long")(text)


def bit_statistics(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set. All rows count; 4,096 sums return."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(values)
        at = np.append(np.arange(BITS * BITS), -1)
        yield pd.DataFrame({"at": at, "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = fingerprints.select("fp").mapInPandas(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for row in rows:
        if row.at < 0:
            n = row.n
        else:
            both[row.at] = row.n
    return n, both.reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, correlated bits together."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda j: (corr[j, sorted(left)].sum(), -j))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda j: (corr[j, group].sum(), -j))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _distance_shares(differ: np.ndarray) -> np.ndarray:
    """Share of pairs at each distance, with bits that differ independently."""
    out = np.ones(1)
    for q in differ:
        out = np.convolve(out, [1 - q, q])
    return out


def signature_rows(bits: int, threshold: int) -> int:
    """Rows a fingerprint gives to a part, probe and index together."""
    probe, index = radii(threshold)
    return _ball(bits, probe) + _ball(bits, index) if threshold >= 0 else 0


def radii(threshold: int) -> tuple[int, int]:
    """A part within ``threshold`` bits: balls of these radii around the two values meet."""
    return (threshold + 1) // 2, threshold // 2


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def allocate(n: int, both: np.ndarray, groups: list[list[int]], same: list[float] | None, max_bits: int) -> tuple[float, list[int]]:
    """Thresholds of the parts, -1 for a part that is not probed, and their estimated cost.

    By the general pigeonhole principle any thresholds that add up to ``max_bits - parts + 1`` lose
    no pair. Dynamic programming over the parts picks those of least estimated work: signature rows
    plus candidate pairs. ``same`` has the measured pairs that agree in a whole part.
    """
    p = both.diagonal() / max(n, 1)
    total, most = max_bits - len(groups) + 1, 3
    cost = []
    for i, group in enumerate(groups):
        shares = _distance_shares(2 * p[group] * (1 - p[group]))
        pairs = n * (n - 1) / 2 * np.cumsum(shares)
        if same is not None:
            pairs = np.maximum(pairs, same[i] * (1 + np.arange(len(pairs))))
        by = {-1: 0.0}
        for t in range(min(most, len(group)) + 1):
            by[t] = n * signature_rows(len(group), t) * ROW_COST + pairs[t] * (1 + (t >= 2))
        cost.append(by)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for by in cost:
        following: dict[int, tuple[float, list[int]]] = {}
        for done, (so_far, chosen) in best.items():
            for t, c in by.items():
                if (at := done + t) not in following or so_far + c < following[at][0]:
                    following[at] = (so_far + c, [*chosen, t])
        best = following
    return min((v for k, v in best.items() if k >= total), default=(math.inf, []))


def _mask(group: list[int]) -> int:
    return _signed(sum(1 << j for j in group))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(group: list[int], radius: int) -> list[int]:
    out = [0]
    if radius >= 1:
        out += [1 << j for j in group]
    if radius >= 2:
        out += [1 << j | 1 << k for j in group for k in group if j < k]
    return [_signed(x) for x in out]


def _same_in_part(fingerprints: DataFrame, groups: list[list[int]]) -> list[float]:
    """For each part, how many pairs of fingerprints agree in it."""
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("value")) for i, g in enumerate(groups)])
    counts = fingerprints.select(F.explode(parts).alias("x")).groupBy("x.part", "x.value").count()
    pairs = {r.part: r.pairs for r in counts.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    return [pairs.get(i, 0.0) for i in range(len(groups))]


def hamming_links(fingerprints: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between different values of the long column ``fp``, which holds each value once.

    Their components are those of all pairs that differ in at most ``max_bits`` bits. Bits are grouped by
    their correlation over all values, each group of bits gets its own threshold (``allocate``), and
    values whose balls meet in a group are compared in full: none that should link is lost.
    """
    n, both = bit_statistics(fingerprints)
    plans = []
    for parts in range(2, max_bits + 2):
        groups = partition_bits(n, both, parts)
        plans.append((allocate(n, both, groups, None, max_bits)[0], parts, groups))
    groups = min(plans)[2]
    thresholds = allocate(n, both, groups, _same_in_part(fingerprints, groups), max_bits)[1]
    return probe(fingerprints, groups, thresholds, max_bits)


def probe(fingerprints: DataFrame, groups: list[list[int]], thresholds: list[int], max_bits: int, crowd: int = CROWD) -> DataFrame:
    """The links by given groups of bits and thresholds.

    A bucket of at most ``crowd`` signatures gives its pairs in a join. A larger one, as many near
    copies make it, is linked in blocks, so that it gives a row per member and not per pair.
    """
    parts = []
    for i, (g, t) in enumerate(zip(groups, thresholds)):
        if t >= 0:
            around, own = radii(t)
            flips = [F.struct(F.lit(x).alias("flip"), F.lit((x % (1 << 64)).bit_count() <= own).alias("own")) for x in _flips(g, around)]
            value = F.col("fp").bitwiseAND(F.lit(_mask(g))).bitwiseXOR(F.col("x.flip"))
            parts.append(fingerprints.select("fp", F.explode(F.array(*flips)).alias("x")).select(F.xxhash64(F.lit(i), value).alias("bucket"), F.col("fp").alias("node"), "x.own"))
    rows = reduce(DataFrame.unionByName, parts)
    crowded = keep(rows.groupBy("bucket").count().where(F.col("count") > crowd).select("bucket"), "crowded")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    few = rows.join(crowded, "bucket", "left_anti") if (some := not crowded.isEmpty()) else rows
    pairs = few.select("bucket", F.col("node").alias("a")).join(few.where("own").select("bucket", F.col("node").alias("b")), "bucket")
    pairs = pairs.where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    if not some:
        return pairs
    members = rows.join(crowded, "bucket", "left_semi").select("bucket", "node", F.lit(1).alias("load"))
    return pairs.unionByName(bucket_links(members, lambda unit, root: unite_near(unit["node"].to_numpy(), root, max_bits)))


def unite_near(values: np.ndarray, root: np.ndarray, max_bits: int) -> None:
    """Unites, in ``root``, all values within ``max_bits`` bits of one another."""
    values = values.view(np.uint64)
    for a in range(0, len(values), TILE):
        p, q = np.nonzero(np.bitwise_count(values[a : a + TILE, None] ^ values[None, a:]) <= max_bits)
        unite(root, p + a, q + a)


def unite_alike(sets: list[np.ndarray], root: np.ndarray, similarity: float, buckets: list[np.ndarray] | None = None) -> None:
    """Unites, in ``root``, all sets of hashes with at least that Jaccard similarity, if they share one of their ``buckets``.

    Sets are counted into cells by the low bits of their hashes; the product of two rows of cells is
    at least the size of what they share, so it leaves out pairs exactly. The others are intersected.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    hashes = [np.asarray(sets[k], np.int64) for k in order]
    sizes = sizes[order]

    def cells(a: int, b: int, width: int) -> np.ndarray:
        at = np.concatenate([(h & (width - 1)) + k * width for k, h in enumerate(hashes[a:b])])
        return np.bincount(at, minlength=(b - a) * width).reshape(b - a, width).astype(np.float32)

    def alike(p: int, q: int) -> bool:
        if buckets is not None and not np.isin(buckets[p], buckets[q]).any():
            return False
        a, b = hashes[position[p]], hashes[position[q]]
        common = np.intersect1d(a, b, assume_unique=True).size
        return common >= similarity * (a.size + b.size - common)

    position = np.argsort(order)
    a = 0
    while a < len(sizes):
        width = 1 << max(10, min(20, int(16 * sizes[a]).bit_length()))
        b = min(a + max(1, min(TILE, CELLS // width)), int(np.searchsorted(sizes, 4 * max(1, sizes[a]), "right")))
        left, c = cells(a, b, width), a
        while c < len(sizes) and sizes[c] * similarity <= sizes[b - 1]:
            d = min(len(sizes), c + max(1, min(TILE, CELLS // width)))
            bound = left @ cells(c, d, width).T
            p, q = np.nonzero(bound * (1 + similarity) >= similarity * (sizes[a:b, None] + sizes[None, c:d]) - 1e-3)
            first = np.argsort(-bound[p, q], kind="stable")  # the likeliest first, so that few need the test
            p, q = p[first] + a, q[first] + c
            later = p < q
            unite(root, order[p[later]], order[q[later]], alike)
            c = d
        a = b


def shingle_set(text: Column, width: int) -> Column:
    """Different shingle hashes of a text, as an array."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_all_hashes(t, width)).view(np.int64) for t in texts])

    return F.pandas_udf(of, "array<long>")(text)


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Rows (node, set) of the given (node, text_key, doc_id), from the text of that key and id.

    One document stands for all that have its text, so exact copies do not meet, however many there are.
    """
    # Few keys go to the texts; many meet the texts in a shuffle.
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes.hint("shuffle_hash")
    d, n = docs.alias("d"), nodes.alias("n")
    same = (F.col("d.text_key") == F.col("n.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("n.doc_id"))
    texts = d.join(n, same).select("n.node", "d.text").dropDuplicates(["node"])
    return texts.select("node", shingle_set(F.col("text"), width).alias("set"))


def verified_links(docs: DataFrame, nodes: DataFrame, max_bits: int, width: int, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of that similarity that share a bucket.

    Buckets are the components of fingerprints within ``max_bits`` bits and the bands of least
    hashes. What buckets connect is looked at together, so that a text's shingles travel to one place;
    where that is more than ``MOST_BLOCKS`` blocks hold, each bucket is looked at by itself. Either way
    the pairs that share a bucket are compared, and no others.
    """
    joined = connected_components(hamming_links(keep(nodes.select("fp").distinct(), "values"), max_bits)).withColumnRenamed("id", "fp")
    of_print = nodes.select("fp", "node").join(joined, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("bucket"), "node")
    of_band = nodes.select(F.posexplode("bands").alias("at", "key"), "node").select(F.xxhash64("at", "key").alias("bucket"), "node")
    rows = of_print.unionByName(of_band)
    shared = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "least")
    members = keep(rows.join(shared, "bucket"), "members")
    reach = connected_components(members.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    # A component's smallest node is not among the ids.
    reach = reach.unionByName(reach.select(F.col("component").alias("id"), "component").distinct())
    reach = keep(reach.withColumnRenamed("id", "node").join(nodes.select("node", "text_key", "doc_id", F.col("size").alias("load")), "node"), "reach")
    large = reach.groupBy("component").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    large = keep(large.where((F.col("n") > MOST_BLOCKS * UNIT_ROWS) | (F.col("load") > MOST_BLOCKS * UNIT_LOAD)).select("component"), "large")
    own = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # at most one more than the bands
    sets = keep(shingle_sets(docs, reach.select("node", "text_key", "doc_id"), width).join(own, "node"), "shingles")
    apart = reach.join(large, "component", "left_anti").select(F.col("component").alias("bucket"), "node", "load")
    if not large.isEmpty():
        apart = apart.unionByName(members.join(reach.join(large, "component", "left_semi"), "node").select("bucket", "node", "load"))
    return bucket_links(apart, lambda unit, root: unite_alike(list(unit["set"]), root, similarity, list(unit["buckets"])), payload=sets)


def simhash_groups(docs: DataFrame, max_bits: int = 4, width: int = 4, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its ``fingerprint`` (long) and ``component_id``, the smallest id reachable by links.

    Without a ``similarity`` documents link if their fingerprints differ in at most ``max_bits`` bits.
    With one, they link if their shingles have at least that Jaccard similarity, and fingerprints
    within ``max_bits`` bits are candidates, as are texts that share one of 24 bands of 5 least
    hashes, which miss one pair in 14,000 at a similarity of 0.8. ``text_key`` is a 64-bit hash of the
    text, and ``first`` is true for the row of least id and key of its group, nulls last, and for rows
    that repeat it.

    Null and empty texts, and texts without words, have fingerprint 0 and are linked like any other.
    Fewer words than ``width`` make one shingle. Texts of any length are read whole, in blocks. Repeated
    rows give repeated rows; a null id keeps its row and takes part, but is nobody's component unless a
    group has only null ids. Ties of ids go to the smaller ``text_key``. An empty table gives an empty
    one. Other columns of ``docs``, whatever their names, are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    if similarity is None:
        fp = fingerprint_column(F.col("text"), width)
        marked = keep(docs.select("doc_id", "text_key", fp.alias("fp")).withColumn("node", F.col("fp")), "fingerprints")
        links = hamming_links(keep(marked.select("fp").distinct(), "values"), max_bits)
    else:
        marked = keep(docs.select("doc_id", "text_key", shingle_profile(F.col("text"), width).alias("profile")).select("doc_id", "text_key", "profile.*"), "fingerprints")
        alike = marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "size", "bands")], F.min(F.struct("text_key", "doc_id")).alias("one"))
        alike = alike.select("node", "fp", "size", "bands", "one.text_key", "one.doc_id")
        links = verified_links(docs, keep(alike, "nodes"), max_bits, width, similarity)
    joined = connected_components(links)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    of_node = marked.groupBy("node").agg(F.min(place).alias("least")).join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("least").alias("least"))
    of_node = of_node.select("node", "component").join(least, "component").select("node", "least")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    return marked.join(of_node, "node").select(F.col("doc_id").alias(id_col), F.col("fp").alias("fingerprint"), F.col("least.doc_id").alias("component_id"), "text_key", first.alias("first"))


def drop_near_duplicates(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each group, and of rows that repeat its id and text only one.

    Documents are known by id and text together, so rows that share an id, or have none, are kept and
    dropped by what they say. Columns of ``docs`` stay, whatever their names.
    """
    key, other_id, other_key = (column_free_of(docs, c) for c in ("text_key", "other_id", "other_key"))
    others = groups.where(~F.col("first")).select(F.col(id_col).alias(other_id), F.col("text_key").alias(other_key)).distinct()
    others = keep(others, "others")  # so that its size is known when it meets the texts
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    kept = keyed.join(others, F.col(id_col).eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key)), "left_anti")
    if not groups.groupBy(id_col, "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, key])
    return kept.drop(key)
