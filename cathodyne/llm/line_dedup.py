"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only (operator 9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.common import bucketed, connected_components, discard, keep, let


#: Different lines that share a segment as they are; where more do, they must share a segment of the rest too.
CROWD = 500
#: What is cut off the ends of a line.
BLANKS = " \t\r\x0b\x0c"
#: Letters whose numbers tell lines apart before they are compared.
LETTERS = "etaoinshrdlucmgp"


def _segment(length: Column, i: Column, tau: Column) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i`` (from 1) of ``tau + 1`` even ones; the last ones take the remainder."""
    base, longer = F.floor(length / (tau + 1)).cast("int"), length % (tau + 1)
    ahead = F.greatest(F.lit(0), i + longer - (tau + 2))  # longer segments before this one
    return base * (i - 1) + ahead + 1, base + F.when(i + longer >= tau + 2, 1).otherwise(0)


def positions(tau: int, own: bool) -> list[tuple[int, int, int]]:
    """What a line looks up, as (less, segment, shift): segment ``segment`` of a line that is ``less`` shorter, moved by ``shift``.

    Its ``own`` segments are the index. As a probe a line looks for segments of lines of its length and
    down to ``tau`` less. The shift is bounded from both sides (edits before the segment, and edits
    behind it given the difference of lengths), so that few substrings are left: 12 for two edits.
    """
    if own:
        return [(0, i, 0) for i in range(1, tau + 2)]
    out = []
    for less in range(tau + 1):
        for i in range(1, tau + 2):
            out += [(less, i, s) for s in range(max(1 - i, less - (tau + 1 - i)), min(i - 1, less + tau + 1 - i) + 1)]
    return out


def letter_bag(line: Column) -> Column:
    """How often each of 16 letters occurs, modulo 16, four bits each."""
    counts = [(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).cast("long") for c in LETTERS]
    return sum((F.shiftleft(c.bitwiseAND(F.lit(15)), 4 * k) for k, c in enumerate(counts[1:], 1)), counts[0].bitwiseAND(F.lit(15)))


def bag_distance(a: Column, b: Column) -> Column:
    """Least sum of differences between the counts of two bags: an edit changes it by two at most."""

    def apart(k: int) -> Column:
        d = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)))
        return F.least(d, F.lit(16) - d)

    return sum((apart(k) for k in range(1, 16)), apart(0))


def by_length(tau: int | Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Edits by length, (from, to, tau), of one ``tau`` for all or of (least characters, tau) steps; a pair goes by its shorter line."""
    steps = [(1, tau)] if isinstance(tau, int) else sorted(tau)
    return [(least, after - 1, t) for (least, t), (after, _) in zip(steps, [*steps[1:], (1 << 31, 0)])]


def segments(lines: DataFrame, steps: list[tuple[int, int, int]], own: bool) -> DataFrame:
    """Rows (key, h, line, n, whole, start, size, and what else there is) of lines (key, h, line, n, whole): hashes of substrings.

    ``whole`` is the length that the steps go by, which is that of the line; ``n`` may be that of what is left of it. A key
    holds the key before it, the lengths and the segment that the substring is for. Lines are read once for all steps.
    """
    reach = [(least, most + (0 if own else tau)) for least, most, tau in steps]
    at = F.lit(None)
    for low in sorted({least for least, _ in reach} | {most + 1 for _, most in reach}):
        found = [(*step, *position) for step, (least, most) in zip(steps, reach) if least <= low <= most for position in positions(step[2], own)]
        names = ("least", "most", "tau", "less", "i", "shift")
        some = F.array(*[F.struct(*[F.lit(x).alias(name) for name, x in zip(names, row)]) for row in found]) if found else F.lit(None)
        at = F.when(F.col("whole") >= low, some).otherwise(at)
    rows = lines.withColumn("p", F.explode(at))
    length = F.col("n") - F.col("p.less")
    start, size = _segment(length, F.col("p.i"), F.col("p.tau"))
    rows = rows.select("*", length.alias("length"), (start + F.col("p.shift")).alias("start"), size.alias("size"), (F.col("whole") - F.col("p.less")).alias("shorter"))
    rows = rows.where(F.col("shorter").between(F.col("p.least"), F.col("p.most")) & (F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
    key = F.xxhash64("key", F.substring("line", F.col("start"), F.col("size")), "length", "p.i", "p.tau")
    return rows.withColumn("key", key).drop("p", "length", "shorter")


def _rest(rows: DataFrame) -> DataFrame:
    """Lines without the segment of their key: what two lines share stands apart, and the rest is within the same edits."""
    line = F.concat(F.substring("line", F.lit(1), F.col("start") - 1), F.substring("line", F.col("start") + F.col("size"), F.col("n")))
    return rows.select("key", "h", line.alias("line"), (F.col("n") - F.col("size")).alias("n"), "whole")


def _common(a: Column, b: Column, limit: Column, part: Callable[[Column, Column], Column]) -> Column:
    """Length of the longest common prefix or suffix, by halving; 31 halvings suffice for any string."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(limit + 1)).cast("int") + 1)
    zero = F.struct(F.lit(0).alias("lo"), limit.cast("int").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        return let(mid, lambda m: F.when(part(a, m) == part(b, m), F.struct(m.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), F.greatest(m - 1, acc["lo"]).alias("hi"))))

    return F.when(limit <= 0, F.lit(0)).otherwise(F.aggregate(steps, zero, halve)["lo"])


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``tau``; anything above ``tau`` if it is above.

    A band of 2 tau + 1 rows around the diagonal slides along as one bit vector: the vertical
    differences of a column are two words, and a column takes a handful of word operations.
    """
    chars = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("m"), F.length(b).alias("n"))
    return let(chars, lambda c: F.when(c["n"] == 0, c["m"]).when(c["m"] == 0, c["n"]).otherwise(_slide(c, tau)))


def _slide(c: Column, tau: int) -> Column:
    width = 2 * tau + 1
    full = F.lit((1 << width) - 1)
    m = c["m"]

    def matches(j: Column) -> Column:
        """The rows of the band in column ``j`` whose characters are the same, as bits."""
        mine = F.get(c["b"], j - 1)
        bits = [F.when(F.coalesce(F.get(c["a"], j - tau + d - 1) == mine, F.lit(False)), 1 << d).otherwise(0) for d in range(width)]
        return sum(bits[1:], bits[0]).cast("long")

    def column(acc: Column, j: Column) -> Column:
        vp, vn = acc["vp"], acc["vn"]

        def rest(d: Column) -> Column:
            hp = vn.bitwiseOR(d.bitwiseOR(vp).bitwiseXOR(full))
            hn, down = d.bitwiseAND(vp), F.shiftright(d, 1)
            last_row = F.element_at(F.array(*[F.lit(1 << k) for k in range(width)]), F.greatest(m - j + tau, F.lit(0)) % width + 1).cast("long")
            along = F.when(hp.bitwiseAND(last_row) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(last_row) != 0, 1).otherwise(0)
            move = F.when(j + tau <= m, F.when(d.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)).otherwise(along)
            return F.struct(hn.bitwiseOR(down.bitwiseOR(hp).bitwiseXOR(full)).alias("vp"), down.bitwiseAND(hp).alias("vn"), (acc["cur"] + move).alias("cur"))

        d0 = let(matches(j), lambda x: (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full))
        return let(d0, rest)

    start = F.struct(F.lit(((1 << (tau + 1)) - 1) << tau).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(tau), m).cast("int").alias("cur"))
    return F.aggregate(F.sequence(F.lit(1), c["n"]), start, column)["cur"]


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether two strings are within ``tau`` edits; what they share at either end is set aside first."""

    def core(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        prefix = _common(x, y, F.least(F.length(x), F.length(y)), lambda s, k: F.substring(s, F.lit(1), k))

        def behind(p: Column) -> Column:
            u, v = F.substring(x, p + 1, F.length(x)), F.substring(y, p + 1, F.length(y))

            def trimmed(q: Column) -> Column:
                s, t = q["u"], q["v"]
                limit = F.least(F.length(s), F.length(t))
                suffix = _common(s, t, limit, lambda z, k: F.substring(z, F.length(z) - k + 1, k))
                return let(suffix, lambda k: banded_distance(F.substring(s, F.lit(1), F.length(s) - k), F.substring(t, F.lit(1), F.length(t) - k), tau))

            return let(F.struct(u.alias("u"), v.alias("v")), trimmed)

        return let(prefix, behind)

    return (F.abs(F.length(a) - F.length(b)) <= tau) & (let(F.struct(a.alias("x"), b.alias("y")), core) <= tau)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text_key, line_no, line, h): lines between line feeds, without ASCII white space at the ends, and their 64-bit hash."""
    # A text is hashed before it is split, once and not for each line; few lines have blanks at their ends.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    exploded = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    blank = reduce(Column.__or__, [at("line", F.lit(c)) for c in BLANKS for at in (F.startswith, F.endswith)])
    line = F.when(blank, F.trim("line", F.lit(BLANKS))).otherwise(F.col("line"))
    return exploded.select("doc_id", "text_key", "line_no", line.alias("line")).withColumn("h", F.xxhash64("line"))


def line_links(distinct_lines: DataFrame, tau: int | Sequence[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b), a < b, of hashes of different lines within ``tau`` edits; ``distinct_lines`` has (h, line, n), a row per line.

    With steps for ``tau`` a pair is within the edits of its shorter line. Lines that share a segment but differ by a
    word would meet in great numbers where a text has many variants. A segment that more than ``CROWD`` lines have is no
    key by itself: what is left of its lines is within the same edits, so those that link share a segment
    of the rest as well, and both make the key, and so on while a rest is long enough. Most lines share no key
    with another. Those that do are found by keys and hashes alone; only their letters are counted, and
    the join of these lines leaves out pairs whose letters differ too much.
    """
    steps = by_length(tau)
    most = max(t for *_, t in steps)
    spark = distinct_lines.sparkSession
    parts = 4 * spark.sparkContext.defaultParallelism

    def keyed(lines: DataFrame, own: bool) -> DataFrame:
        rows = lines.select(F.lit(0).cast("long").alias("key"), "h", "line", "n", F.col("n").alias("whole"))
        return segments(rows, steps, own)

    level = {own: keyed(distinct_lines, own) for own in (False, True)}
    # The index is counted and joined, so it is dealt out once; a part of it makes one file.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = counted = bucketed(level[True].select("key", "h", "n").repartition(buckets, "key"), "key")
    crowds, deeper = [], []
    while True:
        crowded = counted.groupBy("key").agg(F.count("*").alias("rows"), F.min("n").alias("n"))
        crowded = keep(crowded.where((F.col("rows") > CROWD) & (F.col("n") > 3 * most)).select("key"), "crowded")
        if crowded.isEmpty():
            break
        crowds.append(crowded)
        level = {own: keep(segments(_rest(rows.join(crowded, "key", "left_semi")), steps, own), "segments") for own, rows in level.items()}
        deeper.append(level)
        counted = level[True]

    def plain(first: DataFrame, own: bool) -> list[DataFrame]:
        """Rows with keys that are not crowded: of the ``first`` ones, and of what stands behind the crowded ones, level by level."""
        rows = [first, *(level[own] for level in deeper)]
        return [x.join(crowded, "key", "left_anti") for x, crowded in zip(rows, crowds)] + rows[len(crowds) :]

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("key", F.col("h").alias(name), *[F.col("bag").alias(f"bag_{name}") for c in rows.columns if c == "bag"])

    def meet(probe: list[DataFrame], index: list[DataFrame]) -> DataFrame:
        both = [named(p, "p").join(named(i, "i"), "key").where("p != i") for p, i in zip(probe, index)]
        return reduce(DataFrame.unionByName, both)

    def shared(probe: DataFrame, index: DataFrame) -> DataFrame:
        """Lines that meet another at a key, a row per probe at most: a line probes at its own keys, so of several in the index each is found by itself."""
        ends = index.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        return probe.join(ends, "key").where("h != low or h != high").select(F.explode(F.array("h", "low")).alias("h"))

    sharing = reduce(DataFrame.unionByName, map(shared, plain(keyed(distinct_lines, False), False), plain(index, True))).distinct()
    texts = keep(distinct_lines.join(sharing, "h", "left_semi").select("h", "line", "n", letter_bag(F.col("line")).alias("bag")), "texts")
    discard(index)
    bags = texts.select("h", "bag")
    probe, index = ([rows.select("key", "h").join(bags, "h") for rows in plain(keyed(texts, own), own)] for own in (False, True))
    alike = meet(probe, index).where(bag_distance(F.col("bag_p"), F.col("bag_i")) <= 2 * most)
    meeting = alike.select(F.least("p", "i").alias("a"), F.greatest("p", "i").alias("b")).distinct()
    pairs = keep(meeting, "pairs")
    # The test takes long for a row's size, so its rows are dealt out by number and not by bytes.
    a, b = (texts.select(F.col("h").alias(x), F.col("line").alias(f"line_{x}")).repartition(parts, x) for x in "ab")
    both = pairs.repartition(parts, "a").join(a, "a").repartition(parts, "b").join(b, "b")
    shorter = F.least(F.length("line_a"), F.length("line_b"))
    near = reduce(lambda out, step: F.when(shorter >= step[0], within(F.col("line_a"), F.col("line_b"), step[2])).otherwise(out), steps, F.lit(False))
    return both.where(near).select("a", "b")


def line_classes(docs: DataFrame, tau: int | Sequence[tuple[int, int]] = 2, min_chars: int = 32, exact_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of each document: (id, line_no, n_chars, class_id, n_links, kept).

    Lines of at least ``min_chars`` characters link if they are within ``tau`` edits, or within those of the shorter line
    where ``tau`` has (least characters, edits) steps; a class is what
    links connect, and its first line by id and place is ``kept``. ``n_links`` counts the different
    lines linked directly. Of shorter lines, those of at least ``exact_chars`` characters are in a class
    with their exact repeats only; the rest, all shorter ones by default, are kept, in no class. Lines are
    known by a 64-bit hash; of a billion different lines, about one pair in 37 such corpora shares one.

    A null text has no lines, an empty text one empty line. Null ids sort first. Rows that share an id, or have none, are
    told apart by a 64-bit hash of their texts, the smaller first. Rows that repeat an
    id and its text count as one place, so all of them are kept or none; of other ties the place that
    sorts first is kept. Lines of any length are read and compared whole. An empty table gives an empty
    one. Other columns are not read.
    """
    if any(max(low, min_chars) <= 2 * edits for low, _, edits in by_length(tau)):
        raise ValueError("lines must have more than 2 tau characters, so that segments hold something")
    least = min_chars if exact_chars is None else min(exact_chars, min_chars)
    lines = lines_of(docs, id_col, text_col)
    classed = lines.where(F.length("line") >= least)
    place = F.struct("doc_id", "line_no", "text_key")
    known = classed.groupBy("h").agg(F.first("line").alias("line"), F.min(place).alias("first"), F.count("*").alias("rows"))
    known = table = bucketed(known.withColumn("n", F.length("line")), "h")
    links = keep(line_links(known.where(F.col("n") >= min_chars).select("h", "line", "n"), tau), "line-links")
    degrees = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("n_links"))
    classes = connected_components(links).withColumnRenamed("id", "h")
    marked = known.select("h", "first", "rows").join(degrees, "h", "left").join(classes, "h", "left").withColumn("class_id", F.coalesce("component", "h"))
    marked = keep(marked.where("rows > 1 or n_links > 0").select("h", "first", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "marked")
    discard(table)
    firsts = marked.groupBy("class_id").agg(F.min("first").alias("class_first"))
    marked = marked.join(firsts, "class_id").select("h", "class_id", "n_links", "class_first")
    narrow = lines.select("doc_id", "text_key", "line_no", F.length("line").alias("n_chars"), F.when(F.length("line") >= least, F.col("h")).alias("h"))
    placed = narrow.join(marked, "h", "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("class_first.doc_id")) & (F.col("line_no") == F.col("class_first.line_no")) & (F.col("text_key") == F.col("class_first.text_key"))
    return placed.select(
        F.col("doc_id").alias(id_col), "line_no", "n_chars", F.coalesce("class_id", "h").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("class_id").isNull() | is_first).alias("kept")
    )
