"""Mixing sources to target weights (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cathodyne.llm.common import WORD, column_free_of, keep, word_count


def prefix_sums(df: DataFrame, order: Sequence[Column], values: dict[str, str]) -> DataFrame:
    """Adds, for each ``values`` item column: name, the sum of the long column over all rows that come before.

    Rows are dealt out by ranges of ``order`` and sorted there; each range adds up its own rows, and
    one row per range carries the sums on. ``order`` should tell rows apart, as equal rows share a range.
    """
    columns = list(values)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(columns, 0)
        for batch in batches:
            out = [*batch.columns, pa.array([part] * batch.num_rows, pa.int64())]
            for c in columns:
                sums = pc.cumulative_sum(batch.column(c).cast(pa.int64()), start=so_far[c])
                out.append(pc.subtract(sums, batch.column(c).cast(pa.int64())))
                so_far[c] = sums[-1].as_py() if batch.num_rows else so_far[c]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "range_id", *values.values()])

    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.LongType()) for name in ("range_id", *values.values())]])
    ranged = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, schema), "ranges")
    ends = ranged.groupBy("range_id").agg(*[F.max(F.col(b) + F.col(c)).alias(f"range_{b}") for c, b in values.items()])
    earlier = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("range_id", *[F.coalesce(F.sum(f"range_{b}").over(earlier), F.lit(0)).alias(f"range_{b}") for b in values.values()])
    return ranged.join(starts, "range_id").select(*df.columns, *[(F.col(b) + F.col(f"range_{b}")).alias(b) for b in values.values()])


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Targets of sources: rows (source, source_size, source_start, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. All sources together share the size of
    all; a target stops at ``max_epochs`` times its source's size, and what is left over goes to the
    others by weight until none is above. In the order of size over weight the sources that stop come
    first, so one sweep of prefix sums finds the level at which the others meet.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = prefix_sums(sizes.withColumn("one", F.lit(1).cast("long")), by_name, {"one": "rank", "source_size": "source_start"})
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", turn).withColumn("most", F.col("source_size") * max_epochs)
    ranked = prefix_sums(ranked, [(F.col("most") / F.col("weight")).asc(), *by_name], {"most": "most_before", "weight": "weight_before"})
    ranked = keep(ranked, "sources")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total or 0).cast("double") - F.col("most_before")) / (F.lit(weight or 1) - F.col("weight_before"))
    open_ = ranked.select("most_before", (F.col("most") / F.col("weight")).alias("stop"), level.alias("level")).where("stop > level")
    level_of_all = open_.agg(F.min_by("level", F.struct("stop", "most_before"))).first()[0]
    most = F.col("most").cast("double")
    target = most if level_of_all is None else F.least(most, F.lit(level_of_all) * F.col("weight"))
    return ranked.select("source", "source_size", "source_start", target.alias("target"))


def mix_key(seed: str, doc_id: Column, text: Column) -> Column:
    """The hash-random key of a document; only rows that repeat an id and its text share one."""
    text = F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(text)))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """How much of each document a mix by source takes: rows (doc_id, source, key, size, source_size, target, epochs, cut, taken).

    Sizes are words. Each document gets a hash-random key; documents are range-sorted by source and
    key, and distributed prefix sums tell where a source's budget, its target to the nearest word,
    runs out. ``taken`` is ``epochs`` whole passes plus ``cut`` words of the pass that ends early, so
    a source's ``taken`` add up to its budget exactly.

    Null texts have size 0, a null source is a source of its own, null ids and repeated rows count like
    any others, an empty table gives an empty one. Ties of key, which only rows of one id and text
    have, are cut in any order, as they are alike. Long texts count whole. Extra columns are not read.
    """
    key = mix_key(seed, F.col(id_col), F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    sized = keep(sized, "sized")
    targets = keep(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "targets")
    placed = prefix_sums(sized, [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")], {"size": "before"})
    t = targets.withColumnRenamed("source", "target_source")
    joined = placed.join(t, F.col("source").eqNullSafe(F.col("target_source")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as long) div source_size")).otherwise(F.lit(0))
    joined = joined.withColumn("epochs", epochs.cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size") - (F.col("before") - F.col("source_start"))
    joined = joined.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    taken = F.col("epochs") * F.col("size") + F.col("cut")
    return joined.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "key", "size", "source_size", "target", "epochs", "cut", taken.alias("taken"))


def mix_ends(mix: DataFrame, source_col: str = "source") -> DataFrame:
    """Where each source's last pass ends: rows (source, epochs, last_key, last_cut), one per source.

    Documents of a smaller key are taken once more, that of ``last_key`` by ``last_cut`` words, the others not.
    Rows that share the last key share its words evenly.
    """
    by_key = mix.groupBy(F.col(source_col).alias("source"), "key").agg(F.max("epochs").alias("epochs"), F.sum("cut").alias("cut"), F.sum("size").alias("size"), F.count("*").alias("rows"))
    last = F.max(F.when(F.col("cut") > 0, F.struct("key", "cut", "size", "rows")))
    ends = by_key.groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("last"))
    cut = F.when(F.col("last.cut") < F.col("last.size"), F.floor(F.col("last.cut") / F.col("last.rows"))).otherwise(F.lit(-1))
    return ends.select("source", "epochs", F.col("last.key").alias("last_key"), cut.cast("long").alias("last_cut"))


def apply_mix(docs: DataFrame, mix: DataFrame, seed: str = "mix", text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", chars_col: str | None = None) -> DataFrame:
    """The mixed documents themselves: each as often as its source's epochs say, and once more as far as its budget goes.

    A source is decided by its epochs and the key at which its last pass ends, so one row per source
    meets the documents; as long as that table is small, no text is shuffled for it. A whole pass keeps a text as it is; a cut copy has its words
    joined by single spaces, and its length in ``chars_col``. Texts without words are taken once.
    Columns of ``docs`` stay, whatever their names.
    """
    names = {c: column_free_of(docs, c) for c in ("mix_source", "mix_epochs", "mix_last", "mix_cut", "mix_part", "mix_key")}
    # Kept, so that its size is known: a small table goes to the documents, which then stay where they are.
    ends = keep(mix_ends(mix, source_col), "ends").toDF(*[names[c] for c in ("mix_source", "mix_epochs", "mix_last", "mix_cut")])
    source, epochs, last, cut, part, key = (F.col(n) for n in names.values())
    # The key is worked out before the join, as it hashes the text.
    keyed = docs.withColumn(names["mix_key"], mix_key(seed, F.col(id_col), F.col(text_col)))
    placed = keyed.join(ends, F.col(source_col).eqNullSafe(source))
    whole = epochs + F.when(last.isNotNull() & ((key < last) | ((key == last) & (cut < 0))), 1).otherwise(0)
    none = ~F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    copies = F.array_repeat(F.lit(-1).cast("long"), F.when(none, 1).otherwise(whole).cast("int"))
    parts = F.when((key == last) & (cut > 0) & ~none, F.concat(copies, F.array(cut))).otherwise(copies)
    taken = placed.withColumn(names["mix_part"], F.explode(parts))
    found = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    cut_text = F.array_join(F.slice(found, F.lit(1), F.greatest(part, F.lit(1)).cast("int")), " ")
    taken = taken.withColumn(text_col, F.when(part < 0, F.col(text_col)).otherwise(cut_text))
    if chars_col:
        taken = taken.withColumn(chars_col, F.when(part < 0, F.col(chars_col)).otherwise(F.length(text_col)))
    return taken.select(*docs.columns)


#: The same rows in DuckDB's SQL.
MIX_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as key
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, 3 * source_size as most,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sources),
swept as (
  select *, most / weight as stop,
         (sum(source_size) over () - coalesce(sum(most) over w, 0))::double / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as level
  from weighed window w as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size,
         least(most::double, coalesce((select level from swept where stop > level order by stop, source nulls last limit 1) * weight, most::double)) as target
  from swept),
placed as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when source_size = 0 then 0 else (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) end::bigint as taken
from placed
"""
