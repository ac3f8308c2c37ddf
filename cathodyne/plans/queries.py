"""Registered queries: regions of rasters that Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cathodyne.operators.depth import cell_depths, region_depths
from cathodyne.operators.fields import box_regions, cells_above, level_regions
from cathodyne.operators.outline import region_outlines
from cathodyne.operators.parting import part_areas, part_regions
from cathodyne.operators.regions import cell_runs, classify, label_runs, region_properties, summarise
from cathodyne.operators.tracks import region_tracks
from cathodyne.operators.tree import tree_of
from cathodyne.plans.defects import default_classes, defects_of
from cathodyne.sources.shared import keep, new_path
from cathodyne.streaming.volumes import STRIP_SCHEMA, link_slices, run_strips, volume_regions

#: Columns of a raster, and the least quantity of a lit cell.
WIDTH, LEVEL = 128, 40.0


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lit cells of one frame per return flag and ship year: rows are days of the year, columns parts modulo ``WIDTH``."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_partkey", "l_quantity")
    # The greatest quantity of a cell reaches the level if any does, so the filter goes down to the scan.
    items = items.where(F.col("l_quantity") >= LEVEL)
    cells = items.groupBy(
        F.col("l_returnflag").alias("image_id"), F.year("l_shipdate").alias("z"), F.dayofyear("l_shipdate").alias("y"), (F.col("l_partkey") % WIDTH).cast("int").alias("x")
    ).agg(F.max("l_quantity").alias("value"))
    return cells


def raster_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).groupBy("image_id", "z").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


def raster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_runs(raster(spark, sf_dir))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = raster(spark, sf_dir).withColumn("image_id", F.concat_ws("-", "image_id", "z"))
    return region_properties(label_runs(cell_runs(frames)))


def raster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["image_id", "seed_y", "seed_x", "area", "y0", "y1", "x0", "x1", "centre_y", "centre_x", "mean_value", "fill"]
    return _regions(spark, sf_dir).select(*columns)


def raster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(_regions(spark, sf_dir), "image_id")


def raster_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of a return flag as slices of one volume: regions of two cells or more, corners included, and their classes."""
    return defects_of(cell_runs(raster(spark, sf_dir)), min_area=2, diagonal=True, volume=True)


#: Rows of a raster, and parts in which its slices come.
HEIGHT, ARRIVALS = 367, 3


def raster_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same defects, of years that come one after the other: every third year, then the next ones, and a stream that is taken up again each time."""
    strips = keep(run_strips(cell_runs(raster(spark, sf_dir)), HEIGHT), "strips")
    source, out, checkpoint = (new_path(spark, name) for name in ("arriving", "volumes", "progress"))
    for k in range(ARRIVALS):
        strips.where(F.col("z") % ARRIVALS == k).write.mode("append").parquet(source)
        link_slices(spark.readStream.schema(STRIP_SCHEMA).parquet(source), out, checkpoint, diagonal=True).awaitTermination()
    return classify(volume_regions(spark, out).where(F.col("area") >= 2), default_classes())


#: Rows and columns of a field, days of a row, and the cells around each that its sum takes in.
FIELD_HEIGHT, FIELD_WIDTH, FIELD_DAYS, RADIUS = 61, 32, 6, 2
#: Least sum of a lit cell of a field, steps of a level of the tree, and levels.
FIELD_LIT, FIELD_STEP, FIELD_LEVELS = 9, 2, 9
#: Cells within which a peak is alone, and its least squared depth.
REACH, LEAST_PEAK = 2, 2


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one frame per supplier, a row for each of its items: by days of the year and parts modulo ``FIELD_WIDTH``."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_partkey")
    y = F.floor((F.dayofyear("l_shipdate") - 1) / FIELD_DAYS).cast("int")
    at = [F.col("l_suppkey").cast("string").alias("image_id"), F.lit(0).alias("z"), y.alias("y"), (F.col("l_partkey") % FIELD_WIDTH).cast("int").alias("x")]
    return items.select(*at, F.lit(1).alias("value"))


def _lit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_regions(field(spark, sf_dir), RADIUS, FIELD_HEIGHT, FIELD_WIDTH, FIELD_LIT)


def raster_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the fields above the mean of their neighbourhood."""
    return cells_above(field(spark, sf_dir), RADIUS, FIELD_HEIGHT, FIELD_WIDTH).select("image_id", "y", "x", "value", "box")


def raster_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the smoothed fields, with their deepest cells."""
    return region_depths(cell_depths(_lit_runs(spark, sf_dir))).drop("seed_z", "deep_z")


def raster_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeters and holes of the same regions."""
    return region_outlines(_lit_runs(spark, sf_dir)).drop("z")


def raster_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same regions, parted where they have several deep cells."""
    cells = keep(cell_depths(_lit_runs(spark, sf_dir)), "depths")
    return part_areas(part_regions(cells, REACH, LEAST_PEAK)).drop("z")


def raster_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the smoothed fields' regions over all levels."""
    return tree_of(level_regions(field(spark, sf_dir), RADIUS, FIELD_HEIGHT, FIELD_WIDTH, FIELD_STEP, FIELD_LEVELS))


#: Rows of a yearly field, days of a row, least sum of a lit cell, and the first year.
YEAR_HEIGHT, YEAR_DAYS, YEAR_LIT, FIRST_YEAR = 31, 12, 4, 1992


def raster_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of yearly fields, the years of a supplier being the slices of its volume, followed from year to year."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_partkey")
    y = F.floor((F.dayofyear("l_shipdate") - 1) / YEAR_DAYS).cast("int")
    at = [F.col("l_suppkey").cast("string").alias("image_id"), (F.year("l_shipdate") - FIRST_YEAR).alias("z"), y.alias("y"), (F.col("l_partkey") % FIELD_WIDTH).cast("int").alias("x")]
    return region_tracks(box_regions(items.select(*at, F.lit(1).alias("value")), RADIUS, YEAR_HEIGHT, FIELD_WIDTH, YEAR_LIT))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "raster_threshold": raster_threshold,
    "raster_runs": raster_runs,
    "raster_regions": raster_regions,
    "raster_summary": raster_summary,
    "raster_defects": raster_defects,
    "raster_stream": raster_stream,
    "raster_local": raster_local,
    "raster_depths": raster_depths,
    "raster_outlines": raster_outlines,
    "raster_parts": raster_parts,
    "raster_tree": raster_tree,
    "raster_tracks": raster_tracks,
}

_CELLS = f"""cells as (
  select l_returnflag as image_id, year(l_shipdate)::int as z, dayofyear(l_shipdate)::int as y, (l_partkey % {WIDTH})::int as x, max(l_quantity) as value
  from lineitem group by all having max(l_quantity) >= {LEVEL})"""
_RUNS = """runs as (
  select image_id, z, y, min(x) as x0, max(x) as x1, sum(value) as value
  from (select *, x - row_number() over (partition by image_id, z, y order by x) as run from cells) group by image_id, z, y, run)"""
_REGIONS = """links as (
  select a.image_id, a.z, a.y as ay, a.x0 as ax, b.y as bz, b.x0 as bx
  from runs a join runs b on a.image_id = b.image_id and a.z = b.z and abs(a.y - b.y) = 1 and a.x0 <= b.x1 and b.x0 <= a.x1),
reach as (
  select image_id, z, y, x0, y as ry, x0 as rx from runs
  union
  select r.image_id, r.z, r.y, r.x0, l.bz, l.bx from reach r join links l on l.image_id = r.image_id and l.z = r.z and l.ay = r.ry and l.ax = r.rx),
seeds as (select image_id, z, y, x0, min((ry, rx)) as seed from reach group by all),
regions as (
  select r.image_id || '-' || r.z as image_id, s.seed[1]::int as seed_y, s.seed[2]::int as seed_x, sum(r.x1 - r.x0 + 1)::bigint as area,
         min(r.y) as y0, max(r.y) as y1, min(r.x0) as x0, max(r.x1) as x1,
         sum((r.x1 - r.x0 + 1) * r.y)::double as sum_y, sum((r.x0 + r.x1) * (r.x1 - r.x0 + 1) / 2)::double as sum_x, sum(r.value) as total
  from runs r join seeds s using (image_id, z, y, x0) group by 1, 2, 3)"""

_VOLUMES = """links as (
  select a.image_id, a.z as az, a.y as ay, a.x0 as ax, b.z as bz, b.y as by_, b.x0 as bx
  from runs a join runs b on a.image_id = b.image_id and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1
   and ((a.z = b.z and abs(a.y - b.y) = 1) or (abs(a.z - b.z) = 1 and a.y = b.y))),
reach as (
  select image_id, z, y, x0, z as rz, y as ry, x0 as rx from runs
  union
  select r.image_id, r.z, r.y, r.x0, l.bz, l.by_, l.bx from reach r join links l on l.image_id = r.image_id and l.az = r.rz and l.ay = r.ry and l.ax = r.rx),
seeds as (select image_id, z, y, x0, min((rz, ry, rx)) as seed from reach group by all),
sums as (
  select r.image_id, s.seed[1]::int as seed_z, s.seed[2]::int as seed_y, s.seed[3]::int as seed_x, sum(r.x1 - r.x0 + 1)::bigint as area,
         min(r.z) as z0, max(r.z) as z1, min(r.y) as y0, max(r.y) as y1, min(r.x0) as x0, max(r.x1) as x1,
         sum((r.x1 - r.x0 + 1) * r.y)::double as sum_y, sum((r.x0 + r.x1) * (r.x1 - r.x0 + 1) / 2)::double as sum_x, sum(r.value) as total
  from runs r join seeds s using (image_id, z, y, x0) group by 1, 2, 3, 4),
measured as (
  select *, greatest(y1 - y0, x1 - x0) + 1 as longest, least(y1 - y0, x1 - x0) + 1 as shortest,
         area / ((z1 - z0 + 1) * (y1 - y0 + 1) * (x1 - x0 + 1))::double as fill
  from sums where area >= 2)"""

_FIELD = f"""items as (
  select l_suppkey::varchar as image_id, ((dayofyear(l_shipdate) - 1) // {FIELD_DAYS})::int as y, (l_partkey % {FIELD_WIDTH})::int as x, count(*) as value
  from lineitem group by all),
grid as (select image_id, a.y::int as y, b.x::int as x from (select distinct image_id from items), range({FIELD_HEIGHT}) a(y), range({FIELD_WIDTH}) b(x)),
boxes as (
  select g.image_id, g.y, g.x, coalesce(sum(i.value), 0)::bigint as box, coalesce(sum(i.value) filter (i.y = g.y and i.x = g.x), 0)::bigint as value
  from grid g left join items i on i.image_id = g.image_id and abs(i.y - g.y) <= {RADIUS} and abs(i.x - g.x) <= {RADIUS} group by all)"""
_LIT = f"""lit as (select image_id, y, x, image_id::bigint * 2048 + y * {FIELD_WIDTH} + x as id from boxes where box >= {FIELD_LIT}),
ahead as (
  select a.id as a, b.id as b, 0 as down from lit a join lit b on a.image_id = b.image_id and a.y = b.y and a.x + 1 = b.x
  union all
  select a.id, b.id, 1 from lit a join lit b on a.image_id = b.image_id and a.y + 1 = b.y and a.x = b.x),
links as materialized (select a, b, a as first, down from ahead union all select b, a, a, down from ahead),
labels(id, label) using key (id) as (
  select id, id from lit
  union
  select b, low from (select l.b, min(n.label) as low from labels n join links l on l.a = n.id group by l.b) s join recurring.labels r on r.id = s.b where low < r.label),
unlit as (select image_id, y, x from boxes where box < {FIELD_LIT}),
depths as materialized (
  select any_value(n.label) as label, n.id, any_value(l.image_id) as image_id, any_value(l.y) as y, any_value(l.x) as x,
         least(coalesce(min((l.y - u.y) * (l.y - u.y) + (l.x - u.x) * (l.x - u.x)), 1000000000), any_value(least(l.y + 1, {FIELD_HEIGHT} - l.y)) ** 2, any_value(least(l.x + 1, {FIELD_WIDTH} - l.x)) ** 2)::bigint as depth2
  from labels n join lit l using (id) left join unlit u using (image_id) group by n.id)"""
#: A label or peak as row and column.
_Y, _X = f"(({{0}} % 2048) // {FIELD_WIDTH})::int", f"({{0}} % {FIELD_WIDTH})::int"
_OUTLINES = f"""pairs as (select n.label, count(*) as pairs from ahead e join labels n on n.id = e.a group by n.label),
blocks as (
  select n.label, count(*) as blocks from lit a join lit r on r.image_id = a.image_id and r.y = a.y and r.x = a.x + 1
  join lit d on d.image_id = a.image_id and d.y = a.y + 1 and d.x = a.x join lit c on c.image_id = a.image_id and c.y = a.y + 1 and c.x = a.x + 1
  join labels n on n.id = a.id group by n.label),
outlined as (
  select any_value(l.image_id) as image_id, n.label, count(*) as area, coalesce(any_value(p.pairs), 0) as pairs, coalesce(any_value(b.blocks), 0) as blocks
  from labels n join lit l using (id) left join pairs p on p.label = n.label left join blocks b on b.label = n.label group by n.label)"""
_PARTS = f"""peaks as materialized (
  select p.label, p.id from depths p left join depths o
  on o.label = p.label and abs(o.y - p.y) <= {REACH} and abs(o.x - p.x) <= {REACH} and (o.depth2 > p.depth2 or (o.depth2 = p.depth2 and o.id < p.id))
  where p.depth2 >= {LEAST_PEAK} and o.id is null
  union
  select label, arg_min(id, (-depth2, id)) from depths group by label),
edges as materialized (
  select p.label, l.a, l.b, ((4096 - least(p.depth2, q.depth2)) * 2048 + l.first % 2048) * 2 + l.down as place
  from links l join depths p on p.id = l.a join depths q on q.id = l.b where p.label in (select label from peaks group by label having count(*) > 1)),
flooded(id, label, peak) using key (id) as (
  select id, label, id from peaks
  union
  select arg_min(e.b, e.place), e.label, arg_min(f.peak, e.place)
  from recurring.flooded f join edges e on e.a = f.id anti join recurring.flooded g on g.id = e.b
  group by e.label),
parted as (
  select d.image_id, d.label, d.depth2, coalesce(f.peak, p.id) as peak from depths d left join flooded f using (id)
  left join (select label, min(id) as id from peaks group by label having count(*) = 1) p on p.label = d.label)"""
_TREE = f"""cells as (select image_id, y, x, least(box // {FIELD_STEP}, {FIELD_LEVELS}) as level from boxes),
lit as materialized (
  select image_id, z, y, x, (image_id::bigint * 16 + z) * 2048 + y * {FIELD_WIDTH} + x as id
  from (select image_id, unnest(range(1, level + 1)) as z, y, x from cells where level > 0)),
ahead as (
  select a.id as a, b.id as b from lit a join lit b on a.image_id = b.image_id and a.z = b.z and a.y = b.y and a.x + 1 = b.x
  union all
  select a.id, b.id from lit a join lit b on a.image_id = b.image_id and a.z = b.z and a.y + 1 = b.y and a.x = b.x),
links as materialized (select a, b from ahead union all select b, a from ahead),
labels(id, label) using key (id) as (
  select id, id from lit
  union
  select b, low from (select l.b, min(n.label) as low from labels n join links l on l.a = n.id group by l.b) s join recurring.labels r on r.id = s.b where low < r.label),
sets as (select label, count(*) as area, label // 2048 // 16 as image, (label // 2048) % 16 as z, label % 2048 as c from labels group by label),
nodes as (select image, c, area, max(z)::int as level, min(z)::int as base from sets group by all),
lower_sets as (
  select n.image, n.c, n.area, n.level, n.base, s.c as parent, s.area as parent_area, (s.area - n.area) / n.area as growth
  from nodes n left join labels l on l.id = (n.image * 16 + n.base - 1) * 2048 + n.c left join sets s on s.label = l.label),
children as (select image, parent, parent_area, min(growth) as child_growth, count(*) as n_children from lower_sets where parent is not null group by all)"""
_TRACKS = f"""items as (
  select l_suppkey::bigint as image, year(l_shipdate)::int - {FIRST_YEAR} as z, ((dayofyear(l_shipdate) - 1) // {YEAR_DAYS})::int as y, (l_partkey % {FIELD_WIDTH})::int as x, count(*) as value
  from lineitem group by all),
lit as materialized (
  select image, z, y, x, (image * 64 + z) * 1024 + y * {FIELD_WIDTH} + x as id
  from (select i.image, i.z, i.y + a.d as y, i.x + b.d as x, sum(i.value) as box from items i, range(-{RADIUS}, {RADIUS + 1}) a(d), range(-{RADIUS}, {RADIUS + 1}) b(d) group by all)
  where y between 0 and {YEAR_HEIGHT - 1} and x between 0 and {FIELD_WIDTH - 1} and box >= {YEAR_LIT}),
ahead as (
  select a.id as a, b.id as b from lit a join lit b on a.image = b.image and a.z = b.z and a.y = b.y and a.x + 1 = b.x
  union all
  select a.id, b.id from lit a join lit b on a.image = b.image and a.z = b.z and a.y + 1 = b.y and a.x = b.x),
links as materialized (select a, b from ahead union all select b, a from ahead),
labels(id, label) using key (id) as (
  select id, id from lit
  union
  select b, low from (select l.b, min(n.label) as low from labels n join links l on l.a = n.id group by l.b) s join recurring.labels r on r.id = s.b where low < r.label),
named as materialized (select id, label from labels),
pairs as materialized (select distinct p.label as a, q.label as b from named p join named q on q.id = p.id + 1024 and q.id // 65536 = p.id // 65536),
behind as (select a, count(*) as n_behind from pairs group by a),
before as (select b, count(*) as n_before from pairs group by b),
counted as materialized (select a, b, n_behind, n_before from pairs join behind using (a) join before using (b)),
moves as materialized (select a, b from counted where n_behind = 1 and n_before = 1),
tracks(label, track) using key (label) as (
  select distinct label, label from named
  union
  select m.b, min(t.track) from tracks t join moves m on m.a = t.label group by m.b),
nexts as (select b, any_value(n_before) as n_before, max(n_behind) as siblings from counted group by b)"""

ORACLE_SQL: dict[str, str] = {
    "raster_threshold": f"with {_CELLS} select image_id, z, count(*) as n_cells, sum(value) as total from cells group by all",
    "raster_runs": f"with {_CELLS}, {_RUNS} select image_id, z, y, x0, x1, value from runs",
    "raster_regions": f"""with recursive {_CELLS}, {_RUNS}, {_REGIONS}
        select image_id, seed_y, seed_x, area, y0, y1, x0, x1, sum_y / area as centre_y, sum_x / area as centre_x, total / area as mean_value,
               area / ((y1 - y0 + 1) * (x1 - x0 + 1))::double as fill from regions""",
    "raster_summary": f"""with recursive {_CELLS}, {_RUNS}, {_REGIONS}
        select image_id, count(*) as n_regions, sum(area)::bigint as total_area, max(area) as largest_area, avg(area) as mean_area from regions group by image_id""",
    "raster_defects": f"""with recursive {_CELLS}, {_RUNS}, {_VOLUMES}
        select image_id, seed_z, seed_y, seed_x, area, z0, z1, y0, y1, x0, x1, sum_y / area as centre_y, sum_x / area as centre_x, total / area as mean_value, fill,
               case when longest >= 4 * shortest or (fill < 0.25 and longest >= 8) then 'crack' when fill >= 0.5 then 'pore' else 'other' end as defect
        from measured""",
    "raster_local": f"""with {_FIELD} select image_id, y, x, value, box from boxes
        where value * (least(y + {RADIUS}, {FIELD_HEIGHT - 1}) - greatest(y - {RADIUS}, 0) + 1) * (least(x + {RADIUS}, {FIELD_WIDTH - 1}) - greatest(x - {RADIUS}, 0) + 1) > box""",
    "raster_depths": f"""with recursive {_FIELD}, {_LIT}
        select any_value(image_id) as image_id, {_Y.format("label")} as seed_y, {_X.format("label")} as seed_x, count(*) as area, max(depth2) as depth2,
               arg_min(y, (-depth2, id)) as deep_y, arg_min(x, (-depth2, id)) as deep_x from depths group by label""",
    "raster_outlines": f"""with recursive {_FIELD}, {_LIT}, {_OUTLINES}
        select image_id, {_Y.format("label")} as seed_y, {_X.format("label")} as seed_x, area, (4 * area - 2 * pairs)::bigint as perimeter,
               (area - pairs + blocks)::bigint as euler, (1 - area + pairs - blocks)::bigint as holes from outlined""",
    "raster_parts": f"""with recursive {_FIELD}, {_LIT}, {_PARTS}
        select any_value(image_id) as image_id, {_Y.format("label")} as seed_y, {_X.format("label")} as seed_x, {_Y.format("peak")} as peak_y, {_X.format("peak")} as peak_x,
               max(depth2) as depth2, count(*) as area, count(*) over (partition by label) as n_parts from parted group by label, peak""",
    "raster_tree": f"""with recursive {_FIELD}, {_TREE}
        select a.image::varchar as image_id, a.level, a.base, {_Y.format("a.c")} as seed_y, {_X.format("a.c")} as seed_x, a.area, p.level as parent_level,
               {_Y.format("a.parent")} as parent_y, {_X.format("a.parent")} as parent_x, a.parent_area, a.growth, coalesce(c.n_children, 0) as n_children,
               (a.growth is not null and a.area >= 2 and a.growth <= coalesce(p.growth, a.growth) and a.growth <= coalesce(c.child_growth, a.growth)) as stable
        from lower_sets a left join lower_sets p on p.image = a.image and p.c = a.parent and p.area = a.parent_area
        left join children c on c.image = a.image and c.parent = a.c and c.parent_area = a.area""",
    "raster_tracks": f"""with recursive {_TRACKS}
        select (n.label // 65536)::varchar as image_id, ((n.label // 1024) % 64)::int as z, ((n.label % 1024) // {FIELD_WIDTH})::int as seed_y, (n.label % {FIELD_WIDTH})::int as seed_x, count(*) as area,
               coalesce(any_value(x.n_before), 0) as n_before, coalesce(any_value(h.n_behind), 0) as n_behind,
               case when any_value(x.n_before) is null then 'birth' when any_value(x.n_before) > 1 then 'merge' when any_value(x.siblings) > 1 then 'split' else 'move' end as event,
               any_value(h.n_behind) is null as ends, any_value((t.track // 1024) % 64)::int as track_z, any_value((t.track % 1024) // {FIELD_WIDTH})::int as track_y, any_value(t.track % {FIELD_WIDTH})::int as track_x
        from named n left join nexts x on x.b = n.label left join behind h on h.a = n.label join tracks t on t.label = n.label group by n.label""",
}
# However its slices come, a volume has the same defects.
ORACLE_SQL["raster_stream"] = ORACLE_SQL["raster_defects"]
