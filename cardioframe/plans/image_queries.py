"""Queries of the image operators: the vectors of a label, in order, stand for the columns of an image of 64 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import areas, images
from ..sources import tiff, writers
from .registry import query, table

#: Images of the tables are small, so their tiles are too, that stencils cross some.
SIDE = 32
_PX = "im as (select label, row_number() over (partition by label order by vec_id) - 1 as t, embedding from embeddings where label is not null), px as (select label, t, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as y from im), tw as (select label, count(*) as w from im group by label)"


def _tiles(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").where("label is not null")
    columns = e.select("label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), F.col("embedding").cast("array<double>").alias("col"))
    return images.to_tiles(columns, ["label"], side=SIDE)


def _r(c: str, digits: int = 5):
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


_SMOOTH = f"""with {_PX}, ks as (select unnest(range(-6, 7)) as k), kn as (select k, exp(-0.5 * (k / 1.5::double) ** 2) as g from ks), kw as (select k, g / (select sum(g) from kn) as g from kn),
va as (select a.label, a.t, a.y, sum(g * b.v) as v from px a cross join kw join px b on b.label = a.label and b.t = a.t and b.y = least(greatest(a.y + k, 1), 64) group by all),
vb as (select a.label, a.t, a.y, sum(g * b.v) as v from va a join tw on tw.label = a.label cross join kw join va b on b.label = a.label and b.y = a.y and b.t = least(greatest(a.t + k, 0), w - 1) group by all),
vc as (select label, t, y, v * sin(pi() * (y - 1) / 63) as v from vb),
vd as (select label, t, y, avg(v) over (partition by label, y order by t rows between current row and 3 following) as v from vc),
ve as (select vd.* from vd join tw using (label) where t < w - 3)"""


@query(f"{_SMOOTH} select label, t, y, round(v, 5) + 0.0 as v from ve")
def smoothed_images(spark, d):
    """Blur, weights and rolling mean of images, across tiles."""
    found = images.smoothed(_tiles(spark, d), ["label"], side=SIDE)
    return found.select("label", F.col("t").cast("long").alias("t"), F.posexplode("col").alias("y", "v")).select("label", "t", (F.col("y") + 1).cast("long").alias("y"), _r("v"))


@query(f"""{_SMOOTH}, sh as (select label, t, y, case when max(v) over (partition by label, t) > 0 then v / max(v) over (partition by label, t) else 0 end as v from ve),
sc as (select label, t, y, v - min(v) over (partition by label) as v from sh), ov as (select * from (select *, avg(v) over (partition by label, t) as m from sc) where v > m),
fi as (select label, t, min(y) as up, max(y) - 1 as down from ov group by label, t),
li as (select label, avg(up) - coalesce(stddev_samp(up), 0) as lo, avg(down) + coalesce(stddev_samp(down), 0) as hi from fi group by label),
ed as (select fi.label, fi.t, case when any_value(up) <= any_value(lo) then coalesce(min(y) filter (where y > lo), any_value(up)) else any_value(up) end as up,
  case when any_value(down) >= any_value(hi) then coalesce(max(y - 1) filter (where y - 1 < hi), any_value(down)) else any_value(down) end as down from fi join li using (label) join ov on ov.label = fi.label and ov.t = fi.t group by fi.label, fi.t),
st as (select label, greatest(1, trunc(max(up) - coalesce(stddev_samp(up), 0))) as um, greatest(1, trunc(max(down) - coalesce(stddev_samp(down), 0))) as dm, min(up) as u0, max(up) as u1, min(down) as d0, max(down) as d1 from ed group by label),
br as (select sc.label, sc.t, sum(v) filter (where y <= um) - (max(v) filter (where y = 1) + max(v) filter (where y = um)) / 2 as ub, sum(v) filter (where y >= dm) - (max(v) filter (where y = 64) + max(v) filter (where y = dm)) / 2 as db from sc join st using (label) group by sc.label, sc.t)
select ed.label, ed.t, round(ed.t * 0.01::double, 5) as time, round((down - up) * 0.65::double, 5) + 0.0 as distance, up::bigint as up, down::bigint as down, round(ub, 5) + 0.0 as up_bright, round(db, 5) + 0.0 as down_bright,
round((down - d0) / nullif(d1 - d0, 0), 5) + 0.0 as down_norm, round((up - u0) / nullif(u1 - u0, 0), 5) + 0.0 as up_norm, round((down - d0) / nullif(d1 - d0, 0) - (up - u0) / nullif(u1 - u0, 0), 5) + 0.0 as distance_norm
from ed join st using (label) join br on br.label = ed.label and br.t = ed.t""")
def trace_table(spark, d):
    """The trace stage: from images to edges, calibrated distances, brightness of both halves and normalised columns."""
    tiles = _tiles(spark, d)
    movies = tiles.select("label").distinct().withColumns({"resolution": F.lit(0.65), "time_interval": F.lit(0.01)})
    found = images.trace_images(tiles, movies, ["label"], side=SIDE)
    return found.select("label", F.col("t").cast("long").alias("t"), _r("time"), _r("distance"), F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"), *(_r(c) for c in ("up_bright", "down_bright", "down_norm", "up_norm", "distance_norm")))


@query(f"""with {_PX}, of as (select i, j, sqrt(81 - i * i - j * j) as z from (select unnest(range(-7, 8)) as i) cross join (select unnest(range(-7, 8)) as j) where i * i + j * j <= 81),
lo as (select label, y - i as cy, t - j as cx, min(50 * v - z) as v from px cross join of group by all), hi as (select label, cy + i as y, cx + j as t, max(v + z) as v from lo cross join of group by all)
select px.label, px.t, px.y, round(greatest(50 * px.v - hi.v, 0), 5) + 0.0 as v from px join hi on hi.label = px.label and hi.t = px.t and hi.y = px.y""")
def image_background(spark, d):
    """Images less the surface that a ball of radius 9 rolled under them touches."""
    tiles = _tiles(spark, d).withColumn("pixels", F.transform("pixels", lambda v: 50 * v))
    found = images.to_columns(images.subtract_background(tiles, ["label"], 9, SIDE), ["label"], SIDE)
    return found.select("label", F.col("t").cast("long").alias("t"), F.posexplode("col").alias("y", "v")).select("label", "t", (F.col("y") + 1).cast("long").alias("y"), _r("v"))


_CUT = """with st as (select label as movie, (1 + vec_id % 16)::bigint as x, vec_id // 16 as t, embedding from embeddings where label is not null),
po as (select distinct label as movie, 1 as peak_no, (1 + 3 * label % 16)::bigint as xpos from embeddings where label is not null union all select distinct label, 2, (1 + (5 * label + 7) % 16)::bigint from embeddings where label is not null),
ky as (select st.movie, peak_no, xpos, t, embedding from st join po on po.movie = st.movie and po.xpos = st.x)"""


def _kymographs(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").where("label is not null")
    stack = e.select(F.col("label").alias("movie"), (1 + F.col("vec_id") % 16).alias("x"), F.floor(F.col("vec_id") / 16).alias("t"), F.col("embedding").alias("col"))
    path = writers.shared(spark)
    writers.stack(stack, ["movie"], path)
    label = F.col("movie")
    places = F.array(F.struct(F.lit(1).alias("peak_no"), (1 + 3 * label % 16).cast("long").alias("xpos")), F.struct(F.lit(2).alias("peak_no"), (1 + (5 * label + 7) % 16).cast("long").alias("xpos")))
    positions = e.select(F.col("label").alias("movie")).distinct().select("movie", F.explode(places).alias("p")).select("movie", "p.*")
    return areas.kymographs(spark.read.schema(stack.schema).parquet(path), positions, ["movie"])


@query(f"{_CUT} select movie, peak_no, xpos, t, round(list_sum(list_transform(embedding, lambda v: v::double)), 5) + 0.0 as total, len(embedding) as rows from ky")
def kymograph_cuts(spark, d):
    """Kymographs out of stacks that lie in folders by column; only the folders of chosen columns are read."""
    found = _kymographs(spark, d)
    total = F.aggregate(F.col("col").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return found.select("movie", "peak_no", "xpos", "t", (F.round(total, 5) + F.lit(0.0)).alias("total"), F.size("col").cast("long").alias("rows"))


@query(f"""{_CUT}, nb as (select *, row_number() over (partition by movie, peak_no order by t) - 1 as k from ky)
select movie::varchar || '.cxd_peak_' || peak_no || '_at Xpos_' || xpos || '.tiff' as file, k, y, round(v, 5) + 0.0 as v from (select movie, peak_no, xpos, k, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as y from nb)""")
def kymograph_files(spark, d):
    """Kymographs written as image files, and read again strip by strip."""
    cut = _kymographs(spark, d).select(F.concat(F.col("movie").cast("string"), F.lit(".cxd")).alias("recording"), "peak_no", "xpos", "t", "col")
    folder = writers.shared(spark)
    written = tiff.write_images(cut, folder).agg(F.count("*").alias("n")).first()["n"]
    tiles = tiff.image_tiles(spark, folder, side=SIDE) if written else cut.sparkSession.createDataFrame([], "file string, ty int, tx int, height int, width int, pixels array<double>")
    found = images.to_columns(tiles, ["file"], SIDE)
    return found.select("file", F.col("t").cast("long").alias("k"), F.posexplode("col").alias("y", "v")).select("file", "k", (F.col("y") + 1).cast("long").alias("y"), _r("v"))
