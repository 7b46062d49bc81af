"""Queries of the relational stages: joins, groupings, names, dates and result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, naming, order, stats
from ..operators import joins, signal, tables
from ..sources import readers
from .registry import query, table


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


@query("select p_partkey, p_brand, dense_rank() over (order by p_brand)::bigint as ordinal from part")
def label_ordinal(spark, d):
    part = table(spark, d, "part")
    # the ordinal is numbered over the different labels only, so no task sorts all rows
    labels = part.select("p_brand").distinct().withColumn("ordinal", F.dense_rank().over(Window.orderBy("p_brand")).cast("long"))
    return part.select("p_partkey", "p_brand").join(labels, "p_brand")


@query("select l_returnflag, round(median(l_quantity), 6) as l_quantity_median, round(stddev_samp(l_quantity), 6) as l_quantity_sd, round(median(l_extendedprice), 6) as l_extendedprice_median, round(stddev_samp(l_extendedprice), 4) as l_extendedprice_sd from lineitem group by l_returnflag")
def median_sd_all(spark, d):
    found = stats.median_and_sd(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    return found.select("l_returnflag", *(_r(F.col(c), c, 4 if c == "l_extendedprice_sd" else 6) for c in found.columns[1:]))


@query("""with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.1) as d1, quantile_cont(l_extendedprice, 0.75) as q3, quantile_cont(l_quantity, 0.5) as m from lineitem group by l_returnflag),
v as (select l_returnflag, median(abs(l_extendedprice - mid)) * 1.4826::double as mad from (select *, median(l_extendedprice) over (partition by l_returnflag) as mid from lineitem) group by l_returnflag)
select l_returnflag, round(d1, 4) as d1, round(q3, 4) as q3, round(m, 4) as m, round(mad, 4) as mad from q join v using (l_returnflag)""")
def order_statistics(spark, d):
    """Quantiles and deviations of three large groups, of which no task brings more than 5,000 values together."""
    items = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    found = order.quantiles(items, ["l_returnflag"], {"d1": ("l_extendedprice", 0.1), "q3": ("l_extendedprice", 0.75), "m": ("l_quantity", 0.5)}, 5000)
    spread = stats.mad(items, ["l_returnflag"], ["l_extendedprice"], "", 5000).withColumnRenamed("l_extendedprice", "mad")
    return found.join(spread, "l_returnflag").select("l_returnflag", *(_r(F.col(c), c, 4) for c in ("d1", "q3", "m", "mad")))


@query("""select l_linestatus, count_if(l_returnflag = 'A')::bigint as "A", count_if(l_returnflag = 'N')::bigint as "N", count_if(l_returnflag = 'R')::bigint as "R" from lineitem group by l_linestatus""")
def contingency(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(*(F.count_if(F.col("l_returnflag") == f).alias(f) for f in "ANR"))


@query("with c as (select c_nationkey, c_custkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) as k from customer) select n_nationkey, n_name, c_custkey, c_name from nation left join c on c.c_nationkey = n_nationkey and k = 1")
def lookup_first_match(spark, d):
    dim = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_name")
    return joins.lookup(table(spark, d, "nation").select("n_nationkey", "n_name"), dim, "n_nationkey", ["c_custkey"])


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def unfinished_inputs(spark, d):
    """Documents that no label is finished for."""
    return joins.unfinished(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def semi_members(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.members(table(spark, d, "customer").select("c_custkey", "c_name"), big, "c_custkey")


@query("""with q as (select o_orderkey, o_custkey, case when o_orderstatus = 'F' then 'excellent' when o_orderstatus = 'O' then 'good' else 'n.t.' end as quality from orders)
select o_orderkey, o_custkey from q where quality = 'good' and o_custkey not in (select o_custkey from q where quality = 'excellent')""")
def rescued_traces(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "excellent").when(F.col("o_orderstatus") == "O", "good").otherwise("n.t.").alias("quality"))
    return joins.rescue(o, "quality", "o_custkey").select("o_orderkey", "o_custkey")


@query("select quality, d.doc_id, lang, source from labels l right join documents d on l.doc_id = d.doc_id")
def right_join_keep(spark, d):
    """All documents, with their labels where they have any."""
    l, docs = table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang", "source")
    return l.join(docs, "doc_id", "right").select("quality", "doc_id", "lang", "source")


@query("select vec_id, label, quality, toxic from embeddings left join labels on vec_id = doc_id")
def left_meta(spark, d):
    """All vectors, beside the labels of the document of the same number where there are any."""
    e, l = table(spark, d, "embeddings").select("vec_id", "label"), table(spark, d, "labels")
    return e.join(l, F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", "label", "quality", "toxic")


@query("""with per as (select l_orderkey, median(l_quantity) as q, median(l_extendedprice) as p from lineitem group by l_orderkey), rec as (select o_custkey, o_orderpriority, q, p from orders join per on l_orderkey = o_orderkey),
fly as (select o_custkey, round(median(q), 6) as q, round(median(p), 4) as p from rec group by o_custkey) select distinct fly.o_custkey, fly.q, fly.p, rec.o_orderpriority from fly join rec using (o_custkey)""")
def per_recording_to_per_fly(spark, d):
    rec = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.median("l_quantity").alias("q"), F.median("l_extendedprice").alias("p"))
    rec = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(rec, "o_orderkey")
    return tables.per_fly(rec, "o_custkey", ["q", "p"], ["o_orderpriority"]).select("o_custkey", _r(F.col("q"), "q"), _r(F.col("p"), "p", 4), "o_orderpriority")


@query("select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as price, round(stddev_samp(o_totalprice), 4) as sdprice from orders group by o_orderpriority")
def master_table(spark, d):
    found = tables.master_table(table(spark, d, "orders").withColumnRenamed("o_totalprice", "price"), "o_orderpriority", ["price"])
    return found.select("o_orderpriority", "n", _r(F.col("price"), "price", 4), _r(F.col("SDprice"), "sdprice", 4))


@query("select event_id, user_id, value from events where event_type = 'click' union all select event_id, user_id, value from events where event_type = 'view'")
def union_chunks(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    part = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    return part("click").unionByName(part("view"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1")
def distinct_first(spark, d):
    return joins.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select distinct event_type, user_id from events")
def whole_row_distinct(spark, d):
    return table(spark, d, "events").select("event_type", "user_id").distinct()


@query("select l_orderkey, l_linenumber, 'l_quantity' as \"L1\", l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem")
def melt_measures(spark, d):
    return tables.melt(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("select user_id, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'view' then value end) as \"view\", max(case when event_type = 'error' then value end) as error from events group by user_id")
def kv_pivot(spark, d):
    return tables.pivot_kv(table(spark, d, "events"), "user_id", "event_type", "value", ("click", "view", "error"))


@query("select user_id, list_sort(list(event_id)) [1] as first_id, count(*) as n from events group by user_id")
def group_to_list(spark, d):
    lists = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return lists.select("user_id", F.col("ids")[0].alias("first_id"), F.size("ids").cast("long").alias("n"))


_NAME = "'G' || o_custkey % 50 || '_' || o_orderkey || '_' || (o_orderkey % 5 + 1) || 'w' || case when o_orderkey % 2 = 0 then 'm' else 'f' end || '_10x_r1_' || case when o_orderkey % 3 = 0 then 'note' else '' end || '.cxd_peak_' || (o_orderkey % 4) || '_at Xpos_' || (o_orderkey % 700) || '.tiff_traced.jpg'"


@query(f"""with f as (select o_orderkey, {_NAME} as name from orders) select o_orderkey, split_part(name, '_', 1) as code, split_part(name, '_', 2)::int as id, substr(split_part(name, '_', 3), 1, 1) as age, right(split_part(name, '_', 3), 1) as sex,
coalesce(nullif(split_part(split_part(name, '_', 6), '.', 1), ''), 'none') as comment, regexp_extract(name, '^([^_]*_.*?w[fm])_', 1) as fly, regexp_extract(name, 'Xpos_([0-9]+)[.]tiff', 1)::int as xpos, regexp_extract(name, '^(.*?[.]cxd)', 1) as movie,
regexp_replace(name, 'peak_[0-9]+_at', 'peak_X_at') as masked, replace(name, '_traced.jpg', '.csv') as trace from f""")
def parse_names(spark, d):
    n = table(spark, d, "orders").select("o_orderkey", F.expr(_NAME).alias("name"))
    c = F.col("name")
    return n.select(
        "o_orderkey", naming.code(c).alias("code"), naming.number(c).alias("id"), naming.age(c).alias("age"), naming.sex(c).alias("sex"), naming.comment(c).alias("comment"), naming.fly_id(c).alias("fly"),
        naming.xpos(c).alias("xpos"), naming.movie(c).alias("movie"), naming.masked_peak(c).alias("masked"), naming.trace_file(c).alias("trace"),
    )


@query("select o_orderkey, strftime(to_timestamp(epoch(o_orderdate)::bigint + 11644444800 - 11644444800), '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%U') as week_year from orders")
def epoch_dates_week(spark, d):
    camera = F.unix_timestamp("o_orderdate") + dates.CAMERA_EPOCH
    day = dates.day(dates.unix_seconds(camera))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), dates.year_week(day).alias("week_year"))


@query("select l_orderkey, l_linenumber, round(pi() / 4 * (l_quantity * l_quantity - l_tax * l_tax), 6) as sv, round(pi() / 4 * (l_quantity * l_quantity - l_tax * l_tax) * l_discount, 6) as co, round((l_quantity - l_tax) / nullif(l_quantity, 0), 6) as fs from lineitem")
def stroke_volume(spark, d):
    df = tables.heart_output(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("EDD"), F.col("l_tax").alias("ESD"), F.col("l_discount").alias("HR")))
    return df.select("l_orderkey", "l_linenumber", _r(F.col("SV"), "sv"), _r(F.col("CO"), "co"), _r(stats.fractional_shortening(F.col("EDD"), F.col("ESD")), "fs"))


@query("with m as (select floor(avg(distinct p_size)) as mid from part) select p_partkey, case when p_size > mid then 'posterior' else 'anterior' end as segment from part, m")
def mean_distinct_segment(spark, d):
    return tables.segment(table(spark, d, "part"), "p_size").select("p_partkey", "segment")


@query("select o_orderkey, o_totalprice from orders where o_totalprice * 1000 >= 150000000 and o_orderkey % 1000 >= 200 and (o_orderkey % 20) / 1000.0::double <= 0.010")
def filtered_scan(spark, d):
    """Movies that are large, long and fast enough; orders stand for movies."""
    movies = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 1000).alias("size"), (F.col("o_orderkey") % 1000).cast("string").alias("sizeT"), (F.col("o_orderkey") % 20 / 1000).cast("string").alias("time_interval"))
    return tables.usable_movies(movies).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, round(case when l_linenumber = 1 then 0.65 else l_linenumber end * coalesce(nullif(l_tax, 0), 1), 6) as resolution from lineitem")
def scale_rules(spark, d):
    tax = F.nullif(F.col("l_tax"), F.lit(0.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(tables.scale_factor(F.col("l_linenumber").cast("double"), tax), "resolution"))


@query("select l_suppkey, l_linestatus, round(sqrt(avg(pow(l_quantity - l_extendedprice / 1000, 2))), 6) as rmse from lineitem group by l_suppkey, l_linestatus")
def rmse_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(_r(stats.rmse(F.col("l_quantity"), F.col("l_extendedprice") / 1000), "rmse"))


@query("select label, count(*) as n, round(avg(list_sum(embedding)), 4) as mean_sum, round(max(list_max(embedding)), 5) as top from embeddings group by label")
def array_profile(spark, d):
    """Row sums and maxima of arrays, as image columns are stored."""
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return e.groupBy("label").agg(F.count("*").alias("n"), _r(F.avg(F.aggregate("v", F.lit(0.0), lambda a, v: a + v)), "mean_sum", 4), _r(F.max(F.array_max("v")), "top", 5))


@query("""select i as place, label, round(stddev_samp(v::double), 5) as sd from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by i, label""")
def pixel_sd(spark, d):
    """How much each place of an array varies over its rows."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    pixels = e.select("label", F.lit(1).alias("x"), (F.col("i") + 1).cast("long").alias("y"), F.col("v").cast("double").alias("v"))
    return signal.pixel_sd(pixels, ["label"]).select(F.col("y").alias("place"), "label", _r(F.col("sd"), "sd", 5))


@query(f"""with f as (select o_orderkey, {_NAME} as name, o_orderdate as d from orders) select o_orderkey, split_part(name, '_', 1) || '_' || split_part(name, '_', 2) || '_' || split_part(name, '_', 3) as stem, split_part(name, '_', 1) as grp, strftime(d, '%U %Y') as week, round(o_orderkey * 0.005::double, 6) as time from f""")
def names_and_weeks(spark, d):
    n = table(spark, d, "orders").select("o_orderkey", F.expr(_NAME).alias("name"), F.to_date("o_orderdate").alias("day"))
    day = dates.recording_day(F.lit(None).cast("date"), F.col("day"))
    return n.select("o_orderkey", naming.stem(F.col("name")).alias("stem"), naming.without_age_sex(naming.coded(F.col("name"))).alias("grp"), dates.week_and_year(day).alias("week"), _r(dates.frame_time(F.col("o_orderkey"), F.lit(0.005)), "time"))


@query("""select o_orderkey, o_custkey as width, 'uint16' as pixel_type, 10 as frames, round((0.005::double + (o_orderkey % 7) / 1000.0::double) / 2, 6) as time_interval, case when o_orderkey % 3 = 0 then 0.65::double else 0.5::double end * case when o_orderkey % 2 = 0 then 2 else 1 end as resolution,
case when o_orderkey % 4 = 0 then 1 else o_orderkey end as created from orders""")
def metadata_of_dumps(spark, d):
    """Each order as the dump of a movie: lines of key and text, taken apart and laid in columns again."""
    k = F.col("o_orderkey")
    line = lambda key, text: F.struct(F.lit(key).alias("key"), text.cast("string").alias("text"))
    lines = F.array(
        line("Width", F.col("o_custkey")), line("SizeT", F.lit(300)), line("Pixel type", F.lit("uint 16")), line("factor", F.when(k % 3 == 0, "1;1").otherwise("0.5;2")), line("magnification", F.when(k % 2 == 0, "2;x")),
        line("File Info Last Field Date Time", F.when(k % 4 != 0, k + dates.CAMERA_EPOCH)), line("Field 9 Time_From_Start", F.lit(0.1)), line("Field 10 Time_From_Start", F.lit(0.2)), line("Field 9 Time_From_Last", F.lit(0.005)), line("Field 10 Time_From_Last", (k % 7) / 1000),
    )
    dumps = table(spark, d, "orders").select(k.cast("string").alias("file"), F.explode(lines).alias("l")).select("file", "l.*").where("text is not null")
    wide = tables.pivot_kv(readers.metadata(dumps), "file")
    return wide.select(F.col("file").cast("long").alias("o_orderkey"), F.col("sizeX").cast("long").alias("width"), F.col("pixelType").alias("pixel_type"), F.col("imageCount").cast("int").alias("frames"), _r(F.col("time_interval").cast("double"), "time_interval"), F.col("resolution").cast("double").alias("resolution"), F.col("created_unix_from_file").cast("long").alias("created"))
