"""Queries of the result tables: orders stand for recordings (each of a movie of its own), their lines for beats, nations for the mapping of codes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import results, tables
from ..sources import writers
from .registry import query, table

_JPG = "'G' || o_orderkey % 23 || '_' || o_orderkey % 90 || '_' || (o_orderkey % 5 + 1) || 'w' || case when o_orderkey % 2 = 0 then 'm' else 'f' end || '_10x_r1_n' || o_orderkey || '.cxd_peak_' || (o_orderkey % 4 + 1) || '_at Xpos_' || (o_orderkey % 700) || '.tiff_traced.jpg'"
_MARK = [f"l_discount + {k} * l_tax" for k in range(len(results.MARKS))]
_SPAN = {"starts": "l_linenumber", "peaks": "l_linenumber + 0.4e0", "ends": "l_linenumber + 0.9e0", "SI": "1 + l_discount", "deltaSI": "l_tax", "deltaSIplus": "2 * l_tax", "HP": "1 + l_tax + l_discount", "DI": "l_extendedprice / 99991e0"}


def _catalog(spark, d) -> tuple[DataFrame, DataFrame]:
    files = table(spark, d, "orders").select(F.expr(_JPG).alias("jpg"))
    n = table(spark, d, "nation")
    text = lambda e: F.expr(e).cast("string")
    mapping = n.select(text("'G' || n_nationkey").alias("CODE"), F.col("n_name").alias("cross"), text("n_regionkey").alias("type"), text("'f' || n_nationkey").alias("fly"), text("'h' || n_nationkey % 7").alias("human"), text("'s' || n_nationkey").alias("stocks"))
    return results.catalog(files, mapping), mapping


def _inputs(spark, d) -> dict[str, DataFrame]:
    catalog, mapping = _catalog(spark, d)
    catalog = writers.staged(catalog)
    number = F.regexp_extract("cxd_file", r"_n(\d+)\.cxd$", 1).cast("long")
    keyed = catalog.select("index", "cxd_file", number.alias("o_orderkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.unix_timestamp("o_orderdate").cast("string").alias("created_unix_from_file")).join(keyed, "o_orderkey")
    lines = table(spark, d, "lineitem").join(keyed.drop("cxd_file"), F.col("l_orderkey") == F.col("o_orderkey")).select("index", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # in buckets by recording, so that the many medians of its beats are taken without a shuffle
    path = writers.shared(spark)
    lines = writers.series_store(lines, ["index"], ["l_linenumber"], f"lines_{path[-32:]}", path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.col("o_orderkey")
    wide = orders.select(F.concat("cxd_file", F.lit("_new_meta_data.csv")).alias("file"), *(F.col(c) if c == "created_unix_from_file" else F.lit("1").alias(c) for c in tables.META_KEYS))
    return {
        "catalog": catalog, "mapping": mapping, "meta": results.meta_table(wide),
        "beats": lines.select("index", (F.col("l_quantity") + 60).alias("DD"), F.col("l_quantity").alias("SD"), *(F.expr(e).cast("double").alias(c) for c, e in _SPAN.items())),
        "velocities": lines.select("index", (F.col("l_extendedprice") / 997).alias("max_velocity"), (-F.col("l_quantity")).alias("min_velocity")),
        "landmarks": lines.select("index", *(F.expr(e).alias(c) for c, e in zip(results.MARKS, _MARK, strict=True))),
        "timing": orders.select("index", (1 + F.col("o_totalprice") / 999983).alias("HR"), (F.col("o_totalprice") / 9999991).alias("coverage")),
        "directions": orders.select("cxd_file", (k % 11 / 10).alias("anterograde_percent"), (k % 13).cast("double").alias("anterograde_speed"), (k % 17).cast("double").alias("retrograde_speed"), (k % 5).alias("reversals")),
    }


_CAT = f"""with nm as (select o_orderkey as k, o_totalprice as price, o_orderdate as od, {_JPG} as jpg from orders), p as (select *, split_part(jpg, '_', 1) as code, substr(split_part(jpg, '_', 3), 1, 1) as age, right(split_part(jpg, '_', 3), 1) as sex,
regexp_extract(jpg, '^([^_]*_.*?w[fm])_', 1) as fly, regexp_extract(jpg, 'Xpos_([0-9]+)[.]tiff', 1)::int as xpos, regexp_extract(jpg, '^(.*?[.]cxd)', 1) as cxd from nm),
mp as (select 'G' || n_nationkey as code, n_name as "cross", n_regionkey::varchar as type, 'f' || n_nationkey as ff, 'h' || n_nationkey % 7 as hh, 's' || n_nationkey as stocks, dense_rank() over (order by 'h' || n_nationkey % 7) as sorting, dense_rank() over (order by n_regionkey::varchar) as grp from nation),
ct as (select p.*, code || age || sex as coded, row_number() over (order by jpg) as idx, dense_rank() over (order by code || age || sex) as i, row_number() over (partition by code || age || sex order by jpg) as j from p)"""


@query(f"""{_CAT} select jpg, coded as "Genotype", comment, idx as "index", ct.code as "CODE", "cross", type, ff as symbol_fly, hh as symbol_human, sorting, grp as "group", split_part(jpg, '_', 2)::int as "IDnumber", fly as "flyID", i, j from (select *, 'n' || k as comment from ct) ct left join mp on mp.code = ct.code""")
def file_catalog(spark, d):
    """The catalog of recordings with the numbers of recordings, genotypes, symbols and types."""
    found, _ = _catalog(spark, d)
    return found.select("jpg", "Genotype", "comment", *(F.col(c).cast("long").alias(c) for c in ("index", "i", "j", "sorting", "group")), "CODE", "cross", "type", "symbol_fly", "symbol_human", "IDnumber", "flyID")


_RECORDED = f"""{_CAT}, li as (select l.*, {", ".join(f"{e} as {c}" for c, e in zip(results.MARKS, _MARK, strict=True))}, {", ".join(f'({e})::double as sp_{c}' for c, e in _SPAN.items())} from lineitem l),
md as (select *, median(tt10r) over (partition by l_orderkey) as m10, median(sp_SI) over (partition by l_orderkey) as msi, median(sp_HP) over (partition by l_orderkey) as mhp, median(sp_DI) over (partition by l_orderkey) as mdi from li),
ag as (select l_orderkey as k, median(l_quantity + 60) as edd, median(l_quantity) as esd, median(60 / (l_quantity + 60)) as fs, avg(l_extendedprice / 997) as maxv, avg(-l_quantity) as minv, stddev_samp(sp_HP) / median(sp_HP) as ai,
  1.4826::double * median(abs(tt10r - m10)) as mad10, 1.4826::double * median(abs(sp_SI - msi)) as madsi, 1.4826::double * median(abs(sp_HP - mhp)) as madhp, 1.4826::double * median(abs(sp_DI - mdi)) as maddi,
  median(sp_HP) as hpm, median(sp_DI) as dim, median(sp_SI) as sim, median(sp_deltaSI) as dsm, median(sp_deltaSIplus) as dspm, median(sp_HP) - median(peaked) as relax, {", ".join(f"median({c}) as {c}_m" for c in results.MARKS)} from md group by l_orderkey),
re as (select ct.*, mp."cross", mp.type, mp.ff, mp.hh, mp.stocks, ag.* exclude (k), 1 + price / 999983 as hr, price / 9999991 as coverage, pi() / 4 * (edd * edd - esd * esd) as sv, k % 11 / 10 as ap, (k % 13)::double as asp, (k % 17)::double as rsp, k % 5 as rev,
  case when xpos > (select floor(avg(distinct xpos)) from ct) then 'posterior' else 'anterior' end as segment, strftime(od, '%Y-%m-%d') as day, strftime(od, '%U %Y') as wk from ct left join mp on mp.code = ct.code left join ag using (k))"""
#: Names of final() and what SQL calls them.
_MEASURED = {
    "EDD": "edd", "ESD": "esd", "FS": "fs", "HR": "hr", "HP_median": "hpm", "DI_median": "dim", "relaxtime": "relax", "SI_median": "sim", "peaked_median": "peaked_m", "min_velocity": "minv", "max_velocity": "maxv", "MAD_SI": "madsi", "MAD_HP": "madhp", "MAD_DI": "maddi",
    **{f"{m}_median": f"{m}_m" for m in results.MARKS[1:]}, "deltaSI_median": "dsm", "deltaSIplus_median": "dspm", "AI": "ai", "MAD_tt10r": "mad10", "SV": "sv", "CO": "sv * hr", "anterograde_percent": "ap", "anterograde_speed": "asp", "retrograde_speed": "rsp",
}


def _digits(name: str) -> int:
    """Deviations are multiples of a few ten-thousandths, so five digits would often fall on a tie."""
    return 8 if name.startswith("MAD") else 5


def _rounded(columns) -> list:
    return [(F.round(F.col(c), _digits(c)) + F.lit(0.0)).alias(c) for c in columns]


def _assembled(spark, d) -> dict[str, DataFrame]:
    return results.assemble(**_inputs(spark, d))


def _recordings(spark, d) -> DataFrame:
    given = _inputs(spark, d)
    return results.recordings(*(given[k] for k in ("catalog", "beats", "velocities", "timing", "directions")))


def _plain(df: DataFrame) -> DataFrame:
    """Names that SQL needs no quotes for."""
    return df.select(*(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns))


@query(f"""{_RECORDED} select code as "CODE", coded as "CODE_long", fly as "flyID", type, "cross", cxd as cxd_file, day as cxd_recordingday, wk as cxd_week_year, hh as human_gene, ff as fly_gene, xpos as "Xpos", age as "Age", sex as "Sex",
{", ".join(f'round({e}, {_digits(n)}) + 0.0 as "{n}"' for n, e in _MEASURED.items())}, segment, regexp_replace(jpg, 'peak_[0-9]+_at', 'peak_X_at') as file, split_part(jpg, '_', 2)::int as "ID_number", cxd || '_new_meta_data.csv' as filename, coded as "Genotype", stocks from re""")
def final_recordings(spark, d):
    """final_all_data: each recording with its measures, its movie's metadata and the stocks of its code."""
    found = _plain(_assembled(spark, d)["final_all_data"])
    return found.select("CODE", "CODE_long", "flyID", "type", "cross", "cxd_file", F.date_format("cxd_recordingday", "yyyy-MM-dd").alias("cxd_recordingday"), "cxd_week_year", "human_gene", "fly_gene", "Xpos", "Age", "Sex", *_rounded(_MEASURED), "segment", "file", "ID_number", "filename", "Genotype", "stocks")


def _flies_sql(which: str) -> str:
    return f"""{_RECORDED}, sel as (select * from re where {which}), mf as (select fly, {", ".join(f'median({e}) as "{n}"' for n, e in _MEASURED.items())} from sel group by fly),
rv as (select fly, median(rev) as rm, stddev_samp(rev) as rs from (select distinct fly, rev from re) group by fly)
select distinct mf.fly as "flyID", {", ".join(f'round(mf."{n}", {_digits(n)}) + 0.0 as "{n}"' for n in _MEASURED)}, sel.cxd as cxd_file, sel.age as "Age", sel.stocks as stocks""" + (", round(rm, 5) as reversals_median, round(rs, 5) as \"reversals_SD\" from mf join sel using (fly) join rv using (fly)" if which == "true" else " from mf join sel using (fly)")


@query(_flies_sql("true"))
def final_flies(spark, d):
    """final_all_data_per_fly: medians of flies with their attributes and reversals."""
    found = _plain(_assembled(spark, d)["final_all_data_per_fly"])
    return found.select("flyID", *_rounded(_MEASURED), "cxd_file", "Age", "stocks", *_rounded(["reversals_median", "reversals_SD"]))


@query(_flies_sql("segment = 'posterior'"))
def final_flies_posterior(spark, d):
    found = _plain(_assembled(spark, d)["final_all_data_per_fly_posterior"])
    return found.select("flyID", *_rounded(_MEASURED), "cxd_file", "Age", "stocks")


_SPREAD = {"coverage": "SDcoverage", "HR": "SDHR", "EDD": "SDEDD", "ESD": "SDESD", "FS": "SDFS", "max_velocity": "SDMV", "min_velocity": "SDMinV"}
_NUMBERS = {"coverage": "coverage", "HR": "hr", "EDD": "edd", "ESD": "esd", "FS": "fs", "max_velocity": "maxv", "min_velocity": "minv"}


@query(f"""{_RECORDED} select coded as "Code", count(*) as n, any_value("cross") as "Cross", any_value(type) as type, any_value(hh) as human, any_value(ff) as fly, right(coded, 2) as "AgeSex", right(coded, 1) as "Sex", substr(right(coded, 2), 1, 1) as "Age",
{", ".join(f'round(avg({_NUMBERS[c]}), 5) + 0.0 as "{c}", round(stddev_samp({_NUMBERS[c]}), 5) + 0.0 as "{sd}"' for c, sd in _SPREAD.items())} from re group by coded""")
def genotype_table(spark, d):
    """master_table: all columns of a genotype."""
    found = results.genotypes(_recordings(spark, d))
    return found.select(*found.columns[:9], *_rounded(found.columns[9:]))


@query(f"""{_RECORDED} {" union all ".join(f'''select '{m}' as measure, round({e}, 5) + 0.0 as value, coded as "L1", code as "CODE", hh as human, ff as fly, type from re''' for m, e in (("EDD", "edd"), ("ESD", "esd"), ("FS", "fs"), ("HR", "hr"), ("min_velocity", "minv"), ("max_velocity", "maxv")))}""")
def measure_tables(spark, d):
    """The six tables of single measures, one below the other."""
    found = writers.staged(_recordings(spark, d))
    each = [results.measure(found, m).withColumnRenamed(m, "value").withColumn("measure", F.lit(m)) for m in tables.MEASURES]
    return functools.reduce(DataFrame.unionByName, each).select("measure", *_rounded(["value"]), "L1", "CODE", "human", "fly", "type")
