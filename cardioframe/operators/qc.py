"""Quality of traces: smoothness, autocorrelation, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming, order, stats
from . import joins
from .series import Series


def trace_metrics(df: DataFrame, s: Series, up: str, down: str | None = None) -> DataFrame:
    """For each series: smooth_<edge> (sd of differences) and autocorr_<edge> (correlation of a difference with the next), and how far two edges differ."""
    edges = [c for c in (up, down) if c]
    out = df
    for c in edges:
        out = out.withColumn(f"__d_{c}", F.col(c) - s.lag(c))
    for c in edges:
        out = out.withColumn(f"__e_{c}", s.lag(f"__d_{c}"))
    found = out.groupBy(*s.keys).agg(*(a for c in edges for a in (F.stddev_samp(f"__d_{c}").alias(f"smooth_{c}"), stats.correlation(F.col(f"__d_{c}"), F.col(f"__e_{c}")).alias(f"autocorr_{c}"))))
    if down:
        found = found.withColumns({"sd": two_sd(F.col(f"smooth_{up}"), F.col(f"smooth_{down}")), "autocorr_sd": two_sd(F.col(f"autocorr_{up}"), F.col(f"autocorr_{down}"))})
    return found


def two_sd(a: Column, b: Column) -> Column:
    """The sample standard deviation of two numbers."""
    return F.abs(a - b) / F.sqrt(F.lit(2.0))


def classes(metrics: DataFrame, a: str, b: str, sd: str) -> DataFrame:
    """excellent or good by how a trace stands to the medians of all traces, else n.t.; nulls are n.t."""
    middle = order.quantiles(metrics, [], {"__a": (a, 0.5), "__b": (b, 0.5), "__sd": (sd, 0.5)})
    near = lambda share, most: (F.col(a) > F.col("__a") * share) & (F.col(b) > F.col("__b") * share) & (F.col(sd) < F.col("__sd") * most)
    quality = F.when(near(0.9, 1.5), "excellent").when(near(0.5, 3.0), "good").otherwise("n.t.")
    return joins.with_scalar(metrics, middle).withColumn("quality", quality).drop("__a", "__b", "__sd")


def ok_or_bad(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """The older rule: ok where both edges are at least as correlated as the median."""
    middle = order.quantiles(metrics, [], {"__a": (a, 0.5), "__b": (b, 0.5)})
    return joins.with_scalar(metrics, middle).withColumn("quality", F.when((F.col(a) >= F.col("__a")) & (F.col(b) >= F.col("__b")), "ok").otherwise("bad")).drop("__a", "__b")


#: What a trace with an edge that never moves has for its metrics. Fixed values.
FLAT = {"smoothie_up": 10.0, "smoothie_down": 10.0, "sd": 100.0, "dist_cor": 0.0, "norm_dist_cor": 0.0, "autocorr_up": 0.0, "autocorr_down": 0.0, "autocorr_sd": 10.0}


def quality_table(traces: DataFrame, order_by: str = "t") -> DataFrame:
    """A row for each trace: its metrics, what its name says, and its quality, as published.

    traces: csv, order_by, up, down, distance, distance_norm. excellent: both edges are more correlated than 0.9 of the median of all traces, and
    differ less than 1.5 of it; good: of the others those whose distance and normalised distance are correlated over 0.6 and whose edges
    differ by under 4; the rest, and traces without a metric, are n.t. A trace with an edge that never moves has the values of FLAT.
    """
    s = Series(("csv",), (order_by,))
    columns = {"up": "up", "down": "down", "dist": "distance", "norm": "distance_norm"}
    steps = traces.select("csv", order_by, *((F.col(c) - s.lag(c)).alias(f"__d_{k}") for k, c in columns.items()))
    steps = steps.withColumns({f"__e_{k}": s.lag(f"__d_{k}") for k in columns})
    of = {k: (F.stddev_samp(f"__d_{k}").alias(f"__s_{k}"), stats.correlation(F.col(f"__d_{k}"), F.col(f"__e_{k}")).alias(f"__c_{k}")) for k in columns}
    each = steps.groupBy("csv").agg(*(a for pair in of.values() for a in pair))
    found = {
        "smoothie_up": F.col("__s_up"), "smoothie_down": F.col("__s_down"), "sd": two_sd(F.col("__s_down"), F.col("__s_up")), "dist_cor": F.col("__c_dist"), "norm_dist_cor": F.col("__c_norm"),
        "autocorr_up": F.col("__c_up"), "autocorr_down": F.col("__c_down"), "autocorr_sd": two_sd(F.col("__c_up"), F.col("__c_down")),
    }
    still = (F.col("__s_up") == 0) | (F.col("__s_down") == 0)
    known = F.col("__s_up").isNotNull() & F.col("__s_down").isNotNull()
    metrics = each.select("csv", *(F.when(still, FLAT[n]).when(known, c).alias(n) for n, c in found.items()))
    middle = order.quantiles(metrics, [], {f"__{n}": (n, 0.5) for n in ("autocorr_up", "autocorr_down", "sd")})
    best = (F.col("autocorr_up") > F.col("__autocorr_up") * 0.9) & (F.col("autocorr_down") > F.col("__autocorr_down") * 0.9) & (F.col("sd") < F.col("__sd") * 1.5)
    fair = (F.col("dist_cor") > 0.6) & (F.col("sd") < 4) & (F.col("norm_dist_cor") > 0.6)
    name = F.col("csv")
    tiff = F.regexp_extract(name, r"^(.*?\.tiff)", 1)
    return joins.with_scalar(metrics, middle).select(
        "csv", *found, naming.code(name).alias("CODE"), naming.field(name, 2).alias("ID"), naming.xpos(name).alias("Xpos"), F.when(best, "excellent").when(fair, "good").otherwise("n.t.").alias("quality"),
        tiff.alias("tiff"), F.concat(tiff, F.lit("_traced.jpg")).alias("jpeg"), naming.movie(name).alias("cxd"),
    )


def tally(table: DataFrame) -> DataFrame:
    """quality, cxd, value: how many traces of each quality a movie has, 0 where it has none."""
    kinds = ("excellent", "good", "n.t.")
    wide = table.groupBy("cxd").agg(*(F.count_if(F.col("quality") == k).alias(k) for k in kinds))
    return wide.unpivot(["cxd"], [F.col(f"`{k}`") for k in kinds], "quality", "value")


def rescued(table: DataFrame) -> DataFrame:
    """Good traces of movies without an excellent one: cxd, value (how many the movie has) and all columns of the quality table."""
    counts = table.groupBy("cxd").agg(F.count_if(F.col("quality") == "excellent").alias("__best"), F.count_if(F.col("quality") == "good").alias("value"))
    needy = counts.where("__best = 0 and value > 0").drop("__best")
    return needy.join(table.where("quality = 'good'"), "cxd", "left")
