"""Queries of the ordered-series operators, over events: a user is a recording, its events are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import areas, beats, blocks, direction, joins, qc, series, signal, tables
from ..operators.series import Series
from ..sources import writers
from .registry import query, table

S = Series(("user_id",), ("ts", "event_id"))
#: Series of the driver's tables are short, so thresholds look at fewer frames than in recordings.
WIDTH = 12

_E = "with e as (select user_id, event_id, ts, value as x, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as n from events)"
_W = "over (partition by user_id order by ts, event_id)"


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.col("value").alias("x"))


def _r(c, name: str, digits: int = 6):
    """Rounded, and without a negative zero."""
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


@query(f"{_E} select user_id, event_id, round(x - lag(x) {_W}, 6) as diff from e")
def first_diff(spark, d):
    return events(spark, d).select("user_id", "event_id", _r(F.col("x") - S.lag("x"), "diff"))


_SLOPE = f"sign((lead(x) {_W}) - x) - sign(x - (lag(x) {_W}))"


@query(f"{_E} select user_id, event_id, x from (select *, {_SLOPE} as s from e) where s < 0")
def local_peaks(spark, d):
    return events(spark, d).withColumn("p", series.local_extrema(S, "x")).where("p").select("user_id", "event_id", "x")


@query(f"{_E} select user_id, event_id, x from (select *, {_SLOPE} as s from e) where s > 0")
def local_valleys(spark, d):
    return events(spark, d).withColumn("p", series.local_extrema(S, "x", valleys=True)).where("p").select("user_id", "event_id", "x")


def _peaks_sql(m: int) -> str:
    w = "over (partition by user_id order by ts, event_id rows between {} and {})"
    return f"{_E} select user_id, event_id, x from (select *, {_SLOPE} as s, max(x) {w.format(f'{m} preceding', '1 preceding')} as a, max(x) {w.format('1 following', f'{m} following')} as b from e) where s < 0 and x >= a and x >= b"


@query(_peaks_sql(3))
def local_peaks_m3(spark, d):
    return events(spark, d).withColumn("p", series.window_peaks(S, "x", 3)).where("p").select("user_id", "event_id", "x")


@query(_peaks_sql(10))
def local_peaks_m10(spark, d):
    return events(spark, d).withColumn("p", series.window_peaks(S, "x", 10)).where("p").select("user_id", "event_id", "x")


def _rolling_sql(k: int) -> str:
    return f"{_E} select user_id, event_id, round(case when rn <= n - {k - 1} then avg(x) over (partition by user_id order by ts, event_id rows between current row and {k - 1} following) end, 6) as mean from e"


@query(_rolling_sql(4))
def rolling_mean_4(spark, d):
    return events(spark, d).select("user_id", "event_id", _r(series.rolling_mean(S, "x", 4), "mean"))


@query(_rolling_sql(10))
def rolling_mean_10(spark, d):
    return events(spark, d).select("user_id", "event_id", _r(series.rolling_mean(S, "x", 10), "mean"))


@query(f"""{_E}, p as (select user_id, event_id, rn, n, x, list(x) over (partition by user_id order by rn rows between current row and 29 following) as xs, last_value(x) over (partition by user_id order by rn rows between unbounded preceding and unbounded following) as l from e)
select user_id, event_id, round((select median(v) from (select unnest(xs || list_resize([]::double[], (30 - len(xs))::bigint, l)) as v)), 6) as med from p""")
def rolling_median_30(spark, d):
    return events(spark, d).select("user_id", "event_id", _r(series.rolling_median(S, "x", 30), "med"))


_THRESHOLD = f"""{_E}, w as (select *, case when n >= {WIDTH} then {WIDTH} else greatest(1, n // 3) end as k from e),
m as (select a.user_id, a.event_id, a.ts, a.rn, a.n, a.x, a.k, a.n - a.k + 1 as real, avg(b.x) as mean from w a join w b on a.user_id = b.user_id and b.rn between a.rn and a.rn + a.k - 1 group by all),
t as (select user_id, median(mean) as tail from m where rn between real - 5 and real group by user_id),
th as (select m.user_id, m.event_id, m.ts, m.rn, m.x, case when m.rn < m.real then m.mean else t.tail end as threshold from m join t using (user_id))"""


@query(f"{_THRESHOLD} select user_id, event_id, round(threshold, 5) as threshold from th")
def forward_threshold(spark, d):
    return series.forward_threshold(events(spark, d), S, "x", WIDTH).select("user_id", "event_id", _r(F.col("threshold"), "threshold", 5))


@query(f"{_E}, f as (select *, {_SLOPE} < 0 as p from e) select user_id, event_id, count(*) filter (where p) over (partition by user_id order by ts, event_id rows between current row and 5 following) as ahead from f")
def range_count(spark, d):
    return events(spark, d).withColumn("p", series.local_extrema(S, "x")).select("user_id", "event_id", series.count_ahead(S, F.col("p"), 5).alias("ahead"))


@query(f"""{_E}, f as (select *, x < 50 as low from e), g as (select *, rn - row_number() over (partition by user_id order by rn) as k from f where low)
select user_id, min(rn) as first, max(rn) as last, count(*) as n, round_even((min(rn) + max(rn)) / 2.0, 0)::bigint as centre from g group by user_id, k""")
def zero_islands(spark, d):
    found = series.islands(events(spark, d), S, F.col("x") < 50)
    return found.select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n", "centre")


@query("""with e as (select user_id, event_type as v, row_number() over (partition by user_id order by ts, event_id) as rn from events),
m as (select *, case when v is distinct from lag(v) over (partition by user_id order by rn) then 1 else 0 end as fresh from e), g as (select *, sum(fresh) over (partition by user_id order by rn) as run from m)
select user_id, run::bigint as run, min(v) as value, count(*) as length, max(rn) as "end" from g group by user_id, run""")
def run_lengths(spark, d):
    found = series.run_lengths(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), S, "event_type")
    return found.select("user_id", F.col("run").cast("long").alias("run"), "value", "length", F.col("end").cast("long").alias("end"))


_POINTS = f"""{_THRESHOLD}, k as (select *, case when s < 0 and x > threshold then 'P' when s > 0 and x < threshold then 'V' end as kind from (select *, {_SLOPE} as s from th)),
p as (select * from (select *, lag(kind) over (partition by user_id order by rn) as was from k where kind is not null) where not (kind = 'P' and coalesce(was = 'P', false)))"""


def points(spark, d) -> DataFrame:
    return beats.turning_points(events(spark, d).withColumn("t", S.number() - 1), S, "x", WIDTH)


@query(f"{_POINTS} select user_id, event_id, kind, x from p")
def drop_repeat_peaks(spark, d):
    return points(spark, d).select("user_id", "event_id", "kind", "x")


_BEATS = f"""{_POINTS}, q as (select *, lag(kind) over w as k1, lead(kind) over w as k2, lag(rn) over w as r1, lead(rn) over w as r2, lag(x) over w as x1, lead(x) over w as x2 from p window w as (partition by user_id order by rn)),
b as (select user_id, row_number() over (partition by user_id order by rn) as beat, r1 - 1 as start, rn - 1 as peak, r2 - 1 as "end", x1 as start_x, x as peak_x, x2 as end_x, r1 as start_place, r2 as end_place from q where kind = 'P' and k1 = 'V' and k2 = 'V')"""


def all_beats(spark, d) -> DataFrame:
    return beats.find_beats(points(spark, d), S, "x", "t")


@query(f"{_BEATS} select user_id, beat, start, peak, \"end\", start_x, peak_x, end_x from b")
def beats_vpv(spark, d):
    return all_beats(spark, d).select("user_id", F.col("beat").cast("long").alias("beat"), *(F.col(c).cast("long").alias(c) for c in ("start", "peak", "end")), "start_x", "peak_x", "end_x")


def _blocks(spark, d) -> DataFrame:
    """Events numbered and taken as series of blocks of 16 frames."""
    return blocks.numbered(events(spark, d), ["user_id"], ["ts", "event_id"], "place").withColumn("t", F.col("place") - 1)


@query(f"{_BEATS} select user_id, beat, start, peak, \"end\", start_x, peak_x, end_x from b")
def beats_in_blocks(spark, d):
    """Beats of series that are dealt out in blocks."""
    b = blocks.Blocks(("user_id",), "place", 16)
    found = blocks.find_beats(blocks.turning_points(_blocks(spark, d), b, "x", WIDTH), b, "x", "t")
    return found.select("user_id", F.col("beat").cast("long").alias("beat"), *(F.col(c).cast("long").alias(c) for c in ("start", "peak", "end")), "start_x", "peak_x", "end_x")


@query(f"""{_E}, f as (select *, x < 50 as low from e), g as (select *, rn - row_number() over (partition by user_id order by rn) as k from f where low)
select user_id, min(rn) as first, max(rn) as last, count(*) as n, round_even((min(rn) + max(rn)) / 2.0, 0)::bigint as centre from g group by user_id, k""")
def islands_in_blocks(spark, d):
    found = blocks.islands(_blocks(spark, d), blocks.Blocks(("user_id",), "place", 16), F.col("x") < 50)
    return found.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("first", "last", "n", "centre")))


_INTERVALS = f"""{_BEATS}, i1 as (select *, "end" - start as si, lead(start) over (partition by user_id order by start) - start as hp from b),
i2 as (select *, lead(si) over (partition by user_id order by start) - si as dsi, hp - si as di from i1), i3 as (select *, lead(dsi) over (partition by user_id order by start) as dsip from i2)"""


def all_intervals(spark, d) -> DataFrame:
    return beats.intervals(all_beats(spark, d), S.keys)


@query(f"{_INTERVALS} select user_id, beat, si as \"SI\", dsi as \"deltaSI\", dsip as \"deltaSIplus\", hp as \"HP\", di as \"DI\" from i3")
def beat_intervals(spark, d):
    return all_intervals(spark, d).select("user_id", *(F.col(c).cast("long").alias(c) for c in ("beat", "SI", "deltaSI", "deltaSIplus", "HP", "DI")))


@query(f"""{_INTERVALS} select user_id, count(*) as beats, round(median(hp), 6) as "HP_median", round(stddev_samp(hp) / median(hp), 6) as "AI", round(median(peak_x), 6) as "EDD", round(median(start_x), 6) as "ESD",
round(median((peak_x - start_x) / peak_x), 6) as "FS" from i3 group by user_id""")
def beat_summary(spark, d):
    found = beats.summary(all_intervals(spark, d), S.keys)
    return found.select("user_id", "beats", *(_r(F.col(c), c) for c in ("HP_median", "AI", "EDD", "ESD", "FS")))


_ROWS = f"""{_BEATS}, i as (select e.user_id, b.beat, e.rn, e.x, e.rn - b.start_place as time from e join b on e.user_id = b.user_id and e.rn between b.start_place and b.end_place),
c as (select *, count(*) over (partition by user_id, beat) as m, x - first_value(x) over (partition by user_id, beat order by rn) as rise from i),
r as (select user_id, beat, rn, time, rise, case when max(rise) over (partition by user_id, beat) = 0 then rise else rise / max(rise) over (partition by user_id, beat) end as relative, coalesce((rise - lag(rise) over (partition by user_id, beat order by rn)) / 1.0, 0) as velocity from c where m > 3)"""


def beat_rows(spark, d, trim: bool = False) -> DataFrame:
    df = events(spark, d).withColumn("t", S.number() - 1)
    return beats.rows_of_beats(df, all_beats(spark, d), S, "x", "t", more_than=3, trim=trim)


@query(f"{_ROWS} select user_id, beat, rn as place, time, round(rise, 6) as from_start, round(relative, 6) as relative from r")
def beat_normalise(spark, d):
    return beat_rows(spark, d).select("user_id", F.col("beat").cast("long").alias("beat"), F.col("place").cast("long").alias("place"), F.col("time").cast("long").alias("time"), _r(F.col("from_start"), "from_start"), _r(F.col("relative"), "relative"))


@query(f"{_ROWS} select user_id, beat, round(max(velocity), 6) as max_velocity, round(min(velocity), 6) as min_velocity, count(*) as n from r group by user_id, beat")
def beat_velocity(spark, d):
    return beat_rows(spark, d).groupBy("user_id", F.col("beat").cast("long").alias("beat")).agg(_r(F.max("velocity"), "max_velocity"), _r(F.min("velocity"), "min_velocity"), F.count("*").alias("n"))


@query(f"""{_ROWS}, f as (select *, min(case when velocity <> 0 then k end) over (partition by user_id, beat) as moved from (select *, row_number() over (partition by user_id, beat order by rn) as k from r)),
g as (select * from f where k >= coalesce(moved - 1, 1)) select user_id, beat, rn as place, time - min(time) over (partition by user_id, beat) as time from g""")
def beat_trim(spark, d):
    return beat_rows(spark, d, trim=True).select("user_id", *(F.col(c).cast("long").alias(c) for c in ("beat", "place", "time")))


_MARKED = f"""tops as (select *, max(relative) over (partition by user_id, beat) as top from r), pk as (select *, min(case when relative = top then time end) over (partition by user_id, beat) as peaked from tops),
lm as (select user_id, beat, max(peaked) as peaked, {", ".join(f"min(case when time <= peaked and relative > {v} then time end) as tt{round(v * 100)}p, min(case when time > peaked and relative < {v} then time end) as tt{round(v * 100)}r" for v in beats.LEVELS)} from pk group by user_id, beat)"""


@query(f"{_ROWS}, {_MARKED} select * from lm")
def landmarks_crossing(spark, d):
    found = beats.landmarks(beat_rows(spark, d), ("user_id", "beat"))
    return found.select("user_id", *(F.col(c).cast("long").alias(c) for c in found.columns[1:]))


@query(f"""{_ROWS}, a as (select *, (relative + lead(relative) over (partition by user_id, beat order by rn)) / 2 as part from r) select user_id, beat, round(sum(part), 6) as auc from a group by user_id, beat""")
def beat_auc(spark, d):
    return beats.auc(beat_rows(spark, d), ("user_id", "beat"), "place").select("user_id", F.col("beat").cast("long").alias("beat"), _r(F.col("auc"), "auc"))


@query("select user_id, event_id, round((value - min(value) over (partition by user_id)) / nullif(max(value) over (partition by user_id) - min(value) over (partition by user_id), 0), 6) as v from events")
def minmax_norm(spark, d):
    return events(spark, d).select("user_id", "event_id", _r(series.min_max(S, "x"), "v"))


@query("select user_id, event_id, round(1 - value / max(value) over (partition by user_id), 6) as v from events")
def max_norm_flipped(spark, d):
    return events(spark, d).select("user_id", "event_id", _r(series.flipped(series.share_of_max(S, "x")), "v"))


@query("select user_id, event_id, value as x, rank::bigint as rank from (select *, row_number() over (partition by user_id order by value desc, ts, event_id) as rank from events) where rank <= 3")
def topn_peaks(spark, d):
    return series.top(events(spark, d), S, "x", 3).select("user_id", "event_id", "x", F.col("rank").cast("long").alias("rank"))


@query("""with m as (select user_id, value, median(value) over (partition by user_id) as med from events) select user_id, round(1.4826 * median(abs(value - med)), 6) as x_mad from m group by user_id""")
def mad_by_group(spark, d):
    return stats.mad(events(spark, d), ["user_id"], ["x"]).select("user_id", _r(F.col("x_mad"), "x_mad"))


@query("select user_id, round(stddev_samp(value) / median(value), 6) as ai from events group by user_id")
def ai_by_group(spark, d):
    return events(spark, d).groupBy("user_id").agg(_r(stats.arrhythmia_index(F.col("x")), "ai"))


_D = f"{_E}, d1 as (select *, x - lag(x) {_W} as d from e), d2 as (select *, lag(d) over (partition by user_id order by rn) as l from d1)"


@query(f"{_D} select user_id, round(corr(d, l), 6) as autocorr, round(stddev_samp(d), 6) as smooth from d2 group by user_id")
def lag1_autocorr_smoothness(spark, d):
    return qc.trace_metrics(events(spark, d), S, "x").select("user_id", _r(F.col("autocorr_x"), "autocorr"), _r(F.col("smooth_x"), "smooth"))


@query(f"""{_D}, g as (select user_id, corr(d, l) as a, stddev_samp(d) as s from d2 group by user_id), m as (select median(a) as ma, median(s) as ms from g)
select user_id, case when a > ma * 0.9 and s > ms * 0.9 and s < ms * 1.5 then 'excellent' when a > ma * 0.5 and s > ms * 0.5 and s < ms * 3 then 'good' else 'n.t.' end as quality from g, m""")
def qc_classes(spark, d):
    metrics = qc.trace_metrics(events(spark, d), S, "x")
    return qc.classes(metrics.withColumn("sd", F.col("smooth_x")), "autocorr_x", "smooth_x", "sd").select("user_id", "quality")


@query(f"{_E} select user_id, round(regr_slope(x, rn), 6) as slope, round(1 - (1 - regr_r2(x, rn)) * (count(*) - 1) / nullif(count(*) - 2, 0), 6) as rsq from e group by user_id")
def regression_adj_r2(spark, d):
    return events(spark, d).withColumn("rn", S.number()).groupBy("user_id").agg(_r(F.regr_slope("x", "rn"), "slope"), _r(stats.adjusted_r2(F.col("x"), F.col("rn")), "rsq"))


@query(f"{_E} select user_id, round(sum(part), 4) as auc from (select user_id, (x + lead(x) {_W}) / 2 as part from e) group by user_id")
def auc_trapz(spark, d):
    return events(spark, d).withColumn("part", series.trapezoid(S, "x")).groupBy("user_id").agg(_r(F.sum("part"), "auc", 4))


def _marks(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type in ('click', 'view')").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("direction"), F.col("value").alias("speed"))


_MARKS = "with m as (select user_id, ts, event_id, case when event_type = 'click' then 1 else 0 end as dir, value from events where event_type in ('click', 'view')), s as (select *, abs(dir - lag(dir) over (partition by user_id order by ts, event_id)) as step from m)"


@query(f"{_MARKS} select user_id, round(avg(dir), 6) as anterograde_percent, round(avg(value) filter (where dir = 1), 6) as anterograde_speed, round(avg(value) filter (where dir = 0), 6) as retrograde_speed, sum(case when step <> 0 then 1 else 0 end)::bigint as reversals from s group by user_id")
def direction_summary(spark, d):
    marks = _marks(spark, d).withColumn("at", F.struct("ts", "event_id"))
    found = direction.summarise(marks, ["user_id"], "at")
    return found.select("user_id", *(_r(F.col(c), c) for c in ("anterograde_percent", "anterograde_speed", "retrograde_speed")), "reversals")


@query(f"{_MARKS} select user_id, case when count(step) = 0 then null when count(distinct step) = 1 then 0 else sum(step) end::bigint as reversals from s group by user_id")
def reversal_count_literal(spark, d):
    stepped = series.steps(_marks(spark, d), S, "direction")
    return stepped.groupBy("user_id").agg(series.reversals(S, "direction", literal=True).cast("long").alias("reversals"))


@query(f"""{_ROWS}, tt as (select user_id, count(*) * median(1) as total_time from (select user_id from e) group by user_id), u as (select user_id, sum(m) as used, count(*) as kept from (select user_id, beat, max(time) as m from r group by user_id, beat) group by user_id)
select tt.user_id, round(tt.total_time, 6) as total_time, round(used / tt.total_time, 6) as coverage, round(coalesce(kept, 0) / tt.total_time, 6) as heart_rate from tt left join u using (user_id)""")
def timing(spark, d):
    df = events(spark, d).withColumn("t", S.number() - 1)
    rows = beat_rows(spark, d)
    found = beats.timing(df, S, "t", None, rows)
    return found.select("user_id", *(_r(F.col(c).cast("double"), c) for c in ("total_time", "coverage", "heart_rate")))


@query("select user_id, event_id, round(case when value < q then 0 else value end, 6) as floored, round(greatest(value, q), 6) as clamped from (select *, quantile_cont(value, 0.75) over (partition by user_id) as q from events)")
def quantile_floor_clamp(spark, d):
    return events(spark, d).select("user_id", "event_id", _r(signal.quantile_floor(S, "x"), "floored"), _r(signal.quantile_clamp(S, "x"), "clamped"))


@query("select user_id, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as q2, round(quantile_cont(value, 0.75), 6) as q3 from events group by user_id")
def quantiles(spark, d):
    return events(spark, d).groupBy("user_id").agg(*(_r(stats.quantile(F.col("x"), q), f"q{k}") for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))))


@query(f"""{_E}, b as (select user_id, rn as lo, lead(rn) over (partition by user_id order by rn) as hi, row_number() over (partition by user_id order by rn) as bin from e where x > 100),
p as (select e.user_id, e.rn, b.bin from e join b on e.user_id = b.user_id and e.rn >= b.lo and e.rn < b.hi) select user_id, bin, max(rn) as at from p group by user_id, bin""")
def bincode_join(spark, d):
    e = events(spark, d).select("user_id", S.number().cast("long").alias("at"), "x")
    found = joins.bins(e.select("user_id", "at"), e.where("x > 100").select("user_id", F.col("at").alias("border")), ["user_id"], "at", "border")
    return joins.last_in_bin(found, ["user_id"], "at").select("user_id", F.col("bin").cast("long").alias("bin"), "at")


@query(f"""{_E}, l as (select *, min(x) over (partition by user_id order by rn rows between 5 preceding and 5 following) as lo from e), h as (select *, max(lo) over (partition by user_id order by rn rows between 5 preceding and 5 following) as hi from l)
select user_id, event_id, round(x - avg(hi) over (partition by user_id order by rn rows between 5 preceding and 5 following), 6) + 0.0 as corrected from h""")
def rolling_ball(spark, d):
    return signal.with_baseline(events(spark, d), S, "x", 5, 5).select("user_id", "event_id", _r(F.col("corrected"), "corrected"))


@query()
def spline_landmarks(spark, d):
    """Landmarks of a smoothing spline: no SQL says them; tests hold them against known curves."""
    return signal.spline_landmarks(beat_rows(spark, d).withColumn("time", F.col("time").cast("double")), ["user_id", "beat"], step=0.01)


@query(f"""{_E}, m as (select user_id, avg(x) as mean from e group by user_id), o as (select e.user_id, rn, row_number() over (partition by e.user_id order by rn) as k from e join m using (user_id) where x > mean) select user_id, rn as place from o where k = 2""")
def nth_over_mean(spark, d):
    return series.nth_over_mean(events(spark, d), S, "x", 2).select("user_id", F.col("place").cast("long").alias("place"))


@query(f"""{_E}, t as (select user_id, rn, x > 50 as bright from e), g as (select *, rn - row_number() over (partition by user_id order by rn) as k from t where bright), s as (select user_id, min(rn) as a, max(rn) as b from g group by user_id, k having count(*) >= 2),
p as (select * from (select user_id, rn, x, {_SLOPE} as sl from e) where sl < 0), j as (select p.user_id, p.rn, p.x, row_number() over (partition by p.user_id, s.a order by p.x desc, p.rn) as rank from p join s on p.user_id = s.user_id and p.rn between s.a and s.b)
select user_id, rn as place, x, rank from j where rank <= 3""")
def stripe_peaks(spark, d):
    e = events(spark, d).withColumn("rn", S.number())
    s = Series(("user_id",), ("rn",))
    stripes = series.islands(e, s, F.col("x") > 50).where("n >= 2")
    found = signal.stripe_peaks(e, stripes, ("user_id",), "rn", "x")
    return found.select("user_id", F.col("place").cast("long").alias("place"), "x", F.col("rank").cast("long").alias("rank"))


#: Borders from pk (movie, xpos, t): frames between the first and the last peak that see none ahead, for each window that may be taken.
_STEPS = """pf as (select distinct movie, t from pk), pn as (select movie, t, t - lag(t) over (partition by movie order by t, xpos) as d from pk),
st as (select movie, coalesce(floor(stddev_samp(d)), 0) as start, floor(count(*) / any_value(k)) as beats from pn join al using (movie) group by movie),
fr0 as (select movie, unnest(range(min(t), max(t))) as t from pf group by movie), nx as (select fr0.movie, fr0.t, min(pf.t) - fr0.t as gap from fr0 join pf on pf.movie = fr0.movie and pf.t >= fr0.t group by fr0.movie, fr0.t),
steps as (select unnest(range(-10, 11)) as step), tr as (select nx.movie, t, gap, step, start + step as w from nx join st using (movie) cross join steps),
fr as (select *, t - row_number() over (partition by movie, step order by t) as i from tr where w >= 0 and gap > w), b as (select movie, step, round_even((min(t) + max(t)) / 2.0, 0)::bigint as border from fr group by movie, step, i),
c as (select m.movie, m.beats, m.step, 2 + count(b.border) as n from (select * from st cross join steps) m left join b on b.movie = m.movie and b.step = m.step group by all),
ch as (select movie, case when max(case when step = 0 then n end) > 1.2 * beats then coalesce(min(case when step > 0 and n <= 1.2 * beats then step end), 10)
  when max(case when step = 0 then n end) < 0.8 * beats then coalesce(max(case when step < 0 and n >= 0.8 * beats then step end), -10) else 0 end as step from c group by movie, beats),
bo as (select distinct movie, border from (select movie, border from b join ch using (movie, step) union all select movie, 0 from ms union all select movie, frames from ms))"""
_MOVIES = "ms as (select user_id % 7 as movie, max(rn) as frames from e group by 1), al as (select user_id % 7 as movie, count(distinct user_id) as k from e group by 1)"


def _movies(spark, d, frames: DataFrame) -> DataFrame:
    return frames.groupBy("movie").agg(F.max("t").cast("long").alias("frames")).withColumns({"resolution": F.lit(0.65), "time_interval": F.lit(0.01)})


def _frames(spark, d) -> DataFrame:
    """Users as positions of seven movies, their events as frames; values in hundredths, so that means are exact."""
    return events(spark, d).select((F.col("user_id") % 7).alias("movie"), F.col("user_id").alias("xpos"), S.number().cast("long").alias("t"), F.round(F.col("x") * 100).alias("v"))


def _missing_sql(k: str, to: str) -> str:
    """Of the beats in ``k``: how many there are, whether a position has all, and the first and last that lack fewer than two."""
    return f"""h{to} as (select ix.movie, ix.place, count(g.bin) as have from ix left join (select rg.* from rg join {k} on {k}.movie = rg.movie and {k}.bin = rg.bin) g on g.movie = ix.movie and g.place = ix.place group by all),
q{to} as (select movie, count(*) as bins from {k} group by movie), w{to} as (select movie, any_value(bins) as bins, bool_or(have = bins) as whole, min(place) filter (bins - have < 2) as f, max(place) filter (bins - have < 2) as l from h{to} join q{to} using (movie) group by movie)"""


@query(f"""{_E}, {_MOVIES}, pr as (select user_id % 7 as movie, user_id as xpos, rn as t, n, round(x * 100) as v from e),
mn as (select * from (select *, avg(v) over (partition by xpos order by t rows between current row and 3 following) as m from pr) where t <= n - 3),
fl as (select *, 1 - (m - min(m) over (partition by xpos)) / nullif(max(m) over (partition by xpos) - min(m) over (partition by xpos), 0) as y from mn),
pk as (select movie, xpos, t from (select *, sign((lead(y) over o) - y) - sign(y - (lag(y) over o)) as s, max(y) over (partition by xpos order by t rows between 3 preceding and 1 preceding) as a, max(y) over (partition by xpos order by t rows between 1 following and 3 following) as z from fl window o as (partition by xpos order by t)) where s < 0 and y >= a and y >= z),
{_STEPS}, bb as (select movie, border as lo, lead(border) over (partition by movie order by border) as hi, row_number() over (partition by movie order by border) as bin from bo),
ix as (select movie, xpos, row_number() over (partition by movie order by xpos) as place from (select distinct movie, xpos from pr)),
rg as (select pk.movie, pk.xpos, any_value(ix.place) as place, bin, max(t) as t from pk join bb on pk.movie = bb.movie and t >= lo and t < hi join ix on ix.movie = pk.movie and ix.xpos = pk.xpos group by pk.movie, pk.xpos, bin),
bn as (select movie, bin, count(*) as n, nullif(regr_slope(place, t), 'nan'::double) as slope, nullif(1 - (1 - regr_r2(place, t)) * (count(*) - 1) / nullif(count(*) - 2, 0), 'nan'::double) as rsq from rg group by movie, bin),
k1 as (select bn.* from bn join (select movie, avg(n) as usual from (select distinct movie, n from bn) group by movie) u using (movie) where n >= usual - 1e-9),
{_missing_sql("k1", "1")}, k2 as (select k1.* from k1 join w1 using (movie) join al using (movie) where whole or k - n <= 4), {_missing_sql("k2", "2")},
en as (select movie, whole, case when bins < 2 or not whole then 1 else f end as f, case when bins < 2 or not whole then k else l end as l from w2 join al using (movie)),
mk as (select k2.movie, k2.bin, slope, rsq, whole, xf.xpos as xpos_first, xl.xpos as xpos_last, rf.t as t_first, rl.t as t_last, rf.t - rl.t as delta from k2 join en using (movie) join ix xf on xf.movie = k2.movie and xf.place = f join ix xl on xl.movie = k2.movie and xl.place = l
  left join rg rf on rf.movie = k2.movie and rf.bin = k2.bin and rf.place = f left join rg rl on rl.movie = k2.movie and rl.bin = k2.bin and rl.place = l)
select movie, bin, xpos_first, xpos_last, t_first, t_last, delta, case when delta = 0 and rsq > 0.15 and slope <> 0 then (slope > 0)::int when delta is not null then (delta > 0)::int when not whole and slope <> 0 then (slope < 0)::int end as direction,
round(slope, 5) + 0.0 as slope, round((xpos_last - xpos_first) * 0.65 / nullif(delta * 0.01, 0), 4) + 0.0 as speed, round(rsq, 5) as rsq from mk""")
def beat_direction(spark, d):
    """Direction marks of seven movies from the brightness of their positions: the whole chain."""
    frames = _frames(spark, d)
    found = direction.beat_directions(frames, _movies(spark, d, frames), ["movie"], "xpos", "t", "v", smooth=4, reach=3)
    return found.select("movie", F.col("bin").cast("long").alias("bin"), "xpos_first", "xpos_last", "t_first", "t_last", "delta", "direction", _r(F.col("slope"), "slope", 5), _r(F.col("speed"), "speed", 4), _r(F.col("rsq"), "rsq", 5))


@query(f"""{_E}, f as (select user_id % 7 as movie, rn as t, bool_or(s < 0 and x > 150) as peak from (select *, {_SLOPE} as s from e) group by 1, 2),
a as (select *, count(*) filter (where peak) over (partition by movie order by t rows between current row and 2 following) as c, row_number() over (partition by movie order by t) as k from f),
g as (select *, k - row_number() over (partition by movie order by k) as i from a where c = 0) select movie, round_even((min(k) + max(k)) / 2.0, 0)::bigint as border from g group by movie, i""")
def beat_borders(spark, d):
    peaks = events(spark, d).withColumns({"p": series.local_extrema(S, "x") & (F.col("x") > 150), "t": S.number()}).where("p").select((F.col("user_id") % 7).alias("movie"), "t")
    movies = events(spark, d).groupBy("user_id").agg(F.count("*").alias("frames")).groupBy((F.col("user_id") % 7).alias("movie")).agg(F.max("frames").alias("frames"))
    return direction.borders(peaks, ["movie"], "t", 2, movies)


@query(f"""{_E}, {_MOVIES}, pk as (select user_id % 7 as movie, user_id as xpos, rn as t from (select *, {_SLOPE} as s from e) where s < 0 and x > 150), {_STEPS} select movie, border from bo""")
def adaptive_beat_borders(spark, d):
    """Borders with a window of each recording's own, from the spread of its peaks."""
    frames = events(spark, d).select((F.col("user_id") % 7).alias("movie"), F.col("user_id").alias("xpos"), S.number().alias("t"), (series.local_extrema(S, "x") & (F.col("x") > 150)).alias("peak"))
    peaks = frames.where("peak")
    wanted = direction.wanted(peaks, frames.select("movie", "xpos").distinct(), ["movie"], "xpos", "t")
    return direction.adaptive_borders(peaks, _movies(spark, d, frames), ["movie"], "t", wanted)


@query("""with c as (select label as movie, (1 + vec_id % 50)::bigint as x, vec_id // 50 as t, embedding[1:22] || embedding[42:64] as rim from embeddings),
pl as (select distinct label as movie, unnest(list_distinct(list_transform(list_concat(range(2, 26, 2), [(25 + label % 5)::bigint]), lambda k: least(greatest(k, 21), 29)))) as xpos from embeddings)
select movie, xpos, t, round(sum(list_sum(list_transform(rim, lambda v: v::double))) / sum(len(rim)), 6) + 0.0 as profile from c join pl using (movie) where abs(x - xpos) <= 20 group by movie, xpos, t""")
def stripe_profiles(spark, d):
    """Brightness at the rims around each position; vectors stand for image columns of 64 rows."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("movie"), (1 + F.col("vec_id") % 50).alias("x"), F.floor(F.col("vec_id") / 50).alias("t"), F.col("embedding").cast("array<double>").alias("col"))
    movies = e.groupBy("movie").agg(F.lit(64).alias("height")).withColumn("places", direction.positions(F.lit(50), F.array(25 + F.col("movie") % 5)))
    found = direction.stripes(e, movies, ["movie"])
    return found.select("movie", "xpos", "t", _r(F.col("profile"), "profile"))


_AREAS = f"""with recursive {_E[5:]}, br as (select *, (x >= avg(x) over (partition by user_id))::int as b from e),
pad as (select user_id, rn, b, n from br union all select user_id, n + unnest(range(1, 6)), b, n from br where rn = n),
ct as (select user_id, rn, n, b, sum(b) over (partition by user_id order by rn rows between current row and 5 following) as k from pad),
ed as (select user_id, list(rn order by rn) as es from ct where rn <= n and k = 3 group by user_id),
hd as (select ed.user_id, es, list_distinct(list(b) filter (where rn <= es[1])) as kinds, max(b) filter (where rn = 1) as b1, max(b) filter (where rn = es[1]) as be from ed join br using (user_id) group by all),
bs as (select user_id, case when (case when len(kinds) = 1 then b1 else be end) = 1 then list_concat([1::bigint], es) else es end as b from hd),
f as (select user_id, b from bs union all select user_id, b[3:] from f where len(b) >= 2 and b[2] - b[1] < 5),
ar as (select user_id, 1 as area, b[1] as a, b[2] as z from f where len(b) >= 2 and b[2] - b[1] >= 5 union all select user_id, 2, b[3], b[4] from f where len(b) >= 4 and b[2] - b[1] >= 5)"""


@query(f"{_AREAS} select user_id, area, a as first, z as last from ar")
def bright_areas(spark, d):
    """Bright areas of recordings whose frames stand for image columns; SQL takes borders off two by two."""
    found = areas.bright_areas(areas.borders(_columns(spark, d), ["user_id"], "rn", "x", 6), ["user_id"], 5)
    return found.select("user_id", "area", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def _columns(spark, d) -> DataFrame:
    return events(spark, d).select("user_id", S.number().cast("long").alias("rn"), "x")


@query(f"""{_AREAS}, ins as (select e.user_id, e.rn, ar.area, greatest(x, quantile_cont(x, 0.75) over (partition by e.user_id, ar.area)) as v from e join ar on ar.user_id = e.user_id and e.rn between a and z),
pk as (select * from (select *, sign((lead(v) over o) - v) - sign(v - (lag(v) over o)) as s, max(v) over (partition by user_id, area order by rn rows between 3 preceding and 1 preceding) as l, max(v) over (partition by user_id, area order by rn rows between 1 following and 3 following) as r from ins window o as (partition by user_id, area order by rn)) where s < 0 and v >= l and v >= r),
tp as (select user_id, area, v, min(rn) as rn from (select *, row_number() over (partition by user_id, area order by v desc, rn) as k from pk) where k <= 3 group by user_id, area, v),
ps as (select user_id, least(rn + 1, (select max(n) from e where e.user_id = tp.user_id)) as xpos, min({{'area': area, 'v': -v}}) as o from tp group by all)
select user_id, row_number() over (partition by user_id order by o, xpos) as peak_no, xpos from ps""")
def kymograph_positions(spark, d):
    """Columns at which kymographs of these recordings are cut."""
    columns = _columns(spark, d)
    found = areas.kymograph_positions(columns, areas.bright_areas(areas.borders(columns, ["user_id"], "rn", "x", 6), ["user_id"], 5), ["user_id"], "rn", "x")
    return found.select("user_id", F.col("peak_no").cast("long").alias("peak_no"), "xpos")


_TURNED = f"""with e0 as (select user_id, event_id, ts, round(-value * 100) as d, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as n from events),
lo as (select *, min(d) over (partition by user_id order by rn rows between 5 preceding and 5 following) as lo from e0), hg as (select *, max(lo) over (partition by user_id order by rn rows between 5 preceding and 5 following) as hi from lo),
e as (select user_id, event_id, ts, rn, n, d, d - avg(hi) over (partition by user_id order by rn rows between 5 preceding and 5 following) as x from hg){_BEATS[len(_E):]}"""


def _of_recordings(spark, d):
    traces = events(spark, d).select("user_id", "event_id", "ts", F.round(F.col("x") * 100).alias("distance")).withColumn("t", S.number() - 1)
    return beats.of_recordings(traces, S, "t", "distance", WIDTH, 5, 5, digits=0)


@query(f"""{_TURNED} select b.user_id, beat, start, peak, "end", a.d as start_x, p.d as peak_x from b join e a on a.user_id = b.user_id and a.rn = b.start_place join e p on p.user_id = b.user_id and p.rn = b.peak + 1""")
def corrected_beats(spark, d):
    """Beats found on the baseline-corrected series, with the diameters of the original one."""
    _, found = _of_recordings(spark, d)
    return found.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("beat", "start", "peak", "end")), "start_x", "peak_x")


@query(f"""{_TURNED}, ed as (select b.user_id, -median(a.d) as edd from b join e a on a.user_id = b.user_id and a.rn = b.start_place group by b.user_id),
tr as (select e.user_id, b.beat, e.rn, e.d, e.rn - b.start_place as tm, e.d - first_value(e.d) over (partition by e.user_id, b.beat order by e.rn) as rise from e join b on e.user_id = b.user_id and e.rn between b.start_place and b.end_place),
nr as (select *, case when max(rise) over (partition by user_id, beat) = 0 then rise else rise / max(rise) over (partition by user_id, beat) end as rel, coalesce(rise - lag(rise) over (partition by user_id, beat order by rn), 0) as vel, row_number() over (partition by user_id, beat order by rn) as k from tr),
tt as (select * from (select *, min(case when vel <> 0 then k end) over (partition by user_id, beat) as mv from nr) where k >= coalesce(mv - 1, 1)),
ct as (select *, count(*) over (partition by user_id, beat) as m from tt)
select ct.user_id, beat, tm - min(tm) over (partition by ct.user_id, beat) as time, round(rel, 6) + 0.0 as distance, -d as diameter, rn - 1 as timestamp, rise as delta, edd - rise as from_edd, vel as velocity from ct join ed using (user_id) where m > 3""")
def transient_table(spark, d):
    """The rows of beats with all published columns."""
    found = beats.transients(*_of_recordings(spark, d), S, "t", more_than=3)
    return found.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("beat", "time", "timestamp")), _r(F.col("distance"), "distance"), *((F.col(c) + F.lit(0.0)).alias(c) for c in ("diameter", "delta", "velocity")), (F.col("from_EDD") + F.lit(0.0)).alias("from_edd"))


@query(f"""{_ROWS}, a as (select *, (relative + lead(relative) over (partition by user_id, beat order by rn)) / 2 as part from r), s as (select user_id, beat, sum(part) as auc from a group by user_id, beat)
select user_id, beat, round(auc, 6) + 0.0 as auc from s where auc is not null""")
def usual_areas(spark, d):
    """Beats whose area is known and lies between the outermost quartiles of its series, as all known ones do."""
    found = beats.of_usual_area(beats.auc(beat_rows(spark, d), ("user_id", "beat"), "place"), ("user_id",))
    return found.select("user_id", F.col("beat").cast("long").alias("beat"), _r(F.col("auc"), "auc"))


_SPREAD = ", ".join(f"median({c}) as {c}_median, stddev_samp({c}) as {c}_sd" for c in ("peaked", "tt50p", "tt50r"))


@query(f"""{_ROWS}{_INTERVALS[len(_BEATS):]}, {_MARKED}, a as (select user_id, {_SPREAD} from lm group by user_id), h as (select user_id, median(hp) as hp, stddev_samp(hp) as hp_sd, median(si) as si from i3 group by user_id),
dv as (select user_id, 1.4826 * median(abs(hp - mid)) as hp_mad from (select user_id, hp, median(hp) over (partition by user_id) as mid from i3) group by user_id)
select user_id, round(peaked_median, 6) as peaked_median, round(peaked_sd, 6) as peaked_sd, round(tt50p_median, 6) as tt50p_median, round(tt50r_sd, 6) as tt50r_sd, round(h.hp, 6) as hp_median, round(si, 6) as si_median, round(hp_mad, 6) as hp_mad, round(h.hp - peaked_median, 6) as relaxtime, round(hp_sd / h.hp, 6) as ai
from a left join h using (user_id) left join dv using (user_id)""")
def transients_joined(spark, d):
    """Landmarks of each recording joined with its intervals and their spread."""
    marks = beats.landmarks(beat_rows(spark, d), ("user_id", "beat"))
    found = tables.joined_transients(marks, all_intervals(spark, d).select("user_id", "SI", "HP", "DI"), ["user_id"])
    return found.select("user_id", *(_r(F.col(c), n) for c, n in (("peaked_median", "peaked_median"), ("peaked_sd", "peaked_sd"), ("tt50p_median", "tt50p_median"), ("tt50r_sd", "tt50r_sd"), ("HP_median", "hp_median"), ("SI_median", "si_median"), ("HP_mad", "hp_mad"), ("relaxtime", "relaxtime"), ("AI", "ai"))))


@query(f"""{_D}, g as (select user_id, corr(d, l) as a, stddev_samp(d) as s from d2 group by user_id), m as (select median(a) as ma, median(s) as ms from g) select user_id, case when a >= ma and s >= ms then 'ok' else 'bad' end as quality from g, m""")
def qc_ok_or_bad(spark, d):
    return qc.ok_or_bad(qc.trace_metrics(events(spark, d), S, "x"), "autocorr_x", "smooth_x").select("user_id", "quality")


@query(f"{_BEATS} select user_id, beat, start, peak, \"end\", start_x, peak_x, end_x from b")
def beats_from_store(spark, d):
    """Beats read from a table that is bucketed and sorted by series: no shuffle on the way."""
    path = writers.shared(spark)
    stored = writers.series_store(events(spark, d), ["user_id"], ["ts", "event_id"], f"series_{path[-32:]}", path, 8)
    found = beats.find_beats(beats.turning_points(stored.withColumn("t", S.number() - 1), S, "x", WIDTH), S, "x", "t")
    return found.select("user_id", F.col("beat").cast("long").alias("beat"), *(F.col(c).cast("long").alias(c) for c in ("start", "peak", "end")), "start_x", "peak_x", "end_x")


_QUALITY = f"""with q0 as (select 'G' || user_id % 5 || '_' || user_id || '_1wm.cxd_peak_1_at Xpos_' || user_id % 90 || '.tiff.csv' as csv, user_id % 40 as mv, case when user_id % 11 = 0 then 1.0::double else value end as up, row_number() over (partition by user_id order by ts, event_id) as t, event_id from events),
q1 as (select *, (event_id * 7 % 101)::double as down, sqrt(t::double) * 10 as distance, sqrt(t::double) * case when mv % 3 = 0 then 1 else (t % 2) end as distance_norm from q0),
q2 as (select *, up - lag(up) over w as du, down - lag(down) over w as dd, distance - lag(distance) over w as di, distance_norm - lag(distance_norm) over w as dn from q1 window w as (partition by csv order by t)),
q3 as (select *, lag(du) over w as eu, lag(dd) over w as ed, lag(di) over w as ei, lag(dn) over w as en from q2 window w as (partition by csv order by t)),
q4 as (select csv, stddev_samp(du) as su, stddev_samp(dd) as sd_, case when stddev_samp(du) > 0 then corr(du, eu) end as cu, corr(dd, ed) as cd, corr(di, ei) as ci, corr(dn, en) as cn from q3 group by csv),
q5 as (select csv, case when su = 0 or sd_ = 0 then 10 else su end as smoothie_up, case when su = 0 or sd_ = 0 then 10 else sd_ end as smoothie_down, case when su = 0 or sd_ = 0 then 100 else abs(sd_ - su) / sqrt(2.0) end as sd, case when su = 0 or sd_ = 0 then 0 else ci end as dist_cor,
  case when su = 0 or sd_ = 0 then 0 else cn end as norm_dist_cor, case when su = 0 or sd_ = 0 then 0 else cu end as autocorr_up, case when su = 0 or sd_ = 0 then 0 else cd end as autocorr_down from q4),
q6 as (select *, case when autocorr_up > (select median(autocorr_up) from q5) * 0.9 and autocorr_down > (select median(autocorr_down) from q5) * 0.9 and sd < (select median(sd) from q5) * 1.5 then 'excellent' when dist_cor > 0.6 and sd < 4 and norm_dist_cor > 0.6 then 'good' else 'n.t.' end as quality from q5)"""


def _quality(spark, d) -> DataFrame:
    u = F.col("user_id")
    e = events(spark, d).withColumn("t", S.number())
    csv = F.concat(F.lit("G"), (u % 5).cast("string"), F.lit("_"), u.cast("string"), F.lit("_1wm.cxd_peak_1_at Xpos_"), (u % 90).cast("string"), F.lit(".tiff.csv"))
    root = F.sqrt(F.col("t").cast("double"))
    traces = e.select(csv.alias("csv"), "t", F.when(u % 11 == 0, 1.0).otherwise(F.col("x")).alias("up"), (F.col("event_id") * 7 % 101).cast("double").alias("down"), (root * 10).alias("distance"), (root * F.when(u % 40 % 3 == 0, 1).otherwise(F.col("t") % 2)).alias("distance_norm"))
    return qc.quality_table(traces)


@query(f"{_QUALITY} select csv, split_part(csv, '_', 1) as \"CODE\", regexp_extract(csv, 'Xpos_([0-9]+)', 1)::int as \"Xpos\", quality, round(smoothie_up, 5) as smoothie_up, round(sd, 5) + 0.0 as sd, round(dist_cor, 5) + 0.0 as dist_cor, round(autocorr_down, 5) + 0.0 as autocorr_down from q6")
def quality_table(spark, d):
    """The published quality classes with the metrics behind them; some traces have an edge that never moves."""
    return _quality(spark, d).select("csv", "CODE", "Xpos", "quality", *(_r(F.col(c), c, 5) for c in ("smoothie_up", "sd", "dist_cor", "autocorr_down")))


@query(f"""{_QUALITY}, m as (select *, regexp_extract(csv, '^(.*?[.]cxd)', 1) as cxd from q6), c as (select cxd, count_if(quality = 'excellent') as best, count_if(quality = 'good') as value from m group by cxd)
select c.cxd, value, csv, round(sd, 5) + 0.0 as sd from c join m on m.cxd = c.cxd and quality = 'good' where best = 0""")
def rescued_with_quality(spark, d):
    """Good traces of movies without an excellent one, with the columns of the quality table."""
    return qc.rescued(_quality(spark, d)).select("cxd", "value", "csv", _r(F.col("sd"), "sd", 5))


@query(f"""{_QUALITY}, m as (select *, regexp_extract(csv, '^(.*?[.]cxd)', 1) as cxd from q6), k as (select unnest(['excellent', 'good', 'n.t.']) as quality) select k.quality, x.cxd, count(m.csv) as value from (select distinct cxd from m) x cross join k left join m on m.cxd = x.cxd and m.quality = k.quality group by all""")
def quality_tally(spark, d):
    return qc.tally(_quality(spark, d)).select("quality", "cxd", "value")


_EDGE = "select label, vec_id, v, y from (select label, vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as y from embeddings)"


def _edge_sql(y: str, sign: str) -> str:
    return f"""with c as ({_EDGE}), o as (select label, vec_id, {y} as y from (select *, avg(v) over (partition by label, vec_id) as m from c) where v > m), f as (select label, vec_id, min(y) as first from o group by all),
l as (select label, avg(first) - coalesce(stddev_samp(first), 0) as lim from f group by label), n as (select f.label, any_value(lim) as lim, count_if(first <= lim) as off from f join l using (label) group by f.label)
select label, vec_id, {sign} (case when any_value(off) > 0 then coalesce(min(case when y > lim then y end), min(y)) else min(y) end)::bigint as edge from o join n using (label) group by label, vec_id"""


def _edges(spark, d, lower: bool):
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("t"), F.posexplode("embedding").alias("i", "v"))
    found = signal.repaired_edge(e.select("label", "t", (F.col("i") + 1).cast("long").alias("y"), F.col("v").cast("double").alias("v")), ["label"], "v", lower=lower)
    return found.select("label", F.col("t").alias("vec_id"), "edge")


@query(_edge_sql("y", ""))
def repaired_upper_edge(spark, d):
    return _edges(spark, d, lower=False)


@query(_edge_sql("-(y - 1)", "-"))
def repaired_lower_edge(spark, d):
    return _edges(spark, d, lower=True)
