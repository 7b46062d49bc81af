"""From recordings to per-recording, per-fly and per-genotype tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, naming, stats
from . import joins

#: The keys of a movie's metadata, in their order.
META_KEYS = (
    "sizeX", "sizeY", "sizeZ", "sizeC", "sizeT", "pixelType", "bitsPerPixel", "imageCount", "dimensionOrder", "orderCertain", "rgb", "littleEndian", "interleaved",
    "falseColor", "metadataComplete", "thumbnail", "series", "resolutionLevel", "time_interval", "resolution", "created_unix_from_file",
)
MEASURES = ("EDD", "ESD", "FS", "HR", "min_velocity", "max_velocity")


def pivot_kv(kv: DataFrame, key: str, name: str = "L1", value: str = "value", names: tuple[str, ...] = META_KEYS) -> DataFrame:
    """A row for each recording, a column for each name; the pivot needs no pass to find the names."""
    return kv.groupBy(key).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "L1", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def scale_factor(factor: Column, magnification: Column, file: Column | None = None) -> Column:
    """Microns a pixel: a factor of 1 stands for 0.65, a missing magnification for 1; a missing factor is an error that names ``file``."""
    missing = F.raise_error(F.concat(F.lit("no calibration found: "), F.coalesce(file.cast("string") if file is not None else F.lit(None).cast("string"), F.lit("?")))).cast("double")
    return F.when(factor.isNull(), missing).when(factor == 1, 0.65).otherwise(factor) * F.coalesce(magnification, F.lit(1.0))


def movie_dates(meta: DataFrame) -> DataFrame:
    """Day and weeks of a recording from its camera time, a repaired one where it is missing."""
    seconds = dates.unix_seconds(F.coalesce(F.col("created"), F.lit(dates.CAMERA_EPOCH + 1)))
    return meta.withColumn("recordingday", dates.day(seconds)).withColumn("week_year", dates.year_week(F.col("recordingday")))


def usable_movies(files: DataFrame, least_bytes: int = 150_000_000, least_frames: int = 200, slowest: float = 0.010) -> DataFrame:
    """Movies that are large, long and fast enough; numbers compare as numbers."""
    return files.where((F.col("size") >= least_bytes) & (F.col("sizeT").cast("int") >= least_frames) & (F.col("time_interval").cast("double") <= slowest))


def segment(df: DataFrame, x: str) -> DataFrame:
    """posterior beyond the whole part of the mean of all different positions, else anterior."""
    middle = df.select(x).distinct().agg(F.floor(F.avg(x)).alias("__middle"))
    return joins.with_scalar(df, middle).withColumn("segment", F.when(F.col(x) > F.col("__middle"), "posterior").otherwise("anterior")).drop("__middle")


def joined_transients(landmarks: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each recording: medians and standard deviations of its landmarks and of its intervals, scaled MADs of SI, HP and DI, AI and relaxtime. Recordings without intervals keep nulls."""
    marks = stats.median_and_sd(landmarks, keys, [c for c in landmarks.columns if c not in (*keys, "beat")])
    spans = ["SI", "HP", "DI"]
    found = marks.join(stats.median_and_sd(intervals, keys, spans), keys, "left").join(stats.mad(intervals, keys, spans), keys, "left")
    return relaxation(found).withColumn("AI", F.try_divide("HP_sd", "HP_median"))


def per_fly(recordings: DataFrame, fly: str, measures: list[str], attributes: list[str]) -> DataFrame:
    """Medians of a fly's recordings, with its attributes, each different row once."""
    medians = recordings.groupBy(fly).agg(*(F.median(m).alias(m) for m in measures))
    return medians.join(recordings.select(fly, *attributes).distinct(), fly, "left").distinct()


def master_table(recordings: DataFrame, genotype: str, measures: list[str]) -> DataFrame:
    """Means and standard deviations of the measures of each genotype."""
    return recordings.groupBy(genotype).agg(F.count("*").alias("n"), *(f(m).alias(p + m) for m in measures for p, f in (("", F.avg), ("SD", F.stddev_samp))))


def heart_output(df: DataFrame) -> DataFrame:
    sv = stats.stroke_volume(F.col("EDD"), F.col("ESD"))
    return df.withColumn("SV", sv).withColumn("CO", sv * F.col("HR"))


def relaxation(df: DataFrame) -> DataFrame:
    return df.withColumn("relaxtime", F.col("HP_median") - F.col("peaked_median"))
