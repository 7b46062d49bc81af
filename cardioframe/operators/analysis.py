"""The stages in a row: movies to kymographs and directions, kymographs to traces and quality, traces to beats, beats to result tables.

Each stage takes tables and gives tables, so any of them can also begin with what another program made. What a later stage reads
several times is staged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from . import areas, beats, direction, images, qc, results, signal
from .series import Series

KEYS = ["recording"]
CUT = ["recording", "peak_no", "xpos"]
TRACE = Series(("csv",), ("t",))


@dataclass(frozen=True)
class Settings:
    """What the stages go by; the defaults are the published ones.

    window, least_width: of bright areas; sigma, mean, radius: of traces (no radius: no background is taken off); width: frames of the threshold; wm, ws: of the
    baseline; more_than: frames of a beat; step: of the spline's samples (none: landmarks from the samples themselves); side: of tiles
    """

    window: int = 30
    least_width: int = 60
    sigma: float = 1.5
    mean: int = 4
    radius: float | None = 50
    width: int = 400
    wm: int = 20
    ws: int = 20
    more_than: int = 10
    step: float | None = 0.0002
    side: int = images.SIDE


def cut_movies(columns: DataFrame, movies: DataFrame, how: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Kymographs (CUT, t from 0, col) at the brightest positions of each movie, and direction marks of its beats.

    columns: recording, t (from 0), x (from 1), col. movies: recording, width, height, frames, resolution, time_interval. A movie without bright areas has no
    kymograph; its directions come from the evenly spaced positions.
    """
    pixels = columns.select("recording", "t", "x", F.posexplode("col").alias("y", "v"))
    profile = writers.staged(areas.column_profile(signal.pixel_sd(pixels, KEYS), KEYS))
    found = areas.bright_areas(areas.borders(profile, KEYS, "x", "total", how.window), KEYS, how.least_width)
    positions = writers.staged(areas.kymograph_positions(profile, found, KEYS, "x", "area"))
    peaks = positions.groupBy("recording").agg(F.collect_set("xpos").alias("peaks"))
    marks = direction.movie_directions(columns, movies.join(peaks, "recording", "left"), KEYS)
    return writers.staged(areas.kymographs(columns, positions, KEYS)), writers.staged(marks)


def trace_kymographs(kymographs: DataFrame, movies: DataFrame, how: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Traces (csv, t and the columns of images.trace()) of kymographs, and their quality (qc.quality_table())."""
    scale = kymographs.select(*CUT).distinct().join(movies.select("recording", "resolution", "time_interval"), "recording")
    tiles = images.to_tiles(kymographs, CUT, side=how.side)
    found = images.trace_images(tiles, scale, CUT, how.sigma, how.mean, how.radius, how.side)
    name = F.concat("recording", F.lit("_peak_"), F.col("peak_no").cast("string"), F.lit("_at Xpos_"), F.col("xpos").cast("string"), F.lit(".tiff.csv"))
    traces = writers.staged(found.withColumn("csv", name))
    return traces, writers.staged(qc.quality_table(traces))


def usable(traces: DataFrame, quality: DataFrame) -> DataFrame:
    """Excellent traces, and good ones of movies that have none."""
    kept = quality.where("quality = 'excellent'").select("csv").unionByName(qc.rescued(quality).select("csv"))
    return traces.join(kept, "csv", "left_semi")


def analyse(columns: DataFrame, movies: DataFrame, metadata: DataFrame, mapping: DataFrame, how: Settings = Settings(), file_dates: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables (results.assemble()) of movies. metadata: file and the keys of tables.META_KEYS; mapping: CODE, cross, type, fly, human, stocks."""
    kymographs, marks = cut_movies(columns, movies, how)
    traces, quality = trace_kymographs(kymographs, movies, how)
    return tabulate(usable(traces, quality), marks, results.meta_table(metadata, file_dates), mapping, how)


def tabulate(traces: DataFrame, marks: DataFrame, meta: DataFrame, mapping: DataFrame, how: Settings = Settings()) -> dict[str, DataFrame]:
    """All result tables of traces (csv, t, time, distance), of direction marks (recording, bin, direction, speed) and of metadata (results.meta_table())."""
    frames, found = beats.of_recordings(traces.select("csv", "t", "time", "distance"), TRACE, "time", "distance", how.width, how.wm, how.ws)
    frames, found = writers.staged(frames), writers.staged(found)
    rows = writers.staged(beats.transients(frames, found, TRACE, "time", how.more_than))
    names = found.select("csv").distinct().select(F.regexp_replace("csv", r"\.csv$", "_traced.jpg").alias("jpg"))
    catalog = writers.staged(results.catalog(names, mapping))
    index = catalog.select("index", F.col("file").alias("csv"))
    spans = beats.intervals(found, TRACE.keys).join(index, "csv").select("index", "beat", (-F.col("start_x")).alias("DD"), (-F.col("peak_x")).alias("SD"), F.col("start").alias("starts"), F.col("peak").alias("peaks"), F.col("end").alias("ends"), *results.SPANS[3:])
    speeds = rows.groupBy("csv", "beat").agg(F.max("velocity").alias("max_velocity"), F.min("velocity").alias("min_velocity")).join(index, "csv").drop("csv")
    shape = rows.withColumnRenamed("distance", "relative")
    landmarks = beats.landmarks(shape, ("csv", "beat")) if how.step is None else signal.spline_landmarks(shape, ["csv", "beat"], step=how.step)
    timing = beats.timing(frames, TRACE, "time", found, rows).join(index, "csv").select("index", F.col("heart_rate").alias("HR"), "coverage")
    directions = direction.summarise(marks, KEYS, "bin").withColumnRenamed("recording", "cxd_file")
    return results.assemble(catalog, mapping, meta, writers.staged(spans), speeds, writers.staged(landmarks.join(index, "csv").drop("csv")), timing, directions)
