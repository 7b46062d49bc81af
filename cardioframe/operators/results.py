"""The final tables: from a catalog of recordings, their beats and landmarks, and movies' metadata to tables of recordings, flies and genotypes.

Everything is joined by key (``index`` names a recording, ``cxd_file`` a movie, ``flyID`` a fly), never by position. Within the library
columns have plain names; published() gives them the names of the result files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, naming, stats
from . import blocks, joins, tables

MARKS = ("peaked", "tt10p", "tt25p", "tt50p", "tt75p", "tt90p", "tt90r", "tt75r", "tt50r", "tt25r", "tt10r")
SPANS = ("starts", "peaks", "ends", "SI", "deltaSI", "deltaSIplus", "HP", "DI")
DIRECTIONS = ("anterograde_percent", "anterograde_speed", "retrograde_speed")
#: Columns of the result files, in their order. Fixed values.
META_COLUMNS = (*tables.META_KEYS, "filename", "CODE", "flyID", "recordingday", "week_year", "cxd_date", "cxd_file", "cxd_recordingday", "cxd_week_year")
ALL_COLUMNS = (
    "flyID", "file", "EDD", "ESD", "FS", "HR", "min_velocity", "max_velocity", "CODE_long", "CODE_x", "human_gene", "fly_gene", "type", "cross", "ID_number", "Xpos",
    *tables.META_KEYS, "filename", "CODE_y", "recordingday", "week_year", "cxd_date", "cxd_file", "cxd_recordingday", "cxd_week_year",
)
ADDED_COLUMNS = ("Genotype", "Genotype_filename", "AI", "MAD_tt10r", "SV", "CO", "segment", "jpg_noX", *DIRECTIONS)
MEASURE_COLUMNS = (
    "EDD", "ESD", "FS", "HR", "HP_median", "DI_median", "relaxtime", "SI_median", "peaked_median", "min_velocity", "max_velocity", "MAD_SI", "MAD_HP", "MAD_DI",
    *(f"{m}_median" for m in MARKS[1:]), "deltaSI_median", "deltaSIplus_median", "AI", "MAD_tt10r", "SV", "CO", "anterograde_percent",
)
FINAL_COLUMNS = (
    "CODE", "CODE_long", "flyID", "type", "cross", "cxd_file", "cxd_recordingday", "cxd_week_year", "human_gene", "fly_gene", "Xpos", "Age", "Sex",
    *MEASURE_COLUMNS, "segment", "file", "ID_number", "time_interval", "resolution", "filename", "cxd_date", "Genotype", "Genotype_filename", "jpg_noX", "anterograde_speed", "retrograde_speed", "stocks",
)
FLY_ATTRIBUTES = ("CODE", "CODE_long", "type", "cross", "cxd_file", "cxd_recordingday", "cxd_week_year", "human_gene", "fly_gene", "Age", "Sex", "time_interval", "resolution", "filename", "cxd_date", "Genotype", "Genotype_filename", "stocks")
_PUBLISHED = {"min_velocity": "min.velocity", "max_velocity": "max.velocity", "CODE_x": "CODE.x", "CODE_y": "CODE.y"}


def published(df: DataFrame) -> DataFrame:
    """The names of columns in the result files."""
    return df.select(*(F.col(c).alias(_PUBLISHED.get(c, c)) for c in df.columns))


def meta_table(wide: DataFrame, file_dates: DataFrame | None = None) -> DataFrame:
    """meta_data_all. wide: file (a metadata dump's name) and the keys of tables.META_KEYS; file_dates: cxd_file and cxd_date (seconds) of an optional list.

    A listed date is taken from the list's first file of the same fly; a movie without one has the date of its metadata, and is named by its own file.
    """
    name = F.col("file")
    seconds = F.col("created_unix_from_file").cast("long")
    base = wide.select(*tables.META_KEYS, name.alias("filename"), naming.code(name).alias("CODE"), naming.stem(name).alias("flyID"), dates.day(seconds).alias("recordingday"))
    base = base.withColumn("week_year", dates.year_week(F.col("recordingday")))
    own = F.regexp_replace("filename", r"_new_meta_data\.csv$", "")
    if file_dates is None:
        dated = base.withColumns({"__date": F.lit(None).cast("string"), "cxd_file": own})
    else:
        listed = file_dates.select(naming.stem(F.col("cxd_file")).alias("flyID"), F.col("cxd_file"), F.col("cxd_date").cast("string").alias("__date"))
        dated = base.join(joins.first_per_key(listed, ["flyID"], ["cxd_file"]), "flyID", "left")
    date = F.coalesce(F.col("__date"), F.col("created_unix_from_file").cast("string"))
    day = dates.day(date.try_cast("long"))
    return dated.withColumns({"cxd_date": date, "cxd_recordingday": day}).withColumn("cxd_week_year", dates.week_and_year(F.col("cxd_recordingday"))).select(*META_COLUMNS)


def recordings(catalog: DataFrame, beats: DataFrame, velocities: DataFrame, timing: DataFrame, directions: DataFrame) -> DataFrame:
    """The catalog's rows with EDD, ESD and FS (medians of their beats), max_velocity and min_velocity (means of their beats'), HR, coverage, and the directions of their movie.

    beats: index, DD, SD and the spans; velocities: index, max_velocity, min_velocity of each beat; timing: index, HR, coverage; directions: cxd_file, DIRECTIONS, reversals
    """
    size = beats.groupBy("index").agg(F.median("DD").alias("EDD"), F.median("SD").alias("ESD"), F.median(stats.fractional_shortening(F.col("DD"), F.col("SD"))).alias("FS"))
    speed = velocities.groupBy("index").agg(F.avg("max_velocity").alias("max_velocity"), F.avg("min_velocity").alias("min_velocity"))
    out = catalog
    for part, key in ((size, "index"), (speed, "index"), (timing.select("index", "HR", "coverage"), "index"), (directions.select("cxd_file", *DIRECTIONS, "reversals"), "cxd_file")):
        out = out.join(part, key, "left")
    return out


def all_data(found: DataFrame, meta: DataFrame) -> DataFrame:
    """recordings() beside the metadata of their movie. found: recordings()."""
    named = found.select(
        "flyID", F.col("jpg").alias("file"), "EDD", "ESD", "FS", "HR", "min_velocity", "max_velocity", F.col("CODED").alias("CODE_long"), F.col("CODE").alias("CODE_x"), F.col("symbol_human").alias("human_gene"), F.col("symbol_fly").alias("fly_gene"),
        "type", "cross", F.col("IDnumber").alias("ID_number"), "Xpos", "cxd_file", F.col("CODE").alias("CODE_y"),
    )
    return named.join(meta.drop("CODE", "flyID"), "cxd_file", "left").select(*ALL_COLUMNS)


def parameters(found: DataFrame, beats: DataFrame, landmarks: DataFrame) -> DataFrame:
    """jpg and what is added to each recording: AI, MAD_tt10r, SV, CO, segment, jpg_noX and directions. A segment is told by the mean of all different positions."""
    rhythm = beats.groupBy("index").agg(stats.arrhythmia_index(F.col("HP")).alias("AI"))
    slow = stats.mad(landmarks, ["index"], ["tt10r"]).withColumnRenamed("tt10r_mad", "MAD_tt10r")
    out = tables.segment(tables.heart_output(found), "Xpos").join(rhythm, "index", "left").join(slow, "index", "left")
    return out.select("jpg", F.col("CODED").alias("Genotype"), F.col("CODE").alias("Genotype_filename"), "AI", "MAD_tt10r", "SV", "CO", "segment", naming.masked_peak(F.col("jpg")).alias("jpg_noX"), *DIRECTIONS)


def with_parameters(everything: DataFrame, added: DataFrame) -> DataFrame:
    """all_data_table."""
    return everything.join(added.withColumnRenamed("jpg", "file"), "file", "left").select(*ALL_COLUMNS, *ADDED_COLUMNS)


def transients(catalog: DataFrame, landmarks: DataFrame, beats: DataFrame) -> DataFrame:
    """jpg and, of each recording: medians and standard deviations of landmarks and spans, relaxtime, MAD_SI, MAD_HP and MAD_DI. Recordings without landmarks have no row."""
    marks, spans = stats.median_and_sd(landmarks, ["index"], list(MARKS)), stats.median_and_sd(beats, ["index"], list(SPANS))
    spread = stats.mad(beats, ["index"], ["SI", "HP", "DI"], "").select("index", *(F.col(c).alias(f"MAD_{c}") for c in ("SI", "HP", "DI")))
    found = tables.relaxation(marks.join(spans, "index", "left")).join(spread, "index", "left")
    return found.join(catalog.select("index", "jpg"), "index").drop("index")


def final(table: DataFrame, merged: DataFrame, mapping: DataFrame) -> DataFrame:
    """final_all_data: all_data_table beside transients(), its columns in the published order, with the stocks of each code. mapping: CODE, stocks.

    Of rows with the same file the first (by its values) stays, as published; names then lose their peak number.
    """
    file = F.col("file")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by the names that the result has, so that the join, the first rows and the different rows take one shuffle
    dealt = lambda df: df.withColumn("__masked", naming.masked_peak(file)).repartition(parts, "__masked")
    other = dealt(merged.withColumnRenamed("jpg", "file")).withColumnsRenamed({"file": "__file", "__masked": "__name"})
    # a name lies between itself and itself: as an equal key it would be asked for in the shuffle too
    same = (F.col("__masked") == F.col("__name")) & F.col("__file").between(file, file)
    both = dealt(table).join(other, same, "left").drop("__file", "__name").withColumns({"Age": naming.age(file), "Sex": naming.sex(file), "CODE": F.col("CODE_x")})
    one = joins.first_per_key(both, ["__masked", "file"], ["cxd_file", "EDD", "ESD", "HR"])
    stock = joins.lookup(one, mapping.select(naming.mapping_code(F.col("CODE")).alias("CODE"), "stocks"), "CODE", ["stocks"])
    return stock.drop("file").withColumnRenamed("__masked", "file").select(*FINAL_COLUMNS).distinct()


def flies(recorded: DataFrame, reversals: DataFrame | None = None) -> DataFrame:
    """Medians of each fly's recordings with each different set of its attributes, and, if they are given, median and standard deviation of its different reversals.

    recorded: rows of final(); reversals: flyID, reversals
    """
    measures = [*MEASURE_COLUMNS, "anterograde_speed", "retrograde_speed"]
    out = tables.per_fly(recorded, "flyID", measures, list(FLY_ATTRIBUTES))
    if reversals is not None:
        turned = reversals.select("flyID", "reversals").distinct().groupBy("flyID").agg(F.median("reversals").alias("reversals_median"), F.stddev_samp("reversals").alias("reversals_SD"))
        out = out.join(turned, "flyID", "left")
    return out


def genotypes(found: DataFrame) -> DataFrame:
    """master_table: means and standard deviations of the recordings of each genotype, HR in beats a second."""
    spread = {"coverage": "SDcoverage", "HR": "SDHR", "EDD": "SDEDD", "ESD": "SDESD", "FS": "SDFS", "max_velocity": "SDMV", "min_velocity": "SDMinV"}
    first = lambda c, name: F.min(c).alias(name)  # noqa: E731  one value for each genotype
    numbers = [a for c, sd in spread.items() for a in (F.avg(c).alias(c), F.stddev_samp(c).alias(sd))]
    out = found.groupBy(F.col("CODED").alias("Code")).agg(F.count("*").alias("n"), first("cross", "Cross"), first("type", "type"), first("symbol_human", "human"), first("symbol_fly", "fly"), *numbers)
    pair = naming.last(F.col("Code"), 2)
    out = out.withColumns({"AgeSex": pair, "Sex": naming.last(F.col("Code"), 1), "Age": F.substring(pair, 1, 1)})
    return out.select("Code", "n", "Cross", "type", "human", "fly", "AgeSex", "Sex", "Age", *(c for pair in spread.items() for c in pair))


def measure(found: DataFrame, name: str) -> DataFrame:
    """One measure of all recordings: it, L1 (genotype), CODE, human, fly, type."""
    return found.select(name, F.col("CODED").alias("L1"), naming.without_age_sex(F.col("CODED")).alias("CODE"), F.col("symbol_human").alias("human"), F.col("symbol_fly").alias("fly"), "type")


def assemble(catalog: DataFrame, mapping: DataFrame, meta: DataFrame, beats: DataFrame, velocities: DataFrame, landmarks: DataFrame, timing: DataFrame, directions: DataFrame) -> dict[str, DataFrame]:
    """All result tables by name; what several of them share is worked out once and staged."""
    from ..sources import writers

    found = writers.staged(recordings(catalog, beats, velocities, timing, directions))
    everything = writers.staged(all_data(found, meta))
    table = writers.staged(with_parameters(everything, parameters(found, beats, landmarks)))
    writers.dropped(everything)
    last = writers.staged(final(table, transients(catalog, landmarks, beats), mapping))
    part = lambda s: last.where(F.col("segment") == s)
    out = {"meta_data_all": meta, "master_table": genotypes(found), **{f"{m}_data": measure(found, m) for m in tables.MEASURES}, "all_data_table": table, "final_all_data": last}
    out["final_all_data_per_fly"] = flies(last, found.select("flyID", "reversals"))
    for s in ("anterior", "posterior"):
        out |= {f"final_all_data_{s}": part(s), f"final_all_data_per_fly_{s}": flies(part(s))}
    return {name: published(df) for name, df in out.items()}


def ordinals(df: DataFrame, label: str, name: str) -> DataFrame:
    """The different values of ``label`` with their place among them in order, from 1; nulls have none. No task sorts all of them."""
    return blocks.numbered(df.select(label).where(F.col(label).isNotNull()).distinct(), [], [label], name)


def _numbered_by(df: DataFrame, label: Column, other: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(other.select(F.col(key).alias("__key"), name), label == F.col("__key"), "left").drop("__key")


def catalog(files: DataFrame, mapping: DataFrame, jpg: str = "jpg") -> DataFrame:
    """file_catalog: names of recordings taken apart, with the mapping's columns and the numbers recordings go by.

    mapping: CODE, cross, type, fly, human. index: place of a name among all; i: place of its genotype; j: place within the genotype. sorting and group number the
    mapping's different human symbols and types in order, as levels are.
    """
    name = F.col(jpg)
    csv = naming.trace_file(name)
    parts = files.select(name.alias("jpg"), csv.alias("file"), naming.coded(csv).alias("Genotype"), naming.code(csv).alias("Genotype_filename"), naming.age(csv).alias("Age_filename"), naming.sex(csv).alias("Sex_filename"), naming.comment(csv).alias("comment"))
    parts = parts.withColumns({"CODED": F.col("Genotype"), "CODE": F.col("Genotype_filename"), "IDnumber": naming.number(F.col("file")), "flyID": naming.fly_id(F.col("file")), "Xpos": naming.xpos(F.col("file")), "cxd_file": naming.movie(F.col("file"))})
    dim = mapping.select(naming.mapping_code(F.col("CODE")).alias("CODE"), "cross", "type", F.col("fly").alias("symbol_fly"), F.col("human").alias("symbol_human"))
    dim = _numbered_by(dim, F.col("symbol_human"), ordinals(dim, "symbol_human", "sorting"), "symbol_human", "sorting")
    dim = _numbered_by(dim, F.col("type"), ordinals(dim, "type", "group"), "type", "group")
    out = joins.lookup(parts, dim, "CODE", ["cross", "type", "symbol_fly", "symbol_human"])
    out = blocks.numbered(blocks.numbered(out, [], ["jpg"], "index"), ["Genotype"], ["index"], "j")
    out = _numbered_by(out, F.col("Genotype"), ordinals(out, "Genotype", "i"), "Genotype", "i")
    return out.select(
        "jpg", "file", "Genotype", "Genotype_filename", "Age_filename", "Sex_filename", "comment", "index", "CODED", "CODE", "cross", "type", "symbol_fly", "symbol_human", "sorting", "group", "IDnumber", "flyID", "i", "j", "Xpos", "cxd_file"
    )
