"""Readers of movies' files. Columns are chosen by name, listings are filtered by pattern, and file facts come from metadata without reading contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, naming
from ..operators import tables
from . import schemas

#: Metadata keys and the text before the separator in a dump that gives each.
DUMP_KEYS = {
    "sizeX": "Width", "sizeY": "Height", "sizeZ": "SizeZ", "sizeT": "SizeT", "pixelType": "Pixel type", "bitsPerPixel": "Valid bits per pixel",
    "dimensionOrder": "Dimension order", "orderCertain": "Dimension order", "rgb": "RGB", "littleEndian": "Endianness", "interleaved": "Interleaved",
}
#: What the format always has: fixed values.
CONSTANT_KEYS = {"sizeC": "1", "falseColor": "0", "metadataComplete": "1", "thumbnail": "0", "series": "1", "resolutionLevel": "1"}


def listing(spark: SparkSession, path: str, pattern: str = "*.cxd") -> DataFrame:
    """path, file, size and modified of files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", naming.base_name(F.col("path")).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def traces(spark: SparkSession, path: str, pattern: str = "*.csv", columns: tuple[str, ...] = ("time", "distance")) -> DataFrame:
    """Traces with the file and row number of each frame; only ``columns`` are parsed. Files must be in one split, as their rows are numbered."""
    rows = spark.read.schema(schemas.TRACE).option("header", True).option("pathGlobFilter", pattern).option("multiLine", True).csv(path)
    return rows.select(F.col("_metadata.file_name").alias("csv"), *columns)


def directions(spark: SparkSession, path: str) -> DataFrame:
    """Direction marks; the names of their first two columns are data, so the header is skipped."""
    return spark.read.schema(schemas.DIRECTION).option("header", True).option("enforceSchema", True).option("pathGlobFilter", "*_directionmarks.csv").csv(path).select(F.col("_metadata.file_name").alias("csv"), "*")


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """CODE, cross, type, fly, human and the stock columns; codes without underscores and byte-order mark."""
    raw = spark.read.schema(schemas.MAPPING).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(
        naming.mapping_code(F.col("CODE")).alias("CODE"), "cross", "type", F.col("Gene").alias("fly"), F.col("human ortholog").alias("human"),
        F.concat_ws(";", F.col("`Gal4-line`"), F.col("`UAS-line`"), F.col("Stock collection")).alias("stocks"),
    )


def file_dates(spark: SparkSession, path: str) -> DataFrame:
    """cxd_file and cxd_date of an optional list of tab-separated lines (path, date); short lines are read as far as they go.

    The first date of a name stays; of a date the text before its first blank counts. Without a list the table is empty.
    """
    from pyspark.errors import AnalysisException

    from ..operators.joins import first_per_key

    try:
        raw = spark.read.schema(schemas.FILE_DATES).option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.sql("select cast(null as string) as path, cast(null as string) as date where false")
    named = raw.select(naming.base_name(F.translate("path", "\\", "/")).alias("cxd_file"), F.substring_index("date", " ", 1).alias("cxd_date"))
    return first_per_key(named.where("cxd_file is not null"), ["cxd_file"], ["cxd_date"])


def metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, key and text of the lines of saved dumps, parted at the first ``:`` or ``=``. Tabs go; blanks in a row count as one."""
    parts = F.split(F.regexp_replace("value", "\t", ""), "[:=]", 2)
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim(F.regexp_replace(parts[0], " +", " ")).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("text"))
    return rows.where("text is not null")


def metadata(lines: DataFrame) -> DataFrame:
    """file, L1, value: the keys of each movie in long form, with constants and calibration.

    ``Field <k> <type>`` keys hold the time codes of frames: time_interval is the mean of type Time_From_Last,
    imageCount the largest k of Time_From_Start. Of ``factor`` and ``magnification`` the part before the first
    semicolon counts; a movie without a factor is an error. The camera's time is repaired where it is missing.
    """
    number = lambda key: F.max(F.when(F.col("key") == key, F.substring_index("text", ";", 1).try_cast("double")))
    word = F.split("key", " ")
    field, kind = F.get(word, F.lit(1)).try_cast("int"), F.get(word, F.lit(2))
    wide = lines.groupBy("file").agg(
        *(F.max(F.when(F.col("key") == k, F.replace("text", F.lit(" "), F.lit("")))).alias(n) for n, k in DUMP_KEYS.items()),
        F.max(F.when(kind == "Time_From_Start", field)).cast("string").alias("imageCount"),
        F.avg(F.when(kind == "Time_From_Last", F.col("text").try_cast("double"))).cast("string").alias("time_interval"),
        number("factor").alias("__factor"), number("magnification").alias("__zoom"), number("File Info Last Field Date Time").alias("__created"),
    )
    created = F.coalesce(F.col("__created").cast("long"), F.lit(dates.CAMERA_EPOCH + 1)) - dates.CAMERA_EPOCH
    resolution = tables.scale_factor(F.col("__factor"), F.col("__zoom"), F.col("file"))
    wide = wide.withColumns({**{k: F.lit(v) for k, v in CONSTANT_KEYS.items()}, "resolution": resolution.cast("string"), "created_unix_from_file": created.cast("string")})
    return wide.unpivot(["file"], [F.col(k) for k in tables.META_KEYS], "L1", "value").where("value is not null")


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's earlier output, or None before there is any."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def tables_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The result tables of the last finished run (see writers.tables()) by name, all as text; none before a run is finished."""
    done = finished(spark, f"{folder}/finished")
    last = None if done is None else done.orderBy(F.desc("at"), "run").first()
    return {} if last is None else {name: spark.read.option("header", True).csv(f"{folder}/runs/{last['run']}/{name}") for name in last["names"]}


#: What the files of a folder are told apart by: listings of movies, kymographs, traces, traced pictures, direction marks and metadata. Fixed values.
LISTINGS = {"movies": "*.cxd", "kymographs": "*.tiff", "traces": "*.tiff.csv", "pictures": "*_traced.jpg", "directions": "*_directionmarks.csv", "metadata": "*_new_meta_data.csv"}


def listings(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """listing() of each kind of file; a kind without a file is an empty table."""
    return {kind: listing(spark, path, pattern) for kind, pattern in LISTINGS.items()}
