"""Recording names taken apart with column functions.

A name reads ``<CODE>_<id>_<age>w<m|f>_<f4>_<f5>_<comment>.cxd_peak_<k>_at Xpos_<x>.tiff...``. What a name
lacks becomes null, but for the comment, which becomes ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _some(found: Column) -> Column:
    return F.nullif(found, F.lit(""))


def code(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def field(name: Column, k: int) -> Column:
    """The k-th (from 1) of the fields that underscores part."""
    return _some(F.split_part(name, F.lit("_"), F.lit(k)))


def number(name: Column) -> Column:
    return field(name, 2).try_cast("int")


def age(name: Column) -> Column:
    return _some(F.substring(field(name, 3), 1, 1))


def sex(name: Column) -> Column:
    return _some(F.right(field(name, 3), F.lit(1)))


def last(text: Column, n: int) -> Column:
    """The last n characters; all of a shorter text."""
    return F.right(text, F.lit(n))


def comment(name: Column) -> Column:
    return F.coalesce(_some(F.regexp_extract(name, r"^(?:[^_]*_){5}([^.]*)\.", 1)), F.lit("none"))


def fly_id(name: Column) -> Column:
    return _some(F.regexp_extract(name, r"^([^_]*_.*?w[fm])_", 1))


def coded(name: Column) -> Column:
    """Code, age and sex: what recordings are grouped by."""
    return F.concat(code(name), age(name), sex(name))


def xpos(name: Column) -> Column:
    return F.regexp_extract(name, r"Xpos_(\d+)\.tiff", 1).try_cast("int")


def movie(name: Column) -> Column:
    return _some(F.regexp_extract(name, r"^(.*?\.cxd)", 1))


def masked_peak(name: Column) -> Column:
    """The name without its peak number, which different peaks of a movie share."""
    return F.regexp_replace(name, r"peak_\d+_at", "peak_X_at")


def without_age_sex(group: Column) -> Column:
    return F.regexp_replace(group, "[0-9][mf]$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trace_file(jpg: Column) -> Column:
    return F.regexp_replace(jpg, r"_traced\.jpg$", ".csv")


def mapping_code(raw: Column) -> Column:
    """A code of the mapping table: no underscores and no byte-order mark."""
    return F.regexp_replace(raw, "[_\\uFEFF]", "")


def stem(name: Column, fields: int = 3) -> Column:
    """The name up to, and without, the underscore after so many fields."""
    return F.substring_index(name, "_", fields)
