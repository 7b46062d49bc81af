"""Fixed schemas of the stages, so no scan infers types."""

from __future__ import annotations

TRACE = "time double, distance double, up int, down int, up_bright double, down_bright double, down_norm double, up_norm double, distance_norm double"
MAPPING = "`CODE` string, `cross` string, `type` string, `Gal4-line` string, `UAS-line` string, `Gene` string, `human ortholog` string, `DIOPT` string, `Stock collection` string"
META_KV = "value string, L1 string"
FILE_DATES = "path string, date string"
DIRECTION = "t_first double, t_last double, delta double, direction int, slope double, speed double, rsq double"
PIXELS = "recording string, t int, x int, col array<double>"
