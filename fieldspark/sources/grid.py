"""Gridded climate as a long table ``lon, lat, time, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_since


def grid_subset(
    cube: DataFrame,
    bbox: tuple[float, float, float, float],
    fill: float,
    origin: str,
    t: str | None = None,
) -> DataFrame:
    """Cells inside ``(lon_min, lon_max, lat_min, lat_max)``, fill value as NULL, time as a date.

    ``t`` (yyyy-MM-dd) keeps one time slice. All conditions are on source columns, so they reach
    the scan.
    """
    lon0, lon1, lat0, lat1 = bbox
    out = cube.filter(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))
    if t is not None:
        out = out.filter(F.col("time") == F.datediff(F.lit(t).cast("date"), F.lit(origin).cast("date")))
    return out.withColumns({"date": days_since("time", origin), "value": F.nullif(F.col("value"), F.lit(fill))})
