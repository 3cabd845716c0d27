"""The report path as a stream: every step before grouping is a row's own, and duplicates go within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators import observe
from aerolith.operators.filters import CRUISE_ALTITUDE, Domain


def _timed(stream: DataFrame) -> DataFrame:
    """Watermarks need a time with a zone: the session's."""
    return stream.withColumn("datetime", F.col("datetime").cast("timestamp"))


def reports_on_boxes(stream: DataFrame, domain: Domain, step: float, levels: list[float], level_altitudes: list[float], id_column: str = "report", late: str = "6 hours") -> DataFrame:
    """Cruise reports with level and index_right, each report once."""
    fit = _timed(stream).where(F.col("altitude") >= CRUISE_ALTITUDE).withWatermark("datetime", late).dropDuplicatesWithinWatermark([id_column])
    return observe.spatial_join(fit.withColumn("level", observe.nearest_level(F.col("altitude"), levels, level_altitudes)), domain, step)


def turbulence_by_window(stream: DataFrame, column: str, greater_than: float, window: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """(start, level, reports, turbulent) of each window of time."""
    held = _timed(stream).withWatermark("datetime", late)
    made = held.groupBy(F.window("datetime", window).alias("w"), "level").agg(F.count(column).alias("reports"), F.count_if(F.col(column) > greater_than).alias("turbulent"))
    return made.select(F.col("w.start").alias("start"), "level", "reports", "turbulent")
