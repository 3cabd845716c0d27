"""Whole runs: calibrate on one period, evaluate another, verify against reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators import calibrate, diagnostics, filters, metrics, observe
from aerolith.operators.filters import Domain, Thresholds
from aerolith.schema import CELL, LEVEL, TIME, GroupBy, GroupMetric, Severity, ThresholdMode, ValidationCondition


def calibration(grid: DataFrame, names: list[str], percentiles: Thresholds, approximate: bool = False, spread: bool = True, rows: int | None = None, deal: tuple[str, ...] | None = (TIME,)) -> tuple[DataFrame, DataFrame]:
    """(thresholds, distribution parameters) of each diagnostic, worked out here: one row a name each, kept as small tables.

    The wide table is worked out once for both and let go. approximate, spread: as in calibrate.percentile_thresholds.
    rows, deal: as in diagnostics.diagnose.
    """
    wide = diagnostics.diagnose(grid, names, deal=deal, rows=rows).persist(StorageLevel.MEMORY_AND_DISK)
    made = calibrate.percentile_thresholds(wide, names, percentiles, approximate, spread=spread), calibrate.distribution_parameters(diagnostics.long_form(wide, names))
    kept = tuple(grid.sparkSession.createDataFrame(x.collect(), x.schema) for x in made)
    wide.unpersist()
    return kept


def as_thresholds(rows: DataFrame) -> dict[str, Thresholds]:
    """percentile_thresholds' rows, one a diagnostic, on the driver."""
    return {r.diagnostic: Thresholds(*(r[str(s)] for s in Severity)) for r in rows.collect()}


def probabilities(grid: DataFrame, names: list[str], thresholds: DataFrame, mode: ThresholdMode = ThresholdMode.GEQ, levels: list[float] | None = None, deal: tuple[str, ...] | None = (TIME,)) -> DataFrame:
    """Percent of times at which each cell is turbulent, for each diagnostic and severity."""
    return calibrate.turbulence_probability(diagnostics.diagnose(grid, names, deal=deal), calibrate.severity_bounds(thresholds, mode), names, levels)


def dissipation_rates(grid: DataFrame, names: list[str], parameters: DataFrame, deal: tuple[str, ...] | None = (TIME,)) -> DataFrame:
    return calibrate.to_edr(diagnostics.long_form(diagnostics.diagnose(grid, names, deal=deal), names), parameters)


def turbulence_percentage(grid: DataFrame, name: str = "ti1", percentiles: Thresholds = Thresholds(light=90.0, moderate=95.0, severe=99.0), deal: tuple[str, ...] | None = (TIME,)) -> DataFrame:
    """The flagship: thresholds of one diagnostic from its own percentiles, and how often each severity is met in each cell."""
    thresholds, _ = calibration(grid, [name], percentiles, spread=True, deal=deal)
    return probabilities(grid, [name], thresholds, deal=deal)


def harmonise(grid: DataFrame, reports: DataFrame, names: list[str], domain: Domain, step: float, level_altitudes: list[float] | None = None, wide: DataFrame | None = None, deal: tuple[str, ...] | None = (TIME,)) -> DataFrame:
    """Reports at cruise altitude with level, box, grid indices and the diagnostics of their cell. wide: the diagnostics, if they are there."""
    axes = observe.Axes(grid)
    levels = axes.level
    if level_altitudes is None:
        level_altitudes = [r.altitude for r in grid.groupBy(LEVEL).agg(F.first("altitude").alias("altitude")).orderBy(LEVEL).collect()]
    held = reports.withColumn("level", observe.nearest_level(F.col("altitude"), levels, level_altitudes))
    held = filters.quality_control(observe.spatial_join(held, domain, step))
    indexed = axes.indices(held).where("time_index is not null")
    wide = axes.number(diagnostics.diagnose(grid, names, deal=deal) if wide is None else wide).drop(*CELL)
    return observe.gather(indexed, wide, names)


def verification(gathered: DataFrame, names: list[str], conditions: list[ValidationCondition], spread: bool = False) -> dict[str, DataFrame]:
    """ROC curves and their areas. spread: as in metrics.curve; gathered should be a written table then."""
    roc = observe.nearest_value_roc(gathered, conditions, names, spread)
    return {"roc": roc, "auc": metrics.area(roc, ["column", "diagnostic"], spread)}


def skill_maps(gathered: DataFrame, names: list[str], conditions: list[ValidationCondition], strategy: GroupBy = GroupBy.GRID_BOX, least: int = 2, metric: GroupMetric = GroupMetric.AUC, simpson: bool = False, hot: int | None = None) -> dict[str, DataFrame]:
    """A map of grouped skill for each condition. simpson, hot: as in metrics.grouped."""
    return {f"skill_{x.column}": metrics.skill_map(gathered, x.column, x.greater_than, names, strategy.keys, least, metric, ["report"], simpson, hot) for x in conditions}
