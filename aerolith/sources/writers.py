"""Sinks: diagnostics, correlations, preprocessed and harmonised reports, small result files, repartitioning."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import filters
from aerolith.operators.filters import Thresholds
from aerolith.schema import LEVEL, TIME, DistributionParameters
from aerolith.sources import files


def write_diagnostics(wide: DataFrame, path: str) -> None:
    """Overwrites; by date, so that later reads prune."""
    wide.withColumn("date", F.to_date(TIME)).write.mode("overwrite").partitionBy("date").parquet(path)


def write_correlation(matrix: DataFrame, path: str, by_level: bool = False) -> None:
    writer = matrix.write.mode("overwrite")
    (writer.partitionBy(LEVEL) if by_level else writer).parquet(path)


def preprocess_reports(raw: DataFrame, flags: Iterable[str], errors: Iterable[str], needed: Iterable[str], keep: Iterable[str] | None = None) -> DataFrame:
    """Sound reports: good flags, no errors, complete in the needed columns."""
    return filters.complete(filters.good_errors(filters.good_flags(raw, flags), errors), needed, keep)


def write_reports(reports: DataFrame, path: str, time_column: str = "datetime") -> None:
    reports.withColumn("date", F.to_date(time_column)).write.mode("overwrite").partitionBy("date").parquet(path)


def write_harmonised(harmonised: DataFrame, path: str, wanted: bool = True) -> None:
    if wanted:
        harmonised.write.mode("overwrite").parquet(path)


def _json(folder: str, name: str, held: dict) -> str:
    return files.write_text(f"{folder.rstrip('/')}/{name}", json.dumps(held, indent=2))


def write_thresholds(thresholds: dict[str, Thresholds], folder: str, start: str) -> str:
    return _json(folder, f"thresholds_{start}.json", {k: asdict(v) for k, v in thresholds.items()})


def write_distribution_parameters(parameters: dict[str, DistributionParameters], folder: str, start: str) -> str:
    return _json(folder, f"distribution_params_{start}.json", {k: asdict(v) for k, v in parameters.items()})


def repartition_files(spark: SparkSession, source: str, target: str, parts: int, pattern: str = "*.parquet", nested: bool = False) -> None:
    """The matching parquet of a folder, or of each folder in it (nested), as so many files in a folder of its name in target."""
    if parts < 1:
        raise ValueError("at least one file")
    for path in files.folders(source) if nested else [source]:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        held = spark.read.option("pathGlobFilter", pattern).parquet(path)
        held.repartition(parts).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
