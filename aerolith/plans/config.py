"""Run configuration: a YAML file to checked dataclasses."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from aerolith.operators.diagnostics import DIAGNOSTICS
from aerolith.operators.filters import Domain, Thresholds
from aerolith.operators.metrics import HOT_ROWS
from aerolith.schema import GroupBy, GroupMetric, Limits, Severity, ThresholdMode, ValidationCondition
from aerolith.sources import files

CALIBRATION_PHASES = ("thresholds", "histogram")
EVALUATION_PHASES = ("probabilities", "edr", "turbulent_regions", "correlation_between_probabilities", "correlation_between_edr", "regional_correlation_between_probabilities", "regional_correlation_between_edr", "matthews_correlation_on_edr")
#: An evaluation phase that needs another of the same run.
NEEDS = {
    "correlation_between_probabilities": "probabilities", "regional_correlation_between_probabilities": "probabilities",
    "correlation_between_edr": "edr", "regional_correlation_between_edr": "edr", "matthews_correlation_on_edr": "edr",
}
SOURCES = ("acars", "amdar_csv")


class ConfigError(ValueError):
    """What is wrong with a configuration."""


def _known(values: Iterable[str], allowed: Iterable[str], what: str) -> list[str]:
    values = list(values)
    if unknown := [v for v in values if v not in allowed]:
        raise ConfigError(f"unknown {what} {unknown}; there are {sorted(allowed)}")
    if len(set(values)) < len(values):
        raise ConfigError(f"{what} are named twice")
    return values


def folder(path: str, must_exist: bool = True) -> str:
    if files.is_file(path):
        raise ConfigError(f"{path} is not a folder")
    if must_exist and not files.exists(path):
        raise ConfigError(f"no folder {path}")
    return path


def file(path: str) -> str:
    if not files.is_file(path):
        raise ConfigError(f"no file {path}")
    return path


def domain(held: dict[str, Any]) -> Domain:
    try:
        level = held.get("minimum_level"), held.get("maximum_level")
        return Domain(Limits(held["minimum_longitude"], held["maximum_longitude"]), Limits(held["minimum_latitude"], held["maximum_latitude"]), level)
    except KeyError as e:
        raise ConfigError(f"the domain lacks {e}") from e


@dataclass(frozen=True)
class Calibration:
    """Where thresholds and distributions come from: data, or files of an earlier run."""

    phases: list[str]
    data: str | None = None
    percentiles: Thresholds | None = None
    thresholds_file: str | None = None
    parameters_file: str | None = None
    #: Percentiles by a sketch of bounded size instead of all distinct values.
    approximate: bool = False
    spread: bool = True

    def __post_init__(self) -> None:
        _known(self.phases, CALIBRATION_PHASES, "calibration phases")
        if "thresholds" in self.phases and self.percentiles is None and self.thresholds_file is None:
            raise ConfigError("thresholds need percentiles, or a file of thresholds")
        if self.data is None and ((self.percentiles is not None and "thresholds" in self.phases) or ("histogram" in self.phases and self.parameters_file is None)):
            raise ConfigError("calibration needs data, or files of an earlier run")
        for p in (self.percentiles.values() if self.percentiles else []):
            if p is not None and not 0 <= p <= 100:
                raise ConfigError("percentiles lie in 0..100")


@dataclass(frozen=True)
class Evaluation:
    phases: list[str]
    data: str
    severities: list[Severity] = field(default_factory=lambda: list(Severity))
    levels: list[float] | None = None
    mode: ThresholdMode = ThresholdMode.GEQ

    def __post_init__(self) -> None:
        _known(self.phases, EVALUATION_PHASES, "evaluation phases")
        for phase in self.phases:
            if (need := NEEDS.get(phase)) and need not in self.phases:
                raise ConfigError(f"{phase} needs {need}")


@dataclass(frozen=True)
class Reports:
    source: str
    data: str
    pattern: str
    start: datetime
    end: datetime
    conditions: list[ValidationCondition]
    grid_size: float | None = None
    strategies: list[GroupBy] = field(default_factory=list)
    metrics: list[GroupMetric] = field(default_factory=list)
    least_group: int = 2
    save: bool = False
    #: Curves in ranges of scores; areas of groups by Simpson's rule; rows of a group from which its counts are made in ranges.
    spread: bool = True
    simpson: bool = False
    hot_rows: int | None = HOT_ROWS

    def __post_init__(self) -> None:
        _known([self.source], SOURCES, "report sources")
        if self.end <= self.start:
            raise ConfigError("the reports' time window must rise")
        ending = {"acars": (".parquet", ".pq"), "amdar_csv": (".csv",)}[self.source]
        if not self.pattern.endswith(ending):
            raise ConfigError(f"files of {self.source} end in {ending}")
        if len({(x.column, x.greater_than) for x in self.conditions}) < len(self.conditions):
            raise ConfigError("validation conditions are given twice")
        if self.grid_size is None and any(s in (GroupBy.GRID_BOX, GroupBy.HORIZONTAL_BOX) for s in self.strategies):
            raise ConfigError("grouping by boxes needs their size")
        if self.grid_size is not None and self.grid_size <= 0:
            raise ConfigError("the size of boxes is positive")


@dataclass(frozen=True)
class Run:
    name: str
    output: str
    domain: Domain
    diagnostics: list[str]
    calibration: Calibration | None = None
    evaluation: Evaluation | None = None
    reports: Reports | None = None
    #: About how many rows of a time a task takes; times of more are dealt out in bands of latitudes. None: a time a task.
    rows_per_task: int | None = None

    def __post_init__(self) -> None:
        _known(self.diagnostics, DIAGNOSTICS, "diagnostics")
        if not self.name:
            raise ConfigError("the run needs a name")
        if self.rows_per_task is not None and self.rows_per_task < 1:
            raise ConfigError("a task takes a row at least")
        if self.evaluation is not None and self.calibration is None:
            raise ConfigError("an evaluation needs a calibration")
        if self.reports is not None and self.evaluation is None:
            raise ConfigError("reports are compared with an evaluation")
        if self.evaluation is not None:
            wants_edr = any(p.endswith("edr") for p in self.evaluation.phases)
            if wants_edr and "histogram" not in self.calibration.phases:
                raise ConfigError("dissipation rates need the histogram phase")
            if {"probabilities", "turbulent_regions"} & set(self.evaluation.phases) and "thresholds" not in self.calibration.phases:
                raise ConfigError("probabilities need the thresholds phase")


def from_mapping(held: dict[str, Any]) -> Run:
    try:
        calibration, evaluation, reports = (dict(held[k]) if held.get(k) else None for k in ("calibration", "evaluation", "reports"))
        if calibration and calibration.get("percentiles"):
            calibration["percentiles"] = Thresholds(**calibration["percentiles"])
        if evaluation:
            evaluation |= {k: f(evaluation[k]) for k, f in (("severities", lambda v: [Severity(x) for x in v]), ("mode", ThresholdMode)) if k in evaluation}
        if reports:
            reports["conditions"] = [ValidationCondition(**x) for x in reports.get("conditions", [])]
            reports |= {k: [f(x) for x in reports[k]] for k, f in (("strategies", GroupBy), ("metrics", GroupMetric)) if k in reports}
            reports |= {k: datetime.fromisoformat(str(reports[k])) for k in ("start", "end")}
        return Run(held["name"], held["output"], domain(held["domain"]), held["diagnostics"], Calibration(**calibration) if calibration else None, Evaluation(**evaluation) if evaluation else None, Reports(**reports) if reports else None, held.get("rows_per_task"))
    except ConfigError:
        raise
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"the configuration is not valid: {e!r}") from e


def from_yaml(path: str) -> Run:
    import yaml

    held = yaml.safe_load(files.read_text(file(path)))
    if not isinstance(held, dict):
        raise ConfigError("the file is empty or no mapping")
    return from_mapping(held)
