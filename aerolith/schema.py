"""Names of columns, enumerations and required sets of the gridded and observed tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TIME, LEVEL, LAT, LON = "time", "pressure_level", "latitude", "longitude"
#: Keys of a cell of the grid.
CELL = [TIME, LEVEL, LAT, LON]
GRID_VARIABLES = [
    "temperature", "divergence_of_wind", "geopotential", "specific_humidity",
    "eastward_wind", "northward_wind", "potential_vorticity", "vorticity",
]
#: Short names of the reanalysis archive, with the names used here.
SHORT_NAMES = {
    "t": "temperature", "d": "divergence_of_wind", "z": "geopotential", "q": "specific_humidity",
    "u": "eastward_wind", "v": "northward_wind", "pv": "potential_vorticity", "vo": "vorticity",
}
GRID_SCHEMA = T.StructType(
    [T.StructField(TIME, T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in [LEVEL, LAT, LON, "altitude", *GRID_VARIABLES])]
)
#: Columns that an observation table needs after it was joined to boxes.
OBSERVED = ["datetime", "index_right", "level", LAT, LON]
#: Grid index of an observation.
INDICES = ["level_index", "lat_index", "lon_index", "time_index"]


class Severity(StrEnum):
    LIGHT = "light"
    LIGHT_TO_MODERATE = "light_to_moderate"
    MODERATE = "moderate"
    MODERATE_TO_SEVERE = "moderate_to_severe"
    SEVERE = "severe"

    @property
    def rank(self) -> int:
        return list(Severity).index(self)


class ThresholdMode(StrEnum):
    BOUNDED = "bounded"
    GEQ = "geq"


class Hemisphere(StrEnum):
    GLOBAL = "global"
    NORTH = "north"
    SOUTH = "south"


class Region(StrEnum):
    FULL = "full"
    EXTRATROPICS = "extratropics"
    TROPICS = "tropics"


class Relationship(StrEnum):
    """Names as configurations hold them: fixed values."""

    JACCARD = "jaccard_index"
    THIS_GIVEN_OTHER = "this_given_other"
    OTHER_GIVEN_THIS = "other_given_this"
    MATTHEWS = "matthews_correlation"
    THIS_GIVEN_NOT_OTHER = "this_given_not_other"
    OTHER_GIVEN_NOT_THIS = "other_given_not_this"
    ODDS_RATIO = "sample_odds_ratio"
    RELATIVE_RISK = "relative_risk"
    INVERSE_RELATIVE_RISK = "invs_relative_risk"


class GroupBy(StrEnum):
    GRID_BOX = "grid_box"
    GRID_POINT = "grid_point"
    HORIZONTAL_BOX = "horizontal_box"
    HORIZONTAL_POINT = "horizontal_point"

    @property
    def keys(self) -> list[str]:
        point, level = ["lat_index", "lon_index"], ["level_index"]
        return {"grid_box": ["index_right", *level], "grid_point": [*point, *level], "horizontal_box": ["index_right"], "horizontal_point": point}[self]


class GroupMetric(StrEnum):
    AUC = "auc"
    TSS = "tss"
    PREVALENCE = "prevalence"


@dataclass(frozen=True)
class Limits:
    lower: float
    upper: float


@dataclass(frozen=True)
class Coordinate:
    latitude: float
    longitude: float


@dataclass(frozen=True)
class DistributionParameters:
    mean: float
    variance: float


@dataclass(frozen=True)
class ValidationCondition:
    """An observed column counts as turbulent where it is over a value."""

    column: str
    greater_than: float

    def __post_init__(self) -> None:
        if self.greater_than < 0:
            raise ValueError("the value must not be negative")


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """df, if it has all these columns."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def require_boolean(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.BooleanType):
            raise TypeError(f"{c} must be boolean, not {df.schema[c].dataType.simpleString()}")
    return df
