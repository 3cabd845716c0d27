"""Predicates and quality control: domains, longitudes, sentinels, flags, severities, latitude bands."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.schema import LAT, LEVEL, LON, TIME, Hemisphere, Limits, Region, Severity, ThresholdMode, require

#: Flags that mark a report as fit for use, and error codes (character ordinals) that mark it as sound.
GOOD_FLAGS = ("Z", "C", "S", "V", "G")
GOOD_ERRORS = (112, 45)
#: Reports below this altitude in metres are left out; turbulence indices above this are missing.
CRUISE_ALTITUDE, LAST_INDEX = 8500.0, 20.0


@dataclass(frozen=True)
class Domain:
    """Inclusive bounds in degrees and hPa; a level bound of None is open."""

    longitude: Limits
    latitude: Limits
    level: tuple[float | None, float | None] = (None, None)

    def __post_init__(self) -> None:
        if not -180 <= self.longitude.lower < self.longitude.upper <= 180:
            raise ValueError("longitudes must rise within -180..180")
        if not -90 <= self.latitude.lower < self.latitude.upper <= 90:
            raise ValueError("latitudes must rise within -90..90")
        low, high = self.level
        if low is not None and high is not None and low > high:
            raise ValueError("levels must rise")

    def centre(self, whole: bool = False) -> tuple[float, float]:
        """Latitude and longitude of the middle; whole: rounded down."""
        lat, lon = (self.latitude.lower + self.latitude.upper) / 2, (self.longitude.lower + self.longitude.upper) / 2
        return (lat // 1, lon // 1) if whole else (lat, lon)

    @property
    def one_hemisphere(self) -> bool:
        return self.latitude.lower >= 0 or self.latitude.upper <= 0


def wrapped_longitude(longitude: Column, bound: float = -180.0) -> Column:
    """Into [bound, bound + 360)."""
    return F.pmod(longitude - bound, F.lit(360.0)) + bound


def shift_longitude(df: DataFrame, bound: float = -180.0, sort: bool = False, column: str = LON) -> DataFrame:
    shifted = df.withColumn(column, wrapped_longitude(F.col(column), bound))
    return shifted.orderBy(column) if sort else shifted


def select_domain(df: DataFrame, domain: Domain, level: str = LEVEL, wrap: bool = False) -> DataFrame:
    """Rows within the domain, whatever the order of its axes. wrap: longitudes run to 360 and are shifted first."""
    require(df, [LAT, LON, level])
    df = shift_longitude(df) if wrap else df
    low, high = domain.level
    where = F.col(LON).between(domain.longitude.lower, domain.longitude.upper) & F.col(LAT).between(domain.latitude.lower, domain.latitude.upper)
    if low is not None:
        where &= F.col(level) >= low
    if high is not None:
        where &= F.col(level) <= high
    return df.where(where)


def clip_time(df: DataFrame, start: str, end: str, column: str = TIME) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def value_slice(column: str, low: float | None, high: float | None) -> Column:
    """The values from low to high, for an axis of either direction."""
    c = F.col(column)
    return (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)


def select_values(df: DataFrame, **values: Iterable) -> DataFrame:
    """Rows whose columns hold one of the given values exactly."""
    for c, wanted in values.items():
        df = df.where(F.col(c).isin(list(wanted)))
    return df


def sentinel_to_null(c: Column, last: float = LAST_INDEX) -> Column:
    return F.when(c <= last, c)


def nan_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def good_flags(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows whose flags, of those columns that are there, are all good."""
    for c in set(columns) & set(df.columns):
        df = df.where(F.col(c).isin(*GOOD_FLAGS))
    return df


def good_errors(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    for c in set(columns) & set(df.columns):
        df = df.where(F.col(c).isin(*GOOD_ERRORS))
    return df


def complete(df: DataFrame, columns: Iterable[str], keep: Iterable[str] | None = None) -> DataFrame:
    """Rows without a null in those of the columns that are there; keep: the columns to project on, where there."""
    df = df.dropna("any", subset=[c for c in columns if c in df.columns])
    return df if keep is None else df.select(*(c for c in keep if c in df.columns))


def quality_control(observations: DataFrame, least_altitude: float = CRUISE_ALTITUDE) -> DataFrame:
    """Distinct reports at cruise altitude. Reports say nothing of manoeuvres, so none are left out for those."""
    return observations.where(F.col("altitude") >= least_altitude).dropDuplicates()


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def joined_key(*columns: str, separator: str = "_") -> Column:
    return F.concat_ws(separator, *(F.col(c).cast("string") for c in columns))


@dataclass(frozen=True)
class Thresholds:
    """A value for each severity, rising; None where a severity is not used. As percentiles they lie in 0..100."""

    light: float | None = None
    light_to_moderate: float | None = None
    moderate: float | None = None
    moderate_to_severe: float | None = None
    severe: float | None = None

    def __post_init__(self) -> None:
        held = [x for x in self.values() if x is not None]
        if not held:
            raise ValueError("at least one threshold is needed")
        if held != sorted(held):
            raise ValueError("thresholds must rise with severity")

    def values(self) -> list[float | None]:
        return [getattr(self, s) for s in Severity]

    def bounds(self, severity: Severity, mode: ThresholdMode = ThresholdMode.BOUNDED) -> Limits:
        """From the severity's value up to the next one that is set; without end for the last and in mode geq."""
        lower = getattr(self, severity)
        if lower is None:
            raise ValueError(f"{severity} has no threshold")
        if mode is ThresholdMode.GEQ or severity is Severity.SEVERE:
            return Limits(lower, float("inf"))
        above = next((x for x in self.values()[severity.rank + 1 :] if x is not None), None)
        if above is None:
            raise ValueError(f"no threshold above {severity}")
        return Limits(lower, above)


def in_band(c: Column, limits: Limits) -> Column:
    """lower <= c < upper; false for null."""
    return F.coalesce((c >= limits.lower) & (c < limits.upper), F.lit(False))


def turbulent_regions(df: DataFrame, thresholds: dict[str, Thresholds], severity: Severity, mode: ThresholdMode = ThresholdMode.BOUNDED) -> DataFrame:
    """Each named diagnostic replaced by whether it is within the severity's band."""
    require(df, list(thresholds))
    return df.withColumns({d: in_band(F.col(d), t.bounds(severity, mode)) for d, t in thresholds.items()})


#: fixed values: edges of the bands in degrees
TROPICS, POLEWARD = 25.0, 65.0


def region_tags(latitude: Column) -> Column:
    """All (hemisphere, region) pairs that a latitude belongs to, as an array; bounds are strict."""
    a = F.abs(latitude)
    side = {Hemisphere.GLOBAL: F.lit(True), Hemisphere.NORTH: latitude > 0, Hemisphere.SOUTH: latitude < 0}
    band = {Region.FULL: F.lit(True), Region.EXTRATROPICS: (a > TROPICS) & (a < POLEWARD), Region.TROPICS: a < TROPICS}
    tags = [F.when(x & y, F.struct(F.lit(str(h)).alias("hemisphere"), F.lit(str(r)).alias("region"))) for h, x in side.items() for r, y in band.items()]
    return F.array_compact(F.array(*tags))


def by_region(df: DataFrame, latitude: str = LAT) -> DataFrame:
    """A row for each region that a row belongs to: nine passes in one."""
    return df.withColumn("_tag", F.explode(region_tags(F.col(latitude)))).withColumns({"hemisphere": F.col("_tag.hemisphere"), "region": F.col("_tag.region")}).drop("_tag")
