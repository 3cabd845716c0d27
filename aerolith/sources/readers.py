"""Sources: gridded parquet, aircraft reports, computed diagnostics, dates, and small result files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.functions import physics
from aerolith.operators import filters
from aerolith.operators.filters import Domain, Thresholds
from aerolith.schema import CELL, GRID_VARIABLES, LAT, LEVEL, LON, SHORT_NAMES, TIME, DistributionParameters, require
from aerolith.sources import files, netcdf, zarr

#: Fixed values of the aircraft archive: columns that any query reads.
ACARS_COLUMNS = ["altitude", "latitude", "longitude", "timeObs", "phaseFlight", "maxEDR", "medEDR", "maxTurbulence", "medTurbulence", "turbIndex", "vertAccel", "vertGust"]
ACARS_VALIDATION = ["maxEDR", "medEDR", "maxTurbulence", "medTurbulence", "turbIndex", "vertAccel"]
#: Fixed values of the text archive: its columns and their places in a line, all that are of use and the fewest, the columns
#: of text, and what stands for a missing number.
AMDAR_CSV_ALL = {
    "year": 0, "month": 1, "day": 2, "hour": 3, "minute": 4, "second": 5, "registration_number": 11, "call_sign": 12, "latitude": 13,
    "longitude": 14, "altitude": 15, "roll_angle": 20, "pressure": 21, "flight_phase": 22, "wind_direction": 24, "wind_speed": 25,
    "vert_gust_velocity": 26, "vert_gust_acceleration": 27, "turbulence_degree": 28, "air_temperature": 30, "relative_humidity": 32,
}
AMDAR_CSV_COLUMNS = [
    "year", "month", "day", "hour", "minute", "second", "latitude", "longitude", "altitude", "roll_angle",
    "flight_phase", "vert_gust_velocity", "vert_gust_acceleration", "turbulence_degree",
]
AMDAR_CSV_TEXT = ["call_sign", "registration_number"]
AMDAR_CSV_MISSING = "-9999999"
AMDAR_CSV_VALIDATION = ["vert_gust_velocity", "vert_gust_acceleration", "turbulence_degree"]


def read_grid(spark: SparkSession, folder: str, pattern: str = "*.parquet", columns: list[str] | None = None) -> DataFrame:
    """All files of a folder that match the pattern, as one table; only the named columns are read."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    return df.select(*columns) if columns else df


def reanalysis_grid(raw: DataFrame, domain: Domain | None = None, prefix: float = 1.0) -> DataFrame:
    """The archive's short names and 0..360 longitudes to the canonical grid, with altitude from pressure.

    prefix: what a level is multiplied by to be in hPa. The longitude bound is put on the raw column, so that it still
    reaches the scan.
    """
    df = require(raw, ["valid_time", LEVEL, LAT, LON, *SHORT_NAMES], "archive")
    if domain is not None and domain.longitude.lower >= 0:
        df = df.where(F.col(LON).between(domain.longitude.lower, domain.longitude.upper))
    df = df.select("valid_time", LEVEL, LAT, LON, *SHORT_NAMES).withColumnsRenamed(SHORT_NAMES | {"valid_time": TIME})
    df = filters.shift_longitude(df).withColumn(LEVEL, F.col(LEVEL) * prefix)
    df = df if domain is None else filters.select_domain(df, domain)
    return filters.nan_to_null(df, GRID_VARIABLES).withColumn("altitude", physics.icao_altitude(F.col(LEVEL))).select(*CELL, "altitude", *GRID_VARIABLES)


def canonical(df: DataFrame) -> DataFrame:
    """df, checked to be a canonical grid."""
    return require(df, [*CELL, "altitude", *GRID_VARIABLES], "grid")


def open_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical grid of a folder: a Zarr store, netCDF classic files as the reanalysis archive or this library names
    their variables, or parquet. Of arrays only those of the grid are read."""
    if files.exists(f"{folder.rstrip('/')}/.zgroup"):
        return canonical(zarr.read_zarr(spark, folder, ["altitude", *GRID_VARIABLES]))
    if files.names(folder, ".nc"):
        df = netcdf.read_netcdf(spark, folder)
        if set(SHORT_NAMES) <= set(df.columns):
            return canonical(reanalysis_grid(netcdf.read_netcdf(spark, folder, SHORT_NAMES).withColumnsRenamed({TIME: "valid_time"})))
        return canonical(netcdf.read_netcdf(spark, folder, ["altitude", *GRID_VARIABLES]))
    return canonical(read_grid(spark, folder))


def read_acars(spark: SparkSession, path: str) -> DataFrame:
    """Aircraft reports of the parquet archive; only used columns are read, turbulence indices over 20 are missing."""
    df = spark.read.parquet(path)
    return acars(df)


def acars(df: DataFrame) -> DataFrame:
    held = [c for c in ACARS_COLUMNS if c in df.columns]
    return df.select(*(filters.sentinel_to_null(F.col(c)).alias(c) if c == "turbIndex" else F.col(c) for c in held))


def read_amdar_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Reports of the text archive: columns by their places in a line (names of AMDAR_CSV_ALL), datetime from its six parts.

    A file begins with two lines that are no reports: the first is skipped as a header, the second has no number for a
    year. The text is Windows'. A missing second is 0; rows without a turbulence degree are left out.
    """
    names = {AMDAR_CSV_ALL[n]: n for n in columns or AMDAR_CSV_COLUMNS}
    kind = lambda n: T.StringType() if n in AMDAR_CSV_TEXT else T.DoubleType()
    schema = T.StructType([T.StructField(names.get(i, f"unused_{i}"), kind(names.get(i, "call_sign"))) for i in range(max(AMDAR_CSV_ALL.values()) + 1)])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nullValue", AMDAR_CSV_MISSING).option("encoding", "iso-8859-1").csv(path)
    df = raw.select(*(_windows(F.col(n)).alias(n) if n in AMDAR_CSV_TEXT else F.col(n) for n in names.values()))
    return amdar_times(df.where("year is not null"))


def _windows(text: Column) -> Column:
    """Windows text that was read as Latin-1, from which it differs in 27 places."""
    latin = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
    return F.translate(text, latin, latin.encode("latin-1").decode("cp1252"))


def amdar_times(df: DataFrame) -> DataFrame:
    part = lambda n: F.col(n).cast("int")
    df = df.withColumn("second", F.coalesce("second", F.lit(0.0)))
    at = F.make_timestamp_ntz(*map(part, ("year", "month", "day", "hour", "minute")), F.col("second").cast("decimal(8,6)"))
    return df.withColumn("datetime", at).drop("year", "month", "day", "hour", "minute", "second").dropna(subset=["turbulence_degree"])


def read_diagnostics(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A computed set of diagnostics: keys and the wanted ones."""
    df = spark.read.parquet(path)
    return require(df, [*CELL, *names], "store").select(*CELL, *names)


def date_combinations(spark: SparkSession, years: list[int], months: list[int], days: list[int]) -> DataFrame:
    """(year, month, day) of all combinations; [-1] means all months, or all days of each month. Given days are not checked."""
    every = lambda values, all_: F.array(*map(F.lit, all_ if values == [-1] else values))
    dates = spark.range(1).select(F.explode(every(years, years)).alias("year")).select("year", F.explode(every(months, list(range(1, 13)))).alias("month"))
    last = F.day(F.last_day(F.make_date("year", "month", F.lit(1))))
    return dates.select("year", "month", F.explode(F.sequence(F.lit(1), last) if days == [-1] else every(days, days)).alias("day"))


def read_thresholds(path: str) -> dict[str, Thresholds]:
    return {k: Thresholds(**v) for k, v in json.loads(files.read_text(path)).items()}


def read_distribution_parameters(path: str) -> dict[str, DistributionParameters]:
    return {k: DistributionParameters(**v) for k, v in json.loads(files.read_text(path)).items()}
