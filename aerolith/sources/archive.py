"""The raw archive of aircraft reports: compressed netCDF files to sound reports as parquet, in a tree like the input's."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources import files, netcdf, writers

#: Fixed values of the raw archive: variables that are read, of them the quality flags, the error codes, and turbulence,
#: which must not be missing.
VARIABLES = [
    "altitude", "altitudeDD", "bounceError", "correctedFlag", "dataDescriptor", "dataSource", "dataType", "dest_airport_id",
    "en_tailNumber", "heading", "interpolatedLL", "interpolatedTime", "latitude", "latitudeDD", "longitude", "longitudeDD",
    "mach", "maxEDR", "maxEDRDD", "maxTurbulence", "medEDR", "medEDRDD", "medTurbulence", "orig_airport_id", "phaseFlight",
    "speedError", "tempError", "temperature", "temperatureDD", "timeMaxTurbulence", "timeObs", "timeObsDD", "trueAirSpeed",
    "rollFlag", "trueAirSpeedDD", "trueAirSpeedError", "turbIndex", "turbIndexDD", "turbulenceError", "baroAltitude",
    "vertAccel", "vertGust", "windDir", "windDirDD", "windDirError", "windSpeed", "windSpeedDD", "windSpeedError",
]
FLAGS = [
    "altitudeDD", "windSpeedDD", "timeObsDD", "latitudeDD", "longitudeDD", "maxEDRDD", "medEDRDD", "temperatureDD", "trueAirSpeedDD",
    "turbIndexDD", "windDirDD",
]
ERRORS = ["bounceError", "speedError", "turbulenceError"]
NEEDED = ["maxEDR", "medEDR", "turbIndex", "medTurbulence", "maxTurbulence"]
KEPT = [v for v in VARIABLES if v not in FLAGS and v not in ERRORS]


def sound(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of good flags, no errors and complete turbulence, of the columns that raw has; keep: the archive's kept ones."""
    return writers.preprocess_reports(raw, FLAGS, ERRORS, NEEDED, KEPT if keep is None else keep)


def read_raw(spark: SparkSession, inputs: list[str], pattern: str = "*.gz") -> DataFrame:
    """(path, *variables) of all records; variables that no file of the first looked at has are left out.

    Flags are texts of one letter and error codes the numbers of theirs, however a file stores them.
    """
    kinds = netcdf.archive_kinds(spark, inputs, VARIABLES, pattern, absent=False)
    kinds |= {v: "string" for v in FLAGS if v in kinds} | {v: "int" for v in ERRORS if v in kinds}
    return netcdf.read_archive(spark, inputs, kinds, pattern)


def preprocess(spark: SparkSession, inputs: list[str], output: str, pattern: str = "*.gz") -> list[str]:
    """Sound reports of every file as `output`/(its place in the input)/(its name without .gz).parquet; their paths.

    inputs: folders, looked through with all theirs, or single files. All files are one job, of which each file is read in
    one task; what it wrote is moved to its place after the job has been committed, so a lost executor leaves nothing half
    done. A file without sound reports gives no output.
    """
    raw = read_raw(spark, inputs, pattern)
    tree = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.gz$", "")  # a single file has no folders above
    for base in inputs:
        if files.is_folder(base):
            top = files.qualified(base).rstrip("/") + "/"
            tree = F.when(F.startswith("path", F.lit(top)), F.regexp_replace(F.substring("path", len(top) + 1, 1 << 30), r"\.gz$", "")).otherwise(tree)
    made = f"{output.rstrip('/')}/_made"
    sound(raw.withColumn("tree", tree), [*KEPT, "tree"]).write.mode("overwrite").partitionBy("tree").parquet(made)
    out = []
    for folder in files.folders(made):
        name = unquote(folder.rstrip("/").rsplit("/", 1)[-1].removeprefix("tree="))
        out.append(f"{output.rstrip('/')}/{name}.parquet")
        files.move(folder, out[-1])
    files.delete(made)
    return out
