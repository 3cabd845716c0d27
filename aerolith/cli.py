"""Command line: run a configuration, preprocess reports, plan retrievals, repartition files.

    python -m aerolith.cli run CONFIG
    python -m aerolith.cli data amdar preprocess -s acars -i IN -o OUT                                (compressed netCDF)
    python -m aerolith.cli data amdar preprocess -s acars -i IN -o OUT --glob-pattern '*.parquet'
    python -m aerolith.cli data plan -y 2020 -m 1 2 -d -1
    python -m aerolith.cli data utils repartition -d IN -o OUT -n 8
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import calibrate, diagnostics, filters
from aerolith.plans import config, launch
from aerolith.schema import DistributionParameters
from aerolith.sources import archive, files, readers, writers


def execute(spark: SparkSession, run: config.Run) -> dict[str, DataFrame]:
    """All results of a run, by name; calibrations are also written to the output folder.

    Diagnostics, probabilities and harmonised reports are worked out once, as tables that the lazy results read.
    """
    out: dict[str, DataFrame] = {}
    if run.calibration is None:
        return out
    cal, names = run.calibration, run.diagnostics
    thresholds = parameters = None
    if cal.data is not None:
        grid = filters.select_domain(readers.open_grid(spark, config.folder(cal.data)), run.domain)
        found, held = launch.calibration(grid, names, cal.percentiles or filters.Thresholds(light=97.0, severe=99.0), cal.approximate, cal.spread, run.rows_per_task)
        if "thresholds" in cal.phases and cal.thresholds_file is None:
            thresholds = out["thresholds"] = found
            writers.write_thresholds(launch.as_thresholds(found), run.output, run.name)
        if "histogram" in cal.phases and cal.parameters_file is None:
            parameters = out["distribution_parameters"] = held
            writers.write_distribution_parameters({x.diagnostic: DistributionParameters(x.mean, x.variance) for x in held.collect()}, run.output, run.name)
            out["histogram"] = calibrate.log_histogram(diagnostics.long_form(diagnostics.diagnose(grid, names), names))
    if cal.thresholds_file is not None:
        held = readers.read_thresholds(config.file(cal.thresholds_file))
        schema = "diagnostic string, light double, light_to_moderate double, moderate double, moderate_to_severe double, severe double"
        thresholds = out["thresholds"] = spark.createDataFrame([(k, *map(lambda x: None if x is None else float(x), t.values())) for k, t in held.items()], schema)
    if cal.parameters_file is not None:
        held = readers.read_distribution_parameters(config.file(cal.parameters_file))
        parameters = out["distribution_parameters"] = spark.createDataFrame([(k, float(p.mean), float(p.variance)) for k, p in held.items()], "diagnostic string, mean double, variance double")
    if run.evaluation is None:
        return out
    ev = run.evaluation
    grid = filters.select_domain(readers.open_grid(spark, config.folder(ev.data)), run.domain)
    wide = files.written(diagnostics.diagnose(grid, names, rows=run.rows_per_task))  # all that follows reads it
    severities = [str(s) for s in ev.severities]
    if {"probabilities", "turbulent_regions"} & set(ev.phases):
        bounds = calibrate.severity_bounds(thresholds, ev.mode).where(F.col("severity").isin(severities))
        if "probabilities" in ev.phases:
            shares = files.written(calibrate.turbulence_probabilities(wide, bounds, names, ev.levels))
            out["probabilities"] = calibrate.probability_rows(shares, names)
        if "turbulent_regions" in ev.phases:
            out["turbulent_regions"] = calibrate.by_severity(diagnostics.long_form(wide, names), bounds)
    tables = {"probabilities": lambda: shares}
    if "edr" in ev.phases:
        rates = calibrate.edr_columns(wide, parameters, names)
        out["edr"] = calibrate.to_edr(diagnostics.long_form(wide, names), parameters)
        tables["edr"] = lambda: rates
    for kind, table in tables.items():
        if f"correlation_between_{kind}" in ev.phases:
            out[f"correlation_between_{kind}"] = calibrate.correlation(table(), names)
        if f"regional_correlation_between_{kind}" in ev.phases:
            out[f"regional_correlation_between_{kind}"] = calibrate.regional_correlation(table(), names)
    if "matthews_correlation_on_edr" in ev.phases:
        of = {n: calibrate.edr_bounds() for n in names}
        kept = [s for s in ev.severities if getattr(calibrate.edr_bounds(), s) is not None]
        out["matthews_correlation_on_edr"] = calibrate.matthews_by_severity(rates, of, kept)
    if run.reports is not None:
        rep = run.reports
        read = readers.read_acars if rep.source == "acars" else readers.read_amdar_csv
        reports = read(spark, f"{rep.data.rstrip('/')}/{rep.pattern}")
        reports = reports if "datetime" in reports.columns else reports.withColumnRenamed("timeObs", "datetime")
        reports = filters.clip_time(reports, str(rep.start), str(rep.end), "datetime").dropDuplicates()
        reports = reports.withColumn("report", F.xxhash64(*reports.columns))  # distinct rows; the same id in every attempt of a task
        held = launch.harmonise(grid, reports, names, run.domain, rep.grid_size or 1.0, wide=wide)
        if rep.save:
            writers.write_harmonised(held, path := f"{run.output}/{run.name}_harmonised")
            held = spark.read.schema(held.schema).parquet(path)
        else:
            held = files.written(held)
        out["harmonised"] = held
        out |= launch.verification(held, names, rep.conditions, rep.spread)
        for strategy in rep.strategies:
            for metric in rep.metrics:
                made = launch.skill_maps(held, names, rep.conditions, strategy, rep.least_group, metric, rep.simpson, rep.hot_rows)
                out |= {f"{k}_{strategy}_{metric}": v for k, v in made.items()}
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="aerolith", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("config")
    run.add_argument("--log", default="WARNING", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    data = sub.add_parser("data").add_subparsers(dest="area", required=True)
    pre = data.add_parser("amdar").add_subparsers(dest="action", required=True).add_parser("preprocess")
    pre.add_argument("-s", "--source", choices=config.SOURCES, required=True)
    pre.add_argument("-i", "--input", nargs="+", required=True, help="folders or files: compressed netCDF, or parquet")
    pre.add_argument("-o", "--output", help="the input folder, if not given")
    pre.add_argument("--glob-pattern", default="*.gz", help="names of files; those of parquet end in .parquet")
    pre.add_argument("--all-columns", action="store_true", help="of parquet, keep also columns that the archive does not have")
    plan = data.add_parser("plan")
    for short, long in (("-y", "--years"), ("-m", "--months"), ("-d", "--days")):
        plan.add_argument(short, long, nargs="+", type=int, required=True)
    rep = data.add_parser("utils").add_subparsers(dest="action", required=True).add_parser("repartition")
    rep.add_argument("-d", "--directory", required=True)
    rep.add_argument("-o", "--output", required=True)
    rep.add_argument("-n", "--parts", type=int, required=True)
    rep.add_argument("-p", "--glob-pattern", default="*.parquet")
    rep.add_argument("-r", "--nested", action="store_true", help="each folder in the directory by itself")
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("aerolith").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        logging.basicConfig(level=a.log)
        run = config.from_yaml(a.config)
        for name, result in execute(spark, run).items():
            result.write.mode("overwrite").parquet(f"{run.output}/{run.name}/{name}")
    elif a.area == "amdar":
        if a.source != "acars":
            raise NotImplementedError(f"reports of {a.source} need no preprocessing")
        output = a.output or (a.input[0] if files.is_folder(a.input[0]) else a.input[0].rpartition("/")[0] or ".")
        if not a.glob_pattern.endswith((".parquet", ".pq")):
            archive.preprocess(spark, a.input, output, a.glob_pattern.rpartition("/")[-1])
            return
        if len(a.input) > 1 or not a.output:
            raise ValueError("parquet comes from one folder, and goes to another")
        raw = readers.read_grid(spark, config.folder(a.input[0]), a.glob_pattern)
        kept = [x for x in raw.columns if x not in archive.FLAGS and x not in archive.ERRORS] if a.all_columns else None
        writers.write_reports(archive.sound(raw, kept), output, "timeObs")
    elif a.area == "plan":
        readers.date_combinations(spark, a.years, a.months, a.days).orderBy("year", "month", "day").show(1000)
    else:
        writers.repartition_files(spark, config.folder(a.directory), a.output, a.parts, a.glob_pattern, a.nested)


if __name__ == "__main__":
    main()
