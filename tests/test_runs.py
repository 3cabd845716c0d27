"""Sources, sinks, configuration, command line and streams."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

import __spark_entry__
from aerolith import cli
from aerolith.operators import diagnostics
from aerolith.operators.filters import Domain, Thresholds
from aerolith.plans import config, launch
from aerolith.schema import DistributionParameters, Limits
from aerolith.sources import readers, writers
from aerolith.sources.lattice import lattice, observations
from aerolith.streaming import observations as stream


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_one_exchange_serves_all_axes(spark, sf_dir, tmp_path):
    path = str(tmp_path / "grid")
    lattice(spark, sf_dir).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = diagnostics.diagnose(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1


def test_pruning(spark, sf_dir, tmp_path):
    path = str(tmp_path / "grid")
    lattice(spark, sf_dir).write.parquet(path)
    plan = diagnostics.diagnose(spark.read.parquet(path), ["wind_speed"])._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "eastward_wind" in schema and "temperature" not in schema


def test_json_round_trip(tmp_path):
    t = {"ti1": Thresholds(light=1.0, severe=4.0)}
    p = {"ti1": DistributionParameters(0.5, 2.0)}
    assert readers.read_thresholds(writers.write_thresholds(t, str(tmp_path / "o"), "x")) == t
    assert readers.read_distribution_parameters(writers.write_distribution_parameters(p, str(tmp_path / "o"), "x")) == p


def test_csv_reports(spark, tmp_path):
    """Lines of 35 columns, as the archive has them, after two lines that are no reports."""
    path = tmp_path / "r.csv"

    def line(**held):
        at = {readers.AMDAR_CSV_ALL[k]: v for k, v in (dict(year=2024, month=1, day=2, hour=3, minute=4, latitude=50, longitude=-3, altitude=9000, call_sign="\u20acAB\u2019") | held).items()}
        return ",".join(str(at.get(i, f"x{i}" if i > 5 else "")) if i not in (20, 21, 22, 24, 25, 26, 27, 30, 32) else str(at.get(i, i)) for i in range(35))

    head = ",".join(f"name{i}" for i in range(35))
    path.write_bytes("\n".join(["some title,of the archive", head, line(second=-9999999, turbulence_degree=3), line(second=7, turbulence_degree=-9999999), line(second=7.5, turbulence_degree=2)]).encode("cp1252"))
    rows = readers.read_amdar_csv(spark, str(path)).orderBy("datetime").collect()
    assert [str(r.datetime) for r in rows] == ["2024-01-02 03:04:00", "2024-01-02 03:04:07.500000"]
    assert [(r.latitude, r.longitude, r.altitude, r.turbulence_degree) for r in rows] == [(50, -3, 9000, 3), (50, -3, 9000, 2)]
    wide = readers.read_amdar_csv(spark, str(path), list(readers.AMDAR_CSV_ALL)).orderBy("datetime").first()
    assert wide.call_sign == "\u20acAB\u2019" and wide.registration_number == "x11" and wide.relative_humidity == 32


def test_store_errors(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    df.write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError):
        readers.read_diagnostics(spark, str(tmp_path / "s"), ["ti1"])
    with pytest.raises(ValueError):
        readers.canonical(df)
    with pytest.raises(ValueError):
        writers.repartition_files(spark, "x", "y", 0)
    with pytest.raises(ValueError):
        diagnostics.diagnose(df, ["nonsense"])


BASE = {
    "name": "run", "output": "out", "diagnostics": ["ti1", "wind_speed"],
    "domain": {"minimum_longitude": -90, "maximum_longitude": 80, "minimum_latitude": -66, "maximum_latitude": 66},
    "calibration": {"phases": ["thresholds", "histogram"], "data": "grid", "percentiles": {"light": 90, "severe": 99}},
    "evaluation": {"phases": ["probabilities", "edr", "turbulent_regions", "correlation_between_edr", "correlation_between_probabilities", "regional_correlation_between_edr", "matthews_correlation_on_edr"], "data": "grid", "severities": ["light", "severe"]},
}


@pytest.mark.parametrize("change", [
    {"diagnostics": ["nonsense"]}, {"diagnostics": ["ti1", "ti1"]}, {"name": ""}, {"domain": {"minimum_longitude": 0}}, {"calibration": None},
    {"calibration": {"phases": ["thresholds"], "data": "grid"}}, {"calibration": {"phases": ["thresholds"], "percentiles": {"light": 90}}},
    {"calibration": {"phases": ["thresholds"], "data": "grid", "percentiles": {"light": 101}}}, {"calibration": {"phases": ["other"]}},
    {"evaluation": {"phases": ["correlation_between_edr"], "data": "grid"}}, {"evaluation": {"phases": ["edr"]}},
    {"reports": {"source": "acars", "data": "d", "pattern": "*.csv", "start": "2024-01-01", "end": "2024-01-02", "conditions": []}},
    {"reports": {"source": "acars", "data": "d", "pattern": "*.parquet", "start": "2024-01-03", "end": "2024-01-02", "conditions": []}},
    {"reports": {"source": "acars", "data": "d", "pattern": "*.parquet", "start": "2024-01-01", "end": "2024-01-02", "conditions": [], "strategies": ["grid_box"]}},
])
def test_bad_configurations(change):
    with pytest.raises(config.ConfigError):
        config.from_mapping(BASE | change)


def test_run(spark, sf_dir, tmp_path):
    grid, reports, out = (str(tmp_path / x) for x in ("grid", "reports", "out"))
    lattice(spark, sf_dir).write.parquet(grid)
    observations(spark, sf_dir).select("datetime", "latitude", "longitude", F.col("altitude"), "maxEDR", "medEDR", "turbIndex").withColumnRenamed("datetime", "timeObs").write.parquet(reports)
    held = BASE | {"output": out, "calibration": BASE["calibration"] | {"data": grid}, "evaluation": BASE["evaluation"] | {"data": grid}}
    held["reports"] = {"source": "acars", "data": reports, "pattern": "*.parquet", "start": "2024-01-01", "end": "2024-01-02", "grid_size": 10.0, "save": True, "conditions": [{"column": "maxEDR", "greater_than": 0.3}], "strategies": ["grid_box"], "metrics": ["auc"]}
    path = tmp_path / "run.yaml"
    path.write_text(yaml.safe_dump(held))
    cli.main(["run", str(path)], spark)
    assert spark.read.parquet(f"{out}/run/probabilities").count() == 2 * 2 * 6 * 12 * 18
    assert spark.read.parquet(f"{out}/run/auc").count() == 2
    assert spark.read.parquet(f"{out}/run_harmonised").count() > 0
    assert set(json.load(open(f"{out}/thresholds_run.json"))) == {"ti1", "wind_speed"}
    again = held | {"calibration": {"phases": ["thresholds", "histogram"], "thresholds_file": f"{out}/thresholds_run.json", "parameters_file": f"{out}/distribution_params_run.json"}, "reports": None}
    found = cli.execute(spark, config.from_mapping(again))
    assert found["probabilities"].exceptAll(spark.read.parquet(f"{out}/run/probabilities")).count() == 0


def test_utilities(spark, sf_dir, tmp_path, capsys):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    observations(spark, sf_dir).withColumnRenamed("datetime", "timeObs").withColumn("turbulenceError", F.col("error")).withColumn("windSpeedDD", F.col("flag")).withColumn("medTurbulence", F.when(F.col("report") % 7 > 0, 1.0)).write.parquet(raw)
    cli.main(["data", "amdar", "preprocess", "-s", "acars", "-i", raw, "-o", out, "--glob-pattern", "*.parquet", "--all-columns"], spark)
    kept = spark.read.parquet(out)
    assert 0 < kept.count() < spark.read.parquet(raw).count() and kept.where("flag in ('B', 'X') or error = 102 or medTurbulence is null").count() == 0
    assert not {"turbulenceError", "windSpeedDD"} & set(kept.columns)
    with pytest.raises(NotImplementedError):
        cli.main(["data", "amdar", "preprocess", "-s", "amdar_csv", "-i", raw, "-o", out], spark)
    cli.main(["data", "utils", "repartition", "-d", raw, "-o", str(tmp_path / "p"), "-n", "3"], spark)
    assert len(list((tmp_path / "p" / "raw").glob("part-*"))) == 3
    spark.range(10).write.parquet(str(tmp_path / "tree" / "one"))
    spark.range(20).write.parquet(str(tmp_path / "tree" / "two"))
    cli.main(["data", "utils", "repartition", "-d", str(tmp_path / "tree"), "-o", str(tmp_path / "q"), "-n", "2", "-r"], spark)
    assert [spark.read.parquet(str(tmp_path / "q" / x)).count() for x in ("one", "two")] == [10, 20]
    cli.main(["data", "plan", "-y", "2020", "-m", "2", "-d", "-1"], spark)
    assert "29" in capsys.readouterr().out


def test_streams(spark, sf_dir, tmp_path):
    path = str(tmp_path / "reports")
    one = observations(spark, sf_dir)
    one.unionByName(one.limit(50)).repartition(1).write.parquet(path)
    domain = Domain(Limits(-90, 80), Limits(-66, 66))
    made = stream.reports_on_boxes(spark.readStream.schema(one.schema).parquet(path), domain, 10.0, [175.0, 250.0, 350.0], [13500.0, 9480.0, 7000.0])
    run = made.writeStream.format("memory").queryName("boxes").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("boxes").select("report").distinct().count() == one.where("altitude >= 8500").count()
    counted = stream.turbulence_by_window(spark.readStream.schema(one.schema).parquet(path).withColumn("level", F.lit(250.0)), "maxEDR", 0.3)
    run = counted.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("reports")).first()[0] == one.count() + 50


def test_flagship(spark, sf_dir):
    rows = launch.turbulence_percentage(lattice(spark, sf_dir)).groupBy("severity").agg(F.avg("probability").alias("p")).collect()
    held = {r.severity: r.p for r in rows}
    assert held["light"] == pytest.approx(10, abs=0.5) and held["severe"] == pytest.approx(1, abs=0.5)
