"""What keeps memory, shuffles and scans of the grid's queries in proportion to the grid."""

import pytest
from pyspark.sql import functions as F

from aerolith.operators import calibrate, diagnostics
from aerolith.plans import catalogue
from aerolith.sources import lattice as lattices

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_diagnosed_grid_is_dealt_out_once(spark):
    wide = diagnostics.diagnose(lattices.lattice(spark, DIR), ["ngm2", "f3d"], deal=None)
    assert plan(wide).replace("BroadcastExchange", "").count("Exchange") == 1


def test_tasks_grow_with_the_grid_and_not_their_rows(spark, monkeypatch):
    monkeypatch.setattr(lattices, "LINES", 100)
    monkeypatch.setattr(lattices, "TIMES", 4)
    grid = lattices.lattice(spark, DIR)
    times = spark.read.parquet(f"{DIR}/lineitem.parquet").count() // 100
    assert (grid.count(), grid.rdd.getNumPartitions()) == (times * 1296, -(-times // 4))
    held = grid.groupBy(F.spark_partition_id()).agg(F.count_distinct("time").alias("n"), F.count("*").alias("rows")).collect()
    assert max(r.n for r in held) <= 12 and all(r.rows == r.n * 1296 for r in held)


@pytest.mark.parametrize("name", ["agg3_suite_thresholds", "agg2_percentile_thresholds_spread", "flt11_severity_bounds", "agg9_regions_by_severity", "agg8_turbulence_probability", "agg10_dissipation_rates", "flagship_turbulence_percentage"])
def test_no_task_holds_all_values_of_a_diagnostic(spark, monkeypatch, name):
    def spread_only(wide, names, percentiles, approximate=False, accuracy=10_000, spread=False):
        assert spread
        return ranked(wide, names, percentiles, approximate, accuracy, spread)

    ranked = calibrate.percentile_thresholds
    monkeypatch.setattr(calibrate, "percentile_thresholds", spread_only)
    assert catalogue.QUERIES[name](spark, DIR).columns


@pytest.mark.parametrize("name", ["agg4_log_histogram", "flt15_significant_bins"])
def test_histograms_work_the_diagnostics_out_once(spark, name):
    assert "Window" not in plan(catalogue.QUERIES[name](spark, DIR))


def test_exact_thresholds_hold_no_buffer_of_all_values(spark):
    made = plan(catalogue.QUERIES["agg2_percentile_thresholds"](spark, DIR))
    assert "percentile(" not in made and "MapInArrow" in made
