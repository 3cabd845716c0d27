"""Statistics that merge: correlations of many columns, percentiles in two scans, boxes of polygons."""

import functools
import math
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import calibrate, filters, moments, observe
from aerolith.operators.filters import Thresholds
from aerolith.schema import ValidationCondition


def plain(x, y):
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    if len(x) < 1 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def columns(seed, n=400):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    x = {"a": base + rng.normal(size=n), "b": base * 1e-3 + 1e6, "c": -base * 1e12, "d": np.full(n, 0.1), "e": rng.integers(0, 2, n).astype(float), "f": np.full(n, np.nan)}
    for k in ("a", "c", "e"):
        x[k][rng.random(n) < 0.2] = np.nan
    return x


def frame(spark, x, more=""):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) and i % 2 else v for v in r) for i, r in enumerate(zip(*(v.tolist() for v in x.values())))]
    return spark.createDataFrame(rows, ", ".join(f"{k} {'string' if k in more else 'double'}" for k in x)).repartition(5)


def test_correlations(spark):
    x = columns(1)
    names = list(x)
    found = {(r.diagnostic1, r.diagnostic2): r["corr"] for r in calibrate.correlation(frame(spark, x), names[::-1]).collect()}
    assert set(found) == {(a, b) for a in names for b in names}
    for (a, b), r in found.items():
        want = 1.0 if a == b else plain(x[a], x[b])
        assert r == (None if want is None else pytest.approx(want, abs=1e-6 if "b" in (a, b) else 1e-12)), (a, b)


def test_correlations_by_key_and_region(spark):
    x = columns(2)
    rng = np.random.default_rng(3)
    x["latitude"], x["k"] = rng.integers(-80, 81, 400).astype(float), np.array(["u", "v", None], object)[rng.integers(0, 3, 400)]
    df = frame(spark, {k: v for k, v in x.items()}, "k")
    found = {(r.k, r.diagnostic1, r.diagnostic2): r["corr"] for r in calibrate.correlation(df, ["a", "c", "e"], ["k"]).collect()}
    assert len(found) == 27
    for k in ("u", "v", None):
        at = np.array([v == k for v in x["k"]])
        assert found[k, "a", "c"] == pytest.approx(plain(x["a"][at], x["c"][at]), abs=1e-12)
    regional = {(r.hemisphere, r.region, r.diagnostic1, r.diagnostic2): r["corr"] for r in calibrate.regional_correlation(df, ["a", "c"]).collect()}
    exploded = {(r.hemisphere, r.region): r["corr"] for r in filters.by_region(df.where("a is not null and c is not null and not isnan(a) and not isnan(c)")).groupBy("hemisphere", "region").agg(F.corr("a", "c").alias("corr")).collect()}
    assert len(regional) == 9 * 4 and {k[:2] for k in regional} == set(exploded)
    for k, r in exploded.items():
        assert regional[(*k, "a", "c")] == pytest.approx(r, abs=1e-12) == regional[(*k, "c", "a")]


def test_plan_does_not_grow_with_pairs(spark):
    sizes = []
    for n in (3, 27):
        names = [f"x{i}" for i in range(n)]
        df = spark.range(10).select(*(F.rand(i).alias(c) for i, c in enumerate(names)))
        sizes.append(len(calibrate.correlation(df, names)._jdf.queryExecution().executedPlan().toString()))
    assert sizes[1] < sizes[0] + 27 * 200


def test_moments_merge():
    rng = np.random.default_rng(4)
    x = rng.normal(1e8, 1, (300, 4))
    x[rng.random(x.shape) < 0.3] = np.nan
    whole, parts = moments.of_rows(x), np.zeros((6, 4, 4))
    for k in (0, 1, 50, 51, 290):
        parts = moments.merged(parts, moments.of_rows(x[k : {0: 1, 1: 50, 50: 51, 51: 290, 290: 300}[k]]))
    np.testing.assert_allclose(parts, whole, rtol=1e-7, atol=1e-5)


@pytest.mark.parametrize("ranked", [1 << 23, 40])
def test_percentiles(spark, ranked, monkeypatch):
    monkeypatch.setattr(calibrate, "RANKED", ranked)
    rng = np.random.default_rng(5)
    x = {"a": rng.normal(size=5000), "b": rng.integers(0, 4, 5000).astype(float), "c": np.exp(rng.normal(size=5000) * 3), "d": np.full(5000, np.nan), "e": np.full(5000, 7.0)}
    x["a"][:700] = np.nan
    df = spark.createDataFrame([tuple(None if math.isnan(v) else v for v in r) for r in zip(*(v.tolist() for v in x.values()))], ", ".join(f"{k} double" for k in x)).repartition(4).cache()
    levels = Thresholds(light=0.0, light_to_moderate=50.0, moderate=93.7, severe=100.0)
    found = {r.diagnostic: r for r in calibrate.percentile_thresholds(df, list(x), levels, accuracy=200, spread=True).collect()}
    for k, v in x.items():
        held = v[~np.isnan(v)]
        for s, p in (("light", 0), ("light_to_moderate", 50), ("moderate", 93.7), ("severe", 100)):
            assert found[k][s] == (pytest.approx(np.percentile(held, p), rel=1e-12) if len(held) else None), (k, s)
        assert found[k].moderate_to_severe is None


def test_percentiles_of_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(float(i), float("nan") if i >= 900 else float(i), float("nan"), float("inf") if i >= 950 else -float(i)) for i in range(1000)], "a double, b double, c double, d double").repartition(3).cache()
    levels = Thresholds(light=10.0, moderate=89.0, severe=97.0)
    whole, ranked = ({r.diagnostic: str(tuple(r)) for r in calibrate.percentile_thresholds(df, list("abcd"), levels, accuracy=100, spread=x).collect()} for x in (False, True))
    assert ranked == whole


def test_two_scans_and_no_row_multiplied(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("b"))
    plan = calibrate.percentile_thresholds(df, ["a", "b"], Thresholds(light=50.0, severe=99.0), spread=True)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan and plan.count("Range (") == 1


STAR = [(0.0, 0.0), (10.0, 2.0), (20.0, 0.0), (14.0, 9.0), (20.0, 20.0), (9.0, 12.0), (0.0, 20.0), (6.0, 9.0)]


@pytest.mark.parametrize("tile", [1, 3, 256])
@pytest.mark.parametrize(("polygon", "step"), [(STAR, 1.3), (STAR, 7.0), ([(0, 0), (20, 0), (10, 20)], 2.5), ([(0, 0), (4, 0), (4, 4), (0, 4)], 1.0), ([(0, 0), (30, 1), (30, 1.2), (0, 0.2)], 0.5)])
def test_polygon_boxes(spark, polygon, step, tile):
    shape = np.array(polygon, float)
    (x0, y0), (x1, y1) = shape.min(axis=0), shape.max(axis=0)
    xs, ys = observe._edges(x0, x1, step), observe._edges(y0, y1, step)
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(xs) - 1), np.arange(len(ys) - 1), indexing="ij"))
    meets, _ = observe.meeting(shape, xs[i], ys[j], xs[i + 1], ys[j + 1])
    want = [(k, xs[a], ys[b], xs[a + 1], ys[b + 1]) for k, (a, b) in enumerate(zip(i[meets], j[meets]))]
    assert [tuple(r) for r in observe.polygon_boxes(spark, polygon, step, tile).orderBy("index_right").collect()] == want


def test_meeting():
    shape = np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])
    boxes = np.array([(2, 2, 3, 3), (-1, -1, 11, 11), (10, 4, 12, 5), (10.1, 4, 12, 5), (-5, 4, 20, 5), (0, 0, 1, 1), (-3, -3, -1, -1)], float)
    meets, within = observe.meeting(shape, *boxes.T)
    assert meets.tolist() == [True, True, True, False, True, True, False] and within.tolist() == [True, *[False] * 6]


def test_a_million_boxes(spark):
    boxes = observe.polygon_boxes(spark, [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], 0.1)
    assert boxes.agg(F.count("*"), F.max("index_right"), F.count_distinct("index_right")).first()[:] == (1_000_000, 999_999, 1_000_000)


def test_cells_of_equal_values_share_a_score_however_dealt(spark):
    values = [x / 7 for x in np.random.default_rng(5).random(40).tolist()]
    rows = [(i, 0, j, 0, 0.1 * (n % 5), v) for i, v in enumerate(values) for j in range(3) for n in range(11)]
    held = spark.createDataFrame(rows, f"{observe.INDICES[0]} int, {observe.INDICES[1]} int, {observe.INDICES[2]} int, {observe.INDICES[3]} int, edr double, s double")
    for parts in (1, 3, 7):
        found = observe.nearest_value_roc(held.repartition(parts), [ValidationCondition("edr", 0.3)], ["s"])
        assert {r.threshold for r in found.collect()} == {functools.reduce(operator.add, [v] * 11) / 11 for v in values} | {math.inf}
