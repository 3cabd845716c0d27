"""Published values and small worked examples."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions import geodesy, physics
from aerolith.operators import calibrate, filters, metrics, observe, regions, stencil
from aerolith.operators.filters import Domain, Thresholds
from aerolith.schema import Coordinate, GroupMetric, Limits, Severity, ThresholdMode, ValidationCondition


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_physics(spark):
    x = lambda *v: [F.lit(float(i)) for i in v]
    assert value(spark, physics.coriolis(*x(35))) == pytest.approx(8.365038e-05, rel=1e-4)
    assert value(spark, physics.potential_temperature(*x(270, 850))) == pytest.approx(282.8, abs=0.8)
    assert value(spark, physics.icao_altitude(*x(226.32))) == pytest.approx(11000, rel=1e-3)
    assert value(spark, physics.icao_pressure(physics.icao_troposphere_altitude(*x(500)))) == pytest.approx(500)
    for u, v, degrees in ((0, -10, 360), (-10, 0, 90), (0, 10, 180), (10, 0, 270), (0, 0, 0)):
        assert math.degrees(value(spark, physics.wind_direction(*x(u, v)))) == pytest.approx(degrees)
    assert value(spark, physics.angle_difference(*x(0.1, 6.2))) == pytest.approx(2 * math.pi - 6.1)
    assert value(spark, physics.ratio(*x(1, 0))) is None
    flags = [value(spark, physics.feature_flags(F.lit(a), F.lit(b))) for a in (True, False) for b in (True, False)]
    assert flags == [7, 4, 2, 0]
    with pytest.raises(TypeError):
        physics.ice_supersaturated(*x(220))
    with pytest.raises(Exception, match="pressure"):
        value(spark, physics.icao_troposphere_altitude(*x(100)))


def test_geodesy(spark):
    assert value(spark, geodesy.easting(F.lit(5.0))) == pytest.approx(556597.45396637)
    for a, b, metres in ((25, 35, 1108538.732549), (35, 45, 1110351.476283)):
        assert value(spark, geodesy.northing(F.lit(float(b))) - geodesy.northing(F.lit(float(a)))) == pytest.approx(metres, rel=1e-9)
        assert geodesy.vincenty(np.array([0.0]), np.array([a * 1.0]), np.array([0.0]), np.array([b * 1.0]))[0] == pytest.approx(metres, rel=1e-9)
    assert value(spark, geodesy.haversine(*(F.lit(x) for x in (77.037, 38.898, 2.294, 48.858)))) == pytest.approx(5846821.4, abs=0.1)
    a, b = Coordinate(51.5, 0.0), Coordinate(40.6, -73.8)
    points = geodesy.waypoints(spark, a, b, 20).orderBy("i").collect()
    assert (points[0].latitude, points[-1].longitude) == (pytest.approx(51.5), pytest.approx(-73.8))
    with pytest.raises(ValueError):
        geodesy.waypoints(spark, a, b, 1)
    with pytest.raises(ValueError):
        geodesy.check_degrees((-40, 40), "rad")


def test_thresholds():
    t = Thresholds(light=1, moderate=3, severe=9)
    assert t.bounds(Severity.LIGHT) == Limits(1, 3)
    assert t.bounds(Severity.SEVERE).upper == math.inf
    assert t.bounds(Severity.LIGHT, ThresholdMode.GEQ).upper == math.inf
    for bad in (lambda: Thresholds(light=2, severe=1), Thresholds, lambda: t.bounds(Severity.LIGHT_TO_MODERATE), lambda: Thresholds(light=1).bounds(Severity.LIGHT)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        ValidationCondition("x", -1)
    with pytest.raises(ValueError):
        Domain(Limits(10, -10), Limits(0, 1))
    assert Domain(Limits(-10, 10), Limits(1, 30)).one_hemisphere and Domain(Limits(-10, 11), Limits(1, 30)).centre(whole=True) == (15, 0)


def test_percentiles(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("a"))
    row = calibrate.percentile_thresholds(df, ["a"], Thresholds(light=90, light_to_moderate=93, moderate=95, moderate_to_severe=97, severe=99)).first()
    assert tuple(row)[1:] == pytest.approx((90, 93, 95, 97, 99))
    near = calibrate.percentile_thresholds(df, ["a"], Thresholds(light=90), approximate=True).first()
    assert abs(near.light - 90) <= 1 and near.severe is None


def test_roc_example(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.4), (2, 0.35), (2, 0.8)], "y int, s double")
    points = metrics.roc(metrics.curve(df, "y", "s", positive=2)).orderBy(F.desc("threshold")).collect()
    assert [p.fpr for p in points] == [0, 0, 0.5, 0.5, 1] and [p.tpr for p in points] == [0, 0.5, 0.5, 1, 1]
    assert metrics.area(metrics.roc(metrics.curve(df, "y", "s", positive=2))).first().auc == 0.75
    with pytest.raises(ValueError):
        metrics.curve(df, "y", "s")


def test_matthews_is_the_correlation(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(bool(a), bool(b)) for a, b in rng.integers(0, 2, (200, 2))], "x boolean, y boolean")
    m = metrics.contingency(df, "x", "y").select(metrics.matthews_table().alias("a"), metrics.jaccard().alias("j")).first()
    c = metrics.confusion(df, "x", "y").select(metrics.matthews().alias("b"), metrics.critical_success().alias("s")).first()
    r = [x["corr"] for x in calibrate.matthews_correlation(df, ["x", "y"]).collect() if x.diagnostic1 != x.diagnostic2][0]
    assert m.a == pytest.approx(c.b) and m.a == pytest.approx(r) and m.j == pytest.approx(c.s)
    with pytest.raises(TypeError):
        metrics.contingency(df.withColumn("x", F.lit(1)), "x", "y")


def test_odds(spark):
    aspirin = spark.createDataFrame([(189, 10845, 104, 10933)], "n11 long, n10 long, n01 long, n00 long")
    row = aspirin.select(metrics.odds_ratio(False).alias("o"), metrics.relative_risk(False).alias("r")).first()
    assert row.o == pytest.approx(1.83, abs=0.005) and row.r == pytest.approx(1.82, abs=0.005)


def _simpson(y, x):
    """Each pair of panels by the parabola through its points, a last odd one by the last three points'."""
    if len(x) < 3:
        return float(np.trapezoid(y, x))
    total, last = 0.0, len(x) - 1 - (len(x) - 1) % 2
    for i in [*range(0, last, 2), *([len(x) - 3] if len(x) % 2 == 0 else [])]:
        low = i + i % 2
        held = slice(i, i + 3)
        if 0 in np.diff(x[held]):
            total += np.trapezoid(y[low : i + 3], x[low : i + 3])
        else:
            whole = np.polyint(np.polyfit(x[held], y[held], 2))
            total += np.polyval(whole, x[i + 2]) - np.polyval(whole, x[low])
    return float(total)


def test_percentiles_in_two_passes(spark):
    """Equal to the exact aggregation, with ties, a value that half the rows have, nulls and a column of nulls alone."""
    n = 40_000
    df = spark.range(n).select(
        F.rand(3).alias("a"), F.when(F.rand(5) < 0.5, 0.0).otherwise(F.randn(7)).alias("b"), F.floor(F.rand(11) * 7).cast("double").alias("c"),
        F.when(F.rand(13) < 0.1, F.exp(F.randn(17))).alias("d"), F.lit(None).cast("double").alias("e"), F.when(F.col("id") == 5, 2.5).alias("f"),
    ).persist()
    for percentiles in (Thresholds(light=0, light_to_moderate=50, moderate=95, severe=100), Thresholds(light=33.3, severe=99.9)):
        wanted, found = ({r.diagnostic: tuple(r)[1:] for r in calibrate.percentile_thresholds(df, list("abcdef"), percentiles, accuracy=100, spread=x).collect()} for x in (False, True))
        assert found == wanted
    df.unpersist()


def test_simpson(spark):
    rng = np.random.default_rng(4)
    sets = {"five": [0.0, 0.1, 0.4, 0.7, 1.0], "four": [0.0, 0.1, 0.4, 0.7], "two": [0.0, 1.0], "one": [0.5], "ties": [0.0, 0.0, 0.5, 0.5, 0.5, 1.0]}
    sets |= {f"any{n}": np.sort(rng.random(n)).tolist() for n in range(3, 12)}
    rows = [(g, i + 1, len(xs), x, x * x if g in ("five", "four") else float(rng.random())) for g, xs in sets.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, place int, n int, x double, y double")
    w = Window.partitionBy("g").orderBy("place")
    parts = df.withColumn("part", metrics._simpson_part(F.col("x"), F.col("y"), F.col("place"), F.col("n"), w))
    found = {r.g: r.area for r in parts.groupBy("g").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("area")).collect()}
    assert found["five"] == pytest.approx(1 / 3) and found["four"] == pytest.approx(0.7**3 / 3)
    for g, xs in sets.items():
        ys = np.array([r[4] for r in rows if r[0] == g])
        assert found[g] == pytest.approx(_simpson(ys, np.array(xs)), abs=1e-9), g


def test_grouped_skill(spark):
    rows = [("a", s, t) for s, t in ((9.0, True), (8.0, True), (7.0, False), (6.0, False))] + [("b", 1.0, True), ("c", 1.0, False), ("c", 2.0, False), ("c", 3.0, True)]
    df = spark.createDataFrame(rows, "g string, s double, t boolean")
    found = {m: {r.g: r.value for r in metrics.grouped(df, "t", "s", ["g"], m, 2).collect()} for m in GroupMetric}
    assert found[GroupMetric.TSS] == {"a": 1.0, "b": None, "c": -1.0}
    assert found[GroupMetric.PREVALENCE]["a"] == 0.5 and found[GroupMetric.AUC]["a"] == 1.0
    simpson = {r.g: r.value for r in metrics.grouped(df, "t", "s", ["g"], GroupMetric.AUC, 2, simpson=True).collect()}
    assert simpson == {"a": 1.0, "b": None, "c": -1.0}


def test_components_and_distances():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert regions.components(mask).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3]]
    assert regions.components(mask, 1).max() == 4
    rng = np.random.default_rng(2)
    for shape in ((7, 9), (4, 5, 6)):
        target = rng.random(shape) < 0.15
        cells = np.argwhere(target)
        far, which = regions.nearest(target, (2.0, *[1.0] * (len(shape) - 1)))
        square, _ = regions.nearest(target, (1.0,) * len(shape), chebyshev=True)
        for at in np.ndindex(shape):
            step = cells - np.array(at)
            true = np.sqrt(((step * ([2.0] + [1.0] * (len(shape) - 1))) ** 2).sum(axis=1))
            assert far[at] == pytest.approx(true.min()) and square[at] == np.abs(step).max(axis=1).min()
            assert true[np.ravel_multi_index(cells.T, shape) == which[at]][0] == pytest.approx(true.min())


def test_monotone_interpolation(spark):
    """Nodes keep their values, monotone lines stay monotone, straight ones straight; repeated points have their rows."""
    lats, lons = [0.0, 1.0, 2.0], [0.0, 2.0, 4.0, 6.0, 8.0]
    along = [0.0, 1.0, 1.0, 3.0, 10.0]
    cells = [(k, lat, lon, along[j] if k == "bent" else 3 * lat + lon if k == "even" else None if (lat, lon) == (0.0, 8.0) else 1.0) for k in ("bent", "even", "holed") for lat in lats for j, lon in enumerate(lons)]
    grid = spark.createDataFrame(cells, "k string, latitude double, longitude double, f double")
    places = [(float(y), float(x)) for y in (0.0, 0.3, 1.0, 1.9, 2.0) for x in np.linspace(0, 8, 33)]
    points = spark.createDataFrame([*places, places[0]], "latitude double, longitude double")
    for method in ("pchip", "linear"):
        found = observe.interpolate(points, grid, "f", lats, lons, method, ["k"]).collect()
        assert len(found) == 3 * len(places) + 3
        at = {(r.k, r.latitude, r.longitude): r.f for r in found}
        for y in (0.0, 0.3, 1.0, 1.9, 2.0):
            bent = [at["bent", y, x] for x in np.linspace(0, 8, 33)]
            assert (np.diff(bent) >= -1e-12).all() and bent[::8] == pytest.approx(along)
        assert all(at["even", y, x] == pytest.approx(3 * y + x) for y, x in places)
        assert at["holed", 0.0, 8.0] is None and at["holed", 0.3, 0.25] == pytest.approx(1.0)
    ends = spark.createDataFrame([("k", y, x, 5 * y + x) for y in (0.0, 1.0) for x in (0.0, 2.0)], "k string, latitude double, longitude double, f double")
    half = spark.createDataFrame([(0.5, 1.0)], "latitude double, longitude double")
    assert observe.interpolate(half, ends, "f", [0.0, 1.0], [0.0, 2.0], "pchip", ["k"]).first().f == pytest.approx(3.5)


def test_boxes_and_joins(spark):
    for step, n in ((1.0, 25), (5.0, 1), (2.5, 4)):
        assert observe.boxes(spark, Domain(Limits(0, 5), Limits(0, 5)), step).count() == n
    domain = Domain(Limits(0, 4), Limits(0, 4))
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.5, 0.5), (2, 0.0, 0.0), (3, 9.0, 9.0), (4, 1.0, 0.5)], "i int, latitude double, longitude double")
    found = observe.spatial_join(points, domain, 1.0)
    assert sorted((r.i, r.index_right) for r in found.select("i", "index_right").collect()) == sorted((r.i, r.index_right) for r in observe.join_boxes(points, observe.boxes(spark, domain, 1.0)).select("i", "index_right").collect())
    assert found.where("i = 0").count() == 4 and found.where("i = 4").count() == 2 and found.where("i = 3").count() == 0
    assert observe.polygon_boxes(spark, [(0, 0), (2, 0), (0, 2)], 1.0).count() == 4  # one touches the edge alone


def test_levels_and_indices(spark):
    df = spark.createDataFrame([(500.0,), (1000.0,), (2000.0,), (9000.0,), (15000.0,)], "alt double")
    level = observe.nearest_level(F.col("alt"), [1013.25, 843.07, 329.32, 238.42, 187.54], [0, 1524, 8534.4, 10668, 12192])
    assert [r[0] for r in df.select(level).collect()] == [1013.25, 843.07, 843.07, 329.32, 187.54]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r[0] for r in halves.select(observe.regular_index(F.col("v"), 0.0, 1.0, 5)).collect()] == [0, 2, 2]
    with pytest.raises(Exception, match="outside"):
        halves.select(observe.regular_index(F.col("v"), 0.0, 1.0, 2)).collect()
    with pytest.raises(ValueError):
        observe.regular_index(F.col("v"), 0.0, 1.0, 2, window=3.0)


def test_shift_and_spacing(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("p"), (F.col("id") % 3 == 0).alias("f"))
    found = [r.combined for r in stencil.shift_and_combine(df, "f", ["g"], "p", offset_start=2, offset_end=1).orderBy("p").collect()]
    flags = [i % 3 == 0 for i in range(10)]
    assert found == [flags[i - 2] or flags[i + 1] for i in range(2, 9)]
    assert stencil.regular_spacing(df, "p") == 1.0
    assert stencil.regular_spacing(df.withColumn("q", F.col("p") * F.col("p")), "q") is None
    with pytest.raises(ValueError):
        stencil.shift_and_combine(df, "f", ["g"], "p", offset_start=-1)


def test_derivative_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x, f = np.sort(rng.random(12)) * 300, rng.random(12)
    rows = [(0, float(a), 0.0, 0.0, float(b)) for a, b in zip(x, f)]
    df = spark.createDataFrame(rows, "time int, pressure_level double, latitude double, longitude double, f double")
    found = [r.d for r in df.withColumn("d", stencil.first_derivative(F.col("f"), stencil.P)).orderBy("pressure_level").collect()]
    assert np.allclose(found, np.gradient(f, x))


def test_quality_filters(spark):
    df = spark.createDataFrame([("Z", 112, 5.0), ("X", 45, 5.0), ("S", 102, 5.0), ("G", 45, None)], "flag string, error int, v double")
    assert filters.good_errors(filters.good_flags(df, ["flag", "none"]), ["error"]).count() == 2
    assert filters.complete(df, ["v", "absent"], ["flag", "gone"]).columns == ["flag"]


def test_nearest_on_even_axes(spark):
    """Arithmetic gives what comparing all values gives, ties included."""
    even, uneven = [float(x) for x in range(-10, 30, 4)], [0.0, 1.0, 5.0]
    df = spark.range(-150, 350).select((F.col("id") / 10).alias("v"))
    for axis in (even, uneven):
        assert df.select(observe.nearest_of(F.col("v"), axis).alias("a"), observe.nearest_index(F.col("v"), axis).alias("b")).where("a != b").count() == 0


def test_boxes_of_a_table(spark):
    """Points on edges are in all boxes that they touch, whatever the boxes' sizes."""
    held = [(0, 0.0, 0.0, 2.0, 2.0), (1, 2.0, 0.0, 7.0, 3.0), (2, -3.0, -1.0, 0.0, 5.0), (3, 6.5, 2.5, 6.75, 9.0)]
    grid = spark.createDataFrame(held, "index_right int, min_x double, min_y double, max_x double, max_y double")
    points = [(float(x) / 2, float(y) / 2) for x in range(-8, 16) for y in range(-4, 20)]
    found = observe.join_boxes(spark.createDataFrame(points, "longitude double, latitude double"), grid).collect()
    assert sorted((r.longitude, r.latitude, r.index_right) for r in found) == sorted((x, y, k) for x, y in points for k, a, b, c, d in held if a <= x <= c and b <= y <= d)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_curves_in_ranges_are_whole_curves(spark, keys):
    from pyspark.sql import Window

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2503 / 10).alias("s"), (F.col("id") * 31 % 7 < 3).alias("t"))
    found = metrics.curve(df, "t", "s", keys, spread=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    counts = metrics.score_counts(df, "t", "s", keys)
    whole = counts.select(*keys, F.col("score").alias("threshold"), F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))
    assert sorted(found.collect()) == sorted(whole.collect())
    roc = metrics.roc(found, keys)
    v = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    parts = roc.withColumn("a", (F.col("fpr") - F.lag("fpr").over(v)) * (F.col("tpr") + F.lag("tpr").over(v)) / 2)
    wanted = {tuple(r[k] for k in keys): (r.a, r.n) for r in parts.groupBy(*keys).agg(F.sum("a").alias("a"), F.count("*").alias("n")).collect()}
    for r in metrics.area(roc, keys, spread=True).collect():
        assert (r.auc, r.points) == (pytest.approx(wanted[tuple(r[k] for k in keys)][0]), wanted[tuple(r[k] for k in keys)][1])


def test_geodesics_near_antipodes():
    """Where the iteration on longitude does not settle: published lengths, half a meridian, and both ways round."""
    at = lambda *x: geodesy.vincenty(*(np.array([v]) for v in x))[0]
    assert at(0.0, 0.0, 179.5, 0.5) == pytest.approx(19936288.579, abs=1e-3) and at(0.0, 0.0, 179.7, 0.5) == pytest.approx(19944127.421, abs=1e-3)
    assert at(0.0, 0.0, 180.0, 0.0) == pytest.approx(20003931.4586, abs=1e-3) == at(12.0, 30.0, -168.0, -30.0)
    assert at(179.7, 0.5, 0.0, 0.0) == pytest.approx(at(0.0, 0.0, 179.7, 0.5), abs=1e-6) and np.isnan(at(0.0, np.nan, 1.0, 2.0))
    rng = np.random.default_rng(0)
    a, b, lon = rng.uniform(-85, 85, 300), rng.uniform(-85, 85, 300), rng.uniform(-170, 170, 300)
    u, v = (np.arctan((1 - geodesy.FLATTENING) * np.tan(np.radians(x))) for x in (a, b))
    np.testing.assert_allclose(geodesy._by_azimuth(np.abs(np.radians(lon)), u, v), geodesy.vincenty(np.zeros(300), a, lon, b), atol=1e-5)


def test_waypoints_of_routes(spark):
    a, b = Coordinate(51.47, -0.45), Coordinate(40.64, -73.78)
    one = [(r.latitude, r.longitude) for r in geodesy.waypoints(spark, a, b, 9).orderBy("i").collect()]
    df = spark.createDataFrame([(1, 51.47, -0.45, 40.64, -73.78), (2, 10.0, 20.0, 10.0, 20.0), (3, None, 0.0, 1.0, 1.0)], "k int, la double, lo double, ta double, to double")
    rows = geodesy.route_waypoints(df, "la", "lo", "ta", "to", 9).orderBy("k", "i").collect()
    assert [(pytest.approx(r.way_latitude), pytest.approx(r.way_longitude)) for r in rows if r.k == 1] == one
    assert all((r.way_latitude, r.way_longitude) == (pytest.approx(10), pytest.approx(20)) for r in rows if r.k == 2)
    assert [r.way_latitude for r in rows if r.k == 3] == [None] * 9
    with pytest.raises(ValueError):
        geodesy.route_waypoints(df, "la", "lo", "ta", "to", 1)
