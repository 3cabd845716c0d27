"""What is cut into parts gives what it gives whole: regions, distances, stencils, groups, uneven axes, clusters."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import diagnostics, metrics, observe, regions, stencil, tiles
from aerolith.schema import GroupMetric
from aerolith.sources.lattice import lattice

KEYS = ("time", "pressure_level", "latitude", "longitude")


def table(spark, masks, absent=()):
    """masks: (time, level, lat, lon) arrays as columns a, b; absent: cells without a row."""
    shape = masks[0].shape
    rows = [(*map(float, i[:4]), *(bool(m[i]) for m in masks)) for i in np.ndindex(shape) if i not in absent]
    return spark.createDataFrame(rows, "time double, pressure_level double, latitude double, longitude double, " + ", ".join(f"{n} boolean" for n in "ab"[: len(masks)]))


def held(df, column):
    return {tuple(int(r[k]) for k in KEYS): r[column] for r in df.collect()}


def winding(rng, shape, share):
    mask = rng.random(shape) < share
    mask[:, :, ::2, :] |= rng.random(mask[:, :, ::2, :].shape) < 0.8
    return mask


@pytest.mark.parametrize(("dims", "connectivity", "cells"), [(2, 1, 6), (2, 2, 6), (2, 2, 30), (3, 1, 8), (3, 2, 9), (3, 3, 20), (2, 2, 10_000)])
def test_labels_of_tiles(spark, dims, connectivity, cells):
    rng = np.random.default_rng(dims * 10 + connectivity)
    mask = winding(rng, (2, 3, 8, 9), 0.25)
    found = held(regions.label_regions(table(spark, [mask]), "a", dims, connectivity=connectivity, cells=cells), "label")
    for t in range(2):
        slices = [mask[t, p].T for p in range(3)] if dims == 2 else [mask[t].transpose(2, 1, 0)]
        for p, one in enumerate(slices):
            want = regions.components(one, connectivity)
            for i in np.ndindex(one.shape):
                at = (t, p, i[1], i[0]) if dims == 2 else (t, i[2], i[1], i[0])
                assert found[at] == want[i]


@pytest.mark.parametrize("cells", [4, 1000])
def test_absent_rows_are_gaps(spark, cells):
    mask = np.ones((1, 2, 3, 5), bool)
    absent = {(0, 0, j, 2) for j in range(3)}  # a column that one slice lacks and the other has
    found = held(regions.label_regions(table(spark, [mask], absent), "a", 2, cells=cells), "label")
    assert {v for k, v in found.items() if k[1] == 0 and k[3] < 2} == {1} and {v for k, v in found.items() if k[1] == 0 and k[3] > 2} == {2}
    assert {v for k, v in found.items() if k[1] == 1} == {1}
    target = np.zeros_like(mask)
    target[0, 0, 0, 0] = True
    far = held(regions.distance(table(spark, [mask, target], absent), "a", "b", cells=cells), "distance")
    assert far[0, 0, 0, 4] == 4 and far[0, 1, 0, 0] is None


def slow(inside, target, core, sampling, chebyshev):
    out = {}
    cells = [i for i in np.ndindex(target.shape) if target[i]]
    for i in np.ndindex(inside.shape):
        best = None
        for o in cells:
            d = [abs(a - b) * s for a, b, s in zip(i, o, sampling)]
            d = max(d) if chebyshev else sum(x * x for x in d) ** 0.5
            best = (d, o) if best is None or (d, o) < best else best
        out[i] = best if inside[i] else None
    return out


@pytest.mark.parametrize(("cells", "sampling", "chebyshev"), [(12, (1.0, 1.0), False), (25, (2.0, 1.0), False), (12, (1.0, 1.0), True), (10_000, (2.0, 1.0), False), (10_000, (1.0, 1.0), True)])
def test_distances(spark, cells, sampling, chebyshev):
    rng = np.random.default_rng(cells)
    a, b = rng.random((1, 3, 8, 9)) < 0.6, rng.random((1, 3, 8, 9)) < 0.06
    b[0, 2] = False
    found, _ = tiles.nearest_cells(table(spark, [a, b]), "a", "b", ["longitude", "latitude"], list(KEYS), sampling, chebyshev, cells)
    rows = {tuple(int(r[k]) for k in KEYS): (r.far, r.which) for r in found.collect()}
    assert len(rows) == a.size
    for p in range(3):
        for (i, j), want in slow(a[0, p].T, b[0, p].T, 2, sampling, chebyshev).items():
            got = rows[0, p, j, i]
            assert got == (None, None) if want is None else got[0] == pytest.approx(want[0])
            if want is not None and not chebyshev:
                assert got[1] == want[1][0] * 8 + want[1][1]


def test_distances_in_three_dimensions(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((1, 4, 5, 6)) < 0.5, rng.random((1, 4, 5, 6)) < 0.04
    one, other = (held(regions.distance(table(spark, [a, b]), "a", "b", ["longitude", "latitude", "pressure_level"], cells=n), "distance") for n in (20, 10_000))
    want = slow(a[0].transpose(2, 1, 0), b[0].transpose(2, 1, 0), 3, (1, 1, 1), False)
    assert one == other and all(one[0, k, j, i] == (None if w is None else pytest.approx(w[0])) for (i, j, k), w in want.items())


def test_great_circles_of_tiles(spark):
    rng = np.random.default_rng(3)
    df = table(spark, [rng.random((1, 2, 8, 9)) < 0.7, rng.random((1, 2, 8, 9)) < 0.1])
    assert held(regions.haversine_distance(df, "a", "b", cells=12), "distance") == held(regions.haversine_distance(df, "a", "b"), "distance")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 33])
@pytest.mark.parametrize("chebyshev", [False, True])
def test_line_minima(n, chebyshev):
    rng = np.random.default_rng(n)
    f = rng.integers(0, 12, (n, 40)).astype(float)
    f[rng.random(f.shape) < 0.5] = np.inf
    best, which = tiles.line_minima(f, 1.0, chebyshev)
    for j, i in itertools.product(range(40), range(n)):
        cost = [max(f[k, j], abs(i - k)) if chebyshev else f[k, j] + (i - k) ** 2 for k in range(n)]
        assert best[i, j] == min(cost) and (np.isinf(min(cost)) or which[i, j] == cost.index(min(cost)))


def test_tile_shapes():
    assert tiles.tile_shape((10, 10), 1000) == (10, 10) and tiles.tile_shape((10, 10), 30) == (5, 5) and tiles.tile_shape((10, 10), 30, 0) == (10, 3) and tiles.tile_shape((50, 2), 3, 0) == (50, 1)


@pytest.mark.parametrize("rows", [1, 700])
def test_bands(spark, sf_dir, rows):
    grid = lattice(spark, sf_dir)
    names = list(diagnostics.DIAGNOSTICS)
    whole = {tuple(r[:4]): r[4:] for r in diagnostics.diagnose(grid, names).collect()}
    banded = diagnostics.diagnose(grid, names, rows=rows)
    found = banded.collect()
    assert len(found) == len(whole) and banded.columns == diagnostics.diagnose(grid, names).columns
    for r in found:
        for x, y in zip(r[4:], whole[tuple(r[:4])], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-12, abs=0))


def test_bands_take_one_exchange(spark, sf_dir, tmp_path):
    lattice(spark, sf_dir).write.parquet(str(tmp_path / "g"))
    grid = spark.read.parquet(str(tmp_path / "g"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = diagnostics.diagnose(grid, rows=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 1
    sizes = stencil.bands(grid, 700).groupBy("time").count()
    assert sizes.count() > 4 and sizes.agg(F.max("count")).first()[0] <= 700 and stencil.own_rows(stencil.bands(grid, 600)).count() == grid.count()


GROUPS = [("hot", 900), ("tied", 400), ("one", 1), ("two", 2), ("none", 30), ("all", 25), (None, 300), ("odd", 41)]


@pytest.mark.parametrize(("metric", "how"), [(GroupMetric.TSS, {}), (GroupMetric.TSS, {"compat": True}), (GroupMetric.AUC, {}), (GroupMetric.AUC, {"simpson": True}), (GroupMetric.PREVALENCE, {})])
@pytest.mark.parametrize("tie", [["r"], ["name"]])
def test_hot_groups(spark, metric, how, tie):
    rng = random.Random(4)
    rows = [(g, rng.random() < {"none": 0, "all": 1}.get(g, 0.3), 5.0 if g == "tied" or rng.random() < 0.3 else float(rng.randrange(40)), k, f"n{k:05}") for g, n in GROUPS for k in range(n)]
    df = spark.createDataFrame(rows, "g string, t boolean, s double, r int, name string")
    whole, cut = ({r.g: (r.value, r.n) for r in metrics.grouped(df, "t", "s", ["g"], metric, 2, tie=tie, hot=hot, **how).collect()} for hot in (None, 20))
    assert set(whole) == {g for g, _ in GROUPS} == set(cut)
    for g, (value, n) in whole.items():
        assert cut[g] == (None if value is None else pytest.approx(value, abs=1e-12), n)


def test_uneven_axes(spark):
    rng = random.Random(1)
    times = sorted(rng.sample(range(0, 40_000_000, 900), 2500))
    rows = [(k, rng.choice([t + rng.choice([-10_800, -450, 0, 450, 5, 10_800, 10_801]) for t in rng.sample(times, 3)])) for k in range(500)] + [(900, None), (901, -99_999_999)]
    df = spark.createDataFrame(rows, "k int, v long")
    axis = observe.numbered_axis(spark.createDataFrame([(t,) for t in times + times[:5]], "x long"))
    found = observe.nearest_joined(df, F.col("v"), axis, 10_800, "i")
    for r in found.collect():
        d = None if r.v is None else min((abs(r.v - t), i) for i, t in enumerate(times))
        assert r.i == (d[1] if d and d[0] <= 10_800 else None)


def test_uneven_times_are_joined(spark, sf_dir):
    """A grid of many uneven times: indices of reports and cells, and no list of them in the plan."""
    times = [k * 7 + (k * k) % 5 for k in range(2500)]
    at = lambda x: F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=x)
    cells = spark.createDataFrame([(t, float(lat), float(lon)) for t in times for lat in (0, 1) for lon in (0, 1)], "h int, latitude double, longitude double")
    grid = cells.select(at(F.col("h")).alias("time"), F.lit(200.0).alias("pressure_level"), "latitude", "longitude")
    axes = observe.Axes(grid)
    reports = cells.where("latitude = 0 and longitude = 0").select(at(F.col("h") + 2).alias("datetime"), F.lit(200.0).alias("level"), "latitude", "longitude", "h")
    indexed = axes.indices(reports)
    numbered = axes.number(grid)
    for df in (indexed, numbered):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 20_000
    want = {h: min((abs(h + 2 - t), i) for i, t in enumerate(times))[1] for h in times}
    assert {r.h: r.time_index for r in indexed.collect()} == want
    assert sorted(r[0] for r in numbered.select("time_index").distinct().collect()) == list(range(2500)) and numbered.count() == 10_000


def test_clusters():
    # rows 0 and 1 are near each other as points, and 2 and 3; by |r| other names would join
    near = np.array([[1.0, 0.9, 0.0, 0.1], [0.9, 1.0, 0.1, 0.0], [0.0, 0.1, 1.0, 0.8], [0.1, 0.0, 0.8, 1.0]])
    assert regions.complete_linkage_order(near) == ([0, 1, 2, 3], [1, 1, 2, 2])
    apart = np.array([[1.0, -0.95, 0.2], [-0.95, 1.0, 0.1], [0.2, 0.1, 1.0]])
    assert regions.complete_linkage_order(apart) == ([1, 0, 2], [2, 1, 3])  # distances 2.76, 1.54 and 1.72: none within 1.38
    assert regions.complete_linkage_order(apart, "correlation") == ([2, 0, 1], [2, 2, 1])
    assert regions.complete_linkage_order(np.ones((1, 1))) == ([0], [1])
    with pytest.raises(ValueError):
        regions.complete_linkage_order(near, "other")
