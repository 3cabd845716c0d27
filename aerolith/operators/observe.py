"""Observations on the grid: boxes, nearest levels and indices, gathering, scattering and interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.operators import metrics
from aerolith.operators.filters import Domain
from aerolith.schema import CELL, INDICES, LAT, LEVEL, LON, TIME, GroupBy, ValidationCondition, require

c = F.col
#: Values of an uneven axis up to which they are a list in an expression; a longer one is joined, and broadcast up to so many.
LISTED, BROADCAST_ROWS = 64, 1 << 20


def _edges(low: float, high: float, step: float) -> np.ndarray:
    return np.linspace(low, high, math.ceil((high - low) / step) + 1)


def boxes(spark: SparkSession, domain: Domain, step: float) -> DataFrame:
    """(index_right, min_x, min_y, max_x, max_y): equal boxes of about `step` degrees over the domain, numbered down each column."""
    if step <= 0:
        raise ValueError("the step is positive")
    ax, ay = domain.longitude, domain.latitude
    nx, ny = (math.ceil((a.upper - a.lower) / step) for a in (ax, ay))
    wx, wy = (ax.upper - ax.lower) / nx, (ay.upper - ay.lower) / ny
    x, y = F.floor(c("id") / ny), c("id") % ny
    return spark.range(nx * ny).select(c("id").cast("int").alias("index_right"), (ax.lower + x * wx).alias("min_x"), (ay.lower + y * wy).alias("min_y"), (ax.lower + (x + 1) * wx).alias("max_x"), (ay.lower + (y + 1) * wy).alias("max_y"))


#: Boxes on a side of the tiles in which a polygon's boxes are found, one to a task's row; comparisons made at once.
TILE, AT_ONCE = 256, 1 << 21


def meeting(polygon: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(meets, within) of rectangles and a simple polygon: whether they have a point in common, and whether it holds them whole."""
    rows = max(1, AT_ONCE // (16 * len(polygon)))
    if len(x0) > rows:
        parts = [meeting(polygon, *(v[k : k + rows] for v in (x0, y0, x1, y1))) for k in range(0, len(x0), rows)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    ax, ay = polygon.T[:, None, None, :]
    bx, by = np.roll(polygon, 1, axis=0).T[:, None, None, :]
    px, py = np.stack([x0, x1, x1, x0], 1)[:, :, None], np.stack([y0, y0, y1, y1], 1)[:, :, None]  # corners, in turn
    with np.errstate(divide="ignore", invalid="ignore"):
        right = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    corners = right.sum(axis=2) % 2 == 1
    vertex = ((x0[:, None] <= polygon[:, 0]) & (polygon[:, 0] <= x1[:, None]) & (y0[:, None] <= polygon[:, 1]) & (polygon[:, 1] <= y1[:, None])).any(axis=1)
    qx, qy = np.roll(px, 1, axis=1), np.roll(py, 1, axis=1)  # a side goes from the corner before
    side = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    crossed = (side(bx, by, ax, ay, qx, qy) * side(bx, by, ax, ay, px, py) <= 0) & (side(qx, qy, px, py, bx, by) * side(qx, qy, px, py, ax, ay) <= 0)
    crossed &= (np.maximum(np.minimum(ax, bx), np.minimum(px, qx)) <= np.minimum(np.maximum(ax, bx), np.maximum(px, qx))) & (np.maximum(np.minimum(ay, by), np.minimum(py, qy)) <= np.minimum(np.maximum(ay, by), np.maximum(py, qy)))
    edge = vertex | crossed.any(axis=(1, 2))
    return edge | corners.any(axis=1), ~edge & corners.all(axis=1)


def _refined(polygon: np.ndarray, xs: np.ndarray, ys: np.ndarray, i0: int, j0: int, i1: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the boxes i0 to i1, j0 to j1 that meet the polygon: quarters that it holds or misses are not looked into."""
    todo, found = np.array([[i0, j0, i1, j1]]), []
    while len(todo):
        a, b, c_, d = todo.T
        meets, within = meeting(polygon, xs[a], ys[b], xs[c_], ys[d])
        single = (c_ - a == 1) & (d - b == 1)
        for k in np.flatnonzero(meets & (within | single)).tolist():
            i, j = np.meshgrid(np.arange(a[k], c_[k]), np.arange(b[k], d[k]), indexing="ij")
            found.append(np.stack([i.ravel(), j.ravel()]))
        a, b, c_, d = todo[meets & ~within & ~single].T
        m, n = (a + c_ + 1) // 2, (b + d + 1) // 2
        todo = np.concatenate([np.stack(q, 1) for q in ((a, b, m, n), (m, b, c_, n), (a, n, m, d), (m, n, c_, d))])
        todo = todo[(todo[:, 0] < todo[:, 2]) & (todo[:, 1] < todo[:, 3])]
    return tuple(np.concatenate([*found, np.zeros((2, 0), int)], axis=1))


def polygon_boxes(spark: SparkSession, polygon: list[tuple[float, float]], step: float, tile: int = TILE) -> DataFrame:
    """(index_right, min_x, min_y, max_x, max_y): boxes over a polygon's bounding rectangle that meet the polygon, numbered anew, down each column.

    Tiles of boxes are refined in tasks: a quarter that the polygon misses goes, one that it holds stays whole, others are
    cut again down to single boxes. Boxes of a column are numbered together after those of the columns before.
    """
    if step <= 0:
        raise ValueError("the step is positive")
    shape = np.array(polygon, float)
    (x0, y0), (x1, y1) = shape.min(axis=0), shape.max(axis=0)
    xs, ys = _edges(x0, x1, step), _edges(y0, y1, step)
    nx, ny = len(xs) - 1, len(ys) - 1
    across, down = -(-nx // tile), -(-ny // tile)

    def made(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i0, j0 = k // down * tile, k % down * tile
                i, j = _refined(shape, xs, ys, i0, j0, min(i0 + tile, nx), min(j0 + tile, ny))
                columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(v) for v in (xs[i], ys[j], xs[i + 1], ys[j + 1]))]
                yield pa.RecordBatch.from_arrays(columns, ["i", "j", "min_x", "min_y", "max_x", "max_y"])

    found = spark.range(0, across * down, 1, min(across * down, 1 << 12)).mapInArrow(made, "i int, j int, min_x double, min_y double, max_x double, max_y double")
    earlier = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a row a column of boxes
    before = found.groupBy("i").agg(F.count("*").alias("_n")).select("i", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1 + c("_before")
    return found.join(before, "i").select(number.cast("int").alias("index_right"), "min_x", "min_y", "max_x", "max_y")


def spatial_join(points: DataFrame, domain: Domain, step: float) -> DataFrame:
    """points with index_right, a row for each box that holds the point; a point on a shared edge is in each of those boxes.

    The boxes are a rule, not a table: candidates come from the point's own position, so there is no join at all.
    """
    ax, ay = domain.longitude, domain.latitude
    nx, ny = (math.ceil((a.upper - a.lower) / step) for a in (ax, ay))
    wx, wy = (ax.upper - ax.lower) / nx, (ay.upper - ay.lower) / ny

    def held(v: Column, low: float, width: float, n: int) -> Column:
        near = F.floor((v - low) / width).cast("int")
        return F.filter(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i < n) & (v >= low + i * width) & (v <= low + (i + 1) * width))

    rows = points.withColumn("_x", F.explode(held(c(LON), ax.lower, wx, nx))).withColumn("_y", F.explode(held(c(LAT), ay.lower, wy, ny)))
    return rows.withColumn("index_right", (c("_x") * ny + c("_y")).cast("int")).drop("_x", "_y")


def join_boxes(points: DataFrame, grid: DataFrame) -> DataFrame:
    """points with the index_right of each of the given boxes that holds them (a table of boxes, as of a polygon), however many.

    Boxes are listed under the cells that they touch, of the size of the largest box, so at most four; a point is in one.
    """
    sizes = grid.agg(F.max(c("max_x") - c("min_x")), F.max(c("max_y") - c("min_y"))).first()
    wx, wy = (float(s) if s else 1.0 for s in sizes)
    cells = lambda low, high, w: F.explode(F.sequence(F.floor(c(low) / w), F.floor(c(high) / w)))
    listed = grid.withColumn("_x", cells("min_x", "max_x", wx)).withColumn("_y", cells("min_y", "max_y", wy))
    placed = points.withColumns({"_x": F.floor(c(LON) / wx), "_y": F.floor(c(LAT) / wy)})
    held = (c(LON) >= c("min_x")) & (c(LON) <= c("max_x")) & (c(LAT) >= c("min_y")) & (c(LAT) <= c("max_y"))
    return placed.join(listed, ["_x", "_y"]).where(held).select(*points.columns, "index_right")


def nearest_index(value: Column, axis: Iterable[float]) -> Column:
    """Index of the nearest of an axis' values, the first of equals; axes are short lists."""
    axis = list(axis)
    apart = F.array(*(F.struct(F.abs(value - x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(axis)))
    return F.when(value.isNotNull(), F.array_min(apart)["i"])


def nearest_of(value: Column, axis: Iterable[float]) -> Column:
    """nearest_index, by arithmetic where the axis rises evenly, as long axes do; values beyond its ends have the end's."""
    axis = [float(x) for x in axis]
    steps = np.diff(axis)
    if len(axis) < 3 or steps[0] <= 0 or not np.allclose(steps, steps[0], rtol=0, atol=1e-9):
        return nearest_index(value, axis)
    # of two at the same distance the first
    return F.least(F.greatest(F.ceil((value - axis[0]) / float(steps[0]) - 0.5), F.lit(0)), F.lit(len(axis) - 1)).cast("int")


def numbered_axis(values: DataFrame) -> DataFrame:
    """(x, i): the distinct values of the column x in order, numbered from 0. An axis is numbered in one place."""
    return values.select("x").where("x is not null").distinct().select("x", (F.row_number().over(Window.orderBy("x")) - 1).alias("i"))


def nearest_joined(df: DataFrame, value: Column, axis: DataFrame, within: float, name: str) -> DataFrame:
    """df with `name`: the index of the axis' value that is nearest, the first of equals, null if none is within the distance.

    axis: (x, i), values and their indices, any number of them at any spacing. Each is listed under three buckets as wide as
    the distance, so that a row meets in its own bucket all that it may be near to and nothing from afar. A bucket is one
    row of the listed axis, which is broadcast if the axis is short enough, so rows of df are neither multiplied nor grouped.
    """
    if within <= 0:
        raise ValueError("the distance is positive")
    bucket = lambda x: F.floor(x / F.lit(float(within))).cast("long")
    under = F.explode(F.sequence(bucket(c("x")) - 1, bucket(c("x")) + 1)).alias("_bucket")
    near = axis.select(c("x").cast("double").alias("x"), "i").select(under, "x", "i").groupBy("_bucket").agg(F.collect_list(F.struct("x", "i")).alias("_near"))
    placed = df.withColumn("_value", value.cast("double")).withColumn("_bucket", bucket(c("_value")))
    joined = placed.join(F.broadcast(near) if axis.count() <= BROADCAST_ROWS else near, "_bucket", "left")
    best = F.array_min(F.transform("_near", lambda n: F.struct(F.abs(c("_value") - n["x"]).alias("d"), n["i"].alias("i"))))
    return joined.withColumn("_best", best).withColumn(name, F.when(c("_best.d") <= within, c("_best.i"))).drop("_value", "_bucket", "_near", "_best")


def nearest_level(altitude: Column, levels: list[float], level_altitudes: list[float]) -> Column:
    """The pressure level whose altitude is nearest."""
    return F.element_at(F.array(*(F.lit(float(x)) for x in levels)), nearest_index(altitude, level_altitudes) + 1)


def regular_index(value: Column, first: float, spacing: float, size: int, window: float | None = None) -> Column:
    """Index on a regular axis, halves to even. Values beyond the axis by more than half a spacing are an error.

    window: largest distance from the axis' ends; only half the spacing makes sense and any other is refused.
    """
    if window is not None and not math.isclose(window, abs(spacing) / 2):
        raise ValueError("the window must be half the spacing")
    i = F.rint((value - first) / spacing).cast("int")
    bad = F.raise_error(F.concat(F.lit("outside of the axis: "), value.cast("string"))).cast("int")
    return F.when(value.isNull(), None).when((i >= 0) & (i < size), i).otherwise(bad)


def value_at(index: Column, axis: list) -> Column:
    """The axis' value at an index; an index outside of it is an error."""
    bad = F.raise_error(F.concat(F.lit("no such index: "), index.cast("string"))).cast("double")
    return F.when(index.isNull(), None).when((index >= 0) & (index < len(axis)), F.element_at(F.array(*map(F.lit, axis)), index + 1)).otherwise(bad)


def _axis_value(index: Column, axis: list[int]) -> Column:
    """The axis' value at an index that it has; by arithmetic where it is even."""
    steps = np.diff(axis)
    if len(axis) > 2 and (steps == steps[0]).all():
        return F.lit(axis[0]) + index * int(steps[0])
    return F.element_at(F.array(*map(F.lit, axis)), index + 1)


def _even(axis: list) -> bool:
    steps = np.diff(axis)
    return len(axis) >= 3 and steps[0] > 0 and bool(np.allclose(steps, steps[0], rtol=0, atol=1e-9))


class Axes:
    """The grid's four axes, read once; each is a list on the driver, as long as the axis.

    Indices on even axes are arithmetic. An uneven axis is a list in an expression if it has LISTED values at most, as
    levels have; longer ones, as times of several winters, are joined.
    """

    def __init__(self, grid: DataFrame) -> None:
        row = grid.agg(*(F.sort_array(F.collect_set(k)).alias(k) for k in (TIME, LEVEL, LAT, LON))).first()
        self.time, self.level, self.lat, self.lon = (row[k] for k in (TIME, LEVEL, LAT, LON))
        self.kinds = {k: grid.schema[k].dataType.simpleString() for k in (TIME, LEVEL, LAT, LON)}

    def _regular(self, values: list[float]) -> tuple[float, float]:
        steps = np.diff(values)
        if len(values) < 2 or not np.allclose(steps, steps[0]):
            raise ValueError("the axis is not regular")
        return values[0], float(steps[0])

    @property
    def seconds(self) -> list[int]:
        """Each time's seconds after the first."""
        return [int((t - self.time[0]).total_seconds()) for t in self.time]

    def indices(self, observations: DataFrame, tolerance_hours: float = 3.0) -> DataFrame:
        """observations with level_index (from level), lat_index, lon_index and time_index (from datetime).

        Times farther than the tolerance from every time of the grid have a null index.
        """
        (lat0, dlat), (lon0, dlon) = self._regular(self.lat), self._regular(self.lon)
        seconds, within = self.seconds, int(tolerance_hours * 3600)
        second = F.unix_seconds(c("datetime").cast("timestamp")) - F.unix_seconds(F.lit(self.time[0]).cast("timestamp"))
        placed = observations.withColumns({
            "level_index": nearest_index(c("level"), self.level), "lat_index": regular_index(c(LAT), lat0, dlat, len(self.lat)),
            "lon_index": regular_index(c(LON), lon0, dlon, len(self.lon)),
        })
        if len(seconds) > LISTED and not _even(seconds):
            axis = observations.sparkSession.createDataFrame(list(zip(map(float, seconds), range(len(seconds)))), "x double, i int")
            return nearest_joined(placed, second, axis, within, "time_index")
        near = nearest_of(second.cast("double"), seconds)
        return placed.withColumn("time_index", F.when(F.abs(second - _axis_value(near, seconds)) <= within, near))

    def number(self, grid: DataFrame) -> DataFrame:
        """grid with its own index columns."""
        first = F.unix_seconds(F.lit(self.time[0]).cast("timestamp"))
        value = {LEVEL: c(LEVEL), LAT: c(LAT), LON: c(LON), TIME: (F.unix_seconds(c(TIME).cast("timestamp")) - first).cast("double")}
        held = {LEVEL: self.level, LAT: self.lat, LON: self.lon, TIME: self.time}
        names = {LEVEL: "level_index", LAT: "lat_index", LON: "lon_index", TIME: "time_index"}
        columns = grid.columns
        for k, name in names.items():
            axis = [float(x) for x in (self.seconds if k == TIME else held[k])]
            if len(axis) > LISTED and not _even(axis):
                places = grid.sparkSession.createDataFrame(list(zip(held[k], range(len(axis)))), f"`{k}` {self.kinds[k]}, {name} int")
                grid = grid.join(F.broadcast(places) if len(axis) <= BROADCAST_ROWS else places, k, "left")
            else:
                grid = grid.withColumn(name, nearest_of(value[k], axis))
        return grid.select(*columns, *names.values())

    def flat(self) -> Column:
        """Row-major number of a cell in order latitude, longitude, time, level."""
        return ((c("lat_index") * len(self.lon) + c("lon_index")) * len(self.time) + c("time_index")) * len(self.level) + c("level_index")

    def coordinates(self, df: DataFrame) -> DataFrame:
        """Index columns back to coordinates."""
        return df.withColumns({f"grid_{k}": value_at(c(f"{i}_index"), getattr(self, i)) for k, i in ((LAT, "lat"), (LON, "lon"), (LEVEL, "level"))})


def gather(observations: DataFrame, numbered: DataFrame, names: list[str]) -> DataFrame:
    """observations with the named values of their cell, null where they have none; numbered has one row a cell."""
    return observations.join(numbered.select(*INDICES, *names), INDICES, "left")


def observed_cells(numbered: DataFrame, observations: DataFrame) -> DataFrame:
    """numbered with `observed`: whether a cell has an observation."""
    seen = observations.select(*INDICES).dropna().distinct().withColumn("_seen", F.lit(True))
    return numbered.join(seen, INDICES, "left").withColumn("observed", F.coalesce("_seen", F.lit(False))).drop("_seen")


def positive_cells(numbered: DataFrame, observations: DataFrame, condition: ValidationCondition) -> DataFrame:
    """numbered with `positive`: whether any observation of the cell meets the condition."""
    hit = observations.groupBy(*INDICES).agg(F.bool_or(c(condition.column) > condition.greater_than).alias("_hit"))
    return numbered.join(hit, INDICES, "left").withColumn("positive", F.coalesce("_hit", F.lit(False))).drop("_hit")


def observation_counts(observations: DataFrame, column: str, strategy: GroupBy) -> DataFrame:
    """(group keys, num_obs): non-null values of the column."""
    return observations.groupBy(*strategy.keys).agg(F.count(column).alias("num_obs"))


def enough_observations(df: DataFrame, counts: DataFrame, keys: list[str], quantile: float = 0.25) -> DataFrame:
    """Rows of groups that have at least the lower quartile's number of observations."""
    least = counts.agg(F.percentile_approx("num_obs", quantile).alias("_least"))  # one row
    fit = counts.crossJoin(F.broadcast(least)).where("num_obs >= _least").select(*keys)
    return df.join(fit, keys, "left_semi")


def count_histogram(counts: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, lower, held) of num_obs in equal bins, empty ones left out."""
    ends = counts.agg(F.min("num_obs").alias("low"), F.max("num_obs").alias("high"))
    rows = counts.crossJoin(F.broadcast(ends)).withColumn("_w", F.greatest((c("high") - c("low")) / bins, F.lit(1e-12)))
    placed = rows.withColumn("bin", F.least(F.floor((c("num_obs") - c("low")) / c("_w")), F.lit(bins - 1)).cast("int"))
    return placed.groupBy("bin").agg(F.min(c("low") + c("bin") * c("_w")).alias("lower"), F.count("*").alias("held"))


def aggregate_by_box(grid: DataFrame, data: DataFrame, aggregations: list[Column] | dict[str, str], by: str = "index_right", drop_empty: bool = True) -> DataFrame:
    """grid with aggregates of the data of each box; boxes without data go, or keep nulls."""
    per = data.groupBy(by).agg(*aggregations) if isinstance(aggregations, list) else data.groupBy(by).agg(aggregations)
    out = grid.join(per, by, "left")
    return out.dropna("any", subset=[x for x in per.columns if x != by]) if drop_empty else out


def on_grid(grid: DataFrame, per_box: DataFrame, by: str = "index_right") -> DataFrame:
    """All rows of per_box with their box."""
    return grid.join(per_box, by, "right")


def nearest_value_roc(gathered: DataFrame, conditions: list[ValidationCondition], names: list[str], spread: bool = False) -> DataFrame:
    """(column, diagnostic, threshold, fpr, tpr): a cell is positive if any of its observations is, its score the mean value.

    A cell's observations meet before they are summed: sums of parts differ in their last bits by how rows are dealt out,
    and cells of equal values and counts would have scores apart.

    spread: as in metrics.curve; it reads gathered several times, so that should be a written table then.
    """
    truths = [F.bool_or(c(x.column) > x.greater_than).alias(f"_t{i}") for i, x in enumerate(conditions)]
    held = gathered.select(*INDICES, *names, *dict.fromkeys(x.column for x in conditions if x.column not in names))
    cells = held.repartition(*INDICES).groupBy(*INDICES).agg(*truths, *(F.avg(n).alias(n) for n in names))
    tagged = F.array(*(F.struct(F.lit(x.column).alias("column"), c(f"_t{i}").alias("truth")) for i, x in enumerate(conditions)))
    long = cells.select(F.explode(tagged).alias("x"), *names).select("x.column", "x.truth", *names).unpivot(["column", "truth"], names, "diagnostic", "score")
    keys = ["column", "diagnostic"]
    return metrics.roc(metrics.curve(long, "truth", "score", keys, spread=spread), keys)


def bilinear(df: DataFrame, x: Column, y: Column, corners: dict[str, Column], x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """df with `interpolated` from values f00, f10, f01, f11 at the corners of a cell."""
    tx, ty = (x - x0) / (x1 - x0), (y - y0) / (y1 - y0)
    f = corners
    return df.withColumn("interpolated", f["f00"] * (1 - tx) * (1 - ty) + f["f10"] * tx * (1 - ty) + f["f01"] * (1 - tx) * ty + f["f11"] * tx * ty)


def interpolate(points: DataFrame, grid: DataFrame, column: str, lats: list[float], lons: list[float], method: str = "linear", keys: list[str] | None = None) -> DataFrame:
    """points x (time, level) with the column's value at each point; points beyond the regular axes are an error.

    linear: the four cells around a point. nearest: the nearest cell, halves to even. pchip: monotone cubics along longitude
    and then latitude, whose slopes need no cells but the sixteen around a point. Cells are joined by index, so points may
    be as many as they like. A point with a cell absent or null among those that it needs has a null; repeated points each
    have their rows.
    """
    if method not in ("linear", "nearest", "pchip"):
        raise ValueError("method is linear, nearest or pchip")
    keys = keys or [TIME, LEVEL]
    require(points, [LAT, LON])
    bad = ~c(LAT).between(lats[0], lats[-1]) | ~c(LON).between(lons[0], lons[-1])
    points = points.withColumn(LAT, F.when(bad, F.raise_error(F.lit("a point lies outside of the grid")).cast("double")).otherwise(c(LAT)))
    dlat, dlon = lats[1] - lats[0], lons[1] - lons[0]
    fi, fj = (c(LAT) - lats[0]) / dlat, (c(LON) - lons[0]) / dlon
    cells = grid.select(*keys, F.rint((c(LAT) - lats[0]) / dlat).cast("int").alias("_i"), F.rint((c(LON) - lons[0]) / dlon).cast("int").alias("_j"), c(column).alias("_f"))
    if method == "nearest":
        at = points.withColumns({"_i": F.rint(fi).cast("int"), "_j": F.rint(fj).cast("int")})
        return at.join(cells, ["_i", "_j"]).withColumnRenamed("_f", column).drop("_i", "_j")
    i, j = F.least(F.floor(fi), F.lit(len(lats) - 2)).cast("int"), F.least(F.floor(fj), F.lit(len(lons) - 2)).cast("int")
    reach = range(2) if method == "linear" else range(-1, 3)
    around = F.array(*(F.struct((i + a).alias("i"), (j + b).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a in reach for b in reach))
    own = points.groupBy(*points.columns).agg(F.count("*").alias("_times"))
    near = own.withColumn("_c", F.explode(around)).withColumns({"_i": c("_c.i"), "_j": c("_c.j")})
    value = {(a, b): F.max(F.when((c("_c.a") == a) & (c("_c.b") == b), c("_f"))) for a in reach for b in reach}
    held = near.join(cells, ["_i", "_j"]).groupBy(*own.columns, *keys).agg(*(v.alias(f"_{a - reach[0]}{b - reach[0]}") for (a, b), v in value.items()))
    f = [[c(f"_{a}{b}") for b in range(len(reach))] for a in range(len(reach))]
    if method == "linear":
        made = straight(fi - i, *(straight(fj - j, *row) for row in f))
    else:
        made = monotone(fi - i, *(monotone(fj - j, *row, j == 0, j == len(lons) - 2) for row in f), i == 0, i == len(lats) - 2)
    return held.withColumn(column, made).withColumn("_times", F.explode(F.sequence(F.lit(1), c("_times").cast("int")))).select(*points.columns, *keys, column)


def straight(t: Column, f0: Column, f1: Column) -> Column:
    return f0 * (1 - t) + f1 * t


def monotone(t: Column, before: Column, f0: Column, f1: Column, after: Column, first: Column, last: Column) -> Column:
    """A monotone cubic at t in 0..1 from f0 to f1, with the values before and after them on an even axis.

    Slopes are harmonic means of the steps on both sides, 0 where these differ in sign. first, last: nothing lies before,
    or after; the slope at that end is a one-sided one of three points that keeps the sign of its step.
    """
    left, step, right = f0 - before, f1 - f0, after - f1
    inner = lambda d, e: F.when(d * e > 0, 2 * d * e / (d + e)).when((d * e).isNotNull(), 0.0)

    def end(d: Column, e: Column) -> Column:
        slope = (3 * d - e) / 2
        return F.when(F.signum(slope) != F.signum(d), 0.0).when((F.signum(d) != F.signum(e)) & (F.abs(slope) > 3 * F.abs(d)), 3 * d).otherwise(slope)

    at_0 = F.when(first & last, step).when(first, end(step, right)).otherwise(inner(left, step))
    at_1 = F.when(first & last, step).when(last, end(step, left)).otherwise(inner(step, right))
    return (1 + 2 * t) * (1 - t) * (1 - t) * f0 + t * (1 - t) * (1 - t) * at_0 + t * t * (3 - 2 * t) * f1 + t * t * (t - 1) * at_1


def same_axes(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both tables have the same keys and the same values on each axis."""
    require(a, CELL)
    require(b, CELL)
    for k in CELL:
        x, y = a.select(k).distinct(), b.select(k).distinct()
        if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
            raise ValueError(f"{k} differs")
