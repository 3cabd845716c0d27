"""Regions of the grid: jet streams, connected components, and distances between features.

Slices are independent. Components and distances run in numpy, on a slice or on tiles of it: see tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geodesy, physics
from aerolith.operators import stencil, tiles
from aerolith.operators.tiles import nearest  # noqa: F401  part of this module's interface
from aerolith.schema import LAT, LEVEL, LON, TIME, require_boolean

c = F.col
JET_SPEED = 30.0


def alpha_velocity_jet(grid: DataFrame, threshold: float = JET_SPEED) -> DataFrame:
    """grid with `jet`: whether the wind speed's mean over the column's pressure range is over the threshold, on all levels."""
    column = Window.partitionBy(TIME, LAT, LON)
    speed = physics.wind_speed(c("eastward_wind"), c("northward_wind"))
    low, high = grid.agg(F.min(LEVEL), F.max(LEVEL)).first()
    if low is not None and (high > 1100 or low < 0):
        raise ValueError("levels must be in hPa")
    held = stencil.by_time(grid).withColumn("_s", speed).withColumn("_part", stencil.column_trapezoid(c("_s")))
    depth = F.max(LEVEL).over(column) - F.min(LEVEL).over(column)
    return held.withColumn("jet", F.coalesce(physics.ratio(F.sum("_part").over(column), depth) > threshold, F.lit(False))).drop("_s", "_part")


def local_maximum_jet(grid: DataFrame, threshold: float = JET_SPEED) -> DataFrame:
    """grid with `jet`: local maxima of the wind speed in each latitude and level section, eastward and over the threshold."""
    speed = physics.wind_speed(c("eastward_wind"), c("northward_wind"))
    marked = stencil.local_maxima(grid.withColumn("_s", speed), "_s", [TIME, LON], LAT, LEVEL, threshold)
    return marked.withColumn("jet", c("peak") & (c("eastward_wind") >= 0)).drop("_s", "peak")


#: Names as configurations hold them: fixed values.
JET_ALGORITHMS: dict[str, Callable[[DataFrame], DataFrame]] = {"alpha_vel_koch": alpha_velocity_jet, "wind_speed_schiemann": local_maximum_jet}


def masked(df: DataFrame, column: str, mask: str) -> DataFrame:
    """The column where the mask holds, null elsewhere; no row goes."""
    return df.withColumn(column, F.when(c(mask), c(column)))


def components(mask: np.ndarray, connectivity: int | None = None) -> np.ndarray:
    """Labels from 1 in scan order of the components of a mask, 0 outside.

    connectivity: along how many axes at once neighbours may differ; all by default. Least numbers spread along edges
    with pointer jumping, so the number of rounds grows with the logarithm of a component's extent.
    """
    connectivity = connectivity or mask.ndim
    number = np.arange(mask.size).reshape(mask.shape)
    left, right = [], []
    for offset in np.ndindex(*[3] * mask.ndim):
        step = np.array(offset) - 1
        if not 0 < np.abs(step).sum() <= connectivity or tuple(step) < (0,) * mask.ndim:
            continue
        here = tuple(slice(max(-s, 0), mask.shape[i] - max(s, 0)) for i, s in enumerate(step))
        there = tuple(slice(max(s, 0), mask.shape[i] - max(-s, 0)) for i, s in enumerate(step))
        both = mask[here] & mask[there]
        left.append(number[here][both])
        right.append(number[there][both])
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
    root = np.arange(mask.size)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    inside = np.flatnonzero(mask.ravel())
    out = np.zeros(mask.size, np.int32)
    out[inside] = np.unique(root[inside], return_inverse=True)[1] + 1
    return out.reshape(mask.shape)


def _core(dims: int, core: list[str] | None) -> list[str]:
    if dims not in (2, 3):
        raise ValueError("regions have 2 or 3 dimensions")
    core = core or [LON, LAT, LEVEL][:dims]
    if len(core) != dims:
        raise ValueError("name as many core columns as dimensions")
    return core


def label_regions(df: DataFrame, mask: str, dims: int = 3, core: list[str] | None = None, connectivity: int | None = None, keys: tuple[str, ...] = (TIME, LEVEL, LAT, LON), cells: int = tiles.CELLS) -> DataFrame:
    """(keys, label): connected regions of each slice of the other keys, numbered from 1 in scan order; 0 outside.

    Cells are neighbours on the axes of the whole table: one that a slice lacks is a gap. cells: as in tiles.label.
    """
    core = _core(dims, core)
    require_boolean(df, mask)
    return tiles.label(df, mask, core, list(keys), connectivity or dims, components, cells)


def parent_regions(labelled: DataFrame, intersection: str, slices: list[str]) -> DataFrame:
    """labelled with `parent`: whether a cell's region has a cell of the intersection, in its own slice."""
    hit = labelled.where(c(intersection) & (c("label") > 0)).select(*slices, "label").distinct().withColumn("_hit", F.lit(True))
    return labelled.join(hit, [*slices, "label"], "left").withColumn("parent", F.coalesce("_hit", F.lit(False))).drop("_hit")


def distance(df: DataFrame, a: str, b: str, core: list[str] | None = None, sampling: tuple[float, ...] | None = None, measure: str = "euclidean", keys: tuple[str, ...] = (TIME, LEVEL, LAT, LON), cells: int = tiles.CELLS) -> DataFrame:
    """(keys, distance): from each cell of a to the nearest of b in its slice, in cells or by sampling; null outside of a and where b is empty.

    Steps are those of the whole table's axes, so a cell that a slice lacks counts as one. cells: as in tiles.nearest_cells.
    """
    core = core or [LON, LAT]
    require_boolean(df, a, b)
    if measure not in ("euclidean", "chebyshev"):
        raise ValueError("measure is euclidean or chebyshev")
    if sampling and measure == "chebyshev":
        raise ValueError("only euclidean distances are sampled")
    found, _ = tiles.nearest_cells(df, a, b, core, list(keys), sampling or (1.0,) * len(core), measure == "chebyshev", cells)
    return found.select(*keys, c("far").alias("distance"))


def haversine_distance(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = (TIME, LEVEL, LAT, LON), cells: int = tiles.CELLS) -> DataFrame:
    """(keys, distance): metres from each cell of a to that cell of b which is nearest in index space; null as in distance."""
    require_boolean(df, a, b)
    found, (lats, lons) = tiles.nearest_cells(df, a, b, [LAT, LON], list(keys), (1.0, 1.0), cells=cells)
    for name, axis, place in (("to_lat", lats, F.floor(c("which") / len(lons))), ("to_lon", lons, c("which") % len(lons))):
        values = df.sparkSession.createDataFrame(list(enumerate(map(float, axis))), f"_at int, {name} double")  # as long as an axis
        found = found.withColumn("_at", place.cast("int")).join(F.broadcast(values) if len(axis) <= tiles.BROADCAST_ROWS else values, "_at", "left").drop("_at")
    return found.select(*keys, geodesy.haversine(c(LON), c(LAT), c("to_lon"), c("to_lat")).alias("distance"))


def vertical_distance(df: DataFrame, flag: str, absolute: bool = False, partition: tuple[str, ...] = (TIME, LAT, LON), level: str = LEVEL, output: str = "distance") -> DataFrame:
    """df with the distance to the nearest level of the column where the flag holds: in levels, or in the level's unit; infinite if none does."""
    require_boolean(df, flag)
    w = Window.partitionBy(*partition).orderBy(level)
    place: Column = c(level) if absolute else F.row_number().over(w).cast("double")
    held = df.withColumn("_at", place).withColumn("_hit", F.when(c(flag), c("_at")))
    below = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return held.withColumn(output, F.coalesce(F.least(c("_at") - below, above - c("_at")), F.lit(float("inf")))).drop("_at", "_hit")


def vertical_distance_between(df: DataFrame, a: str, b: str, absolute: bool = False) -> DataFrame:
    """vertical_distance to the levels where both features hold."""
    return vertical_distance(df.withColumn("_both", c(a) & c(b)), "_both", absolute).drop("_both")


CLUSTER_MEASURES = ("rows", "correlation")


def complete_linkage_order(matrix: np.ndarray, measure: str = "rows") -> tuple[list[int], list[int]]:
    """Order and cluster numbers of a small correlation matrix: complete linkage, cut at half the largest distance between two.

    Clusters are numbered as the tree's leaves come, the earlier branch first; the order is by cluster, then by place.

    measure: rows takes the matrix's rows as points and their Euclidean distances; correlation takes 1 - |r|. Missing
    correlations count as 0. Of equally near clusters those that hold the earlier names join first.
    """
    if measure not in CLUSTER_MEASURES:
        raise ValueError(f"the measure is one of {CLUSTER_MEASURES}")
    held = np.nan_to_num(matrix)
    far = np.sqrt(((held[:, None, :] - held[None, :, :]) ** 2).sum(axis=2)) if measure == "rows" else 1 - np.abs(held)
    clusters: list[list[int]] = [[i] for i in range(len(far))]
    merges: list[tuple[float, list[int]]] = []
    while len(clusters) > 1:
        d, i, j = min((max(far[a, b] for a in clusters[i] for b in clusters[j]), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        joined = clusters[i] + clusters[j]
        merges.append((d, joined))
        clusters = [x for k, x in enumerate(clusters) if k not in (i, j)] + [joined]
    leaves = clusters[0] if clusters else []
    cut = far.max() / 2 if merges else 0.0
    number = list(range(len(far)))
    for d, members in merges:
        if d <= cut:
            least = min(number[m] for m in members)
            number = [least if k in members else n for k, n in enumerate(number)]
    place = {n: i + 1 for i, n in enumerate(dict.fromkeys(number[i] for i in leaves))}
    cluster = [place[n] for n in number]
    return sorted(range(len(cluster)), key=lambda i: (cluster[i], i)), cluster
