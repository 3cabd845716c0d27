"""Regions and distances in slices of any size: tiles of a bounded number of cells, one to a task.

A slice is what the keys other than the core axes leave; its cells are numbered along the axes of the whole table, so a row
that a slice lacks is a gap there and not a neighbourhood.

Components: each tile is labelled by itself, by the number in scan order of a component's first cell. Cells on both sides of
a border between tiles then say which labels are one, and these equivalences, few against the cells, are united by rounds of
star contraction.

Distances: exact, one axis at a time. A pass deals out tiles that are whole along its axis. In a line each cell takes the
best of the line's cells; the best one's place never moves back as the cell moves on, so the middle cell's bounds the others'
on both sides, and a line of n cells takes n log n steps instead of n squared.
"""

from __future__ import annotations

from itertools import product
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.sources import files

c = F.col
#: Cells of a task at most.
CELLS = 1 << 20
#: Values of an axis up to which it is broadcast to number the cells.
BROADCAST_ROWS = 1 << 20


def tile_shape(shape: tuple[int, ...], cells: int, whole: int | None = None) -> tuple[int, ...]:
    """The slice's shape, its longest axes halved until a tile has at most so many cells; the axis `whole` stays."""
    sizes = list(shape)
    while prod(sizes) > cells and max(n for k, n in enumerate(sizes) if k != whole) > 1:
        k = max((k for k in range(len(sizes)) if k != whole), key=lambda k: sizes[k])
        sizes[k] = -(-sizes[k] // 2)
    return tuple(sizes)


def numbered(df: DataFrame, core: list[str]) -> tuple[DataFrame, list[list]]:
    """df with _i0, _i1, ..: each core column's place among its distinct values, and those values, which are the axes."""
    row = df.agg(*(F.sort_array(F.collect_set(k)).alias(f"a{i}") for i, k in enumerate(core))).first()
    axes = [list(row[i]) for i in range(len(core))]
    for i, (k, axis) in enumerate(zip(core, axes, strict=True)):
        places = df.sparkSession.createDataFrame(list(zip(axis, range(len(axis)))), f"`{k}` {df.schema[k].dataType.simpleString()}, _i{i} int")
        df = df.join(F.broadcast(places) if len(axis) <= BROADCAST_ROWS else places, k)
    return df, axes


def flat(at: list[Column], shape: tuple[int, ...]) -> Column:
    """The cell's number in scan order."""
    out = at[0].cast("long")
    for x, n in zip(at[1:], shape[1:], strict=True):
        out = out * n + x
    return out


def _tile_columns(sizes: tuple[int, ...]) -> list[Column]:
    return [F.floor(c(f"_i{k}") / n).cast("int").alias(f"_t{k}") for k, n in enumerate(sizes)]


def _fields(df: DataFrame, names: list[str], *more: str) -> str:
    return ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), *more])


def _own(group: pd.DataFrame, sizes: tuple[int, ...]) -> tuple[tuple[np.ndarray, ...], list[int]]:
    """Each row's place in its tile, and where the tile begins."""
    at = [group[f"_i{k}"].to_numpy() for k in range(len(sizes))]
    begin = [int(x[0]) // n * n for x, n in zip(at, sizes, strict=True)]
    return tuple(x - b for x, b in zip(at, begin, strict=True)), begin


def united(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, root) of the nodes of edges (by, a, b), a < b: root is the least node that can be reached.

    Rounds of large and small stars on written tables; a round that changes nothing is the last.
    """
    star = lambda rows: F.explode(rows).alias("e")
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*by, "a", "b")), F.lit(0))).first())
    edges = files.written(edges.select(*by, "a", "b").distinct())
    last = state(edges)
    while last[0]:
        both = edges.unionByName(edges.select(*by, c("b").alias("a"), c("a").alias("b")))
        least = both.groupBy(*by, "a").agg(F.least(F.min("b"), c("a")).alias("m"))
        large = both.where("b > a").join(least, [*by, "a"]).where("m < b").select(*by, c("b").alias("a"), c("m").alias("b")).distinct()  # a's smaller ones
        down = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        small = large.join(down, [*by, "a"]).select(*by, star(F.array(F.struct(c("m").alias("a"), c("b").alias("b")), F.struct(c("m").alias("a"), c("a").alias("b")))))
        edges = files.written(small.select(*by, "e.a", "e.b").where("a < b").distinct())
        if (now := state(edges)) == last:
            break
        last = now
    return edges.select(*by, c("b").alias("node"), c("a").alias("root"))


def label(df: DataFrame, mask: str, core: list[str], keys: list[str], connectivity: int, components, cells: int = CELLS) -> DataFrame:
    """(keys, label): connected regions of each slice, numbered from 1 in scan order of their first cells; 0 outside.

    components: what labels an array. No task holds more than `cells` cells of a slice.
    """
    rest = [k for k in keys if k not in core]
    rows, axes = numbered(df.select(*keys, mask), core)
    shape = tuple(map(len, axes))
    if not prod(shape):
        return df.select(*keys, F.lit(0).alias("label"))
    sizes, at = tile_shape(shape, cells), [f"_i{k}" for k in range(len(core))]
    strides = [prod(shape[k + 1 :]) for k in range(len(shape))]

    def labelled(group: pd.DataFrame) -> pd.DataFrame:
        here, begin = _own(group, sizes)
        held = np.zeros(sizes, bool)
        held[here] = group[mask].fillna(False).to_numpy(bool)
        labels = components(held, connectivity)
        firsts = np.full(labels.max() + 1, -1, np.int64)
        values, places = np.unique(labels, return_index=True)
        inside = values > 0
        cell = np.unravel_index(places[inside], sizes)
        firsts[values[inside]] = sum((x + b) * s for x, b, s in zip(cell, begin, strides, strict=True))
        return group[[*keys, *at]].assign(_root=firsts[labels[here]])

    tiles = _tile_columns(sizes)
    made = rows.groupBy(*rest, *tiles).applyInPandas(labelled, _fields(rows, [*keys, *at], "_root long"))
    if sizes == shape:
        roots = made.where("_root >= 0").select(*rest, "_root", c("_root").alias("_final"))
    else:
        made = files.written(made)
        merged = united(_border_links(made, rest, shape, sizes, connectivity), rest).withColumnRenamed("node", "_root")
        roots = made.where("_root >= 0").select(*rest, "_root").join(merged, [*rest, "_root"], "left").select(*rest, "_root", F.coalesce("root", "_root").alias("_final"))
    numbers = roots.distinct().withColumn("label", F.dense_rank().over(Window.partitionBy(*rest).orderBy("_final"))).select(*rest, "_root", "label")
    return made.join(numbers, [*rest, "_root"], "left").select(*keys, F.coalesce("label", F.lit(0)).cast("int").alias("label"))


def _border_links(made: DataFrame, rest: list[str], shape: tuple[int, ...], sizes: tuple[int, ...], connectivity: int) -> DataFrame:
    """(rest, a, b), a < b: labels of neighbours on the two sides of a border between tiles."""
    dims = range(len(shape))
    at = [c(f"_i{k}") for k in dims]
    cut = [k for k in dims if sizes[k] < shape[k]]
    edge = F.lit(False)
    for k in cut:
        edge = edge | (at[k] % sizes[k] == 0) | (at[k] % sizes[k] == sizes[k] - 1)
    border = made.where((c("_root") >= 0) & edge)
    steps = [s for s in product((-1, 0, 1), repeat=len(shape)) if 0 < sum(map(abs, s)) <= connectivity and s > (0,) * len(shape)]

    def beyond(step: tuple[int, ...]) -> Column:
        """The neighbour's number if it lies in the slice, across a border."""
        to = [a + s for a, s in zip(at, step, strict=True)]
        crosses, inside = F.lit(False), F.lit(True)
        for k in dims:
            inside = inside & (to[k] >= 0) & (to[k] < shape[k])
            if k in cut and step[k]:
                crosses = crosses | (F.floor(to[k] / sizes[k]) != F.floor(at[k] / sizes[k]))
        return F.when(crosses & inside, flat(to, shape))

    out = border.select(*rest, c("_root").alias("x"), F.explode(F.array_compact(F.array(*map(beyond, steps)))).alias("_cell"))
    into = border.select(*rest, c("_root").alias("y"), flat(at, shape).alias("_cell"))
    return out.join(into, [*rest, "_cell"]).where("x != y").select(*rest, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def line_minima(f: np.ndarray, step: float, chebyshev: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each line f[:, j] and each place i of it: the least of f[k, j] and the distance from i to k together, and the first such k.

    Together is the sum with the squared distance, or the larger of the two. The first best k does not fall as i rises, so
    places are solved by halves, each between its solved neighbours' bests; a level of all lines is one array.
    """
    n, m = f.shape
    best, which = np.full((n, m), np.inf), np.zeros((n, m), np.int64)
    solved = np.full(n, False)
    lines = np.arange(m)
    stride = 1 << max(n - 1, 1).bit_length()
    while stride:
        places = np.arange(stride - 1, n, 2 * stride)
        stride //= 2
        places = places[~solved[places]]
        if not len(places):
            continue
        before = np.searchsorted(known := np.flatnonzero(solved), places) - 1
        low = np.where((before >= 0)[:, None], which[known[np.maximum(before, 0)]] if len(known) else 0, 0)
        after = before + 1
        high = np.where((after < len(known))[:, None], which[known[np.minimum(after, max(len(known) - 1, 0))]] if len(known) else n - 1, n - 1)
        low, high = np.broadcast_to(low, (len(places), m)), np.broadcast_to(high, (len(places), m))
        count = (high - low + 1).ravel()
        begin = np.cumsum(count) - count
        k = np.arange(count.sum()) - np.repeat(begin, count) + np.repeat(low.ravel(), count)
        apart = (np.repeat(np.repeat(places, m), count) - k) * step
        held = f[k, np.repeat(np.tile(lines, len(places)), count)]
        cost = np.maximum(held, np.abs(apart)) if chebyshev else held + apart * apart
        least = np.minimum.reduceat(cost, begin)
        hit = np.flatnonzero(cost == np.repeat(least, count))
        first = hit[np.searchsorted(hit, begin)]
        best[places], which[places] = least.reshape(len(places), m), k[first].reshape(len(places), m)
        solved[places] = True
    return best, which


def nearest(target: np.ndarray, sampling: tuple[float, ...], chebyshev: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distance from every cell to the nearest true one, and that cell's flat number, of equals the first in scan order.

    No target: infinite, and the array's size. Exact for both measures, as squares add and maxima nest; of cells at the same
    Chebyshev distance any may be the one.
    """
    best, which = np.where(target, 0.0, np.inf), np.where(target, np.arange(target.size).reshape(target.shape), target.size)
    for axis in range(target.ndim - 1, -1, -1):
        best, which = passed(best, which, axis, sampling[axis], chebyshev)
    return (best if chebyshev else np.sqrt(best)), np.where(np.isfinite(best), which, target.size)


def passed(best: np.ndarray, which: np.ndarray, axis: int, step: float, chebyshev: bool) -> tuple[np.ndarray, np.ndarray]:
    """One axis of nearest: each cell takes the best of its line."""
    f, w = np.moveaxis(best, axis, 0), np.moveaxis(which, axis, 0)
    value, k = line_minima(f.reshape(len(f), -1), step, chebyshev)
    at = np.take_along_axis(w.reshape(len(f), -1), k, 0)
    return np.moveaxis(value.reshape(f.shape), 0, axis), np.moveaxis(at.reshape(f.shape), 0, axis)


def nearest_cells(df: DataFrame, a: str, b: str, core: list[str], keys: list[str], sampling: tuple[float, ...], chebyshev: bool = False, cells: int = CELLS) -> tuple[DataFrame, list[list]]:
    """((keys, far, which), axes): for each cell of a its distance to the nearest cell of b in its slice and that cell's number.

    Both are null outside of a and where b is empty. A slice of at most `cells` cells is one task; a larger one takes an
    exchange an axis, dealt out in tiles that are whole along it, and a task then holds that many cells, or one line.
    """
    rest = [k for k in keys if k not in core]
    rows, axes = numbered(df.select(*keys, a, b), core)
    shape, at = tuple(map(len, axes)), [f"_i{k}" for k in range(len(core))]
    number = flat([c(x) for x in at], shape)
    none = (F.lit(None).cast("double").alias("far"), F.lit(None).cast("long").alias("which"))
    if not prod(shape):
        return df.select(*keys, *none), axes
    if prod(shape) <= cells:

        def measured(group: pd.DataFrame) -> pd.DataFrame:
            here = tuple(group[x].to_numpy() for x in at)
            target = np.zeros(shape, bool)
            target[here] = group[b].fillna(False).to_numpy(bool)
            far, which = nearest(target, sampling, chebyshev)
            fit = group[a].fillna(False).to_numpy(bool) & np.isfinite(far[here])
            return _told(group[keys], far[here], which[here], fit)

        return rows.groupBy(*rest).applyInPandas(measured, _fields(rows, keys, "far double", "which long")), axes
    held = rows.select(*rest, *at, F.when(F.coalesce(c(b), F.lit(False)), 0.0).alias("_best"), F.when(F.coalesce(c(b), F.lit(False)), number).alias("_which"))
    held = held.where("_best is not null")
    for axis in range(len(core) - 1, -1, -1):
        sizes = tile_shape(shape, cells, axis)
        one = _pass(shape, sizes, axis, sampling[axis], chebyshev, rest)
        held = held.groupBy(*rest, *_tile_columns(sizes)).applyInPandas(one, _fields(held, [*rest, *at], "_best double", "_which long"))
    found = rows.where(c(a)).select(*keys, *at).join(held, [*rest, *at]).select(*keys, (c("_best") if chebyshev else F.sqrt("_best")).alias("far"), c("_which").alias("which"))
    return df.select(*keys).join(found, keys, "left"), axes


def _pass(shape: tuple[int, ...], sizes: tuple[int, ...], axis: int, step: float, chebyshev: bool, rest: list[str]):
    """What passes one axis of a tile on: the cells that have a best one by then."""
    at = [f"_i{k}" for k in range(len(shape))]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        here, begin = _own(group, sizes)
        best, which = np.full(sizes, np.inf), np.full(sizes, -1, np.int64)
        best[here], which[here] = group["_best"].to_numpy(), group["_which"].to_numpy()
        best, which = passed(best, which, axis, step, chebyshev)
        inside = np.isfinite(best)
        for k, (n, start, size) in enumerate(zip(shape, begin, sizes, strict=True)):
            if start + size > n:  # the last tile reaches over the end
                inside[tuple(slice(n - start, None) if j == k else slice(None) for j in range(len(shape)))] = False
        places = np.nonzero(inside)
        out = pd.DataFrame({x: p + s for x, p, s in zip(at, places, begin, strict=True)})
        for r in rest:
            out[r] = [group[r].iloc[0]] * len(out)
        return out.assign(_best=best[places], _which=which[places])[[*rest, *at, "_best", "_which"]]

    return one


def _told(out: pd.DataFrame, far: np.ndarray, which: np.ndarray, fit: np.ndarray) -> pd.DataFrame:
    """out with far and which, null where not fit; whole numbers stay whole."""
    return out.assign(far=pd.arrays.FloatingArray(np.where(fit, far, 0.0), ~fit), which=pd.arrays.IntegerArray(np.where(fit, which, 0), ~fit))
