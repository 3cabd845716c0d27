"""Stencils of the grid as window functions.

All three axes are windows over one row on either side. A grid that is hash-partitioned on `time` satisfies every one of
them, so `by_time` costs one exchange where three windows would cost three. `bands` does the same for parts of a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from aerolith.functions import geodesy, physics
from aerolith.schema import LAT, LEVEL, LON, TIME


def by_time(grid: DataFrame, keys: tuple[str, ...] = (TIME,)) -> DataFrame:
    """One exchange for all stencils. (time, pressure_level) spreads few time steps wider, but the level axis then exchanges again."""
    return grid.repartition(*keys)


#: Rows on each side of a band of latitudes that are repeated in it: as many as derivatives along latitude are nested, at most.
HALO = 2


def bands(grid: DataFrame, rows: int, halo: int = HALO) -> DataFrame:
    """grid with `time` as a struct of time and band: bands of latitudes, dealt out by one exchange, of about so many rows each.

    Rows within `halo` latitudes of a band are repeated in it, so every stencil that partitions by `time` works within a
    band, and is right on the band's own rows: see own_rows. A band has halo latitudes at least, so a row is in three bands
    at most. Latitudes are numbered by a small table of the axis.
    """
    lats, across = grid.agg(F.sort_array(F.collect_set(LAT)), F.count_distinct(LEVEL) * F.count_distinct(LON)).first()
    height = max(halo, 1, rows // max(across, 1) - 2 * halo)
    own = [(lat, i // height, sorted({k // height for k in (i - halo, i, i + halo) if 0 <= k < len(lats)})) for i, lat in enumerate(lats)]
    kind = grid.schema[LAT].dataType.simpleString()
    places = grid.sparkSession.createDataFrame(own, f"`{LAT}` {kind}, _own int, _in array<int>")  # as long as the axis
    held = grid.join(F.broadcast(places), LAT).withColumn("_band", F.explode("_in"))
    key = F.struct(F.col(TIME).alias("at"), F.col("_band").alias("band"))
    return held.withColumn("_row_is_own", F.col("_band") == F.col("_own")).withColumn(TIME, key).drop("_own", "_in", "_band").repartition(TIME)


def own_rows(banded: DataFrame) -> DataFrame:
    """Each row once, in its own band, with its time again."""
    return banded.where("_row_is_own").withColumn(TIME, F.col(TIME)["at"]).drop("_row_is_own")


@dataclass(frozen=True)
class Axis:
    """An axis of the grid: the keys of its lines, its column, and the coordinate that derivatives are taken along."""

    lines: tuple[str, ...]
    name: str
    coordinate: Callable[[], Column]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.lines).orderBy(self.name)


X = Axis((TIME, LEVEL, LAT), LON, lambda: geodesy.easting(F.col(LON)))
Y = Axis((TIME, LEVEL, LON), LAT, lambda: geodesy.northing(F.col(LAT)))
P = Axis((TIME, LAT, LON), LEVEL, lambda: F.col(LEVEL))


def first_derivative(f: Column, axis: Axis, x: Column | None = None) -> Column:
    """Second-order differences on any spacing, first-order at the two ends; null on an axis of one point.

    Rows whose coordinate is null count as absent.
    """
    x = axis.coordinate() if x is None else x
    w = axis.window
    hs, hd = x - F.lag(x).over(w), F.lead(x).over(w) - x
    before, after = F.lag(f).over(w), F.lead(f).over(w)
    inner = (hs * hs * after + (hd * hd - hs * hs) * f - hd * hd * before) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (after - f) / hd).when(hd.isNull(), (f - before) / hs).otherwise(inner)


def gradient_x(f: Column, geospatial: bool = True) -> Column:
    d = first_derivative(f, X)
    return d * geodesy.parallel_scale(F.col(LAT)) if geospatial else d


def gradient_y(f: Column, geospatial: bool = True) -> Column:
    d = first_derivative(f, Y)
    return d * geodesy.meridional_scale(F.col(LAT)) if geospatial else d


def spatial_gradient(grid: DataFrame, column: str, geospatial: bool = True, dimension: str | None = None) -> DataFrame:
    """grid with dfdx, dfdy, or one of them (dimension x or y)."""
    made = {"dfdx": gradient_x, "dfdy": gradient_y}
    if dimension not in (None, "x", "y"):
        raise ValueError("dimension is x, y or None")
    return grid.withColumns({k: f(F.col(column), geospatial) for k, f in made.items() if dimension in (None, k[-1])})


def first_order_laplacian(f: Column, geospatial: bool = True) -> Column:
    """Sum of the two first derivatives, which is what the mass term of its one user needs."""
    return gradient_x(f, geospatial) + gradient_y(f, geospatial)


def gradient_magnitude(f: Column, squared: bool = False) -> Column:
    return physics.magnitude(gradient_x(f), gradient_y(f), squared=squared)


def vector_derivatives(u: Column, v: Column) -> dict[str, Column]:
    """du_dx, du_dy, dv_dx, dv_dy with metric terms.

    The scale factors depend on latitude alone, so the term along x is a constant of the latitude and the one along y
    is nought.
    """
    lat = F.col(LAT)
    p, m = geodesy.parallel_scale(lat), geodesy.meridional_scale(lat)
    bend = m / p * first_derivative(p, Y)
    return {
        "du_dx": p * first_derivative(u, X) - v * bend,
        "du_dy": m * first_derivative(u, Y),
        "dv_dx": p * first_derivative(v, X) + u * bend,
        "dv_dy": m * first_derivative(v, Y),
    }


def pressure_derivative(f: Column) -> Column:
    return first_derivative(f, P)


def altitude_derivative(f: Column, geopotential: Column, level: Column | None = None) -> Column:
    """d/dz on pressure levels: g * (df/dp) / (dPhi/dp); null where geopotential does not change."""
    return physics.GRAVITY * physics.ratio(first_derivative(f, P, level), first_derivative(geopotential, P, level))


def angle_derivative(f: Column, uniform: bool, axis: Axis = P) -> Column:
    """Derivative of an angle along an ascending axis.

    The two ends, and the inside of a uniform axis, take the smaller unsigned angle between neighbours. The inside of an
    uneven axis is the plain signed derivative. uniform is a property of the whole axis: see regular_spacing.
    """
    x, w = axis.coordinate(), axis.window
    hs, hd = x - F.lag(x).over(w), F.lead(x).over(w) - x
    before, after = F.lag(f).over(w), F.lead(f).over(w)
    inner = physics.angle_difference(after, before) / (hs + hd) if uniform else first_derivative(f, axis)
    return F.when(hs.isNull(), physics.angle_difference(after, f) / hd).when(hd.isNull(), physics.angle_difference(f, before) / hs).otherwise(inner)


def vertical_wind_shear(u: Column, v: Column, geopotential: Column | None = None, absolute: bool = False, squared: bool = False, level: Column | None = None) -> Column:
    """Length of (du/dz, dv/dz), along pressure if no geopotential is given."""
    d = (lambda f: first_derivative(f, P, level)) if geopotential is None else (lambda f: altitude_derivative(f, geopotential, level))
    return physics.magnitude(d(u), d(v), absolute=absolute, squared=squared)


def ertel_potential_vorticity(vorticity: Column, theta: Column) -> Column:
    return -physics.GRAVITY * physics.absolute_vorticity(vorticity, F.col(LAT)) * pressure_derivative(theta)


def difference(f: Column, axis: Axis = P) -> Column:
    """From the row before; null in the first row."""
    return f - F.lag(f).over(axis.window)


def shift_and_combine(df: DataFrame, column: str, partition: list[str], order: str, combine: Callable[[Column, Column], Column] = lambda a, b: a | b, offset_start: int = 1, offset_end: int = 1, fill: object = None, output: str = "combined") -> DataFrame:
    """Combines each row with those so many rows before and after, and trims the rows that lack one."""
    if offset_start < 0 or offset_end < 0:
        raise ValueError("offsets must not be negative")
    if order not in df.columns:
        raise ValueError(f"no column {order}")
    w = Window.partitionBy(*partition).orderBy(order)
    rows = df.withColumns({
        output: combine(F.lag(column, offset_start, fill).over(w), F.lead(column, offset_end, fill).over(w)),
        "_row": F.row_number().over(w), "_rows": F.count("*").over(Window.partitionBy(*partition)),
    })
    return rows.where((F.col("_row") > offset_start) & (F.col("_row") <= F.col("_rows") - offset_end)).drop("_row", "_rows")


def column_trapezoid(f: Column, axis: Axis = P) -> Column:
    """The trapezoid from each row to the next on the axis, null in the last; their sum is the integral."""
    x, w = axis.coordinate(), axis.window
    each = (f + F.lead(f).over(w)) / 2 * (F.lead(x).over(w) - x)
    return each


def regular_spacing(df: DataFrame, column: str, tolerance: float = 1e-9) -> float | None:
    """The spacing of a column's distinct values if it is the same throughout, else None. The distinct values are an axis of the grid."""
    w = Window.orderBy(column)
    steps = df.select(column).distinct().select((F.lead(column).over(w) - F.col(column)).alias("h"))
    low, high = steps.agg(F.min("h"), F.max("h")).first()
    if low is None or abs(high - low) > tolerance * max(abs(low), 1.0):
        return None
    return low


def local_maxima(df: DataFrame, column: str, slice_keys: list[str], row: str, col: str, threshold: float, footprint: tuple[int, int] = (3, 3), output: str = "peak") -> DataFrame:
    """Marks values over the threshold that are the largest of a footprint of odd sides around them, in each slice.

    The maximum over a rectangle is that over its rows and then its columns. A slice of one value all over has no peak.
    """
    if any(n % 2 == 0 or n < 1 for n in footprint):
        raise ValueError("the footprint's sides must be odd")
    reach_row, reach_col = footprint[0] // 2, footprint[1] // 2
    along_col = Window.partitionBy(*slice_keys, row).orderBy(col).rowsBetween(-reach_col, reach_col)
    along_row = Window.partitionBy(*slice_keys, col).orderBy(row).rowsBetween(-reach_row, reach_row)
    whole = Window.partitionBy(*slice_keys)
    best = df.withColumn("_m", F.max(column).over(along_col)).withColumn("_m", F.max("_m").over(along_row))
    flat = F.min(column).over(whole) == F.max(column).over(whole)
    return best.withColumn(output, F.coalesce((F.col(column) == F.col("_m")) & (F.col(column) > threshold) & ~flat, F.lit(False))).drop("_m")
