"""The turbulence diagnostics: a registry of names, each a list of steps of columns over one shared wide table.

A column that needs a window over another window's result is in a later step. `diagnose` takes the union of the steps
that the wanted names need, so shared derivatives are worked out once, in one pass over one partitioning of the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions import physics
from aerolith.operators import stencil
from aerolith.schema import CELL, GRID_VARIABLES, LAT, LEVEL, TIME, require

_u, _v = lambda: F.col("eastward_wind"), lambda: F.col("northward_wind")
_phi = lambda: F.col("geopotential")
c = F.col


def _vector(name: str) -> Callable[[], Column]:
    return lambda: stencil.vector_derivatives(_u(), _v())[name]


#: Shared columns: name -> (names it needs, builder). Names of the grid itself need no entry.
SHARED: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "theta": ([], lambda: physics.potential_temperature(c("temperature"), c(LEVEL))),
    "speed": ([], lambda: physics.wind_speed(_u(), _v())),
    "direction": ([], lambda: physics.wind_direction(_u(), _v())),
    "absolute_vorticity": ([], lambda: physics.absolute_vorticity(c("vorticity"), c(LAT))),
    **{k: ([], _vector(k)) for k in ("du_dx", "du_dy", "dv_dx", "dv_dy")},
    "shearing": (["dv_dx", "du_dy"], lambda: physics.shearing_deformation(c("dv_dx"), c("du_dy"))),
    "stretching": (["du_dx", "dv_dy"], lambda: physics.stretching_deformation(c("du_dx"), c("dv_dy"))),
    # squared, as every user of it expects
    "total_deformation": (["shearing", "stretching"], lambda: physics.total_deformation(c("shearing"), c("stretching"), squared=True)),
    "jacobian": (["du_dx", "du_dy", "dv_dx", "dv_dy"], lambda: physics.jacobian(c("du_dx"), c("du_dy"), c("dv_dx"), c("dv_dy"))),
    "theta_x": (["theta"], lambda: stencil.gradient_x(c("theta"))),
    "theta_y": (["theta"], lambda: stencil.gradient_y(c("theta"))),
    "theta_z": (["theta"], lambda: stencil.altitude_derivative(c("theta"), _phi())),
    "u_z": ([], lambda: stencil.altitude_derivative(_u(), _phi())),
    "v_z": ([], lambda: stencil.altitude_derivative(_v(), _phi())),
    "shear": (["u_z", "v_z"], lambda: physics.magnitude(c("u_z"), c("v_z"))),
    "stability": (["theta", "theta_z"], lambda: -physics.ratio(F.lit(physics.GRAVITY), c("theta")) * c("theta_z")),
    "ri": (["stability", "shear"], lambda: physics.ratio(c("stability"), c("shear"))),
    "brown": (["absolute_vorticity", "shearing", "stretching"], lambda: F.sqrt(0.3 * c("absolute_vorticity") * c("absolute_vorticity") + c("shearing") * c("shearing") + c("stretching") * c("stretching"))),
    "speed_x": (["speed"], lambda: stencil.gradient_x(c("speed"))),
    "speed_y": (["speed"], lambda: stencil.gradient_y(c("speed"))),
    "absolute_vorticity_x": (["absolute_vorticity"], lambda: stencil.gradient_x(c("absolute_vorticity"))),
    "absolute_vorticity_y": (["absolute_vorticity"], lambda: stencil.gradient_y(c("absolute_vorticity"))),
    "vorticity_slope": ([], lambda: stencil.gradient_magnitude(c("vorticity"))),
    "layer": ([], lambda: stencil.difference(c("altitude"))),
    # levels without the first of each column of the grid
    "upper_level": (["layer"], lambda: F.when(c("layer").isNotNull(), c(LEVEL))),
    "upper_shear_squared": (["upper_level"], lambda: stencil.vertical_wind_shear(_u(), _v(), _phi(), absolute=True, squared=True, level=c("upper_level"))),
    "mass_slope": ([], lambda: stencil.first_order_laplacian(_phi())),
    "u_p": ([], lambda: stencil.pressure_derivative(_u())),
    "v_p": ([], lambda: stencil.pressure_derivative(_v())),
    "temperature_z": ([], lambda: stencil.altitude_derivative(c("temperature"), _phi())),
    "direction_p": (["direction"], lambda: stencil.angle_derivative(c("direction"), uniform=False)),
    "direction_z": (["direction_p"], lambda: stencil.altitude_derivative(c("direction_p"), _phi())),
}


def _frontogenesis_3d() -> Column:
    x, y, z = c("theta_x"), c("theta_y"), c("theta_z")
    length = F.sqrt(x * x + y * y + z * z)
    total = x * (c("du_dx") * x + c("dv_dx") * y) + y * (c("du_dy") * x + c("dv_dy") * y) + z * (c("u_z") * x + c("v_z") * y - c("divergence_of_wind") * z)
    return F.when(length == 0, F.lit(0.0)).otherwise(-physics.ratio(F.lit(1.0), length) * total)


def _frontogenesis_2d() -> Column:
    x, y = c("theta_x"), c("theta_y")
    length = F.sqrt(x * x + y * y)
    total = x * x * c("du_dx") + y * y * c("dv_dy") + x * y * c("dv_dy") + x * y * c("du_dy")
    return F.when(length == 0, F.lit(0.0)).otherwise(-physics.ratio(F.lit(1.0), length) * total)


def _dutton(dutton: bool = True) -> Column:
    across = physics.ratio(_u(), c("speed")) * c("speed_y")
    along = physics.ratio(_v(), c("speed")) * c("speed_x")
    return 10.5 + 1.25 * (along - across if dutton else across - along) + 0.25 * c("shear")


#: name -> (shared columns it needs, builder)
DIAGNOSTICS: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "f3d": (["theta_x", "theta_y", "theta_z", "du_dx", "du_dy", "dv_dx", "dv_dy", "u_z", "v_z"], _frontogenesis_3d),
    "f2d": (["theta_x", "theta_y", "du_dx", "du_dy", "dv_dy"], _frontogenesis_2d),
    "temperature_gradient": ([], lambda: stencil.gradient_magnitude(c("temperature"))),
    "endlich": (["speed", "direction_z"], lambda: c("speed") * F.abs(c("direction_z"))),
    "ti1": (["shear", "total_deformation"], lambda: c("shear") * c("total_deformation")),
    "ti2": (["shear", "total_deformation"], lambda: c("shear") * (c("total_deformation") - c("divergence_of_wind"))),
    "ncsu1": (["vorticity_slope", "du_dx", "dv_dy", "ri"], lambda: physics.ratio(c("vorticity_slope") * physics.at_least(_u() * c("du_dx") + _v() * c("dv_dy"), 0.0), physics.at_least(c("ri"), 1e-5))),
    "colson_panofsky": (["upper_shear_squared", "layer", "ri"], lambda: c("upper_shear_squared") * c("layer") * c("layer") * (1 - c("ri") / 0.5)),
    "ubf": (["mass_slope", "jacobian"], lambda: F.abs(c("mass_slope") + physics.coriolis(c(LAT)) * c("vorticity") + 2 * c("jacobian") - physics.coriolis_over_radius(c(LAT)) * _u())),
    "bunt_vaisala": (["stability"], lambda: c("stability")),
    "vertical_wind_shear": (["shear"], lambda: c("shear")),
    "richardson": (["ri"], lambda: c("ri")),
    "wind_speed": (["speed"], lambda: c("speed")),
    "deformation": (["total_deformation"], lambda: c("total_deformation") * c("total_deformation")),
    "wind_direction": (["direction"], lambda: c("direction")),
    "horizontal_divergence": ([], lambda: F.abs(c("divergence_of_wind"))),
    "magnitude_pv": ([], lambda: F.abs(c("potential_vorticity"))),
    "gradient_pv": ([], lambda: stencil.gradient_magnitude(c("potential_vorticity"))),
    "vorticity_squared": ([], lambda: c("vorticity") * c("vorticity")),
    "directional_shear": (["direction_z"], lambda: F.abs(c("direction_z"))),
    "ngm1": (["speed", "total_deformation"], lambda: c("speed") * c("total_deformation")),
    "ngm2": (["temperature_z", "total_deformation"], lambda: F.abs(c("temperature_z")) * c("total_deformation")),
    "brown1": (["brown"], lambda: c("brown")),
    "brown2": (["brown", "shear"], lambda: c("brown") * c("shear") * c("shear") / 24),
    "nva": (["absolute_vorticity_x", "absolute_vorticity_y"], lambda: physics.at_least(-_u() * c("absolute_vorticity_x") - _v() * c("absolute_vorticity_y"), 0.0)),
    "dutton": (["speed", "speed_x", "speed_y", "shear"], _dutton),
    "edr_lunnon": (["stretching", "shearing", "u_p", "v_p"], lambda: c("stretching") * (c("v_p") * c("v_p") - c("u_p") * c("u_p")) - 2 * c("u_p") * c("v_p") * c("shearing")),
}


def _depth(name: str) -> int:
    needs = SHARED[name][0]
    return 1 + max((_depth(n) for n in needs), default=0)


def _closure(names: Iterable[str]) -> set[str]:
    found: set[str] = set()
    todo = list(names)
    while todo:
        if (name := todo.pop()) not in found:
            found.add(name)
            todo += SHARED[name][0]
    return found


def derived(grid: DataFrame, names: Iterable[str], uniform_levels: bool = False, deal: tuple[str, ...] | None = (TIME,)) -> DataFrame:
    """grid with these shared columns and all that they need. deal: None for a grid that is dealt out already."""
    grid = grid if deal is None else stencil.by_time(grid, deal)
    wanted = _closure(names)
    for depth in range(1, max(map(_depth, wanted), default=0) + 1):
        layer = {n: SHARED[n][1]() for n in sorted(wanted) if _depth(n) == depth}
        if "direction_p" in layer:
            layer["direction_p"] = stencil.angle_derivative(c("direction"), uniform=uniform_levels)
        grid = grid.withColumns(layer)
    return grid


def diagnose(grid: DataFrame, names: Iterable[str] | None = None, uniform_levels: bool = False, keep: Iterable[str] = (), deal: tuple[str, ...] | None = (TIME,), rows: int | None = None) -> DataFrame:
    """Cell keys, kept columns, and a column for each named diagnostic (all by default). colson_panofsky is null in each first level.

    uniform_levels: whether the levels are evenly spaced (stencil.regular_spacing says); it decides how angles are
    differenced along them. deal: what the grid is dealt out by; (time, pressure_level) spreads few time steps wider, for
    one exchange more where diagnostics need the level axis; None: it is dealt out by time already. rows: about how many rows of a time a task takes; times of
    more are dealt out in bands with repeated rows at their borders (stencil.bands), still by one exchange.
    """
    names = list(DIAGNOSTICS) if names is None else list(names)
    if unknown := sorted(set(names) - set(DIAGNOSTICS)):
        raise ValueError(f"no diagnostics {unknown}; there are {sorted(DIAGNOSTICS)}")
    held = require(grid, [*CELL, "altitude", *GRID_VARIABLES], "grid")
    shared = {n for d in names for n in DIAGNOSTICS[d][0]}
    made = [DIAGNOSTICS[n][1]().alias(n) for n in names]
    if rows is None:
        return derived(held, shared, uniform_levels, deal).select(*CELL, *keep, *made)
    banded = derived(stencil.bands(held, rows), shared, uniform_levels, None)
    return stencil.own_rows(banded.select(*CELL, "_row_is_own", *keep, *made))


def long_form(wide: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, diagnostic, value)."""
    return wide.unpivot(CELL if keys is None else keys, names, "diagnostic", "value")
