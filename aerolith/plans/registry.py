"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.schema import LAT, LEVEL, LON, TIME
from aerolith.sources.lattice import GRID_SQL, OBSERVED_SQL, lattice, observations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Keys of a cell in results: whole hours since 1970, and the coordinates.
KEYS = ["hour", LEVEL, LAT, LON]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return put


def hour(column: str = TIME) -> Column:
    """Hours since 1970 of a zone-less time, whatever the session's zone."""
    return (F.unix_date(F.to_date(column)).cast("long") * 24 + F.hour(column)).alias("hour")


def keyed(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(hour(), LEVEL, LAT, LON, *columns)


def r(c: Column, digits: int | None) -> Column:
    """Rounded, or as it is where both engines do the same arithmetic."""
    return c if digits is None else F.round(c, digits)


def q(expression: str, digits: int | None) -> str:
    """The same rounding in SQL, without a negative zero."""
    return f"({expression})" if digits is None else f"(round({expression}, {digits}) + 0.0::DOUBLE)"


def tables(sql: str, *, grid: bool = True, obs: bool = False, more: list[str] | None = None) -> str:
    parts = [GRID_SQL] * grid + [OBSERVED_SQL] * obs + (more or [])
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"


def grid_query(name: str, columns: list[tuple[str, Callable[[], Column], str, int | None]], where: tuple[Callable[[], Column], str] | None = None) -> None:
    """A query of scalar columns over the grid: (name, what makes the Column, SQL, digits)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lattice(spark, sf_dir)
        df = df if where is None else df.where(where[0]())
        return keyed(df, *(r(make(), k).alias(n) for n, make, _, k in columns))

    body = ", ".join(f"{q(s, k)} AS {n}" for n, _, s, k in columns)
    register(name, tables(f"SELECT {', '.join(KEYS)}, {body} FROM grid" + (f" WHERE {where[1]}" if where else "")))(query)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


# SQL of stencils -----------------------------------------------------------------------------------------------------
_LAT = "radians(latitude)"
PARALLEL = f"(sqrt(1 - {{e2}} * sin({_LAT}) * sin({_LAT})) / cos({_LAT}))"
MERIDIONAL = f"(pow(1 - {{e2}} * sin({_LAT}) * sin({_LAT}), 1.5) / (1 - {{e2}}))"
_f = 1 / 298.257223563
_e2, _n = _f * (2 - _f), _f / (2 - _f)
PARALLEL, MERIDIONAL = (f"{x}".replace("{e2}", repr(_e2) + "::DOUBLE") for x in (PARALLEL, MERIDIONAL))
NORTHING = (
    f"({6378137.0 / (1 + _n)!r}::DOUBLE * ({1 + _n**2 / 4 + _n**4 / 64!r}::DOUBLE * {_LAT} - {1.5 * (_n - _n**3 / 8)!r}::DOUBLE * sin(2 * {_LAT}) + {15 / 16 * (_n**2 - _n**4 / 4)!r}::DOUBLE * sin(4 * {_LAT})"
    f" - {35 / 48 * _n**3!r}::DOUBLE * sin(6 * {_LAT}) + {315 / 512 * _n**4!r}::DOUBLE * sin(8 * {_LAT})))"
)
AXES = {
    "x": ("PARTITION BY hour, pressure_level, latitude ORDER BY longitude", "(6378137.0::DOUBLE * radians(longitude))"),
    "y": ("PARTITION BY hour, pressure_level, longitude ORDER BY latitude", NORTHING),
    "p": ("PARTITION BY hour, latitude, longitude ORDER BY pressure_level", "pressure_level"),
}


def d(f: str, axis: str, x: str | None = None) -> str:
    """First derivative of an expression along an axis."""
    over, own = AXES[axis]
    x = x or own
    lag, lead = (lambda e, g=g: f"{g}({e}) OVER ({over})" for g in ("lag", "lead"))
    hs, hd = f"({x} - {lag(x)})", f"({lead(x)} - {x})"
    inner = f"({hs} * {hs} * {lead(f)} + ({hd} * {hd} - {hs} * {hs}) * ({f}) - {hd} * {hd} * {lag(f)}) / ({hs} * {hd} * ({hd} + {hs}))"
    return f"(CASE WHEN {lag(x)} IS NULL THEN ({lead(f)} - ({f})) / {hd} WHEN {lead(x)} IS NULL THEN (({f}) - {lag(f)}) / {hs} ELSE {inner} END)"


def gx(f: str) -> str:
    return f"({d(f, 'x')} * {PARALLEL})"


def gy(f: str) -> str:
    return f"({d(f, 'y')} * {MERIDIONAL})"


def dz(f: str, x: str | None = None) -> str:
    return f"(9.80665::DOUBLE * {d(f, 'p', x)} / nullif({d('geopotential', 'p', x)}, 0))"


def apart(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), 2 * pi() - abs({a} - {b}))"


def angle_p(f: str, uniform: bool = False) -> str:
    over, x = AXES["p"]
    lag, lead = f"lag({f}) OVER ({over})", f"lead({f}) OVER ({over})"
    lx, hx = f"lag({x}) OVER ({over})", f"lead({x}) OVER ({over})"
    inner = f"{apart(lead, lag)} / ({hx} - {lx})" if uniform else d(f, "p")
    return f"(CASE WHEN {lx} IS NULL THEN {apart(lead, f)} / ({hx} - {x}) WHEN {hx} IS NULL THEN {apart(f, lag)} / ({x} - {lx}) ELSE {inner} END)"


DIRECTION = "(CASE WHEN eastward_wind = 0 AND northward_wind = 0 THEN 0.0 WHEN pi() / 2 - atan2(-northward_wind, -eastward_wind) <= 0 THEN pi() / 2 - atan2(-northward_wind, -eastward_wind) + 2 * pi() ELSE pi() / 2 - atan2(-northward_wind, -eastward_wind) END)"
CORIOLIS = f"({2 * 7292115e-11!r}::DOUBLE * sin({_LAT}))"
_BEND = f"({MERIDIONAL} / {PARALLEL} * {d(PARALLEL, 'y')})"
WIDE = [
    f"w1 AS (SELECT *, temperature / pow(pressure_level / 1000.0, 0.28571428571428564::DOUBLE) AS theta, sqrt(eastward_wind * eastward_wind + northward_wind * northward_wind) AS speed, {DIRECTION} AS direction, vorticity + {CORIOLIS} AS zeta FROM grid)",
    f"""w2 AS (SELECT *, {PARALLEL} * {d("eastward_wind", "x")} - northward_wind * {_BEND} AS du_dx, {MERIDIONAL} * {d("eastward_wind", "y")} AS du_dy,
      {PARALLEL} * {d("northward_wind", "x")} + eastward_wind * {_BEND} AS dv_dx, {MERIDIONAL} * {d("northward_wind", "y")} AS dv_dy,
      {gx("theta")} AS theta_x, {gy("theta")} AS theta_y, {dz("theta")} AS theta_z, {dz("eastward_wind")} AS u_z, {dz("northward_wind")} AS v_z,
      {gx("temperature")} AS t_x, {gy("temperature")} AS t_y, {dz("temperature")} AS t_z, {gx("vorticity")} AS vo_x, {gy("vorticity")} AS vo_y, {gx("potential_vorticity")} AS pv_x, {gy("potential_vorticity")} AS pv_y,
      {gx("zeta")} AS zeta_x, {gy("zeta")} AS zeta_y, {gx("speed")} AS speed_x, {gy("speed")} AS speed_y, {gx("geopotential")} + {gy("geopotential")} AS mass, {d("eastward_wind", "p")} AS u_p, {d("northward_wind", "p")} AS v_p,
      {angle_p("direction")} AS direction_p, altitude - lag(altitude) OVER ({AXES["p"][0]}) AS layer FROM w1)""",
    "w3 AS (SELECT *, dv_dx + du_dy AS shearing, du_dx - dv_dy AS stretching, du_dx * dv_dy - du_dy * dv_dx AS jac, sqrt(u_z * u_z + v_z * v_z) AS shear, -(9.80665::DOUBLE / theta) * theta_z AS stability, CASE WHEN layer IS NOT NULL THEN pressure_level END AS upper FROM w2)",
    f"w4 AS (SELECT *, shearing * shearing + stretching * stretching AS def2, stability / nullif(shear, 0) AS ri, {dz('direction_p')} AS direction_z, {dz('eastward_wind', 'upper')} AS uu, {dz('northward_wind', 'upper')} AS vu, sqrt(0.3::DOUBLE * zeta * zeta + shearing * shearing + stretching * stretching) AS brown FROM w3)",
]
#: name -> (SQL over w4, power of ten that brings it to hundreds)
DIAGNOSTIC_SQL = {
    "f3d": ("CASE WHEN theta_x = 0 AND theta_y = 0 AND theta_z = 0 THEN 0.0 ELSE -1 / sqrt(theta_x * theta_x + theta_y * theta_y + theta_z * theta_z) * (theta_x * (du_dx * theta_x + dv_dx * theta_y) + theta_y * (du_dy * theta_x + dv_dy * theta_y) + theta_z * (u_z * theta_x + v_z * theta_y - divergence_of_wind * theta_z)) END", 10),
    "f2d": ("CASE WHEN theta_x = 0 AND theta_y = 0 THEN 0.0 ELSE -1 / sqrt(theta_x * theta_x + theta_y * theta_y) * (theta_x * theta_x * du_dx + theta_y * theta_y * dv_dy + theta_x * theta_y * dv_dy + theta_x * theta_y * du_dy) END", 12),
    "temperature_gradient": ("sqrt(t_x * t_x + t_y * t_y)", 8),
    "endlich": ("speed * abs(direction_z)", 6),
    "ti1": ("shear * def2", 14),
    "ti2": ("shear * (def2 - divergence_of_wind)", 10),
    "ncsu1": ("sqrt(vo_x * vo_x + vo_y * vo_y) * greatest(eastward_wind * du_dx + northward_wind * dv_dy, 0) / CASE WHEN ri IS NOT NULL THEN greatest(ri, 0.00001::DOUBLE) END", 11),
    "colson_panofsky": ("(uu * uu + vu * vu) * layer * layer * (1 - ri / 0.5)", 0),
    "ubf": (f"abs(mass + {CORIOLIS} * vorticity + 2 * jac - {CORIOLIS} / 6371008.7714::DOUBLE * eastward_wind)", 5),
    "bunt_vaisala": ("stability", 6),
    "vertical_wind_shear": ("shear", 5),
    "richardson": ("ri", 2),
    "wind_speed": ("speed", 1),
    "deformation": ("def2 * def2", 20),
    "wind_direction": ("direction", 2),
    "horizontal_divergence": ("abs(divergence_of_wind)", 8),
    "magnitude_pv": ("abs(potential_vorticity)", 8),
    "gradient_pv": ("sqrt(pv_x * pv_x + pv_y * pv_y)", 14),
    "vorticity_squared": ("vorticity * vorticity", 11),
    "directional_shear": ("abs(direction_z)", 7),
    "ngm1": ("speed * def2", 10),
    "ngm2": ("abs(t_z) * def2", 13),
    "brown1": ("brown", 6),
    "brown2": ("brown * shear * shear / 24", 12),
    "nva": ("greatest(-eastward_wind * zeta_x - northward_wind * zeta_y, 0)", 11),
    "dutton": ("10.5 + 1.25 * (northward_wind / nullif(speed, 0) * speed_x - eastward_wind / nullif(speed, 0) * speed_y) + 0.25 * shear", 1),
    "edr_lunnon": ("stretching * (v_p * v_p - u_p * u_p) - 2 * u_p * v_p * shearing", 8),
}


def diagnosed(*names: str) -> list[str]:
    """Tables up to `diag`: keys and the named diagnostics, not rounded."""
    body = ", ".join(f"({DIAGNOSTIC_SQL[n][0]})::DOUBLE AS {n}" for n in names)
    return [*WIDE, f"diag AS (SELECT hour, pressure_level, latitude, longitude, altitude, {body} FROM w4)"]


def scaled(name: str) -> str:
    """The SQL of one diagnostic of `diag`, rounded to six figures or so."""
    return q(f"{name} * 1e{DIAGNOSTIC_SQL[name][1]}", 3)


def scaled_column(name: str) -> Column:
    return r(F.col(name) * F.lit(10.0 ** DIAGNOSTIC_SQL[name][1]), 3)
