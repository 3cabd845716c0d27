"""Queries over the grid: scalar functions, filters, stencils, diagnostics, calibration, correlation and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geodesy, physics
from aerolith.operators import calibrate, diagnostics, filters, metrics, observe, regions, stencil
from aerolith.operators.filters import Domain, Thresholds
from aerolith.plans import launch
from aerolith.plans.registry import AXES, CORIOLIS, DIAGNOSTIC_SQL, DIRECTION, KEYS, MERIDIONAL, NORTHING, PARALLEL, angle_p, apart, d, diagnosed, dz, grid_query, gx, gy, hour, keyed, q, r, register, scaled, scaled_column, tables
from aerolith.schema import CELL, LAT, LEVEL, LON, TIME, Limits, Severity
from aerolith.sources import files, readers
from aerolith.sources.lattice import lattice

c = F.col
u, v, alt, temp = (lambda x=x: c(x) for x in ("eastward_wind", "northward_wind", "altitude", "temperature"))
lev, lat, lon = (lambda x=x: c(x) for x in (LEVEL, LAT, LON))
_key = ", ".join(KEYS)

# scalar functions ----------------------------------------------------------------------------------------------------
_US = "288.0 / 0.0065 * (1 - pow(pressure_level / 1013.25, 287.0::DOUBLE * 0.0065::DOUBLE / 9.80665::DOUBLE))"
_TROPO = "288.16 / 0.0065 * (1 - pow(pressure_level / 1013.25, 1 / 5.2561::DOUBLE))"
_B = "(9.80665::DOUBLE * log10(exp(1.0::DOUBLE)) / (287.0::DOUBLE * 216.66::DOUBLE))"
_STRATO = f"(288.16::DOUBLE - 216.66::DOUBLE) / 0.0065::DOUBLE + 5.2561::DOUBLE / {_B} * log10(216.66::DOUBLE / 288.16::DOUBLE) - log10(pressure_level / 1013.25) / {_B}"
_ICE = "100.0 * exp(-6024.5282 / temperature + 24.7219 + 0.010613868 * temperature - 0.000013198825::DOUBLE * temperature * temperature - 0.49382577 * ln(temperature))"
_RHI = f"(specific_humidity * (100 * pressure_level) * (461.51::DOUBLE / 287.0::DOUBLE) / ({_ICE}))"
grid_query("sca1_us_standard_altitude", [("metres", lambda: physics.us_standard_altitude(lev()), _US, 4)])
grid_query("sca2_icao_troposphere_altitude", [("metres", lambda: physics.icao_troposphere_altitude(lev()), _TROPO, 4)], (lambda: lev() > 226.32, "pressure_level > 226.32"))
grid_query("sca3_icao_stratosphere_altitude", [("metres", lambda: physics.icao_stratosphere_altitude(lev()), _STRATO, 4)], (lambda: lev() <= 226.32, "pressure_level <= 226.32"))
grid_query("sca4_icao_altitude", [("metres", lambda: physics.icao_altitude(lev()), f"CASE WHEN pressure_level > 226.32 THEN {_TROPO} ELSE {_STRATO} END", 4)])
grid_query("sca5_icao_pressure", [("hpa", lambda: physics.icao_pressure(alt()), "1013.25 * pow((288.16::DOUBLE - 0.0065::DOUBLE * altitude) / 288.16::DOUBLE, 5.2561::DOUBLE)", 6)])
grid_query("sca6_potential_temperature", [("theta", lambda: physics.potential_temperature(temp(), lev()), "temperature / pow(pressure_level / 1000.0, 0.28571428571428564::DOUBLE)", 6)])
grid_query("sca7_coriolis", [("f", lambda: physics.coriolis(lat()) * 1e6, f"{CORIOLIS} * 1e6", 6)])
grid_query("sca8_coriolis_over_radius", [("beta", lambda: physics.coriolis_over_radius(lat()) * 1e12, f"{CORIOLIS} / 6371008.7714::DOUBLE * 1e12", 5)])
grid_query("sca9_absolute_vorticity", [("zeta", lambda: physics.absolute_vorticity(c("vorticity"), lat()) * 1e6, f"(vorticity + {CORIOLIS}) * 1e6", 5)])
grid_query("sca10_vertical_vorticity", [("value", lambda: physics.vertical_vorticity(v(), u()), "northward_wind - eastward_wind", 6)])
grid_query("sca11_deformations", [("shearing", lambda: physics.shearing_deformation(v(), u()), "northward_wind + eastward_wind", 6), ("stretching", lambda: physics.stretching_deformation(u(), v()), "eastward_wind - northward_wind", 6)])
grid_query("sca12_magnitude", [("speed", lambda: physics.wind_speed(u(), v()), "sqrt(eastward_wind * eastward_wind + northward_wind * northward_wind)", 6), ("squared", lambda: physics.magnitude(u(), v(), absolute=True, squared=True), "eastward_wind * eastward_wind + northward_wind * northward_wind", None), ("total_deformation", lambda: physics.total_deformation(v() + u(), u() - v(), squared=True), "(northward_wind + eastward_wind) * (northward_wind + eastward_wind) + (eastward_wind - northward_wind) * (eastward_wind - northward_wind)", None)])
grid_query("sca13_wind_direction", [("direction", lambda: physics.wind_direction(u(), v()), DIRECTION, 7)])
grid_query("sca14_angle_difference", [("apart", lambda: physics.angle_difference(F.radians(lon() + 90), F.radians(lat() + 66)), apart("radians(longitude + 90)", "radians(latitude + 66)"), 7)])
grid_query("sca15_jacobian", [("value", lambda: physics.jacobian(u(), v(), temp(), alt()), "eastward_wind * altitude - northward_wind * temperature", None)])
grid_query("sca16_ice_saturation_pressure", [("pa", lambda: physics.ice_saturation_pressure(temp()), _ICE, 5)])
grid_query("sca17_ice_relative_humidity", [("rhi", lambda: physics.ice_relative_humidity(c("specific_humidity"), 100 * lev(), temp()), _RHI, 6)])
grid_query("sca18_ice_supersaturated", [("issr", lambda: physics.ice_supersaturated(temp(), specific_humidity=c("specific_humidity"), pressure_pa=100 * lev()).cast("double"), f"(temperature < 273.15 AND {_RHI} > 1.0)::INT::DOUBLE", 0)])
grid_query("sca19_haversine", [("metres", lambda: geodesy.haversine(lon(), lat(), F.lit(2.294), F.lit(48.858)), "2 * 6371008.7714::DOUBLE * asin(sqrt(pow(sin(radians(48.858 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(48.858)) * pow(sin(radians(2.294 - longitude) / 2), 2)))", 3)])
grid_query("sca21_nominal_spacing", [("x", lambda: geodesy.easting(lon()), AXES["x"][1], 4), ("y", lambda: geodesy.northing(lat()), NORTHING, 4)])
grid_query("sca22_scale_factors", [("parallel", lambda: geodesy.parallel_scale(lat()), PARALLEL, 8), ("meridional", lambda: geodesy.meridional_scale(lat()), MERIDIONAL, 8)])
grid_query("sca24_feature_flags", [("flags", lambda: physics.feature_flags(u() > 30, v() > 8).cast("double"), "(((eastward_wind > 30)::INT << 2) | ((northward_wind > 8)::INT << 1) | ((eastward_wind > 30)::INT & (northward_wind > 8)::INT))::DOUBLE", 0)])
grid_query("sca25_at_least", [("clipped", lambda: physics.at_least(v(), 1e-5), "greatest(northward_wind, 0.00001::DOUBLE)", 6)])
grid_query("sca26_log_of_positive", [("ln", lambda: physics.log_of_positive(v()), "CASE WHEN northward_wind > 0 THEN ln(northward_wind) END", 7)])
_EDR = "exp({c1} - {c2} / sqrt(0.8::DOUBLE) * 3.1::DOUBLE) * pow(greatest(eastward_wind, 0), {c2} / sqrt(0.8::DOUBLE))".format(c1="-2.572::DOUBLE", c2="0.5067::DOUBLE")
grid_query("sca27_eddy_dissipation", [("edr", lambda: physics.eddy_dissipation(u(), 3.1, 0.8), _EDR, 7)])


@register("sca20_geodesic")
def _geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(lattice(spark, sf_dir), r(geodesy.geodesic(lon(), lat(), lon() + 10, lat()), 3).alias("east"), r(geodesy.geodesic(lon(), lat(), lon(), lat() + 12), 3).alias("north"))


@register("sca28_midpoint", tables(f"SELECT {_key}, (latitude + 48.5) / 2 AS lat, (longitude - 3.25) / 2 AS lon FROM grid"))
def _midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(lattice(spark, sf_dir), ((lat() + 48.5) / 2).alias("lat"), ((lon() - 3.25) / 2).alias("lon"))


@register("sca30_names", tables("SELECT DISTINCT 'ti1_at_' || CAST(CAST(pressure_level AS INT) AS VARCHAR) AS name FROM grid"))
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(spark, sf_dir).select(F.concat_ws("_", F.lit("ti1"), F.lit("at"), lev().cast("int").cast("string")).alias("name")).distinct()


# filters -------------------------------------------------------------------------------------------------------------
DOMAIN = Domain(Limits(-60, 40), Limits(-30, 66), (200.0, 300.0))
_all = f"{_key}, eastward_wind"


@register("flt1_select_domain", tables(f"SELECT {_all} FROM grid WHERE longitude BETWEEN -60 AND 40 AND latitude BETWEEN -30 AND 66 AND pressure_level BETWEEN 200 AND 300"))
def _domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(filters.select_domain(lattice(spark, sf_dir), DOMAIN), "eastward_wind")


@register("flt2_shift_longitude", tables("SELECT hour, pressure_level, latitude, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END AS longitude, eastward_wind FROM grid"))
def _shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(filters.shift_longitude(lattice(spark, sf_dir), 0.0), "eastward_wind")


@register("flt3_value_slice", tables(f"SELECT {_all} FROM grid WHERE latitude >= -10 AND pressure_level <= 250"))
def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(lattice(spark, sf_dir).where(filters.value_slice(LAT, -10, None) & filters.value_slice(LEVEL, None, 250)), "eastward_wind")


@register("flt4_clip_time", tables(f"SELECT {_all} FROM grid WHERE hour BETWEEN 473358 AND 473364"))
def _clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(filters.clip_time(lattice(spark, sf_dir), "2024-01-01 06:00:00", "2024-01-01 12:00:00"), "eastward_wind")


@register("flt10_severity_band", tables(f"SELECT {_key}, eastward_wind >= 30 AND eastward_wind < 45 AS eastward_wind, northward_wind >= 4 AND northward_wind < 8 AS northward_wind FROM grid"))
def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = {"eastward_wind": Thresholds(light=20, moderate=30, severe=45), "northward_wind": Thresholds(light=2, moderate=4, severe=8)}
    return keyed(filters.turbulent_regions(lattice(spark, sf_dir), held, Severity.MODERATE), "eastward_wind", "northward_wind")


@register("flt12_latitude_bands", tables("""
  SELECT hemisphere, region, count(*) AS cells, round(avg(eastward_wind), 6) AS mean FROM grid,
    (VALUES ('global', -90, 90), ('north', 0, 90), ('south', -90, 0)) h(hemisphere, lo, hi), (VALUES ('full', -1, 91), ('extratropics', 25, 65), ('tropics', -1, 25)) g(region, a, b)
  WHERE latitude > lo AND latitude < hi AND abs(latitude) > a AND abs(latitude) < b GROUP BY ALL"""))
def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_region(lattice(spark, sf_dir)).groupBy("hemisphere", "region").agg(F.count("*").alias("cells"), r(F.avg("eastward_wind"), 6).alias("mean"))


@register("flt13_jet_mask", tables(f"SELECT {_key}, CASE WHEN eastward_wind > 30 THEN northward_wind END AS northward_wind FROM grid"))
def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(regions.masked(lattice(spark, sf_dir).withColumn("jet", u() > 30), "northward_wind", "jet"), "northward_wind")


@register("flt14_exact_select", tables(f"SELECT {_all} FROM grid WHERE pressure_level IN (200, 300) AND latitude IN (-6, 6)"))
def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(filters.select_values(lattice(spark, sf_dir), pressure_level=[200.0, 300.0], latitude=[-6.0, 6.0]), "eastward_wind")


@register("flt16_rename", tables(f"SELECT {_key}, eastward_wind AS u, northward_wind AS v FROM grid"))
def _rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(filters.rename(lattice(spark, sf_dir), {"eastward_wind": "u", "northward_wind": "v"}), "u", "v")


# sources -------------------------------------------------------------------------------------------------------------
@register("src2_reanalysis_grid", tables(f"SELECT {_key}, {q(f'CASE WHEN pressure_level > 226.32 THEN {_TROPO} ELSE {_STRATO} END', 4)} AS altitude, eastward_wind, temperature FROM grid WHERE longitude BETWEEN -60 AND 40 AND latitude BETWEEN -30 AND 66 AND pressure_level BETWEEN 200 AND 300"))
def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolith.schema import SHORT_NAMES

    raw = filters.shift_longitude(lattice(spark, sf_dir), 0.0).withColumnsRenamed({x: s for s, x in SHORT_NAMES.items()} | {TIME: "valid_time"}).drop("altitude")
    return keyed(readers.reanalysis_grid(raw, DOMAIN), r(alt(), 4).alias("altitude"), "eastward_wind", "temperature")


@register("src10_date_combinations", """WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders), days AS (SELECT unnest(range(make_date(year, 1, 1)::TIMESTAMP, make_date(year + 1, 1, 1)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS x FROM y)
  SELECT year(x)::INT AS year, month(x)::INT AS month, day(x)::INT AS day, count(o_orderkey) AS orders FROM days LEFT JOIN orders ON o_orderdate::DATE = x WHERE month(x) IN (2, 12) GROUP BY ALL""")
def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days of two months of the years that have orders, with their orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    years = sorted(x[0] for x in orders.select(F.year("o_orderdate")).distinct().collect())  # a few
    dates = readers.date_combinations(spark, years, [2, 12], [-1])
    per = orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.day("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return dates.join(per, ["year", "month", "day"], "left").fillna({"orders": 0})


# stencils ------------------------------------------------------------------------------------------------------------
def stencil_query(name: str, columns: list[tuple[str, object, str, int]], more: list[str] | None = None, before=None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lattice(spark, sf_dir)
        df = before(df) if before else df
        return keyed(df.withColumns({n: r(make(), k) for n, make, _, k in columns}), *(n for n, *_ in columns))

    register(name, tables(f"SELECT {_key}, {', '.join(f'{q(s, k)} AS {n}' for n, _, s, k in columns)} FROM {'w1' if more else 'grid'}", more=more))(query)


_theta = lambda df: df.withColumn("theta", physics.potential_temperature(temp(), lev()))
_direction = lambda df: df.withColumn("direction", physics.wind_direction(u(), v()))
W1 = diagnosed("ti1")[:1]
stencil_query("win1_first_derivative", [("dx", lambda: stencil.first_derivative(u(), stencil.X) * 1e7, f"{d('eastward_wind', 'x')} * 1e7", 3), ("dy", lambda: stencil.first_derivative(u(), stencil.Y) * 1e7, f"{d('eastward_wind', 'y')} * 1e7", 3), ("dp", lambda: stencil.first_derivative(temp(), stencil.P) * 1e4, f"{d('temperature', 'p')} * 1e4", 3)])
stencil_query("win2_spatial_gradient", [("dfdx", lambda: stencil.gradient_x(temp()) * 1e8, f"{gx('temperature')} * 1e8", 3), ("dfdy", lambda: stencil.gradient_y(temp()) * 1e8, f"{gy('temperature')} * 1e8", 3), ("plain", lambda: stencil.gradient_x(temp(), False) * 1e8, f"{d('temperature', 'x')} * 1e8", 3)])
stencil_query("win3_first_order_laplacian", [("value", lambda: stencil.first_order_laplacian(c("geopotential")) * 1e5, f"({gx('geopotential')} + {gy('geopotential')}) * 1e5", 3)])
stencil_query("win5_pressure_derivative", [("value", lambda: stencil.pressure_derivative(u()) * 1e4, f"{d('eastward_wind', 'p')} * 1e4", 3)])
stencil_query("win6_altitude_derivative", [("value", lambda: stencil.altitude_derivative(u(), c("geopotential")) * 1e5, f"{dz('eastward_wind')} * 1e5", 3)])
stencil_query("win7_angle_derivative", [("value", lambda: stencil.angle_derivative(c("direction"), uniform=False) * 1e5, f"{angle_p('direction')} * 1e5", 3), ("uniform", lambda: stencil.angle_derivative(c("direction"), uniform=True) * 1e5, f"{angle_p('direction', True)} * 1e5", 3)], W1, _direction)
stencil_query("win8_vertical_wind_shear", [("shear", lambda: stencil.vertical_wind_shear(u(), v(), c("geopotential")) * 1e5, f"sqrt(pow({dz('eastward_wind')}, 2) + pow({dz('northward_wind')}, 2)) * 1e5", 3), ("by_pressure", lambda: stencil.vertical_wind_shear(u(), v(), squared=True) * 1e4, f"(pow({d('eastward_wind', 'p')}, 2) + pow({d('northward_wind', 'p')}, 2)) * 1e4", 8)])
stencil_query("win9_gradient_magnitude", [("value", lambda: stencil.gradient_magnitude(temp()) * 1e8, f"sqrt(pow({gx('temperature')}, 2) + pow({gy('temperature')}, 2)) * 1e8", 3)])
stencil_query("win10_ertel_potential_vorticity", [("value", lambda: stencil.ertel_potential_vorticity(c("vorticity"), c("theta")) * 1e6, f"-9.80665::DOUBLE * zeta * {d('theta', 'p')} * 1e6", 3)], W1, _theta)
stencil_query("win11_difference", [("layer", lambda: stencil.difference(alt()), f"altitude - lag(altitude) OVER ({AXES['p'][0]})", 6)])


@register("win4_vector_derivatives", tables(f"SELECT {_key}, {', '.join(q(f'{x} * 1e7', 3) + f' AS {x}' for x in ('du_dx', 'du_dy', 'dv_dx', 'dv_dy'))} FROM w2", more=diagnosed("ti1")[:2]))
def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lattice(spark, sf_dir).withColumns(stencil.vector_derivatives(u(), v()))
    return keyed(made, *(r(c(x) * 1e7, 3).alias(x) for x in ("du_dx", "du_dy", "dv_dx", "dv_dy")))


@register("win12_shift_and_combine", tables(f"SELECT {_key}, (l OR h) AS combined FROM (SELECT {_key}, lag(eastward_wind > 30) OVER w AS l, lead(eastward_wind > 30) OVER w AS h FROM grid WINDOW w AS ({AXES['p'][0]})) WHERE l IS NOT NULL AND h IS NOT NULL"))
def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(stencil.shift_and_combine(lattice(spark, sf_dir).withColumn("fast", u() > 30), "fast", [TIME, LAT, LON], LEVEL), "combined")


@register("win13_trapezoid", tables(f"SELECT hour, latitude, longitude, round(sum(part), 4) AS integral FROM (SELECT *, (temperature + lead(temperature) OVER w) / 2 * (lead(pressure_level) OVER w - pressure_level) AS part FROM grid WINDOW w AS ({AXES['p'][0]})) GROUP BY ALL"))
def _trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lattice(spark, sf_dir).withColumn("part", stencil.column_trapezoid(temp()))
    return held.groupBy(hour(), LAT, LON).agg(r(F.sum("part"), 4).alias("integral"))


_PEAK = """SELECT a.hour, a.pressure_level, a.latitude, a.longitude, a.s > 30 AND a.s = max(b.s) AND any_value(a.flat) = false AS peak FROM s a JOIN s b ON a.hour = b.hour AND a.longitude = b.longitude
  AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY a.hour, a.pressure_level, a.latitude, a.longitude, a.s"""
_S = "s AS (SELECT *, sqrt(eastward_wind * eastward_wind + northward_wind * northward_wind) AS s, dense_rank() OVER (ORDER BY latitude) AS i, dense_rank() OVER (ORDER BY pressure_level) AS j, false AS flat FROM grid)"


@register("win14_local_maxima", tables(_PEAK, more=[_S]))
def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lattice(spark, sf_dir).withColumn("s", physics.wind_speed(u(), v()))
    return keyed(stencil.local_maxima(held, "s", [TIME, LON], LAT, LEVEL, 30.0), "peak")


_STEPS = " UNION ALL ".join(f"SELECT '{k}' AS axis, lead({k}) OVER (ORDER BY {k}) - {k} AS h FROM (SELECT DISTINCT {k} FROM grid)" for k in (LAT, LON, LEVEL))


@register("win17_regular_spacing", tables(f"SELECT axis, CASE WHEN max(h) - min(h) <= 1e-9 * greatest(abs(min(h)), 1) THEN min(h) END AS spacing FROM ({_STEPS}) GROUP BY axis"))
def _spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lattice(spark, sf_dir)
    return spark.createDataFrame([(k, stencil.regular_spacing(grid, k)) for k in (LAT, LON, LEVEL)], "axis string, spacing double")


# diagnostics ---------------------------------------------------------------------------------------------------------
for _i, _name in enumerate(DIAGNOSTIC_SQL, 1):

    def _diagnostic(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return keyed(diagnostics.diagnose(lattice(spark, sf_dir), [name], deal=None), scaled_column(name).alias(name))

    register(f"dg{_i}_{_name}", tables(f"SELECT {_key}, {scaled(_name)} AS {_name} FROM diag", more=diagnosed(_name)))(_diagnostic)

# calibration and evaluation ------------------------------------------------------------------------------------------
NAMES = ["ti1", "wind_speed", "brown1"]
PERCENTILES = Thresholds(light=90.0, light_to_moderate=93.0, moderate=95.0, severe=99.0)
_wide = lambda spark, sf_dir, names=NAMES: diagnostics.diagnose(lattice(spark, sf_dir), names, deal=None)
_values = lambda spark, sf_dir, names=NAMES: files.written(_wide(spark, sf_dir, names).select(*names))  # noqa: E731  worked out once for what reads it twice
_DIAG = diagnosed(*NAMES)
_SCALE = {n: f"1e{DIAGNOSTIC_SQL[n][1]}" for n in NAMES}
_LONG = [*_DIAG, "long AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT hour, pressure_level, latitude, longitude, '{n}' AS diagnostic, {n} AS value FROM diag" for n in NAMES) + "))"]
_scale = lambda: F.element_at(F.create_map(*(x for n in NAMES for x in (F.lit(n), F.lit(10.0 ** DIAGNOSTIC_SQL[n][1])))), c("diagnostic"))
_SCALE_SQL = "CASE diagnostic " + " ".join(f"WHEN '{n}' THEN {s}" for n, s in _SCALE.items()) + " END"


def _pct(p: float | None) -> str:
    return "NULL::DOUBLE" if p is None else f"round(quantile_cont(value, {p / 100}) * any_value({_SCALE_SQL}), 3)"


_THRESHOLDS = "thr AS (SELECT diagnostic, quantile_cont(value, 0.9) AS light, quantile_cont(value, 0.93) AS light_to_moderate, quantile_cont(value, 0.95) AS moderate, quantile_cont(value, 0.99) AS severe FROM long GROUP BY diagnostic)"
_BOUNDS_SQL = """bounds AS (SELECT diagnostic, 'light' AS severity, light AS lower, light_to_moderate AS upper FROM thr UNION ALL SELECT diagnostic, 'light_to_moderate', light_to_moderate, moderate FROM thr
  UNION ALL SELECT diagnostic, 'moderate', moderate, severe FROM thr UNION ALL SELECT diagnostic, 'severe', severe, 'Infinity'::DOUBLE FROM thr)"""


@register("agg1_across_columns", tables(f"""
  SELECT {_key}, CASE WHEN eastward_wind >= northward_wind AND eastward_wind >= temperature THEN 0 WHEN northward_wind >= temperature THEN 1 ELSE 2 END::BIGINT AS argmax,
    CASE WHEN eastward_wind <= northward_wind AND eastward_wind <= temperature THEN 0 WHEN northward_wind <= temperature THEN 1 ELSE 2 END::BIGINT AS argmin, 3::BIGINT AS count,
    CASE WHEN eastward_wind >= northward_wind AND eastward_wind >= temperature THEN 'eastward_wind' WHEN northward_wind >= temperature THEN 'northward_wind' ELSE 'temperature' END AS idxmax,
    CASE WHEN eastward_wind <= northward_wind AND eastward_wind <= temperature THEN 'eastward_wind' WHEN northward_wind <= temperature THEN 'northward_wind' ELSE 'temperature' END AS idxmin,
    round(greatest(eastward_wind, northward_wind, temperature), 6) AS max, round(least(eastward_wind, northward_wind, temperature), 6) AS min,
    round((eastward_wind + northward_wind + temperature) / 3, 6) AS mean, round(list_sort([eastward_wind, northward_wind, temperature])[2], 6) AS median,
    eastward_wind * northward_wind * temperature AS prod, round(eastward_wind + northward_wind + temperature, 6) AS sum,
    sqrt(((eastward_wind - (eastward_wind + northward_wind + temperature) / 3) * (eastward_wind - (eastward_wind + northward_wind + temperature) / 3) + (northward_wind - (eastward_wind + northward_wind + temperature) / 3) * (northward_wind - (eastward_wind + northward_wind + temperature) / 3) + (temperature - (eastward_wind + northward_wind + temperature) / 3) * (temperature - (eastward_wind + northward_wind + temperature) / 3)) / 3) AS std, ((eastward_wind - (eastward_wind + northward_wind + temperature) / 3) * (eastward_wind - (eastward_wind + northward_wind + temperature) / 3) + (northward_wind - (eastward_wind + northward_wind + temperature) / 3) * (northward_wind - (eastward_wind + northward_wind + temperature) / 3) + (temperature - (eastward_wind + northward_wind + temperature) / 3) * (temperature - (eastward_wind + northward_wind + temperature) / 3)) / 3 AS var,
    round(eastward_wind + northward_wind, 6) AS cumsum_2, eastward_wind * northward_wind AS cumprod_2, true AS "any", eastward_wind > 10 AND northward_wind > 0 AS "all" FROM grid"""))
def _across(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = lattice(spark, sf_dir), ["eastward_wind", "northward_wind", "temperature"]
    df = df.withColumns({"f1": u() > 10, "f2": v() > 0, "f3": temp() > 0})
    for m in calibrate.REDUCTIONS:
        df = calibrate.across_columns(df, (["f1", "f2", "f3"] if m == "any" else ["f1", "f2"]) if m in ("any", "all") else names, m, f"_{m}")
    digits = {"max": 6, "min": 6, "mean": 6, "median": 6, "prod": None, "sum": 6, "std": None, "var": None}
    plain = [c(f"_{m}").alias(m) for m in ("idxmax", "idxmin", "count", "all", "any")]
    places = [c(f"_{m}").cast("long").alias(m) for m in ("argmax", "argmin")]
    return keyed(df, *places, *plain, *(r(c(f"_{m}"), k).alias(m) for m, k in digits.items()), r(F.element_at("_cumsum", 2), 6).alias("cumsum_2"), F.element_at("_cumprod", 2).alias("cumprod_2"))


_THRESHOLD_ROWS = tables(f"SELECT diagnostic, {_pct(90)} AS light, {_pct(93)} AS light_to_moderate, {_pct(95)} AS moderate, {_pct(None)} AS moderate_to_severe, {_pct(99)} AS severe FROM long GROUP BY diagnostic", more=_LONG)


@register("agg2_percentile_thresholds", _THRESHOLD_ROWS)
def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calibrate.percentile_thresholds(_values(spark, sf_dir), NAMES, PERCENTILES)
    return made.select("diagnostic", *(r(c(str(s)) * _scale(), 3).alias(str(s)) for s in Severity))


@register("agg2_percentile_thresholds_spread", _THRESHOLD_ROWS)
def _percentiles_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calibrate.percentile_thresholds(_values(spark, sf_dir), NAMES, PERCENTILES, spread=True)
    return made.select("diagnostic", *(r(c(str(s)) * _scale(), 3).alias(str(s)) for s in Severity))


_ALL = list(DIAGNOSTIC_SQL)
_ALL_SCALE = lambda: F.element_at(F.create_map(*(x for n in _ALL for x in (F.lit(n), F.lit(10.0 ** DIAGNOSTIC_SQL[n][1])))), c("diagnostic"))


@register("agg3_suite_thresholds", tables(" UNION ALL ".join(f"SELECT '{n}' AS diagnostic, {q(f'quantile_cont({n}, 0.9) * 1e{DIAGNOSTIC_SQL[n][1]}', 3)} AS light, {q(f'quantile_cont({n}, 0.99) * 1e{DIAGNOSTIC_SQL[n][1]}', 3)} AS severe FROM diag" for n in _ALL), more=diagnosed(*_ALL)))
def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calibrate.percentile_thresholds(_values(spark, sf_dir, _ALL), _ALL, Thresholds(light=90.0, severe=99.0), spread=True)
    return made.select("diagnostic", r(c("light") * _ALL_SCALE(), 3).alias("light"), r(c("severe") * _ALL_SCALE(), 3).alias("severe"))


_LOGS = [*_LONG, "logs AS (SELECT diagnostic, ln(value) AS ln FROM long WHERE value > 0)", "ends AS (SELECT diagnostic, min(ln) AS low, max(ln) AS high, count(*) AS n, (max(ln) - min(ln)) / 50 AS w FROM logs GROUP BY diagnostic)"]


@register("agg4_log_histogram", tables("""SELECT e.diagnostic, b.bin::INT AS bin, round(low + b.bin * w, 5) AS lower, round(low + (b.bin + 1) * w, 5) AS upper, round(coalesce(held, 0) / (n * w), 4) AS density
  FROM ends e CROSS JOIN range(50) b(bin) LEFT JOIN (SELECT l.diagnostic, least(floor((ln - low) / w), 49)::INT AS bin, count(*) AS held FROM logs l JOIN ends USING (diagnostic) GROUP BY ALL) h ON h.diagnostic = e.diagnostic AND h.bin = b.bin""", more=_LOGS))
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calibrate.log_histogram(diagnostics.long_form(_values(spark, sf_dir), NAMES, []))
    return made.select("diagnostic", "bin", r(c("lower"), 5).alias("lower"), r(c("upper"), 5).alias("upper"), r(c("density"), 4).alias("density"))




@register("flt15_significant_bins", tables("""SELECT diagnostic, count(*) AS bins FROM (SELECT l.diagnostic, least(floor((ln - low) / w), 49)::INT AS bin, count(*) / (any_value(n) * any_value(w)) AS density FROM logs l JOIN ends USING (diagnostic) GROUP BY ALL) WHERE density >= 0.01 GROUP BY diagnostic""", more=_LOGS))
def _significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calibrate.significant_bins(calibrate.log_histogram(diagnostics.long_form(_values(spark, sf_dir), NAMES, [])), 0.01)
    return made.groupBy("diagnostic").agg(F.count("*").alias("bins"))


@register("agg5_distribution_parameters", tables("SELECT diagnostic, round(avg(ln), 5) AS mean, round(var_pop(ln), 5) AS variance FROM logs GROUP BY diagnostic", more=_LOGS))
def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calibrate.distribution_parameters(diagnostics.long_form(_wide(spark, sf_dir), NAMES))
    return made.select("diagnostic", r(c("mean"), 5).alias("mean"), r(c("variance"), 5).alias("variance"))


@register("agg6_log_moments", tables("SELECT round(avg(ln(northward_wind)), 6) AS mean, round(var_pop(ln(northward_wind)), 6) AS variance FROM grid WHERE northward_wind > 0"))
def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.observed_distribution(lattice(spark, sf_dir), "northward_wind").select(r(c("mean"), 6).alias("mean"), r(c("variance"), 6).alias("variance"))


@register("flt11_severity_bounds", tables(f"SELECT diagnostic, severity, round(lower * {_SCALE_SQL}, 3) AS lower, round(upper * {_SCALE_SQL}, 3) AS upper FROM bounds", more=[*_LONG, _THRESHOLDS, _BOUNDS_SQL]))
def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = calibrate.severity_bounds(calibrate.percentile_thresholds(_values(spark, sf_dir), NAMES, PERCENTILES, spread=True))
    return made.select("diagnostic", "severity", r(c("lower") * _scale(), 3).alias("lower"), r(c("upper") * _scale(), 3).alias("upper"))


@register("agg8_turbulence_probability", tables("SELECT diagnostic, severity, pressure_level, latitude, longitude, 100.0::DOUBLE * sum((value >= lower)::INT) / count(DISTINCT hour) AS probability FROM long JOIN bounds USING (diagnostic) GROUP BY ALL", more=[*_LONG, _THRESHOLDS, _BOUNDS_SQL]))
def _probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lattice(spark, sf_dir)
    thresholds, _ = launch.calibration(grid, NAMES, PERCENTILES, spread=True, deal=None)
    return launch.probabilities(grid, NAMES, thresholds, deal=None)


@register("agg9_regions_by_severity", tables(f"SELECT {_key}, diagnostic, severity, value >= lower AND value < upper AS turbulent FROM long JOIN bounds USING (diagnostic)", more=[*_LONG, _THRESHOLDS, _BOUNDS_SQL]))
def _by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = files.written(_wide(spark, sf_dir))
    bounds = calibrate.severity_bounds(calibrate.percentile_thresholds(wide, NAMES, PERCENTILES, spread=True))
    return keyed(calibrate.by_severity(diagnostics.long_form(wide, NAMES), bounds), "diagnostic", "severity", "turbulent")


@register("agg10_dissipation_rates", tables(f"SELECT {_key}, diagnostic, round(exp(-2.572::DOUBLE - 0.5067::DOUBLE / sqrt(variance) * mean) * pow(greatest(value, 0), 0.5067::DOUBLE / sqrt(variance)), 5) AS edr FROM long JOIN (SELECT diagnostic, avg(ln) AS mean, var_pop(ln) AS variance FROM logs GROUP BY 1) USING (diagnostic)", more=_LOGS))
def _edr(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lattice(spark, sf_dir)
    _, parameters = launch.calibration(grid, NAMES, PERCENTILES, spread=True, deal=None)
    return keyed(launch.dissipation_rates(grid, NAMES, parameters, deal=None), "diagnostic", r(c("edr"), 5).alias("edr"))


def _corr_sql(source: str, names: list[str], keys: str = "", where: str = "") -> str:
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    one = lambda a, b: f"SELECT {k}'{a}' AS diagnostic1, '{b}' AS diagnostic2, " + (f"1.0::DOUBLE AS corr FROM {source} {g or 'LIMIT 1'}" if a == b else f"round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM {source} {g}")
    return " UNION ALL ".join(f"SELECT * FROM ({one(a, b)})" for a in names for b in names)


@register("agg14_correlation", tables(_corr_sql("diag", NAMES), more=_DIAG))
def _correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.correlation(_wide(spark, sf_dir), NAMES).withColumn("corr", r(c("corr"), 6))


_REGIONAL = "regional AS (SELECT hemisphere, region, diag.* FROM diag, (VALUES ('global', -90, 90), ('north', 0, 90), ('south', -90, 0)) h(hemisphere, lo, hi), (VALUES ('full', -1, 91), ('extratropics', 25, 65), ('tropics', -1, 25)) g(region, a, b) WHERE latitude > lo AND latitude < hi AND abs(latitude) > a AND abs(latitude) < b)"


@register("agg15_regional_correlation", tables(_corr_sql("regional", NAMES, "hemisphere, region"), more=[*_DIAG, _REGIONAL]))
def _regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.regional_correlation(_wide(spark, sf_dir), NAMES).withColumn("corr", r(c("corr"), 6))


_MASKS = "masks AS (SELECT eastward_wind > 30 AS a, northward_wind > 8 AS b, temperature > 225 AS t FROM grid)"


@register("agg16_matthews", tables(_corr_sql("(SELECT a::INT AS a, b::INT AS b, t::INT AS t FROM masks)", ["a", "b", "t"]), more=[_MASKS]))
def _matthews(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = lattice(spark, sf_dir).select((u() > 30).alias("a"), (v() > 8).alias("b"), (temp() > 225).alias("t"))
    return calibrate.matthews_correlation(masks, ["a", "b", "t"]).withColumn("corr", r(c("corr"), 6))


@register("agg17_matthews_by_severity", tables(_corr_sql("(SELECT 'light' AS severity, (eastward_wind >= 30)::INT AS eastward_wind, (northward_wind >= 4)::INT AS northward_wind FROM grid UNION ALL SELECT 'severe', (eastward_wind >= 50)::INT, (northward_wind >= 12)::INT FROM grid)", ["eastward_wind", "northward_wind"], "severity")))
def _matthews_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = {"eastward_wind": Thresholds(light=30, severe=50), "northward_wind": Thresholds(light=4, severe=12)}
    return calibrate.matthews_by_severity(lattice(spark, sf_dir), held, [Severity.LIGHT, Severity.SEVERE]).withColumn("corr", r(c("corr"), 6))


@register("agg18_zonal_mean", tables("SELECT hour, pressure_level, latitude, round(avg(temperature), 6) AS temperature FROM grid GROUP BY ALL"))
def _zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.zonal_mean(lattice(spark, sf_dir), ["temperature"]).select(hour(), LEVEL, LAT, r(temp(), 6).alias("temperature"))


@register("agg19_time_mean", tables("SELECT pressure_level, latitude, longitude, round(avg(CASE WHEN eastward_wind > 30 THEN northward_wind END), 6) AS v FROM grid GROUP BY ALL"))
def _time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lattice(spark, sf_dir).withColumn("v", F.when(u() > 30, v()))
    return calibrate.time_mean(held, ["v"]).select(LEVEL, LAT, LON, r(c("v"), 6).alias("v"))


@register("agg30_time_window", tables("SELECT min(hour) AS first, max(hour) AS last FROM grid"))
def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.time_window(lattice(spark, sf_dir)).select(hour("first").alias("first"), hour("last").alias("last"))


@register("agg12_contingency", tables("SELECT pressure_level, count_if(eastward_wind > 30 AND northward_wind > 8)::BIGINT AS n11, count_if(eastward_wind > 30 AND NOT northward_wind > 8)::BIGINT AS n10, count_if(NOT eastward_wind > 30 AND northward_wind > 8)::BIGINT AS n01, count_if(NOT eastward_wind > 30 AND NOT northward_wind > 8)::BIGINT AS n00 FROM grid GROUP BY ALL"))
def _contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lattice(spark, sf_dir).select(LEVEL, (u() > 30).alias("x"), (v() > 8).alias("y"))
    return metrics.contingency(held, "x", "y", [LEVEL])


_TABLE = "tab AS (SELECT diagnostic, pressure_level, count_if(jet AND t)::DOUBLE AS n11, count_if(jet AND NOT t)::DOUBLE AS n10, count_if(NOT jet AND t)::DOUBLE AS n01, count_if(NOT jet AND NOT t)::DOUBLE AS n00 FROM (SELECT 'wind_speed' AS diagnostic, pressure_level, eastward_wind > 30 AS jet, speed >= 40 AS t FROM w1 UNION ALL SELECT 'northward_wind', pressure_level, eastward_wind > 30, northward_wind >= 8 FROM w1) GROUP BY ALL)"
_REL_SQL = """SELECT diagnostic, pressure_level, round(((n11 + n10 + n01 + n00) * n11 - (n11 + n10) * (n11 + n01)) / nullif(sqrt(n11 + n10) * sqrt(n01 + n00) * sqrt(n11 + n01) * sqrt(n10 + n00), 0), 6) AS matthews_correlation,
  round(CASE WHEN n00 * n11 > 0 AND n01 * n10 > 0 THEN ln(n00 * n11 / (n01 * n10)) END, 6) AS sample_odds_ratio, round(CASE WHEN n11 > 0 AND n01 > 0 AND n01 + n00 > 0 THEN ln(n11 / n01 * ((n01 + n00) / (n11 + n10))) END, 6) AS relative_risk,
  round(n11 / nullif(n11 + n10 + n01, 0), 6) AS jaccard_index, round(n11 / nullif(n11 + n10, 0), 6) AS this_given_other, round(n11 / nullif(n11 + n01, 0), 6) AS other_given_this, round(n01 / nullif(n01 + n00, 0), 6) AS this_given_not_other,
  round(n10 / nullif(n10 + n00, 0), 6) AS other_given_not_this, round(CASE WHEN n11 > 0 AND n10 > 0 AND n10 + n00 > 0 THEN ln(n11 / n10 * ((n10 + n00) / (n11 + n01))) END, 6) AS invs_relative_risk FROM tab"""


@register("met17_19_relationships", tables(_REL_SQL, more=[*W1, _TABLE]))
def _relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lattice(spark, sf_dir).withColumns({"wind_speed": physics.wind_speed(u(), v()), "jet": u() > 30})
    long = held.unpivot([LEVEL, "jet"], ["wind_speed", "northward_wind"], "diagnostic", "value")
    made = metrics.relationships(long, "jet", {"wind_speed": 40.0, "northward_wind": 8.0}, [LEVEL])
    return made.select("diagnostic", LEVEL, *(r(c(x), 6).alias(x) for x in made.columns[2:]))


# regions -------------------------------------------------------------------------------------------------------------
_JET = f"jets AS (SELECT *, sum(part) OVER (PARTITION BY hour, latitude, longitude) / 175.0 > 30 AS jet FROM (SELECT *, (speed + lead(speed) OVER w) / 2 * (lead(pressure_level) OVER w - pressure_level) AS part FROM w1 WINDOW w AS ({AXES['p'][0]})))"


@register("reg1_alpha_velocity_jet", tables(f"SELECT {_key}, jet FROM jets", more=[*W1, _JET]))
def _alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(regions.JET_ALGORITHMS["alpha_vel_koch"](lattice(spark, sf_dir)), "jet")


@register("reg2_local_maximum_jet", tables(f"SELECT {_key}, peak AND eastward_wind >= 0 AS jet FROM ({_PEAK}) JOIN grid USING ({_key})", more=[_S]))
def _schiemann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(regions.JET_ALGORITHMS["wind_speed_schiemann"](lattice(spark, sf_dir)), "jet")


@register("met20_jet_relationship", tables("""SELECT round(n11 / nullif(n11 + n10 + n01, 0), 6) AS jaccard_index, round(n11 / nullif(n11 + n10, 0), 6) AS this_given_other FROM (SELECT count_if(jet AND northward_wind >= 8)::DOUBLE AS n11, count_if(jet AND NOT northward_wind >= 8)::DOUBLE AS n10, count_if(NOT jet AND northward_wind >= 8)::DOUBLE AS n01 FROM jets)""", more=[*W1, _JET]))
def _jet_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolith.schema import Relationship

    long = regions.alpha_velocity_jet(lattice(spark, sf_dir)).unpivot(["jet"], ["northward_wind"], "diagnostic", "value")
    made = metrics.relationships(long, "jet", {"northward_wind": 8.0}, [], [Relationship.JACCARD, Relationship.THIS_GIVEN_OTHER])
    return made.select(r(c("jaccard_index"), 6).alias("jaccard_index"), r(c("this_given_other"), 6).alias("this_given_other"))


_INDEXED = "ix AS (SELECT *, dense_rank() OVER (ORDER BY longitude) - 1 AS i, dense_rank() OVER (ORDER BY latitude) - 1 AS j, eastward_wind > 38 AS a, northward_wind > 9 AS b FROM grid)"
_REACH = """reach(hour, pressure_level, id, root) AS (
  SELECT hour, pressure_level, i * 12 + j, i * 12 + j FROM ix WHERE a
  UNION SELECT r.hour, r.pressure_level, n.i * 12 + n.j, r.root FROM reach r JOIN ix m ON m.hour = r.hour AND m.pressure_level = r.pressure_level AND m.i * 12 + m.j = r.id
    JOIN ix n ON n.hour = m.hour AND n.pressure_level = m.pressure_level AND n.a AND abs(n.i - m.i) <= 1 AND abs(n.j - m.j) <= 1)"""
_LABELS = "roots AS (SELECT hour, pressure_level, id, min(root) AS root FROM reach GROUP BY ALL), labels AS (SELECT *, dense_rank() OVER (PARTITION BY hour, pressure_level ORDER BY root) AS label FROM roots)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(spark, sf_dir).withColumns({"a": u() > 38, "b": v() > 9})


@register("reg4_label_regions", tables(f"SELECT ix.hour, ix.pressure_level, latitude, longitude, coalesce(label, 0)::INT AS label FROM ix LEFT JOIN labels ON labels.hour = ix.hour AND labels.pressure_level = ix.pressure_level AND labels.id = i * 12 + j", more=[_INDEXED, _REACH, _LABELS]))
def _label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(regions.label_regions(_features(spark, sf_dir), "a", 2), "label")


@register("reg5_parent_regions", tables("""SELECT ix.hour, ix.pressure_level, latitude, longitude, coalesce(label, 0)::INT AS label, coalesce(bool_or(a AND b) OVER (PARTITION BY ix.hour, ix.pressure_level, label), false) AND label IS NOT NULL AS parent
  FROM ix LEFT JOIN labels ON labels.hour = ix.hour AND labels.pressure_level = ix.pressure_level AND labels.id = i * 12 + j""", more=[_INDEXED, _REACH, _LABELS]))
def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir)
    labelled = regions.label_regions(df, "a", 2).join(df.select(*CELL, (c("a") & c("b")).alias("both")), CELL)
    return keyed(regions.parent_regions(labelled, "both", [TIME, LEVEL]), "label", "parent")


_NEAR = "FROM ix p LEFT JOIN ix o ON o.hour = p.hour AND o.pressure_level = p.pressure_level AND o.b GROUP BY p.hour, p.pressure_level, p.latitude, p.longitude, p.a"


@register("reg6_distance", tables(f"SELECT p.hour, p.pressure_level, p.latitude, p.longitude, round(CASE WHEN p.a THEN min(sqrt((p.i - o.i) ** 2 + (p.j - o.j) ** 2)) END, 6) AS euclidean, CASE WHEN p.a THEN min(greatest(abs(p.i - o.i), abs(p.j - o.j))) END::DOUBLE AS chebyshev, round(CASE WHEN p.a THEN min(sqrt((2 * (p.i - o.i)) ** 2 + (p.j - o.j) ** 2)) END, 6) AS sampled {_NEAR}", more=[_INDEXED]))
def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir)
    plain = regions.distance(df, "a", "b").withColumnRenamed("distance", "euclidean")
    square = regions.distance(df, "a", "b", measure="chebyshev").withColumnRenamed("distance", "chebyshev")
    sampled = regions.distance(df, "a", "b", sampling=(2.0, 1.0)).withColumnRenamed("distance", "sampled")
    return keyed(plain.join(square, CELL).join(sampled, CELL), r(c("euclidean"), 6).alias("euclidean"), "chebyshev", r(c("sampled"), 6).alias("sampled"))


@register("reg7_haversine_distance", tables(f"""SELECT hour, pressure_level, latitude, longitude, round(CASE WHEN a THEN 2 * 6371008.7714::DOUBLE * asin(sqrt(pow(sin(radians(t[4] - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(t[4])) * pow(sin(radians(t[5] - longitude) / 2), 2))) END, 3) AS distance
  FROM (SELECT p.hour, p.pressure_level, p.latitude, p.longitude, p.a, min([(p.i - o.i) ** 2 + (p.j - o.j) ** 2, o.j, o.i, o.latitude, o.longitude]) AS t {_NEAR})""", more=[_INDEXED]))
def _haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(regions.haversine_distance(_features(spark, sf_dir), "a", "b"), r(c("distance"), 3).alias("distance"))


_VERT = "vert AS (SELECT *, dense_rank() OVER (ORDER BY pressure_level) AS k FROM ix)"
_VERT_SQL = "SELECT p.hour, p.pressure_level, p.latitude, p.longitude, coalesce(min(abs(p.k - o.k)), 'Infinity'::DOUBLE)::DOUBLE AS levels, coalesce(min(abs(p.pressure_level - o.pressure_level)), 'Infinity'::DOUBLE) AS hpa FROM vert p LEFT JOIN vert o ON o.hour = p.hour AND o.latitude = p.latitude AND o.longitude = p.longitude AND {hit} GROUP BY ALL"


@register("reg8_vertical_distance", tables(_VERT_SQL.format(hit="o.a"), more=[_INDEXED, _VERT]))
def _vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regions.vertical_distance(_features(spark, sf_dir), "a", output="levels")
    return keyed(regions.vertical_distance(df, "a", absolute=True, output="hpa"), "levels", "hpa")


@register("reg9_vertical_distance_between", tables(f"SELECT hour, pressure_level, latitude, longitude, levels AS distance FROM ({_VERT_SQL.format(hit='o.a AND o.b')})", more=[_INDEXED, _VERT]))
def _vertical_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(regions.vertical_distance_between(_features(spark, sf_dir), "a", "b"), "distance")


_FIVE = NAMES + ["deformation", "ngm1"]
_CORRELATED = ", ".join("[" + ", ".join("1.0::DOUBLE" if a == b else f"corr({a}::DOUBLE, {b}::DOUBLE)" for b in _FIVE) + "]" for a in _FIVE)
#: Complete linkage: each round joins the two clusters whose farthest members are nearest; h is how far they are.
_LINKAGE = f"""matrix AS (SELECT [{_CORRELATED}] AS r FROM diag),
apart AS (SELECT list_transform(range(25), lambda k: sqrt(list_sum(list_transform(range(1, 6), lambda t: pow(r[k // 5 + 1][t] - r[k % 5 + 1][t], 2))))) AS d FROM matrix),
tree(step, cl, h, d) AS (
  SELECT 0, [[1], [2], [3], [4], [5]]::BIGINT[][], 0.0::DOUBLE, d FROM apart
  UNION ALL
  SELECT step + 1, list_concat(list_filter(cl, lambda x, k: k <> b.i AND k <> b.j), [list_concat(cl[b.i], cl[b.j])]), b.h, d FROM (
    SELECT step, cl, d, list_sort(list_filter(list_transform(range(len(cl) * len(cl)), lambda p: {{'h': list_max(flatten(list_transform(cl[p // len(cl) + 1], lambda x: list_transform(cl[p % len(cl) + 1], lambda y: d[(x - 1) * 5 + y])))), 'i': p // len(cl) + 1, 'j': p % len(cl) + 1}}), lambda s: s.i < s.j))[1] AS b
    FROM tree WHERE len(cl) > 1)
),
flat AS (SELECT cl FROM tree WHERE h <= list_max(d) / 2 ORDER BY step DESC LIMIT 1),
leaves AS (SELECT cl[1] AS l FROM tree WHERE len(cl) = 1),
owned AS (SELECT i, list_min(list_transform(list_filter(cl, lambda x: list_contains(x, i))[1], lambda m: list_position(l, m))) AS first_leaf FROM flat, leaves, range(1, 6) t(i)),
ranked AS (SELECT i, dense_rank() OVER (ORDER BY first_leaf) AS cluster FROM owned)"""


@register("reg11_correlation_clusters", tables(f"SELECT CAST(row_number() OVER (ORDER BY cluster, i) - 1 AS INT) AS place, {_FIVE!r}[i] AS diagnostic, CAST(cluster AS INT) AS cluster FROM ranked", more=[*diagnosed(*_FIVE), _LINKAGE]))
def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    names = _FIVE
    held = {(x.diagnostic1, x.diagnostic2): x["corr"] for x in calibrate.correlation(_wide(spark, sf_dir, names), names).collect()}
    order, cluster = regions.complete_linkage_order(np.array([[held[a, b] for b in names] for a in names], float))
    return spark.createDataFrame([(i, names[k], cluster[k]) for i, k in enumerate(order)], "place int, diagnostic string, cluster int")


# interpolation -------------------------------------------------------------------------------------------------------
def _points(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(c("id").alias("point"), (F.lit(-60.0) + c("id") * 3).alias(LAT), (F.lit(-85.0) + c("id") * 4).alias(LON))


_LATS, _LONS = [-66.0 + 12 * i for i in range(12)], [-90.0 + 10 * i for i in range(18)]
_PTS = "pts AS (SELECT id AS point, (-60.0 + id * 3)::DOUBLE AS lat, (-85.0 + id * 4)::DOUBLE AS lon, (-60.0 + id * 3 + 66) / 12.0::DOUBLE AS fi, (-85.0 + id * 4 + 90) / 10.0::DOUBLE AS fj FROM range(40) t(id)), gi AS (SELECT *, (latitude + 66) / 12 AS i, (longitude + 90) / 10 AS j FROM grid)"


@register("jon16_17_interpolate_linear", tables("SELECT point, lat AS latitude, lon AS longitude, hour, pressure_level, round(sum(temperature * (1 - abs(fi - i)) * (1 - abs(fj - j))), 8) AS temperature FROM pts JOIN gi ON abs(fi - i) < 1 AND abs(fj - j) < 1 GROUP BY ALL", more=[_PTS]))
def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = observe.interpolate(_points(spark), lattice(spark, sf_dir), "temperature", _LATS, _LONS)
    return made.select("point", LAT, LON, hour(), LEVEL, r(temp(), 8).alias("temperature"))


@register("jon17_interpolate_nearest", tables("SELECT point, lat AS latitude, lon AS longitude, hour, pressure_level, temperature FROM pts JOIN gi ON i = round_even(fi, 0) AND j = round_even(fj, 0)", more=[_PTS]))
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = observe.interpolate(_points(spark), lattice(spark, sf_dir), "temperature", _LATS, _LONS, "nearest")
    return made.select("point", LAT, LON, hour(), LEVEL, "temperature")


def _cubic(source: str, made: str, keep: str, f: str, line: str, place: str, at: str, last: int) -> list[str]:
    """Tables up to `made`: the columns of keep and v, the monotone cubic of f along place at the position at, per line."""
    over = f"OVER (PARTITION BY {line} ORDER BY {place})"
    end = lambda d, e: f"(CASE WHEN sign(3 * ({d}) - ({e})) <> sign({d}) THEN 0 WHEN sign({d}) <> sign({e}) AND abs((3 * ({d}) - ({e})) / 2) > 3 * abs({d}) THEN 3 * ({d}) ELSE (3 * ({d}) - ({e})) / 2 END)"
    steps = f"SELECT *, {f} - lag({f}) {over} AS s1, lag({f}) {over} - lag({f}, 2) {over} AS s2, lead({f}) {over} - {f} AS n1, lead({f}, 2) {over} - lead({f}) {over} AS n2 FROM {source}"
    slopes = f"SELECT *, CASE WHEN s1 IS NULL THEN {end('n1', 'n2')} WHEN n1 IS NULL THEN {end('s1', 's2')} WHEN s1 * n1 > 0 THEN 2 * s1 * n1 / (s1 + n1) ELSE 0 END AS m FROM ({steps})"
    beside = f"SELECT *, lead({f}) {over} AS f1, lead(m) {over} AS m1, {at} - {place} AS t FROM ({slopes})"
    return [f"{made} AS (SELECT {keep}, (1 + 2 * t) * (1 - t) * (1 - t) * {f} + t * (1 - t) * (1 - t) * m + t * t * (3 - 2 * t) * f1 + t * t * (t - 1) * m1 AS v FROM ({beside}) WHERE {place} = least(floor({at}), {last}))"]


_EACH = "at_row AS (SELECT g.hour, g.pressure_level, g.i, g.j, g.temperature AS f, p.point, p.lat, p.lon, p.fi, p.fj FROM gi g CROSS JOIN pts p)"
_PCHIP = [
    _PTS, _EACH, *_cubic("at_row", "along", "hour, pressure_level, i, point, lat, lon, fi", "f", "point, hour, pressure_level, i", "j", "fj", 16),
    *_cubic("along", "cubic", "hour, pressure_level, point, lat, lon", "v", "point, hour, pressure_level", "i", "fi", 10),
]


@register("jon17_interpolate_pchip", tables(f"SELECT point, lat AS latitude, lon AS longitude, hour, pressure_level, {q('v', 6)} AS temperature FROM cubic", more=_PCHIP))
def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = observe.interpolate(_points(spark), lattice(spark, sf_dir), "temperature", _LATS, _LONS, "pchip")
    return made.select("point", LAT, LON, hour(), LEVEL, r(temp(), 6).alias("temperature"))


@register("first_time_step", tables(f"SELECT {_all} FROM grid WHERE hour = (SELECT min(hour) FROM grid)"))
def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lattice(spark, sf_dir)
    first = grid.agg(F.min(TIME).alias(TIME))  # one row
    return keyed(grid.join(F.broadcast(first), TIME), "eastward_wind")


@register("flagship_turbulence_percentage", tables("SELECT diagnostic, severity, pressure_level, latitude, longitude, 100.0::DOUBLE * sum((value >= lower)::INT) / count(DISTINCT hour) AS probability FROM long JOIN bounds USING (diagnostic) WHERE diagnostic = 'ti1' AND severity <> 'light_to_moderate' GROUP BY ALL", more=[*_LONG, _THRESHOLDS, _BOUNDS_SQL]))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return launch.turbulence_percentage(lattice(spark, sf_dir), deal=None)
