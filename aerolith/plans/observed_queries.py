"""Queries over reports: sources, quality control, joins to the grid, verification metrics, sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geodesy
from aerolith.operators import calibrate, filters, metrics, observe
from aerolith.operators.filters import Domain
from aerolith.plans import launch
from aerolith.plans.registry import KEYS, diagnosed, keyed, observed, q, r, register, tables
from aerolith.schema import CELL, LAT, LEVEL, LON, GroupBy, GroupMetric, Limits, ValidationCondition
from aerolith.sources import files, netcdf, readers, writers, zarr
from aerolith.sources.lattice import lattice

c = F.col
_key = ", ".join(KEYS)
_O = lambda sql, more=None, grid=False: tables(sql, grid=grid, obs=True, more=more)
DOMAIN, STEP = Domain(Limits(-90, 80), Limits(-66, 66)), 10.0
CONDITION = ValidationCondition("maxEDR", 0.3)
NAMES = ["wind_speed", "ti1"]

# sources and quality control -----------------------------------------------------------------------------------------


@register("src3_acars_scan", _O('SELECT altitude, latitude, longitude, "maxEDR", "medEDR", CASE WHEN "turbIndex" <= 20 THEN "turbIndex" END AS "turbIndex" FROM obs'))
def _acars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.acars(observed(spark, sf_dir))


@register("src4_amdar_times", "SELECT event_id::BIGINT AS report, epoch(TIMESTAMP '2024-01-01' + to_seconds(event_id * 997 % 64800))::BIGINT AS second, value AS turbulence_degree FROM events WHERE event_id % 4 <> 0")
def _amdar(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = c("event_id") * 997 % 64800
    whole = lambda x: F.floor(x).cast("double")
    raw = events.select(
        c("event_id").cast("long").alias("report"), F.lit(2024.0).alias("year"), F.lit(1.0).alias("month"), F.lit(1.0).alias("day"), whole(at / 3600).alias("hour"), whole(at % 3600 / 60).alias("minute"),
        F.when(at % 60 != 0, (at % 60).cast("double")).alias("second"), F.when(c("event_id") % 4 != 0, c("value")).alias("turbulence_degree"),
    )
    made = readers.amdar_times(raw)
    days = F.unix_date(F.to_date("datetime")).cast("long") * 86400
    return made.select("report", (days + F.hour("datetime") * 3600 + F.minute("datetime") * 60 + F.second("datetime")).alias("second"), "turbulence_degree")


@register("flt5_quality_control", _O("SELECT DISTINCT report, altitude, latitude, longitude FROM obs WHERE altitude >= 8500"))
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = observed(spark, sf_dir)
    return filters.quality_control(reports.unionByName(reports)).select("report", "altitude", LAT, LON)


@register("flt6_good_flags", _O("SELECT report, flag FROM obs WHERE flag IN ('Z', 'C', 'S', 'V', 'G')"))
def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.good_flags(observed(spark, sf_dir), ["flag", "absent"]).select("report", "flag")


@register("flt7_good_errors", _O("SELECT report, error FROM obs WHERE error IN (112, 45)"))
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.good_errors(observed(spark, sf_dir), ["error"]).select("report", "error")


@register("flt8_complete", _O('SELECT report, "turbIndex" FROM obs WHERE "turbIndex" <= 20'))
def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = observed(spark, sf_dir).withColumn("turbIndex", filters.sentinel_to_null(c("turbIndex")))
    return filters.complete(held, ["turbIndex", "absent"], ["report", "turbIndex", "absent"])


@register("flt9_sentinel", _O('SELECT report, CASE WHEN "turbIndex" <= 20 THEN "turbIndex" END AS "turbIndex" FROM obs'))
def _sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("report", filters.sentinel_to_null(c("turbIndex")).alias("turbIndex"))


@register("flt17_joined_key", _O("SELECT report, flag || '_' || error AS key FROM obs"))
def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("report", filters.joined_key("flag", "error").alias("key"))


@register("agg7_observed_distribution", _O('SELECT round(avg(ln("maxEDR")), 6) AS mean, round(var_pop(ln("maxEDR")), 6) AS variance FROM obs WHERE "maxEDR" > 0'))
def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.observed_distribution(observed(spark, sf_dir)).select(r(c("mean"), 6).alias("mean"), r(c("variance"), 6).alias("variance"))


@register("agg11_frequency", _O('SELECT count("maxEDR") AS n, count_if("maxEDR" > 0.3)::BIGINT AS turbulent, count_if("maxEDR" > 0.3)::DOUBLE / count("maxEDR") AS share FROM obs'))
def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.frequency(observed(spark, sf_dir), "maxEDR", 0.3)


# joins ---------------------------------------------------------------------------------------------------------------
_BOXES = "boxes AS (SELECT (x * 14 + y)::INT AS index_right, -90 + x * 10.0::DOUBLE AS min_x, -66 + y * (132 / 14.0::DOUBLE) AS min_y, -90 + (x + 1) * 10.0::DOUBLE AS max_x, -66 + (y + 1) * (132 / 14.0::DOUBLE) AS max_y FROM range(17) a(x) CROSS JOIN range(14) b(y))"
_LEVEL = "lev AS (SELECT o.*, arg_min(l.p, abs(o.altitude - l.z)) AS level, arg_min(l.i, abs(o.altitude - l.z))::INT AS level_index FROM obs o CROSS JOIN (VALUES (0, 175.0::DOUBLE, 13500.0::DOUBLE), (1, 200.0, 12120.0), (2, 225.0, 10780.0), (3, 250.0, 9480.0), (4, 300.0, 8220.0), (5, 350.0, 7000.0)) l(i, p, z) GROUP BY ALL)"
_ALTITUDES = [13500.0, 12120.0, 10780.0, 9480.0, 8220.0, 7000.0]
_LEVELS = [175.0, 200.0, 225.0, 250.0, 300.0, 350.0]
_INDEXED = """idx AS (SELECT b.index_right, l.*, round_even((l.latitude + 66) / 12, 0)::INT AS lat_index, round_even((l.longitude + 90) / 10, 0)::INT AS lon_index,
  arg_min(t.i, abs(l.second - 1704067200 - t.i * 21600) * 10 + t.i)::INT AS time_index
  FROM lev l JOIN boxes b ON l.longitude BETWEEN min_x AND max_x AND l.latitude BETWEEN min_y AND max_y CROSS JOIN range(4) t(i) WHERE l.altitude >= 8500 GROUP BY ALL)"""
_GATHER = [
    *diagnosed(*NAMES), _BOXES, _LEVEL, _INDEXED,
    "num AS (SELECT d.*, ((hour - 473352) // 6)::INT AS time_index, (dense_rank() OVER (ORDER BY pressure_level) - 1)::INT AS level_index, ((latitude + 66) / 12)::INT AS lat_index, ((longitude + 90) / 10)::INT AS lon_index FROM diag d)",
    "gat AS (SELECT idx.*, num.wind_speed, num.ti1 FROM idx LEFT JOIN num USING (level_index, lat_index, lon_index, time_index))",
]


@register("jon1_spatial_join", _O("SELECT report, index_right FROM obs JOIN boxes ON longitude BETWEEN min_x AND max_x AND latitude BETWEEN min_y AND max_y", [_BOXES]))
def _spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.spatial_join(observed(spark, sf_dir), DOMAIN, STEP).select("report", "index_right")


@register("jon2_boxes", _O(f"""SELECT (x * ny + y)::INT AS index_right, {q('x0 + x * (x1 - x0) / nx', 6)} AS min_x, {q('y0 + y * (y1 - y0) / ny', 6)} AS min_y, {q('x0 + (x + 1) * (x1 - x0) / nx', 6)} AS max_x, {q('y0 + (y + 1) * (y1 - y0) / ny', 6)} AS max_y FROM (
  SELECT *, unnest(range(nx)) AS x FROM (SELECT *, ceil((x1 - x0) / 7.5)::BIGINT AS nx, ceil((y1 - y0) / 7.5)::BIGINT AS ny FROM (
  SELECT floor(min(longitude))::DOUBLE AS x0, ceil(max(longitude))::DOUBLE AS x1, floor(min(latitude))::DOUBLE AS y0, ceil(max(latitude))::DOUBLE AS y1 FROM obs))), LATERAL (SELECT unnest(range(ny)) AS y)"""))
def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over all that the reports reach."""
    x0, x1, y0, y1 = observed(spark, sf_dir).agg(F.floor(F.min("longitude")), F.ceil(F.max("longitude")), F.floor(F.min("latitude")), F.ceil(F.max("latitude"))).first()
    domain = Domain(Limits(float(x0), float(x1)), Limits(float(y0), float(y1)))
    return observe.boxes(spark, domain, 7.5).select("index_right", *(r(c(x), 6).alias(x) for x in ("min_x", "min_y", "max_x", "max_y")))


_H = "pow(sin(radians(40.64::DOUBLE - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40.64::DOUBLE)) * pow(sin(radians(-73.78::DOUBLE - longitude) / 2), 2)"
_WAY = f"""way AS (SELECT report, i, sin((1 - t) * w) / sin(w) AS wa, sin(t * w) / sin(w) AS wb, radians(latitude) AS a, radians(longitude) AS b, radians(40.64::DOUBLE) AS d, radians(-73.78::DOUBLE) AS e
  FROM (SELECT report, latitude, longitude, 2 * asin(sqrt({_H})) AS w FROM obs) CROSS JOIN (SELECT i::INT AS i, i / 4.0::DOUBLE AS t FROM range(5) s(i))),
xyz AS (SELECT report, i, wa * cos(a) * cos(b) + wb * cos(d) * cos(e) AS x, wa * cos(a) * sin(b) + wb * cos(d) * sin(e) AS y, wa * sin(a) + wb * sin(d) AS z FROM way)"""


@register("sca29_waypoints", _O(f"SELECT report, i, {q('degrees(atan2(z, sqrt(x * x + y * y)))', 6)} AS latitude, {q('degrees(atan2(y, x))', 6)} AS longitude FROM xyz", [_WAY]))
def _waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points on the way from every report to one place."""
    routes = observed(spark, sf_dir).select("report", "latitude", "longitude", F.lit(40.64).alias("to_latitude"), F.lit(-73.78).alias("to_longitude"))
    made = geodesy.route_waypoints(routes, "latitude", "longitude", "to_latitude", "to_longitude", 5)
    return made.select("report", "i", r(c("way_latitude"), 6).alias("latitude"), r(c("way_longitude"), 6).alias("longitude"))


#: A triangle that narrows upwards meets a box if it does so at the box's lower side.
_TRIANGLE = "polygon AS (SELECT (row_number() OVER (ORDER BY i, j) - 1)::INT AS index_right, 2.5 * i AS min_x, 2.5 * j AS min_y, 2.5 * (i + 1) AS max_x, 2.5 * (j + 1) AS max_y FROM range(8) a(i), range(8) b(j) WHERE 2.5 * (i + 1) >= 2.5 * j / 2 AND 2.5 * i <= 20 - 2.5 * j / 2)"


@register("jon3_polygon_boxes", _O("SELECT index_right, count(*) AS reports FROM obs JOIN polygon ON longitude BETWEEN min_x AND max_x AND latitude BETWEEN min_y AND max_y GROUP BY index_right", [_TRIANGLE]))
def _polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = observe.polygon_boxes(spark, [(0.0, 0.0), (20.0, 0.0), (10.0, 20.0)], 2.5)
    return observe.join_boxes(observed(spark, sf_dir), grid).groupBy("index_right").agg(F.count("*").alias("reports"))


@register("jon4_nearest_level", _O("SELECT report, level FROM lev", [_LEVEL]))
def _level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("report", observe.nearest_level(c("altitude"), _LEVELS, _ALTITUDES).alias("level"))


@register("jon5_nearest_index", _O("SELECT report, arg_min(i, abs(altitude - z) * 100 + i)::INT AS level_index FROM obs CROSS JOIN (VALUES (0, 13000), (1, 11000), (2, 9000), (3, 8000)) l(i, z) GROUP BY report"))
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("report", observe.nearest_index(c("altitude"), [13000.0, 11000.0, 9000.0, 8000.0]).alias("level_index"))


@register("jon6_regular_index", _O("SELECT report, round_even((latitude + 66) / 12, 0)::INT AS lat_index, round_even((longitude + 90) / 10, 0)::INT AS lon_index FROM obs"))
def _regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("report", observe.regular_index(c(LAT), -66.0, 12.0, 12).alias("lat_index"), observe.regular_index(c(LON), -90.0, 10.0, 18).alias("lon_index"))


@register("jon7_value_at", _O("SELECT report, -66.0::DOUBLE + 12 * round_even((latitude + 66) / 12, 0) AS grid_latitude FROM obs"))
def _value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = observe.regular_index(c(LAT), -66.0, 12.0, 12)
    return observed(spark, sf_dir).select("report", observe.value_at(index, [-66.0 + 12 * i for i in range(12)]).alias("grid_latitude"))


def _harmonised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return launch.harmonise(lattice(spark, sf_dir), observed(spark, sf_dir), NAMES, DOMAIN, STEP, _ALTITUDES, deal=None)


@register("jon8_13_grid_indices", _O("SELECT report, index_right, level_index, lat_index, lon_index, time_index FROM idx", [_BOXES, _LEVEL, _INDEXED]))
def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = observe.Axes(lattice(spark, sf_dir))
    held = observed(spark, sf_dir).withColumn("level", observe.nearest_level(c("altitude"), _LEVELS, _ALTITUDES))
    made = axes.indices(filters.quality_control(observe.spatial_join(held, DOMAIN, STEP)))
    return made.select("report", "index_right", "level_index", "lat_index", "lon_index", "time_index")


@register("jon9_flat_index", tables(f"SELECT {_key}, ((((latitude + 66) / 12 * 18 + (longitude + 90) / 10) * (SELECT count(DISTINCT hour) FROM grid) + (hour - 473352) // 6) * 6 + dense_rank() OVER (ORDER BY pressure_level) - 1)::INT AS flat FROM grid"))
def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lattice(spark, sf_dir)
    axes = observe.Axes(grid)
    return keyed(axes.number(grid), axes.flat().alias("flat"))


@register("jon10_gather", _O("SELECT report, index_right, round(wind_speed, 6) AS wind_speed, round(ti1 * 1e14, 3) AS ti1 FROM gat", _GATHER, True))
def _gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonised(spark, sf_dir).select("report", "index_right", r(c("wind_speed"), 6).alias("wind_speed"), r(c("ti1") * 1e14, 3).alias("ti1"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lattice(spark, sf_dir)
    return observe.Axes(grid).number(grid)


_CELLS = "SELECT hour, pressure_level, n.latitude, n.longitude, {what} FROM num n LEFT JOIN (SELECT level_index, lat_index, lon_index, time_index, bool_or(\"maxEDR\" > 0.3) AS hit FROM idx GROUP BY ALL) USING (level_index, lat_index, lon_index, time_index)"


@register("jon11_observed_cells", _O(_CELLS.format(what="hit IS NOT NULL AS observed"), _GATHER[:-1], True))
def _observed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(observe.observed_cells(_numbered(spark, sf_dir), _harmonised(spark, sf_dir)), "observed")


@register("jon12_positive_cells", _O(_CELLS.format(what="coalesce(hit, false) AS positive"), _GATHER[:-1], True))
def _positive_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(observe.positive_cells(_numbered(spark, sf_dir), _harmonised(spark, sf_dir), CONDITION), "positive")


@register("agg20_jon14_aggregate_by_box", _O(f"SELECT index_right, {q('min_x', 6)} AS min_x, reports, edr FROM boxes JOIN (SELECT index_right, count(*) AS reports, max(\"maxEDR\") AS edr FROM idx GROUP BY 1) USING (index_right)", [_BOXES, _LEVEL, _INDEXED]))
def _by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = observe.aggregate_by_box(observe.boxes(spark, DOMAIN, STEP), _harmonised(spark, sf_dir), [F.count("*").alias("reports"), F.max("maxEDR").alias("edr")])
    return made.select("index_right", r(c("min_x"), 6).alias("min_x"), "reports", "edr")


@register("jon14_on_grid", _O(f"SELECT index_right, {q('min_x', 6)} AS min_x, n FROM (SELECT index_right, count(*) AS n FROM idx GROUP BY 1) LEFT JOIN boxes USING (index_right)", [_BOXES, _LEVEL, _INDEXED]))
def _on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _harmonised(spark, sf_dir).groupBy("index_right").agg(F.count("*").alias("n"))
    return observe.on_grid(observe.boxes(spark, DOMAIN, STEP), per).select("index_right", r(c("min_x"), 6).alias("min_x"), "n")


@register("agg21_any_in_group", _O('SELECT level_index, lat_index, lon_index, time_index, bool_or("maxEDR" > 0.3) AS hit FROM idx GROUP BY ALL', [_BOXES, _LEVEL, _INDEXED]))
def _any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonised(spark, sf_dir).groupBy("level_index", "lat_index", "lon_index", "time_index").agg(F.bool_or(c("maxEDR") > 0.3).alias("hit"))


for _strategy in GroupBy:
    _cols = ", ".join(_strategy.keys)

    def _counts(spark: SparkSession, sf_dir: str, strategy: GroupBy = _strategy) -> DataFrame:
        return observe.observation_counts(_harmonised(spark, sf_dir), "maxEDR", strategy)

    register(f"agg22_23_counts_{_strategy}", _O(f'SELECT {_cols}, count("maxEDR") AS num_obs FROM idx GROUP BY {_cols}', [_BOXES, _LEVEL, _INDEXED]))(_counts)

# grouped skill -------------------------------------------------------------------------------------------------------
_ROWS = """pts AS (SELECT index_right, level_index, ti1, report, "maxEDR" > 0.3 AS t, sum(("maxEDR" > 0.3)::INT) OVER w AS tp, row_number() OVER w AS i, sum(("maxEDR" > 0.3)::INT) OVER g AS p, count(*) OVER g AS n
  FROM gat WINDOW w AS (PARTITION BY index_right, level_index ORDER BY ti1 DESC, report ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY index_right, level_index)),
rates AS (SELECT *, tp / nullif(p, 0)::DOUBLE AS tpr, CASE WHEN n = p THEN 0.0 ELSE (i - tp) / (n - p)::DOUBLE END AS fpr FROM pts)"""
_AUC_PARTS = "parts AS (SELECT *, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM rates WINDOW w AS (PARTITION BY index_right, level_index ORDER BY i))"
_STEPS_SQL = "steps AS (SELECT *, fpr - lag(fpr, 1) OVER w AS e, lag(fpr, 1) OVER w - lag(fpr, 2) OVER w AS d, lag(tpr, 1) OVER w AS y1, lag(tpr, 2) OVER w AS y2 FROM rates WINDOW w AS (PARTITION BY index_right, level_index ORDER BY i))"
#: d and e are the last two steps up to a row, so a parabola is added by its third point here.
_SIMPSON_PARTS = """simp AS (SELECT *, CASE
    WHEN i % 2 = 1 AND i > 2 THEN CASE WHEN d = 0 OR e = 0 THEN d * (y2 + y1) / 2 + e * (y1 + tpr) / 2 ELSE (d + e) / 6 * ((2 - e / d) * y2 + (d + e) * (d + e) / (d * e) * y1 + (2 - d / e) * tpr) END
    WHEN i = n AND n % 2 = 0 THEN CASE WHEN n = 2 OR d = 0 OR e = 0 THEN e * (y1 + tpr) / 2 ELSE tpr * (2 * e * e + 3 * d * e) / (6 * (d + e)) + y1 * (e * e + 3 * d * e) / (6 * d) - y2 * e * e * e / (6 * d * (d + e)) END
  END AS a FROM steps)"""
_GROUPED = "SELECT index_right, level_index, round(CASE WHEN count(*) < 5 THEN NULL WHEN max(p) < 2 THEN -1 ELSE {value} END, 6) AS value, count(*) AS n FROM {source} GROUP BY ALL"


def _grouped(spark: SparkSession, sf_dir: str, metric: GroupMetric, **more) -> DataFrame:
    held = _harmonised(spark, sf_dir).withColumn("t", c("maxEDR") > 0.3)
    made = metrics.grouped(held, "t", "ti1", ["index_right", "level_index"], metric, 5, tie=["report"], **more)
    return made.withColumn("value", r(c("value"), 6))


@register("agg24_prevalence", _O("SELECT index_right, level_index, round(CASE WHEN count(*) >= 5 THEN avg(t::INT) END, 6) AS value, count(*) AS n FROM rates GROUP BY ALL", [*_GATHER, _ROWS], True))
def _prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, GroupMetric.PREVALENCE)


@register("agg25_true_skill", _O(_GROUPED.format(value="max(tpr - fpr)", source="rates"), [*_GATHER, _ROWS], True))
def _skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, GroupMetric.TSS)


@register("agg25_true_skill_compat", _O(_GROUPED.format(value="max(tpr + fpr - 1)", source="rates"), [*_GATHER, _ROWS], True))
def _skill_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, GroupMetric.TSS, compat=True)


@register("agg26_area_trapezoid", _O(_GROUPED.format(value="coalesce(sum(a), 0)", source="parts"), [*_GATHER, _ROWS, _AUC_PARTS], True))
def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, GroupMetric.AUC)


@register("agg26_area_simpson", _O(_GROUPED.format(value="coalesce(sum(a), 0)", source="simp"), [*_GATHER, _ROWS, _STEPS_SQL, _SIMPSON_PARTS], True))
def _simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, GroupMetric.AUC, simpson=True)


@register("agg27_skill_map", _O(f"SELECT index_right, level_index, CASE WHEN value >= 0 THEN value END AS ti1 FROM ({_GROUPED.format(value='coalesce(sum(a), 0)', source='parts')}) WHERE value IS NOT NULL", [*_GATHER, _ROWS, _AUC_PARTS], True))
def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.skill_map(_harmonised(spark, sf_dir), "maxEDR", 0.3, ["ti1"], ["index_right", "level_index"], 5, tie=["report"])
    return made.withColumn("ti1", r(c("ti1"), 6))


_COUNTS = 'cnt AS (SELECT index_right, count("maxEDR") AS num_obs FROM idx GROUP BY 1)'


@register("agg28_enough_observations", _O("SELECT report, idx.index_right FROM idx JOIN cnt USING (index_right) WHERE num_obs >= (SELECT quantile_disc(num_obs, 0.25) FROM cnt)", [_BOXES, _LEVEL, _INDEXED, _COUNTS]))
def _enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _harmonised(spark, sf_dir)
    counts = observe.observation_counts(held, "maxEDR", GroupBy.HORIZONTAL_BOX)
    return observe.enough_observations(held, counts, ["index_right"]).select("report", "index_right")


@register("agg29_count_histogram", _O("SELECT least(floor((num_obs - lo) / w), 99)::INT AS bin, count(*) AS held FROM (SELECT *, greatest((hi - lo) / 100.0::DOUBLE, 1e-12) AS w FROM cnt, (SELECT min(num_obs) AS lo, max(num_obs) AS hi FROM cnt)) GROUP BY 1", [_BOXES, _LEVEL, _INDEXED, _COUNTS]))
def _count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.count_histogram(observe.observation_counts(_harmonised(spark, sf_dir), "maxEDR", GroupBy.HORIZONTAL_BOX)).select("bin", "held")


# curves and scores over the order lines, where scores and labels are all that is needed -------------------------------
_LINES = "lines AS (SELECT l_quantity AS s, l_discount > 0.05 AS t, l_quantity > 30 AS x, l_returnflag AS g, l_tax FROM lineitem)"
_CURVE = "SELECT {k}s AS threshold, sum(sum(t::INT)) OVER ({p}ORDER BY s DESC)::BIGINT AS tp, sum(sum((NOT t)::INT)) OVER ({p}ORDER BY s DESC)::BIGINT AS fp FROM lines GROUP BY {k}s"
_CURVE_ALL, _CURVE_G = _CURVE.format(k="", p=""), _CURVE.format(k="g, ", p="PARTITION BY g ")
_ROC = "roc AS (SELECT threshold, fp / (SELECT max(fp) FROM cur)::DOUBLE AS fpr, tp / (SELECT max(tp) FROM cur)::DOUBLE AS tpr FROM cur UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0)"
_L = lambda sql, more=None: tables(sql, grid=False, more=[_LINES, *(more or [])])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(c("l_quantity").alias("s"), (c("l_discount") > 0.05).alias("t"), (c("l_quantity") > 30).alias("x"), c("l_returnflag").alias("g"), "l_tax")


@register("met1_win15_curve", _L(_CURVE_ALL))
def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve(_lines(spark, sf_dir), "t", "s")


@register("met1_curve_by_group", _L(_CURVE_G))
def _curve_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve(_lines(spark, sf_dir), "t", "s", ["g"], spread=True)


@register("met1_win16_curve_steps", _L("SELECT threshold, tp, fp FROM (SELECT *, lead(threshold) OVER (ORDER BY threshold DESC) AS after, (max(threshold) OVER () - min(threshold) OVER ()) / 20 AS step FROM cur) WHERE after IS NULL OR threshold - after > step", [f"cur AS ({_CURVE_ALL})"]))
def _curve_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve(_lines(spark, sf_dir), "t", "s", intervals=20)


@register("met2_roc", _L("SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc", [f"cur AS ({_CURVE_ALL})", _ROC]))
def _roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.roc(metrics.curve(_lines(spark, sf_dir), "t", "s"))
    return made.select("threshold", r(c("fpr"), 9).alias("fpr"), r(c("tpr"), 9).alias("tpr"))


@register("met3_grouped_rates", _L("SELECT g, threshold, round(tp / p::DOUBLE, 9) AS tpr, round(CASE WHEN n = 0 THEN 0.0 ELSE fp / n::DOUBLE END, 9) AS fpr FROM (SELECT *, max(tp) OVER (PARTITION BY g) AS p, max(fp) OVER (PARTITION BY g) AS n FROM cur) WHERE p >= 2", [f"cur AS ({_CURVE_G})"]))
def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.grouped_curve(_lines(spark, sf_dir), "t", "s", ["g"])
    return made.select("g", "threshold", r(c("tpr"), 9).alias("tpr"), r(c("fpr"), 9).alias("fpr"))


@register("met4_22_area", _L("SELECT round(sum(a), 9) AS auc FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM roc WINDOW w AS (ORDER BY threshold DESC))", [f"cur AS ({_CURVE_ALL})", _ROC]))
def _auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.area(metrics.roc(metrics.curve(_lines(spark, sf_dir), "t", "s"))).select(r(c("auc"), 9).alias("auc"))


@register("met5_mean_absolute_error", _L("SELECT round(avg(abs(s - l_tax)), 6) AS mae FROM lines"))
def _mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_absolute_error(_lines(spark, sf_dir), "s", "l_tax").select(r(c("mae"), 6).alias("mae"))


_CONF = "conf AS (SELECT g, count_if(NOT t AND NOT x)::BIGINT AS tn, count_if(NOT t AND x)::BIGINT AS fp, count_if(t AND NOT x)::BIGINT AS fn, count_if(t AND x)::BIGINT AS tp FROM lines GROUP BY g)"


@register("agg13_confusion", _L("SELECT * FROM conf", [_CONF]))
def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_lines(spark, sf_dir), "t", "x", ["g"])


_SCORES = {
    "matthews": (metrics.matthews, "(tp::DOUBLE * tn - fp::DOUBLE * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))"),
    "critical_success": (metrics.critical_success, "tp / (tp + fn + fp)::DOUBLE"),
    "gilbert": (metrics.gilbert, "(tp - (tp + fp)::DOUBLE * (tp + fn) / (tp + tn + fp + fn)) / (tp + fp + fn - (tp + fp)::DOUBLE * (tp + fn) / (tp + tn + fp + fn))"),
    "accuracy": (metrics.accuracy, "(tp + tn) / (tp + tn + fp + fn)::DOUBLE"),
    "f1": (metrics.f1, "2 * tp / (2 * tp + fp + fn)::DOUBLE"),
    "sensitivity": (metrics.sensitivity, "tp / (tp + fn)::DOUBLE"),
    "specificity": (metrics.specificity, "tn / (tn + fp)::DOUBLE"),
    "true_skill": (metrics.true_skill, "tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE - 1"),
}


@register("met6_8_10_14_scores", _L("SELECT g, " + ", ".join(f"{q(s, 8)} AS {n}" for n, (_, s) in _SCORES.items()) + " FROM conf", [_CONF]))
def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.confusion(_lines(spark, sf_dir), "t", "x", ["g"])
    return made.select("g", *(r(f(), 8).alias(n) for n, (f, _) in _SCORES.items()))


_TABLE = "tab AS (SELECT g, tp::DOUBLE AS n11, fn::DOUBLE AS n10, fp::DOUBLE AS n01, tn::DOUBLE AS n00 FROM conf)"


@register("met7_9_15_16_table_scores", _L(f"""SELECT g, {q("((n11 + n10 + n01 + n00) * n11 - (n11 + n10) * (n11 + n01)) / (sqrt(n11 + n10) * sqrt(n01 + n00) * sqrt(n11 + n01) * sqrt(n10 + n00))", 8)} AS matthews, round(n11 / (n11 + n10 + n01), 8) AS jaccard,
  {q("ln(n00 * n11 / (n01 * n10))", 8)} AS log_odds, round(n00 * n11 / (n01 * n10), 8) AS odds, {q("ln(n11 / n01 * ((n01 + n00) / (n11 + n10)))", 8)} AS log_risk, round(n11 / n01 * ((n01 + n00) / (n11 + n10)), 8) AS risk FROM tab""", [_CONF, _TABLE]))
def _table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.contingency(_lines(spark, sf_dir), "t", "x", ["g"])
    columns = {"matthews": metrics.matthews_table(), "jaccard": metrics.jaccard(), "log_odds": metrics.odds_ratio(), "odds": metrics.odds_ratio(False), "log_risk": metrics.relative_risk(), "risk": metrics.relative_risk(False)}
    return made.select("g", *(r(x, 8).alias(n) for n, x in columns.items()))


_NEAREST = """cells AS (SELECT level_index, lat_index, lon_index, time_index, bool_or("maxEDR" > 0.3) AS t, avg(wind_speed) AS wind_speed, avg(ti1) AS ti1 FROM gat GROUP BY ALL),
long AS (SELECT 'wind_speed' AS diagnostic, wind_speed AS s, t FROM cells UNION ALL SELECT 'ti1', ti1, t FROM cells),
cur AS (SELECT diagnostic, s, sum(sum(t::INT)) OVER (PARTITION BY diagnostic ORDER BY s DESC) AS tp, sum(sum((NOT t)::INT)) OVER (PARTITION BY diagnostic ORDER BY s DESC) AS fp FROM long WHERE s IS NOT NULL GROUP BY diagnostic, s),
roc AS (SELECT diagnostic, s, tp / max(tp) OVER (PARTITION BY diagnostic) AS tpr, fp / max(fp) OVER (PARTITION BY diagnostic) AS fpr FROM cur UNION ALL SELECT DISTINCT diagnostic, 'Infinity'::DOUBLE, 0, 0 FROM cur)"""


@register("met21_nearest_value_roc", _O("SELECT 'maxEDR' AS \"column\", diagnostic, count(*) AS points, round(sum(a), 4) AS auc FROM (SELECT diagnostic, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM roc WINDOW w AS (PARTITION BY diagnostic ORDER BY s DESC)) GROUP BY diagnostic", [*_GATHER, _NEAREST], True))
def _nearest_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = observe.nearest_value_roc(_harmonised(spark, sf_dir), [CONDITION], NAMES)
    keys = ["column", "diagnostic"]
    return metrics.area(curve, keys).select(*keys, "points", r(c("auc"), 4).alias("auc"))


# sinks: written, read again ------------------------------------------------------------------------------------------
@register("snk1_reports_round_trip", _O("SELECT report, flag, error FROM obs WHERE flag IN ('Z', 'C', 'S', 'V', 'G') AND error IN (112, 45) AND \"turbIndex\" <= 20"))
def _reports_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    raw = observed(spark, sf_dir).withColumn("turbIndex", filters.sentinel_to_null(c("turbIndex")))
    writers.write_reports(writers.preprocess_reports(raw, ["flag"], ["error"], ["turbIndex"]), path)
    return spark.read.parquet(path).select("report", "flag", "error")


@register("snk2_src5_diagnostics_round_trip", tables(f"SELECT {_key}, round(wind_speed, 6) AS wind_speed FROM diag", more=diagnosed("wind_speed")))
def _diagnostics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolith.operators import diagnostics

    path = files.scratch(spark)
    writers.write_diagnostics(diagnostics.diagnose(lattice(spark, sf_dir), ["wind_speed", "brown1"], deal=None), path)
    return keyed(readers.read_diagnostics(spark, path, ["wind_speed"]), r(c("wind_speed"), 6).alias("wind_speed"))


@register("snk5_correlation_round_trip", tables("SELECT pressure_level, a.n AS diagnostic1, b.n AS diagnostic2, round(CASE WHEN a.n = b.n THEN 1.0 ELSE m END, 6) AS corr FROM (SELECT pressure_level, corr((eastward_wind > 30)::INT, (northward_wind > 8)::INT) AS m FROM grid GROUP BY 1), (VALUES ('x'), ('y')) a(n), (VALUES ('x'), ('y')) b(n)"))
def _correlation_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    masks = lattice(spark, sf_dir).select(LEVEL, (c("eastward_wind") > 30).alias("x"), (c("northward_wind") > 8).alias("y"))
    writers.write_correlation(calibrate.matthews_correlation(masks, ["x", "y"], [LEVEL]), path, by_level=True)
    return spark.read.parquet(path).select(c(LEVEL).cast("double").alias(LEVEL), "diagnostic1", "diagnostic2", r(c("corr"), 6).alias("corr"))


@register("snk6_repartition", _O("SELECT report FROM obs"))
def _repartition_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    observed(spark, sf_dir).select("report").write.parquet(path)
    writers.repartition_files(spark, path, f"{path}-parts", 3)
    return spark.read.parquet(f"{path}-parts/{path.rsplit('/', 1)[-1]}")


@register("snk7_harmonised_round_trip", _O("SELECT report, index_right, level_index FROM gat", _GATHER, True))
def _harmonised_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    writers.write_harmonised(_harmonised(spark, sf_dir), path)
    return spark.read.parquet(path).select("report", "index_right", "level_index")


@register("src1_grid_scan", tables(f"SELECT {_key}, temperature FROM grid"))
def _grid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    lattice(spark, sf_dir).withColumn("date", F.to_date("time")).write.partitionBy("date").parquet(path)
    return keyed(readers.read_grid(spark, path, columns=["time", LEVEL, LAT, LON, "temperature"]), "temperature")


@register("src1_netcdf_scan", tables(f"SELECT {_key}, altitude, temperature, vorticity FROM grid WHERE pressure_level <= 250"))
def _netcdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark)
    grid = lattice(spark, sf_dir).withColumn("day", F.date_format("time", "yyyy-MM-dd-HH"))
    netcdf.write_netcdf(grid, path, CELL, ["altitude", "temperature", "vorticity"], "day")
    read = netcdf.read_netcdf(spark, path, ["altitude", "temperature", "vorticity"], rows=1000)
    return keyed(read.where(c(LEVEL) <= 250), "altitude", "temperature", "vorticity")


@register("snk2_src5_zarr_round_trip", tables(f"SELECT {_key}, round(wind_speed, 6) AS wind_speed FROM diag", more=diagnosed("wind_speed")))
def _zarr_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolith.operators import diagnostics

    path = files.scratch(spark)
    zarr.write_zarr(diagnostics.diagnose(lattice(spark, sf_dir), ["wind_speed", "brown1"], deal=None), path, ["wind_speed", "brown1"], {LEVEL: 4, LON: 7})
    return keyed(zarr.read_zarr(spark, path, ["wind_speed"]), r(c("wind_speed"), 6).alias("wind_speed"))


_UNEVEN = """axis AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT second // 60 * 60 + second // 60 % 5 * 7 AS x FROM obs)),
near AS (SELECT o.report, a.i, row_number() OVER (PARTITION BY o.report ORDER BY abs(o.second - a.x), a.i) AS k FROM obs o JOIN axis a ON a.x BETWEEN o.second - 25 AND o.second + 25)"""


@register("jon13_uneven_times", _O("SELECT o.report, CAST(coalesce(n.i, -1) AS INT) AS time_index FROM obs o LEFT JOIN near n ON n.report = o.report AND n.k = 1", [_UNEVEN]))
def _uneven_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports at the nearest, within 25 seconds, of the uneven times that their minutes give; -1 for none."""
    reports = observed(spark, sf_dir).withColumn("second", F.unix_seconds(c("datetime").cast("timestamp")))
    minute = F.floor(c("second") / 60)
    axis = observe.numbered_axis(reports.select((minute * 60 + minute % 5 * 7).alias("x")))
    held = observe.nearest_joined(reports, c("second"), axis, 25, "time_index")
    return held.select("report", F.coalesce("time_index", F.lit(-1)).alias("time_index"))


def _hot(spark: SparkSession, sf_dir: str, metric: GroupMetric, **more) -> DataFrame:
    """_grouped in ranges of scores for groups of 20 reports or more, from a written table."""
    held = files.written(_harmonised(spark, sf_dir).withColumn("t", c("maxEDR") > 0.3).select("index_right", "level_index", "report", "t", "ti1"))
    made = metrics.grouped(held, "t", "ti1", ["index_right", "level_index"], metric, 5, tie=["report"], hot=20, **more)
    return made.withColumn("value", r(c("value"), 6))


@register("agg25_skill_hot_groups", _O(_GROUPED.format(value="max(tpr - fpr)", source="rates"), [*_GATHER, _ROWS], True))
def _skill_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir, GroupMetric.TSS)


@register("agg26_simpson_hot_groups", _O(_GROUPED.format(value="coalesce(sum(a), 0)", source="simp"), [*_GATHER, _ROWS, _STEPS_SQL, _SIMPSON_PARTS], True))
def _simpson_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir, GroupMetric.AUC, simpson=True)
