"""Thresholds, distributions, severities, probabilities and correlations of diagnostics, one aggregation for all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import physics
from aerolith.operators import filters, moments
from aerolith.operators.filters import Thresholds
from aerolith.schema import LAT, LEVEL, LON, TIME, Severity, ThresholdMode, require

#: fixed values: observed dissipation rates from which turbulence counts as of a severity, and bins of a histogram
EDR_LIGHT, EDR_MODERATE, EDR_SEVERE = 0.1, 0.2, 0.45
BINS = 50

REDUCTIONS = ("all", "any", "argmax", "argmin", "count", "idxmax", "idxmin", "max", "min", "mean", "median", "prod", "sum", "std", "var", "cumsum", "cumprod")


def across_columns(df: DataFrame, columns: list[str], method: str, name: str, append: bool = True, skip_missing: bool = True) -> DataFrame:
    """Reduces columns row by row into one. Nulls are skipped, or make the result null; cumsum and cumprod give arrays.

    argmax and argmin count columns from 0, idxmax and idxmin give names; std and var are those of the population.
    """
    if method not in REDUCTIONS:
        raise ValueError(f"no reduction {method}; there are {REDUCTIONS}")
    require(df, columns)
    held = F.array(*(F.col(c) for c in columns))
    some = F.filter(held, lambda x: x.isNotNull()) if skip_missing else held
    some_double = some.cast("array<double>") if method not in ("all", "any") else some
    n = F.size(some)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = physics.ratio(total(some_double), n.cast("double"))
    variance = physics.ratio(F.aggregate(some_double, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n.cast("double"))
    place = lambda best: F.array_position(held, best) - 1
    names = F.array(*map(F.lit, columns))
    middle = F.sort_array(some_double)
    half = (F.element_at(middle, F.greatest((n + 1).cast("int").bitwiseAND(-2) / 2, F.lit(1)).cast("int")) + F.element_at(middle, F.greatest((n + 2).cast("int").bitwiseAND(-2) / 2, F.lit(1)).cast("int"))) / 2
    running = lambda f, zero: F.transform(held, lambda _, i: F.aggregate(F.slice(held.cast("array<double>"), F.lit(1), i + 1), F.lit(zero), lambda a, x: f(a, F.coalesce(x, F.lit(zero)) if skip_missing else x)))
    made: dict[str, Column] = {
        "all": F.forall(some, lambda x: x.cast("boolean")), "any": F.exists(some, lambda x: x.cast("boolean")),
        "count": F.size(F.filter(held, lambda x: x.isNotNull())).cast("long"), "max": F.array_max(some), "min": F.array_min(some),
        "argmax": place(F.array_max(held)), "argmin": place(F.array_min(held)),
        "idxmax": F.try_element_at(names, (place(F.array_max(held)) + 1).cast("int")), "idxmin": F.try_element_at(names, (place(F.array_min(held)) + 1).cast("int")),
        "sum": total(some_double), "mean": mean, "prod": F.aggregate(some_double, F.lit(1.0), lambda x, y: x * y),
        "var": variance, "std": F.sqrt(variance), "median": F.when(n > 0, half),
        "cumsum": running(lambda a, x: a + x, 0.0), "cumprod": running(lambda a, x: a * x, 1.0),
    }
    out = made[method].alias(name)
    return df.select("*", out) if append else df.select(*(c for c in df.columns if c not in columns), out)


def percentile_thresholds(wide: DataFrame, names: list[str], percentiles: Thresholds, approximate: bool = False, accuracy: int = 10_000, spread: bool = True) -> DataFrame:
    """(diagnostic, light .. severe): values at the percentiles, null where a percentile is; all names together.

    approximate: by a bounded sketch. Else exact: a sketch says between which values a percentile lies, and a second pass
    ranks only those. It reads wide twice, so that should be kept or written then. spread=False reads it once, but holds
    all distinct values in one buffer, which is for small tables.
    """
    held = [(str(s), p / 100) for s, p in zip(Severity, percentiles.values(), strict=True) if p is not None]
    if any(not 0 <= p <= 1 for _, p in held):
        raise ValueError("percentiles lie in 0..100")
    if spread and not approximate and held:
        return _ranked(wide, names, held, accuracy)
    points = F.array(*(F.lit(p) for _, p in held))
    of = (lambda c: F.percentile_approx(c, points, accuracy)) if approximate else (lambda c: F.percentile(c, points))
    row = wide.agg(*(of(F.col(n)).alias(n) for n in names))
    long = row.unpivot([], names, "diagnostic", "v")
    return long.select("diagnostic", *_by_severity({s: F.col("v")[i] for i, (s, _) in enumerate(held)}))


def _by_severity(value: dict[str, Column]) -> list[Column]:
    return [value.get(str(s), F.lit(None).cast("double")).alias(str(s)) for s in Severity]


def _ranked(wide: DataFrame, names: list[str], held: list[tuple[str, float]], accuracy: int) -> DataFrame:
    """percentile_thresholds in two scans of the wide table, no row of which is multiplied.

    The first makes a sketch of each column, which says between which values a percentile lies. The second counts: values
    under a percentile's range as one, values in it by value, column by column of each batch.
    """
    wide = wide.select(*(F.col(n).cast("double").alias(n) for n in names))
    edges, total = _brackets(wide, names, [p for _, p in held], accuracy)
    counts = wide.mapInArrow(_bracketed(names, edges), "diagnostic string, k int, v double, n long").groupBy("diagnostic", "k", "v").agg(F.sum("n").alias("n"))
    sizes = wide.sparkSession.createDataFrame(list(total.items()), "diagnostic string, `all` long")  # a row a name
    counts = counts.join(F.broadcast(sizes), "diagnostic")
    upto = Window.partitionBy("diagnostic", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.element_at(F.array(*(F.lit(p) for _, p in held)), F.col("k") + 1) * (F.col("all") - 1)
    summed = counts.withColumns({"upto": F.sum("n").over(upto), "place": place})
    at = lambda rank: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > rank), F.col("v")))
    under = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
    found = summed.groupBy("diagnostic", "k", "place").agg(at(F.floor("place")).alias("below"), at(F.ceil("place")).alias("above"), under.alias("under"))
    part = F.col("place") - F.floor("place")
    between = F.when((part == 0) | (F.col("below") == F.col("above")), F.col("below")).otherwise((F.ceil("place") - F.col("place")) * F.col("below") + part * F.col("above"))
    sure = (F.col("under") <= F.floor("place")) & F.col("above").isNotNull()
    value = found.select("diagnostic", "k", F.when(sure, between).otherwise(F.raise_error(F.lit("a sketch erred by more than it may")).cast("double")).alias("v"))
    all_names = wide.sparkSession.createDataFrame([(n,) for n in names], "diagnostic string")
    wanted = {s: F.max(F.when(F.col("k") == i, F.col("v"))) for i, (s, _) in enumerate(held)}
    made = value.groupBy("diagnostic").agg(*(v.alias(s) for s, v in wanted.items()))
    return all_names.join(made, "diagnostic", "left").select("diagnostic", *_by_severity({s: F.col(s) for s in wanted}))


#: Values in a percentile's range that are ranked in one task; a wider range is narrowed first.
RANKED = 1 << 23


def _brackets(wide: DataFrame, names: list[str], shares: list[float], accuracy: int) -> tuple[dict[str, list[tuple[float, float]]], dict[str, int]]:
    """For each name (lowest, highest) value of each percentile's range, and how many values it has.

    A sketch's rank errs by a share of 1 / accuracy at most, and ranges reach three times as far. A range that holds more
    than RANKED values is sketched itself, in one more scan for all such ranges, until none is too wide or they no longer
    shrink, as where one value is met that often.
    """
    reach = 3 / accuracy
    points = [max(p - reach, 0.0) for p in shares] + [min(p + reach, 1.0) for p in shares]
    row = wide.agg(*(F.percentile_approx(n, points, accuracy).alias(f"e{i}") for i, n in enumerate(names)), *(F.count(n).alias(f"n{i}") for i, n in enumerate(names))).first()
    total = {n: row[f"n{i}"] for i, n in enumerate(names) if row[f"n{i}"]}
    edges = {n: list(zip(row[f"e{i}"][: len(shares)], row[f"e{i}"][len(shares) :])) for i, n in enumerate(names) if n in total}
    todo = {(n, k) for n, x in total.items() for k in range(len(shares)) if 2 * reach * x > RANKED}
    while todo:
        listed = sorted(todo)
        inside = lambda n, k: F.when(F.col(n).between(*edges[n][k]), F.col(n))
        counts = wide.agg(*(x for i, (n, k) in enumerate(listed) for x in (F.count(F.when(F.col(n) < edges[n][k][0], 1)).alias(f"u{i}"), F.count(inside(n, k)).alias(f"i{i}")))).first()
        asked = {}
        for i, (n, k) in enumerate(listed):
            rank, under, held = shares[k] * (total[n] - 1), counts[f"u{i}"], counts[f"i{i}"]
            if held > RANKED:
                asked[n, k] = [min(max((rank - under) / held + d, 0.0), 1.0) for d in (-reach, reach)]
        if not asked:
            break
        found = wide.agg(*(F.percentile_approx(inside(n, k), p, accuracy).alias(f"e{i}") for i, ((n, k), p) in enumerate(asked.items()))).first()
        todo = set()
        for i, (n, k) in enumerate(asked):
            new = tuple(found[f"e{i}"])
            if new != edges[n][k]:
                todo.add((n, k))
            edges[n][k] = new
    return edges, total


def _bracketed(names: list[str], edges: dict[str, list[tuple[float, float]]]):
    """Counts of a partition's values: (name, percentile, value, n), the value null for those under the range."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under: dict[tuple[str, int], int] = {}
        for batch in batches:
            out: list[tuple[str, int, np.ndarray, np.ndarray]] = []
            for i, n in enumerate(names):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False) if n in edges else np.zeros(0)
                for k, (low, high) in enumerate(edges.get(n, [])):
                    below = ~(x >= low) & ~np.isnan(x)  # nan is above all numbers, as in Spark's order
                    under[n, k] = under.get((n, k), 0) + int(below.sum())
                    values, times = np.unique(x[~below & (np.isnan(high) | (x <= high))], return_counts=True)
                    out.append((n, k, values, times))
            yield _counts(out)
        yield _counts([(n, k, np.zeros(1), np.array([x])) for (n, k), x in under.items()], True)

    def _counts(rows: list[tuple[str, int, np.ndarray, np.ndarray]], null: bool = False) -> pa.RecordBatch:
        sizes = np.array([len(v) for _, _, v, _ in rows], np.int64)
        values = np.concatenate([*(v for _, _, v, _ in rows), np.zeros(0)])
        columns = [pa.array(np.repeat(np.array([n for n, *_ in rows], object), sizes).tolist(), pa.string()), pa.array(np.repeat(np.array([k for _, k, *_ in rows], np.int32), sizes), pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64(), mask=np.full(len(values), null)), pa.array(np.concatenate([*(t for *_, t in rows), np.zeros(0, np.int64)]).astype(np.int64))], ["diagnostic", "k", "v", "n"])

    return counted


def distribution_parameters(long: DataFrame) -> DataFrame:
    """(diagnostic, mean, variance) of ln of the positive values; population variance."""
    ln = physics.log_of_positive(F.col("value"))
    return long.groupBy("diagnostic").agg(F.avg(ln).alias("mean"), F.var_pop(ln).alias("variance"))


def observed_distribution(observations: DataFrame, column: str = "maxEDR") -> DataFrame:
    ln = physics.log_of_positive(F.col(column))
    return observations.agg(F.avg(ln).alias("mean"), F.var_pop(ln).alias("variance"))


def log_histogram(long: DataFrame, bins: int = BINS) -> DataFrame:
    """(diagnostic, bin, lower, upper, density) of ln of the positive values: equal bins from least to largest, empty ones too."""
    logs = long.select("diagnostic", physics.log_of_positive(F.col("value")).alias("ln")).where("ln is not null")
    ends = logs.groupBy("diagnostic").agg(F.min("ln").alias("low"), F.max("ln").alias("high"), F.count("*").alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    # one row a diagnostic
    placed = logs.join(F.broadcast(ends), "diagnostic").select("diagnostic", F.least(F.floor(F.when(width > 0, (F.col("ln") - F.col("low")) / F.when(width > 0, width)).otherwise(0.0)), F.lit(bins - 1)).cast("int").alias("bin"))
    counted = placed.groupBy("diagnostic", "bin").agg(F.count("*").alias("held"))
    every = ends.select("diagnostic", "low", "n", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    density = physics.ratio(F.coalesce("held", F.lit(0)).cast("double"), F.col("n") * F.col("width"))
    return every.join(counted, ["diagnostic", "bin"], "left").select("diagnostic", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lower"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"), density.alias("density"))


def significant_bins(histogram: DataFrame, least: float = 1e-6) -> DataFrame:
    return histogram.where(F.col("density") >= least)


def histogram_structs(histogram: DataFrame, parameters: DataFrame) -> DataFrame:
    """(diagnostic, hist_values, bins, mean, variance), bins being the edges, one more than values."""
    rows = histogram.groupBy("diagnostic").agg(F.sort_array(F.collect_list(F.struct("bin", "lower", "upper", "density"))).alias("h"))
    return rows.join(parameters, "diagnostic").select("diagnostic", F.col("h.density").alias("hist_values"), F.concat(F.col("h.lower"), F.array(F.element_at("h", -1)["upper"])).alias("bins"), "mean", "variance")


def severity_bounds(thresholds: DataFrame, mode: ThresholdMode = ThresholdMode.BOUNDED) -> DataFrame:
    """(diagnostic, severity, rank, lower, upper) of the severities that have a threshold, from percentile_thresholds' rows.

    The last band of a diagnostic has no end. One row a severity and diagnostic.
    """
    names = [str(s) for s in Severity]
    long = thresholds.unpivot(["diagnostic"], names, "severity", "lower").where("lower is not null")
    long = long.withColumn("rank", F.array_position(F.array(*map(F.lit, names)), F.col("severity")).cast("int") - 1)
    if mode is ThresholdMode.GEQ:
        return long.select("diagnostic", "severity", "rank", "lower", F.lit(float("inf")).alias("upper"))
    from pyspark.sql import Window

    after = F.lead("lower").over(Window.partitionBy("diagnostic").orderBy("rank"))
    return long.select("diagnostic", "severity", "rank", "lower", F.coalesce(after, F.lit(float("inf"))).alias("upper"))


def by_severity(long: DataFrame, bounds: DataFrame) -> DataFrame:
    """long with a row for each severity: severity, turbulent. bounds: five rows a diagnostic at most, so it is broadcast."""
    joined = long.join(F.broadcast(bounds.select("diagnostic", "severity", "lower", "upper")), "diagnostic")
    return joined.withColumn("turbulent", F.coalesce((F.col("value") >= F.col("lower")) & (F.col("value") < F.col("upper")), F.lit(False))).drop("lower", "upper")


def turbulence_probabilities(wide: DataFrame, bounds: DataFrame, names: list[str], levels: list[float] | None = None) -> DataFrame:
    """(severity, level, lat, lon, a column for each name): percent of the grid's times at which the cell is turbulent.

    One sum a name and severity on the wide table, so a cell's time is one row to the exchange whatever their number. bounds:
    rows of severity_bounds, five a name at most; they are looked up at once and become numbers in the sums. A name without
    bounds for a severity is null there.
    """
    wide = wide if levels is None else wide.where(F.col(LEVEL).isin(levels))
    held = {(x.diagnostic, x.severity): (x.lower, x.upper) for x in bounds.select("diagnostic", "severity", "lower", "upper").collect()}
    kinds = [str(s) for s in Severity if any((n, str(s)) in held for n in names)]
    if not kinds:
        return wide.select(F.lit("").alias("severity"), LEVEL, LAT, LON, *(F.lit(0.0).alias(n) for n in names)).limit(0)
    inside = lambda n, b: F.coalesce(((F.col(n) >= b[0]) & (F.col(n) < b[1])).cast("int"), F.lit(0))
    sums = wide.groupBy(LEVEL, LAT, LON).agg(*(F.sum(inside(n, held[n, s])).alias(f"{s}|{n}") for s in kinds for n in names if (n, s) in held))
    times = wide.agg(F.count_distinct(TIME).alias("_times"))  # one row
    share = lambda s, n: (100.0 * F.col(f"{s}|{n}") / F.col("_times") if (n, s) in held else F.lit(None).cast("double")).alias(n)
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), *(share(s, n) for n in names)) for s in kinds))).alias("x")
    return sums.crossJoin(F.broadcast(times)).select(LEVEL, LAT, LON, rows).select("x.severity", LEVEL, LAT, LON, *(f"x.{n}" for n in names))


def turbulence_probability(wide: DataFrame, bounds: DataFrame, names: list[str], levels: list[float] | None = None) -> DataFrame:
    """turbulence_probabilities in long form: (diagnostic, severity, level, lat, lon, probability)."""
    return probability_rows(turbulence_probabilities(wide, bounds, names, levels), names)


def probability_rows(probabilities: DataFrame, names: list[str]) -> DataFrame:
    keys = ["severity", LEVEL, LAT, LON]
    return probabilities.unpivot(keys, names, "diagnostic", "probability").where("probability is not null").select("diagnostic", *keys, "probability")


def edr_columns(wide: DataFrame, parameters: DataFrame, names: list[str], c1: float = physics.EDR_C1, c2: float = physics.EDR_C2) -> DataFrame:
    """wide with dissipation rates in place of the named diagnostics; null for a name without parameters (a row a name, looked up at once)."""
    held = {x.diagnostic: (x["mean"], x.variance) for x in parameters.select("diagnostic", "mean", "variance").collect()}
    number = lambda x: F.lit(x).cast("double")
    made = {n: physics.eddy_dissipation(F.col(n), *map(number, held[n]), c1, c2) if n in held else number(None) for n in names}
    return wide.withColumns(made)


def to_edr(long: DataFrame, parameters: DataFrame, c1: float = physics.EDR_C1, c2: float = physics.EDR_C2) -> DataFrame:
    """long with edr, by each diagnostic's log-normal mean and variance (one row each, broadcast)."""
    joined = long.join(F.broadcast(parameters.select("diagnostic", "mean", "variance")), "diagnostic")
    return joined.withColumn("edr", physics.eddy_dissipation(F.col("value"), F.col("mean"), F.col("variance"), c1, c2)).drop("mean", "variance")


def edr_bounds() -> Thresholds:
    return Thresholds(light=EDR_LIGHT, moderate=EDR_MODERATE, severe=EDR_SEVERE)


def frequency(df: DataFrame, column: str, greater_than: float) -> DataFrame:
    """(n, turbulent, share) of the non-null values."""
    return df.agg(F.count(column).alias("n"), F.count_if(F.col(column) > greater_than).alias("turbulent")).withColumn("share", physics.ratio(F.col("turbulent").cast("double"), F.col("n").cast("double")))


def correlation(wide: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, diagnostic1, diagnostic2, corr): Pearson over rows where both are present; all pairs in one pass, by merged moments."""
    return moments.correlations(wide, names, keys or [])


def regional_correlation(wide: DataFrame, names: list[str]) -> DataFrame:
    """correlation for each hemisphere and region; the grid must reach over both bands' edges."""
    low, high = wide.agg(F.min(LAT), F.max(LAT)).first()
    if low is None or low > -filters.TROPICS or high < filters.POLEWARD:
        raise ValueError("the grid does not reach over the regions")
    tagged = wide.select(filters.region_tags(F.col(LAT)).alias("_tags"), *names)
    return moments.correlations(tagged, names, [], "_tags")


def matthews_correlation(masks: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """correlation of boolean columns, which is Matthews' coefficient of each pair."""
    for n in names:
        if masks.schema[n].dataType.simpleString() != "boolean":
            raise TypeError(f"{n} must be boolean")
    return correlation(masks.select(*(keys or []), *(F.col(n).cast("double").alias(n) for n in names)), names, keys)


def matthews_by_severity(wide: DataFrame, thresholds: dict[str, Thresholds], severities: list[Severity], mode: ThresholdMode = ThresholdMode.GEQ) -> DataFrame:
    """matthews_correlation of the thresholded diagnostics for each severity."""
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(str(s)).alias("severity"), *(filters.in_band(F.col(d), t.bounds(s, mode)).alias(d) for d, t in thresholds.items())) for s in severities))).alias("r"))
    return matthews_correlation(rows.select("r.*"), list(thresholds), ["severity"])


def zonal_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(TIME, LEVEL, LAT).agg(*(F.avg(c).alias(c) for c in columns))


def time_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls are skipped."""
    return df.groupBy(LEVEL, LAT, LON).agg(*(F.avg(c).alias(c) for c in columns))


def time_window(df: DataFrame) -> DataFrame:
    return df.agg(F.min(TIME).alias("first"), F.max(TIME).alias("last"))
