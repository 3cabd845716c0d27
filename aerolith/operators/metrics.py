"""Verification metrics: contingency counts and what follows from them, ROC curves, grouped skill."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerolith.functions.physics import ratio
from aerolith.operators.filters import Thresholds
from aerolith.schema import GroupMetric, Relationship, Severity, require_boolean

c = F.col


def contingency(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n11, n10, n01, n00) of two boolean columns, x first; rows where either is null do not count."""
    require_boolean(df, x, y)
    both = lambda a, b: F.count_if((c(x) == a) & (c(y) == b))
    counts = [both(a, b).alias(f"n{int(a)}{int(b)}") for a in (True, False) for b in (True, False)]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def confusion(df: DataFrame, truth: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, tn, fp, fn, tp)."""
    names = {"n00": "tn", "n01": "fp", "n10": "fn", "n11": "tp"}
    made = contingency(df, truth, prediction, keys)
    return made.select(*(keys or []), *(c(a).alias(b) for a, b in names.items()))


def _d(*names: str) -> list[Column]:
    return [c(n).cast("double") for n in names]


def matthews() -> Column:
    tp, tn, fp, fn = _d("tp", "tn", "fp", "fn")
    return ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def critical_success() -> Column:
    tp, fp, fn = _d("tp", "fp", "fn")
    return ratio(tp, tp + fn + fp)


def gilbert() -> Column:
    tp, tn, fp, fn = _d("tp", "tn", "fp", "fn")
    chance = ratio((tp + fp) * (tp + fn), tp + tn + fp + fn)
    return ratio(tp - chance, tp + fp + fn - chance)


def accuracy() -> Column:
    tp, tn, fp, fn = _d("tp", "tn", "fp", "fn")
    return ratio(tp + tn, tp + tn + fp + fn)


def f1() -> Column:
    tp, fp, fn = _d("tp", "fp", "fn")
    return ratio(2 * tp, 2 * tp + fp + fn)


def sensitivity() -> Column:
    tp, fn = _d("tp", "fn")
    return ratio(tp, tp + fn)


def specificity() -> Column:
    tn, fp = _d("tn", "fp")
    return ratio(tn, tn + fp)


def true_skill() -> Column:
    return sensitivity() + specificity() - 1


def matthews_table() -> Column:
    n11, n10, n01, n00 = _d("n11", "n10", "n01", "n00")
    x1, x0, y1, y0 = n11 + n10, n01 + n00, n11 + n01, n10 + n00
    return ratio((x1 + x0) * n11 - x1 * y1, F.sqrt(x1) * F.sqrt(x0) * F.sqrt(y1) * F.sqrt(y0))


def jaccard() -> Column:
    n11, n10, n01 = _d("n11", "n10", "n01")
    return ratio(n11, n11 + n10 + n01)


def odds_ratio(log: bool = True) -> Column:
    n11, n10, n01, n00 = _d("n11", "n10", "n01", "n00")
    r = ratio(n00 * n11, n01 * n10)
    return F.when(r > 0, F.ln(r)) if log else r


def relative_risk(log: bool = True, inverse: bool = False) -> Column:
    """inverse: with the two features in each other's place."""
    n11, n10, n01, n00 = _d("n11", "n01", "n10", "n00") if inverse else _d("n11", "n10", "n01", "n00")
    r = ratio(n11, n01) * ratio(n01 + n00, n11 + n10)
    return F.when(r > 0, F.ln(r)) if log else r


def _share(a: str, b: str) -> Callable[[], Column]:
    return lambda: ratio(c(a).cast("double"), (c(a) + c(b)).cast("double"))


#: The conditional shares are named as their users know them; n11 / (n11 + n10) is a share of the first feature's cells.
RELATIONSHIPS: dict[Relationship, Callable[[], Column]] = {
    Relationship.MATTHEWS: matthews_table, Relationship.ODDS_RATIO: odds_ratio, Relationship.RELATIVE_RISK: relative_risk,
    Relationship.INVERSE_RELATIVE_RISK: lambda: relative_risk(inverse=True), Relationship.JACCARD: jaccard,
    Relationship.THIS_GIVEN_OTHER: _share("n11", "n10"), Relationship.OTHER_GIVEN_THIS: _share("n11", "n01"),
    Relationship.THIS_GIVEN_NOT_OTHER: _share("n01", "n00"), Relationship.OTHER_GIVEN_NOT_THIS: _share("n10", "n00"),
}


def relationships(long: DataFrame, feature: str, thresholds: dict[str, float], keys: list[str], wanted: list[Relationship] | None = None) -> DataFrame:
    """(diagnostic, keys, a column for each relationship) of a boolean feature and each diagnostic at or over its threshold.

    long has diagnostic and value. One aggregation for all diagnostics and relationships.
    """
    least = F.create_map(*(x for d, t in thresholds.items() for x in (F.lit(d), F.lit(float(t)))))
    marked = long.where(c("diagnostic").isin(list(thresholds))).withColumn("_turbulent", c("value") >= least[c("diagnostic")])
    table = contingency(marked, feature, "_turbulent", ["diagnostic", *keys])
    return table.select("diagnostic", *keys, *(RELATIONSHIPS[r]().alias(str(r)) for r in (wanted or list(Relationship))))


def mean_absolute_error(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.abs(c(a) - c(b))).alias("mae"))


#: Ranges of scores that running counts are made in, side by side.
RANGES = 64


def score_counts(df: DataFrame, truth: str, score: str, keys: list[str], positive: object | None = None) -> DataFrame:
    """(keys, score, p, n): labels at each distinct score; null scores and labels are left out."""
    if df.schema[truth].dataType.simpleString() != "boolean":
        if positive is None:
            raise ValueError("a label for positives is needed unless the truth is boolean")
        df = df.withColumn(truth, c(truth) == F.lit(positive))
    held = df.where(c(truth).isNotNull() & c(score).isNotNull())
    return held.groupBy(*keys, c(score).alias("score")).agg(F.count_if(c(truth)).alias("p"), F.count_if(~c(truth)).alias("n"))


def curve(df: DataFrame, truth: str, score: str, keys: list[str] | None = None, intervals: int = -1, positive: object | None = None, spread: bool = False) -> DataFrame:
    """(keys, threshold, tp, fp): counts of labels at or over each distinct score.

    intervals: leave out thresholds that are followed by a step no larger than the range over so many; -1 for none.
    Without keys, and with spread for each of a few keys with many scores, the running counts are made within ranges of
    scores, and the totals of the ranges above are added, so that no one task holds all scores of a key.
    """
    keys = keys or []
    counts = score_counts(df, truth, score, keys, positive)
    if keys and not spread:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"))
        made = counts.select(*keys, c("score").alias("threshold"), F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))
    else:
        held = _ranged(counts, "score", keys)
        w = Window.partitionBy(*keys, "_range").orderBy(F.desc("score"))
        sums = held.groupBy(*keys, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # RANGES rows a key at most
        above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*keys, "_range", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
        inside = held.select(*keys, "_range", "score", F.sum("p").over(w).alias("p"), F.sum("n").over(w).alias("n"))
        made = inside.join(before if keys else F.broadcast(before), [*keys, "_range"]).select(*keys, c("score").alias("threshold"), (c("p") + c("_p")).alias("tp"), (c("n") + c("_n")).alias("fp"))
    if intervals == -1:
        return made
    steps = made.groupBy(*keys).agg(((F.max("threshold") - F.min("threshold")) / intervals).alias("_step"))
    wide = _beside(made, keys, "threshold", ["threshold"], after=True, spread=spread)
    wide = wide.join(steps, keys) if keys else wide.crossJoin(F.broadcast(steps))  # without keys one row
    return wide.where(c("_beside").isNull() | (c("threshold") - c("_beside.threshold") > c("_step"))).select(*made.columns)


def _ranged(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """df with `_range`, within each key: 0 for the largest values of the column, RANGES - 1 at most. Keys are not null."""
    edges = F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)]).cast("array<double>")
    above = lambda all_: F.size(F.filter(all_, lambda e: e > c(column)))
    if keys:
        return df.join(df.groupBy(*keys).agg(edges.alias("_edges")), keys).withColumn("_range", above(c("_edges"))).drop("_edges")
    held = df.agg(edges).first()[0] or []
    return df.withColumn("_range", above(F.array(*map(F.lit, held)).cast("array<double>")) if held else F.lit(0))


def _beside(df: DataFrame, keys: list[str], column: str, fields: list[str], after: bool = False, spread: bool = False) -> DataFrame:
    """df with `_beside`: the fields of the row before in falling order of the column, or of the row after; null where there is none.

    Without keys, or with spread, rows are put side by side within ranges of the column, whose ends are looked up among
    the ranges.
    """
    one, move = F.struct(*fields), F.lead if after else F.lag
    if keys and not spread:
        return df.withColumn("_beside", move(one).over(Window.partitionBy(*keys).orderBy(F.desc(column))))
    held = _ranged(df, column, keys)
    ends = held.groupBy(*keys, "_range").agg((F.max_by if after else F.min_by)(one, c(column)).alias("_end"))
    ends = ends.select(*keys, "_range", move("_end").over(Window.partitionBy(*keys).orderBy("_range")).alias("_next"))  # RANGES rows a key at most
    inside = held.withColumn("_here", move(one).over(Window.partitionBy(*keys, "_range").orderBy(F.desc(column))))
    joined = inside.join(ends if keys else F.broadcast(ends), [*keys, "_range"])
    return joined.withColumn("_beside", F.coalesce("_here", "_next")).drop("_range", "_here", "_next")


def roc(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, threshold, fpr, tpr) from curve's rows, with a start of (0, 0) at infinity; a rate over nothing is null."""
    keys = keys or []
    ends = points.groupBy(*keys).agg(F.max("tp").alias("_tp"), F.max("fp").alias("_fp"))
    rated = (points.join(ends, keys) if keys else points.crossJoin(F.broadcast(ends))).select(*keys, "threshold", ratio(c("fp").cast("double"), c("_fp").cast("double")).alias("fpr"), ratio(c("tp").cast("double"), c("_tp").cast("double")).alias("tpr"))
    return rated.unionByName(ends.where("_tp is not null").select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def area(rates: DataFrame, keys: list[str] | None = None, spread: bool = False) -> DataFrame:
    """(keys, auc, points): trapezoids under roc's rows in order of falling threshold, and how many rows; auc is null with fewer than two."""
    keys = keys or []
    part = (c("fpr") - c("_beside.fpr")) * (c("tpr") + c("_beside.tpr")) / 2
    held = _beside(rates, keys, "threshold", ["fpr", "tpr"], spread=spread).withColumn("_part", part)
    return held.groupBy(*keys).agg(F.sum("_part").alias("auc"), F.count("*").alias("points"))


def area_of_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """(auc) under points in order of x, which must be monotonic in `order`; the sign follows a falling x. In ranges of the order."""
    step = c("_beside")[x] - c(x)  # to the next in the order
    rows = _beside(df, [], "order", [x, y]).withColumns({"_s": step, "_a": step * (c(y) + c("_beside")[y]) / 2})
    bad = (F.min("_s") < 0) & (F.max("_s") > 0)
    few = F.count("*") < 2
    return rows.agg(F.when(few, F.raise_error(F.lit("two points at least")).cast("double")).when(bad, F.raise_error(F.lit("x is not monotonic")).cast("double")).otherwise(F.abs(F.sum("_a")) * F.signum(F.sum("_a")) * F.when(F.min("_s") < 0, -1.0).otherwise(1.0)).alias("auc"))


def _simpson_part(x: Column, y: Column, place: Column, n: Column, w: WindowSpec) -> Column:
    """What a row adds to Simpson's rule on any spacing, of rows in the window's order; place counts them from 1."""
    beside = lambda v, k: F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w)
    return _simpson_of({k: (beside(x, k), beside(y, k)) if k else (x, y) for k in range(-2, 3)}, place, n)


def _simpson_of(points: dict[int, tuple[Column, Column]], place: Column, n: Column) -> Column:
    """What a row adds to Simpson's rule: a parabola through each three points, from its first point.

    points: (x, y) of the row (0) and of the two before and after it. With an odd number of panels the last row adds the
    last one, by the parabola of the three last points; with two rows it is a trapezoid. A step of nothing makes both panels
    trapezoids.
    """
    (x2, y2), (x1, y1), (x, y), (x3, y3), (x4, y4) = (points[k] for k in range(-2, 3))
    flat = lambda h, u, v: h * (u + v) / 2
    a, b = x3 - x, x4 - x3
    three = (a + b) / 6 * ((2 - b / a) * y + (a + b) * (a + b) / (a * b) * y3 + (2 - a / b) * y4)
    pair = F.when((a == 0) | (b == 0), flat(a, y, y3) + flat(b, y3, y4)).otherwise(three)
    d, e = x1 - x2, x - x1
    tail = y * (2 * e * e + 3 * d * e) / (6 * (d + e)) + y1 * (e * e + 3 * d * e) / (6 * d) - y2 * e * e * e / (6 * d * (d + e))
    one = F.when((n == 2) | (d == 0) | (e == 0), flat(e, y, y1)).otherwise(tail)
    return F.when((place % 2 == 1) & (place + 2 <= n), pair).when((place == n) & (n % 2 == 0), one)


#: Rows of a group from which its running counts are made in ranges, where that is asked for.
HOT_ROWS = 1 << 20


def grouped(df: DataFrame, truth: str, score: str, keys: list[str], metric: GroupMetric, least: int, simpson: bool = False, compat: bool = False, tie: list[str] | None = None, hot: int | None = None) -> DataFrame:
    """(keys, value, n): prevalence, true skill or area under the curve of each group, null for groups under `least` rows.

    Skill and area are -1 where a group has fewer than two positives. Skill is the largest TPR - FPR; compat gives
    the largest TPR + FPR - 1. Points are single rows in order of falling score, then of `tie`. simpson: parabolas in place
    of trapezoids.

    A group's running counts are made in one task; with hot, those of groups of that many rows or more are made in ranges of
    scores instead, and a score that many rows share in ranges of the first column of `tie` (a number), with the same
    results. The groups' sizes are looked up for that at once, so df should be a written table then.
    """
    if least < 1:
        raise ValueError("the least size of a group is positive")
    held = df.where(c(truth).isNotNull() & c(score).isNotNull())
    if metric is GroupMetric.PREVALENCE:
        made = held.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(c(truth).cast("double")).alias("value"))
        return made.select(*keys, F.when(c("n") >= least, c("value")).alias("value"), "n")
    rows = held.select(*keys, c(score).alias("_score"), *(c(t).alias(f"_tie{i}") for i, t in enumerate(tie or [])), c(truth).cast("int").alias("_hit"))
    order = [F.desc("_score"), *(f"_tie{i}" for i in range(len(tie or [])))]
    neighbours = range(-1, 3) if metric is GroupMetric.AUC and simpson else ()
    placed = _placed(rows, keys, order, neighbours) if hot is None else _placed_in_ranges(rows, keys, order, neighbours, hot)

    def rates(tp: Column, place: Column) -> tuple[Column, Column]:
        """(FPR, TPR) after so many rows, of which so many are hits."""
        fpr = F.when(c("_n") == c("_p"), F.lit(0.0)).otherwise(ratio((place - tp).cast("double"), (c("_n") - c("_p")).cast("double")))
        return fpr, ratio(tp.cast("double"), c("_p").cast("double"))

    here, before = rates(c("_tp"), c("_i")), rates(c("_tp") - c("_hit"), c("_i") - 1)
    if metric is GroupMetric.TSS:
        value = F.max(here[1] + here[0] - 1 if compat else here[1] - here[0])
    elif simpson:
        points = {0: here, -1: before, -2: rates(c("_tp") - c("_hit") - c("_at-1"), c("_i") - 2), 1: rates(c("_tp") + c("_at1"), c("_i") + 1), 2: rates(c("_tp") + c("_at1") + c("_at2"), c("_i") + 2)}
        value = F.coalesce(F.sum(_simpson_of(points, c("_i"), c("_n"))), F.lit(0.0))
    else:
        value = F.coalesce(F.sum(F.when(c("_i") > 1, (here[0] - before[0]) * (here[1] + before[1]) / 2)), F.lit(0.0))
    made = placed.groupBy(*keys).agg(value.alias("value"), F.count("*").alias("n"), F.max("_p").alias("_p"))
    return made.select(*keys, F.when(c("n") < least, None).when(c("_p") < 2, -1.0).otherwise(c("value")).alias("value"), "n")


def _placed(rows: DataFrame, keys: list[str], order: list, neighbours: Iterable[int]) -> DataFrame:
    """rows with _i, the place in the group, _tp, hits up to it, _n and _p, the group's rows and hits, and the neighbours' hits."""
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beside = {f"_at{k}": (F.lead("_hit", k) if k > 0 else F.lag("_hit", -k)).over(w) for k in neighbours if k}
    return rows.withColumns({"_tp": F.sum("_hit").over(up), "_i": F.row_number().over(w), "_p": F.sum("_hit").over(whole), "_n": F.count("*").over(whole)} | beside)


def _placed_in_ranges(rows: DataFrame, keys: list[str], order: list, neighbours: Iterable[int], hot: int) -> DataFrame:
    """_placed, where groups of `hot` rows or more are cut into ranges of about RANGES-th of their rows.

    A score that is an edge between ranges is a range of its own, so one that many rows share can be cut again by the first
    tie. Ranges are counted by themselves and get the totals of those before them, and the hits across their borders.
    """
    rows, keys = rows.withColumn("_k", F.struct(*keys)), ["_k"]  # a struct is joined also where its fields are null
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_hit").alias("_p"))
    large = sizes.where(c("_n") >= hot).select(*keys)
    count = large.count()  # no more than rows / hot
    if not count:
        return _placed(rows, keys, order, neighbours)
    sent = F.broadcast if count * RANGES <= 1 << 20 else (lambda x: x)
    shares = [i / RANGES for i in range(1, RANGES)]
    same = lambda a, b: F.array_contains(a, b)
    edges = rows.join(sent(large), keys).groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_score", shares)).alias("_edges"))
    first = rows.join(sent(edges), keys, "left").withColumn("_range", F.coalesce(2 * F.size(F.filter("_edges", lambda e: e > c("_score"))) - F.when(same(c("_edges"), c("_score")), 0).otherwise(1), F.lit(-1))).drop("_edges")
    if ties := [x for x in rows.columns if x == "_tie0"]:
        tie = c(ties[0]).try_cast("double")
        full = first.where("_range >= 0 and _range % 2 = 0").groupBy(*keys, "_range").agg(F.count("*").alias("_m"), F.array_distinct(F.percentile_approx(tie, shares)).alias("_cuts")).where(c("_m") >= hot / RANGES * 2)
        cut = F.coalesce(F.size(F.filter("_cuts", lambda e: e < tie)), F.lit(0))
        first = first.join(sent(full.drop("_m")), [*keys, "_range"], "left").withColumn("_cut", F.when(c("_cuts").isNotNull(), cut).otherwise(0)).drop("_cuts")
    else:
        first = first.withColumn("_cut", F.lit(0))
    part = [*keys, "_range", "_cut"]
    w = Window.partitionBy(*part).orderBy(*order)
    up, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*part)
    inner = first.withColumns({"_tp": F.sum("_hit").over(up), "_i": F.row_number().over(w), "_m": F.count("*").over(whole)} | {f"_at{k}": (F.lead("_hit", k) if k > 0 else F.lag("_hit", -k)).over(w) for k in neighbours if k})
    pick = lambda k, place: F.max(F.when(place == k, c("_hit"))).alias(f"_e{k}")
    sums = inner.groupBy(*part).agg(F.count("*").alias("_c"), F.sum("_hit").alias("_h"), pick(1, c("_i")), pick(2, c("_i")), F.max(F.when(c("_i") == c("_m"), c("_hit"))).alias("_e0"))
    ranges = Window.partitionBy(*keys).orderBy("_range", "_cut")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    next_ = lambda x, k=1: F.lead(x, k).over(ranges)
    ends = sums.select(
        *part, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_h0"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"), F.sum("_h").over(Window.partitionBy(*keys)).alias("_p"),
        F.lag("_e0").over(ranges).alias("_b"), next_("_e1").alias("_a1"), F.coalesce(next_("_e2"), next_("_e1", 2)).alias("_a2"),
    )
    out = inner.join(ends, part).withColumns({"_tp": c("_tp") + c("_h0"), "_left": c("_m") - c("_i"), "_first": c("_i") == 1}).withColumn("_i", c("_i") + c("_c0"))
    across = {"_at-1": F.when(c("_first"), c("_b")).otherwise(c("_at-1")), "_at1": F.when(c("_left") == 0, c("_a1")).otherwise(c("_at1")), "_at2": F.when(c("_left") == 0, c("_a2")).when(c("_left") == 1, c("_a1")).otherwise(c("_at2"))} if neighbours else {}
    return out.withColumns(across) if across else out


def grouped_curve(df: DataFrame, truth: str, score: str, keys: list[str], least_positives: int = 2) -> DataFrame:
    """(keys, threshold, tpr, fpr) at distinct scores for groups of at least so many positives; without negatives FPR is 0."""
    points = curve(df, truth, score, keys)
    w = Window.partitionBy(*keys)
    held = points.withColumns({"_p": F.max("tp").over(w), "_n": F.max("fp").over(w)}).where(c("_p") >= least_positives)
    return held.select(*keys, "threshold", ratio(c("tp").cast("double"), c("_p").cast("double")).alias("tpr"), F.when(c("_n") == 0, F.lit(0.0)).otherwise(ratio(c("fp").cast("double"), c("_n").cast("double"))).alias("fpr"))


def skill_map(scored: DataFrame, column: str, greater_than: float, names: list[str], keys: list[str], least: int, metric: GroupMetric = GroupMetric.AUC, tie: list[str] | None = None, simpson: bool = False, hot: int | None = None) -> DataFrame:
    """(keys, one column a diagnostic): grouped() of each, in one job; values of -1 become null, groups of nulls alone go.

    simpson, hot: as in grouped.
    """
    held = scored.withColumn("_truth", c(column) > greater_than).unpivot([*keys, "_truth", *(tie or [])], names, "diagnostic", "_score")
    value = grouped(held, "_truth", "_score", [*keys, "diagnostic"], metric, least, simpson, tie=tie, hot=hot)
    some = value.where(c("value").isNotNull()).withColumn("value", F.when(c("value") >= 0, c("value")))
    return some.groupBy(*keys).pivot("diagnostic", names).agg(F.first("value"))


def severities(thresholds: Thresholds) -> list[Severity]:
    return [s for s, v in zip(Severity, thresholds.values(), strict=True) if v is not None]
