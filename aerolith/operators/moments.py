"""Correlations of many columns from moments that merge: a plan of one size whatever the number of pairs.

A task keeps, for each pair of columns, the number of rows where both are there, their means and their squared and crossed
deviations: numpy products of a batch, merged batch by batch. A task gives one row of small arrays a group; those are merged
in the same way, pair by pair. Deviations are about each batch's own values, so large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

c = F.col
#: What is kept of a pair.
FIELDS = ("n", "mx", "my", "sxx", "syy", "sxy")
#: Groups of a task whose moments are held at once.
GROUPS = 1 << 8
#: A column whose deviation is under so small a share of its mean is constant but for rounding.
_SAME = 1e-12


def of_rows(x: np.ndarray) -> np.ndarray:
    """FIELDS by column by column of the rows of x; NaN is missing."""
    there = ~np.isnan(x)
    first = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    z, m = np.where(there, x - first, 0.0), there.astype(float)
    n, s, q, p = m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z
    some = np.maximum(n, 1)
    mean, spread = s / some, np.maximum(q - s * s / some, 0.0)
    spread[spread <= 1e-13 * q] = 0.0
    mean = np.where(n > 0, mean + first[:, None], 0.0)
    return np.stack([n, mean, mean.T, spread, spread.T, p - s * s.T / some])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of both sets of rows."""
    n = a[0] + b[0]
    share, weight = b[0] / np.maximum(n, 1), a[0] * b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def _merged_column(rows: Column) -> Column:
    """merged over an array of structs, one from each task."""

    def both(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        some = F.greatest(n, F.lit(1.0))
        share, weight, dx, dy = b["n"] / some, a["n"] * b["n"] / some, b["mx"] - a["mx"], b["my"] - a["my"]
        made = (n, a["mx"] + dx * share, a["my"] + dy * share, a["sxx"] + b["sxx"] + dx * dx * weight, a["syy"] + b["syy"] + dy * dy * weight, a["sxy"] + b["sxy"] + dx * dy * weight)
        return F.struct(*(x.alias(k) for x, k in zip(made, FIELDS, strict=True)))

    return F.aggregate(rows, F.struct(*(F.lit(0.0).alias(k) for k in FIELDS)), both)


def correlations(wide: DataFrame, names: list[str], keys: list[str], tags: str | None = None) -> DataFrame:
    """(keys, diagnostic1, diagnostic2, corr): Pearson over rows where both are there; null where one is constant, 1 of itself.

    keys: few groups. tags: an array column of structs; a row counts in each of its structs, whose fields are then keys
    too, though rows are not repeated: moments of each distinct array are, once they are worked out.
    """
    of = [*keys, *([tags] if tags else [])]
    ordered = sorted(names)
    pairs = list(combinations_with_replacement(range(len(ordered)), 2))
    left, right = (np.array([p[k] for p in pairs]) for k in range(2))
    schema = StructType([*(wide.schema[k] for k in of)])
    key_types = to_arrow_schema(schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([v[0][i] for v in held.values()], key_types.field(i).type) for i in range(len(of))]
            values = [pa.array([v[1][f][left, right] for v in held.values()], pa.list_(pa.float64())) for f in range(len(FIELDS))]
            return pa.RecordBatch.from_arrays([*columns, *values], [*(f"_k{i}" for i in range(len(of))), *FIELDS])

        for batch in batches:
            x = np.stack([np.asarray(batch.column(1 + len(of) + i).to_numpy(zero_copy_only=False), float) for i in range(len(ordered))], axis=1)
            groups, firsts, at = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
            for k, (group, first) in enumerate(zip(groups.tolist(), firsts.tolist(), strict=True)):
                made = of_rows(x[at == k] if len(groups) > 1 else x)
                key = held[group][0] if group in held else [batch.column(1 + i)[first].as_py() for i in range(len(of))]
                held[group] = (key, merged(held[group][1], made) if group in held else made)
            if len(held) > GROUPS:
                yield out()
                held = {}
        if held:
            yield out()

    group_hash = (F.xxhash64(*of) if of else F.lit(0).cast("long")).alias("_group")  # few groups, so a hash tells them apart
    read = wide.select(group_hash, *of, *(c(n).cast("double") for n in ordered))
    fields = [*(f"_k{i} {wide.schema[k].dataType.simpleString()}" for i, k in enumerate(of)), *(f"{k} array<double>" for k in FIELDS)]
    part = read.mapInArrow(summed, ", ".join(fields))
    named = [c(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    group = [*keys]
    if tags:
        part = part.withColumn("_tag", F.explode(c(f"_k{len(keys)}")))
        fields_of = wide.schema[tags].dataType.elementType.names
        named += [c(f"_tag.{f}").alias(f) for f in fields_of]
        group += fields_of
    each = part.select(*named, F.posexplode(F.arrays_zip(*FIELDS)).alias("_pair", "_m")).groupBy(*group, "_pair").agg(_merged_column(F.collect_list("_m")).alias("m"))  # a struct a task
    m = c("m")
    varies = lambda s, mean: m[s] > m["n"] * F.pow(m[mean] * _SAME, 2)
    corr = F.when(varies("sxx", "mx") & varies("syy", "my"), m["sxy"] / (F.sqrt(m["sxx"]) * F.sqrt(m["syy"])))
    listed = wide.sparkSession.createDataFrame([(k, ordered[a], ordered[b]) for k, (a, b) in enumerate(pairs)], "_pair int, diagnostic1 string, diagnostic2 string")
    half = each.withColumn("corr", corr).join(F.broadcast(listed), "_pair").withColumn("corr", F.when(c("diagnostic1") == c("diagnostic2"), 1.0).otherwise(c("corr")))
    sides = F.explode(F.when(c("diagnostic1") == c("diagnostic2"), F.array(F.struct(c("diagnostic1").alias("a"), c("diagnostic2").alias("b")))).otherwise(F.array(F.struct(c("diagnostic1").alias("a"), c("diagnostic2").alias("b")), F.struct(c("diagnostic2").alias("a"), c("diagnostic1").alias("b"))))).alias("s")
    return half.select(*group, sides, "corr").select(*group, c("s.a").alias("diagnostic1"), c("s.b").alias("diagnostic2"), "corr")
