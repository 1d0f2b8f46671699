"""Exact quantiles (linear interpolation) at every size.

Values are counted first, so a hot value is one row whatever its weight. The
counted values are range-partitioned by (group, column, value): each range is
one window partition, and the ranges' sums are its offset. Quantiles are read
off at their two ranks. No task holds the values of a column or a group, and
no row goes to one task but a range's sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def column_of(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def prefix_counts(df: DataFrame, cols: dict, group: list[str] = ()) -> DataFrame:
    """For each distinct non-null value x of each of ``cols`` (name ->
    expression) in each group: (group.., column, x, cnt, cum, n), cum the rows
    up to and with x, n all rows of that column and group."""
    keys = [*group, "column"]
    stacked = df.select(*group, F.inline(F.array(*[F.struct(F.lit(k).alias("column"), column_of(c).alias("x")) for k, c in cols.items()])))
    counts = stacked.where(F.col("x").isNotNull()).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("cnt"))
    v = written(counts.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()), "prefix-counts")
    sums = v.groupBy(*keys, "part").agg(F.sum("cnt").alias("s"))
    by = Window.partitionBy(*keys)
    sums = sums.select(*[F.col(k).alias(f"{k}__k") for k in keys], F.col("part").alias("part__k"),
                       (F.sum("s").over(by.orderBy("part")) - F.col("s")).alias("offset"), F.sum("s").over(by).alias("n"))
    on = F.col("part") == F.col("part__k")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    inside = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return (v.withColumn("run", F.sum("cnt").over(inside)).join(sums, on)
            .select(*keys, "x", "cnt", (F.col("offset") + F.col("run")).alias("cum"), "n"))


def quantile_table(df: DataFrame, cols: dict, qs: list[float], group: list[str] = ()) -> DataFrame:
    """(group.., column, n, q0, q1, ..): the quantiles ``qs`` of each column in
    each group, by linear interpolation between the ranks around q (n - 1).
    Columns and groups without a value have no row."""
    pc = prefix_counts(df, cols, group)
    aggs = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("n") - 1)
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = (rank >= F.col("cum") - F.col("cnt")) & (rank < F.col("cum"))
            aggs.append(F.max(F.when(holds, F.col("x"))).alias(f"{name}{i}"))
    wide = pc.groupBy(*group, "column").agg(F.max("n").alias("n"), *aggs)
    out = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("n") - 1)
        out.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place - F.floor(place))).alias(f"q{i}"))
    return wide.select(*group, "column", "n", *out)


def quantiles(df: DataFrame, cols: dict | list, qs: list[float]) -> dict[str, list]:
    """Column -> its quantiles (None where it has no value): a row per column
    on the driver."""
    cols = cols if isinstance(cols, dict) else {c: c for c in cols}
    got = {r["column"]: [r[f"q{i}"] for i in range(len(qs))] for r in quantile_table(df, cols, qs).collect()} if cols else {}
    return {c: got.get(c, [None] * len(qs)) for c in cols}


def medians(df: DataFrame, cols: dict | list) -> dict:
    return {c: q[0] for c, q in quantiles(df, cols, [0.5]).items()}
