"""Column profiling: every profile is one aggregation over all requested
columns (design rule 1), unpivoted to a long table with ``inline``.

Scale notes
-----------
* Wide profiles compute all columns in a single ``agg`` (one scan, partial
  aggregation on the map side, one tiny exchange).
* Exact percentiles buffer values per group; ``approx=True`` switches to
  ``percentile_approx`` (bounded sketch) for very large inputs.
* Modes never build per-value maps in one task: values are stacked into
  (column, value) pairs, counted by a distributed ``groupBy`` (hot values are
  collapsed by map-side combine) and the winner is a ``min(struct)``.
* ECDF / QQ positions use a two-level prefix sum (fixed value-range buckets,
  then a window per bucket over *distinct* values), so no global
  single-partition window is ever formed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dlit, numeric_columns
from ..functions.normal import norm_ppf
from ..functions.moments import correlations
from ..functions.quantiles import medians, prefix_counts, quantile_table


def _unpivot_wide(wide: DataFrame, cols: list[str], fields: dict[str, str],
                  key: str = "column") -> DataFrame:
    """wide one-row frame with ``{c}__{f}`` columns -> one row per column."""
    rows = [F.struct(F.lit(c).alias(key),
                     *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in cols]
    out = wide.select(F.inline(F.array(*rows)))
    return out.select(key, *[F.col(f).cast(t).alias(f) for f, t in fields.items()])


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null percentage (0-100) and null count of every column, descending."""
    cols = cols or df.columns
    aggs = []
    for c in cols:
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__null_count")]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    wide = wide.select("*", *[(F.col(f"{c}__null_count") * 100.0 / F.col("__n"))
                              .alias(f"{c}__null_pct") for c in cols])
    long = _unpivot_wide(wide, cols, {"null_count": "bigint", "null_pct": "double"})
    return (long.select("column", "null_count", F.round("null_pct", 4).alias("null_pct"))
                .orderBy(F.desc("null_pct"), "column"))


def null_bands(profile: DataFrame, drop_above=70.0, test_from=10.0) -> DataFrame:
    """Band columns by null %: drop (> drop_above), test [test_from, drop_above],
    simple (0, test_from), complete (0)."""
    p = F.col("null_pct")
    return profile.withColumn(
        "band", F.when(p > drop_above, "drop").when(p >= test_from, "test")
                 .when(p > 0, "simple").otherwise("complete"))


def co_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count of rows where both columns are null, for every pair (a <= b).

    Rows collapse to patterns of nulls first (one grouping with partial
    counts), so the pairs of any number of columns are made from patterns."""
    pairs = [(a, a) for a in cols] + list(combinations(cols, 2))
    patterns = (df.select(F.array(*[F.col(c).isNull() for c in cols]).alias("nulls"))
                .groupBy("nulls").agg(F.count("*").alias("n")))
    places = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.lit(cols.index(a)).alias("i"), F.lit(cols.index(b)).alias("j"))
                       for a, b in pairs])  # one literal, so the pairs do not lengthen the generated code
    both = F.when(F.get("nulls", F.col("i")) & F.get("nulls", F.col("j")), F.col("n")).otherwise(F.lit(0))
    return (patterns.select("nulls", "n", F.inline(places)).groupBy("col_a", "col_b")
            .agg(F.sum(both).cast("long").alias("both_null")))


def distinct_profile(df: DataFrame, cols: list[str] | None = None,
                     approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct non-null values per column. Exact: (column, value) pairs are
    stacked and de-duplicated by one distributed aggregation (map-side
    combine collapses hot values), then counted per column, instead of one
    count-distinct expansion per column. ``approx``: HyperLogLog++ sketches
    in a single pass."""
    cols = cols or df.columns
    if approx:
        wide = df.agg(*[F.approx_count_distinct(F.col(c), rsd).alias(f"{c}__n_distinct") for c in cols])
        return _unpivot_wide(wide, cols, {"n_distinct": "bigint"})
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])))
    counts = (stacked.where(F.col("v").isNotNull()).distinct()
              .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counts, "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear), max per column:
    one aggregate, and the quantile table of all columns."""
    cols = cols or numeric_columns(df.schema)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    fields = {"count": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double"}
    long = _unpivot_wide(df.agg(*aggs), cols, fields)
    qs = quantile_table(df, {c: c for c in cols}, [0.25, 0.5, 0.75]).select(
        "column", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return long.join(qs, "column", "left").select("column", "count", *[F.round(f, 6).alias(f) for f in (
        "mean", "std", "min", "q25", "q50", "q75", "max")])


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r for every unordered pair (and the diagonal):
    one pass of matrix products, whatever the number of columns."""
    r = correlations(df, [F.col(f"`{c}`") for c in cols])
    rows = [(cols[i], cols[j], None if r[i, j] != r[i, j] else float(r[i, j]))
            for i, j in [(i, i) for i in range(len(cols))] + list(combinations(range(len(cols)), 2))]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double").withColumn("r", F.round("r", 6))


def shape_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population skewness, excess kurtosis (scipy defaults), mean/median."""
    mid = medians(df, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.skewness(x).alias(f"{c}__skew"), F.kurtosis(x).alias(f"{c}__kurt"),
                 F.try_divide(F.avg(x), F.lit(mid[c]).cast("double")).alias(f"{c}__mean_median")]
    long = _unpivot_wide(df.agg(*aggs), cols,
                         {"skew": "double", "kurt": "double", "mean_median": "double"})
    return long.select("column", *[F.round(f, 6).alias(f) for f in ("skew", "kurt", "mean_median")])


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls in the last bin.
    Bounds come from a one-row aggregate (two scalars), then one grouped count."""
    x = F.col(c).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    width = (hi - lo) if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * F.lit(bins)).cast("int") + 1, F.lit(bins))
    return (df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .select("bin",
                      F.round(F.lit(lo) + (F.col("bin") - 1) * F.lit(width / bins), 6).alias("bin_lo"),
                      F.round(F.lit(lo) + F.col("bin") * F.lit(width / bins), 6).alias("bin_hi"),
                      "n"))


def boxplot_stats(df: DataFrame, cat: str, c: str, k: float = 1.5) -> DataFrame:
    """Per category: quartiles, IQR, whiskers (furthest points inside the
    k*IQR fences) and outlier count. The quartile table has one row per
    category and joins back on the category key (size-checked broadcast)."""
    from ..functions.joins import checked_broadcast
    x = F.col(c).cast("double")
    q = quantile_table(df, {c: c}, [0.25, 0.5, 0.75], [cat]).select(
        cat, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.select(cat, x.alias("_x")).where(F.col("_x").isNotNull()).join(checked_broadcast(q), cat)
    lo_f = F.col("q1") - k * F.col("iqr")
    hi_f = F.col("q3") + k * F.col("iqr")
    out = j.groupBy(cat, "q1", "median", "q3", "iqr", "n").agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.sum(((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).cast("long")).alias("n_outliers"))
    return out.select(cat, "n", *[F.round(f, 6).alias(f) for f in
                                  ("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi")],
                      "n_outliers")


def ecdf(df: DataFrame, c: str) -> DataFrame:
    """Empirical CDF at every distinct value: F(x) = #(values <= x) / n."""
    pc = prefix_counts(df, {c: c})
    return pc.select(F.col("x").alias(c), F.col("cnt").alias("n"), F.col("cum").alias("cum_n"),
                     F.round(F.col("cum") / F.col("n"), 6).alias("ecdf"))


# Ranks that one row spreads into; longer runs are cut and dealt out first.
QQ_RUN = 10_000


def qq_points(df: DataFrame, c: str) -> DataFrame:
    """Normal QQ pairs with Filliben plotting positions (ordered value vs
    standard-normal quantile of its rank position). A value that is held by
    many rows spreads over runs of QQ_RUN ranks, dealt out before they are
    written row by row."""
    pc = prefix_counts(df, {c: c}).select("x", "n", (F.col("cum") - F.col("cnt")).alias("start"), "cum")
    runs = pc.withColumn("from", F.explode(F.sequence("start", F.col("cum") - 1, F.lit(QQ_RUN).cast("bigint"))))
    runs = runs.repartition("x", "from")
    rk = F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + QQ_RUN, "cum")))
    pts = runs.select(F.col("x").alias("sample"), F.col("n").cast("double").alias("nn"), rk.alias("rank"))
    nn, i = F.col("nn"), F.col("rank").cast("double")
    end = F.pow(F.lit(0.5), F.lit(1.0) / nn)
    m = (F.when(i == 1, F.lit(1.0) - end).when(i == nn, end).otherwise((i - 0.3175) / (nn + 0.365)))
    return pts.select("rank", F.round(norm_ppf(m), 6).alias("theoretical"), F.round("sample", 6).alias("sample"))


def mode_profile(df: DataFrame, cols: list[str], default: str = "Unknown") -> DataFrame:
    """Most frequent non-null value of each column; smallest value on ties;
    ``default`` when a column is entirely null. Values compared as strings."""
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols]))).where(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg_n"),
                                                       F.col("value").alias("value"))).alias("m"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(best, "column", "left")
                 .select("column", F.coalesce(F.col("m.value"), F.lit(default)).alias("mode"),
                         F.coalesce(-F.col("m.neg_n"), F.lit(0)).cast("bigint").alias("mode_count")))


def numeric_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mode of numeric columns compared numerically (smallest on ties)."""
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in cols]))).where(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg_n"),
                                                       F.col("value").alias("value"))).alias("m"))
    return best.select("column", F.col("m.value").alias("mode"),
                       (-F.col("m.neg_n")).cast("bigint").alias("mode_count"))


def missing_patterns(df: DataFrame, cols: list[str], mean_cols: list[str]) -> DataFrame:
    """Distinct missingness patterns ('1' = null) with count and per-pattern
    means of ``mean_cols``."""
    pat = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return (df.groupBy(pat.alias("pattern"))
              .agg(F.count(F.lit(1)).alias("n"),
                   *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in mean_cols]))


def top_extremes(df: DataFrame, c: str, key: str, k: int = 10, threshold: float = 3.0,
                 log: bool = True) -> DataFrame:
    """Top-k rows by |z| (population std) of ``c`` (log1p scale by default);
    a distributed top-k (TakeOrderedAndProject), one stats pass first. Rows
    within the threshold are no extremes and are left out."""
    x = F.log1p(F.col(c)) if log else F.col(c).cast("double")
    st = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    z = F.abs((x - F.lit(st["m"])) / F.lit(st["s"] or 1.0))
    return (df.where(z > threshold)
              .select(key, F.col(c).alias("value"), F.round(x, 6).alias("value_log"),
                      F.round(z, 6).alias("abs_z"), F.lit(True).alias("is_extreme"))
              .orderBy(F.desc("abs_z"), F.asc(key)).limit(k))
