"""Missing-value diagnosis and imputation: fit on a training frame, apply
as a pure projection.

Every fit is one aggregation over all columns (null counts, distinct counts,
means, medians) plus a distributed mode pass; the results are a few scalars
per column, held in a small ``params`` object (and exposed as a long
parameter table). Transforms are ``select`` lists of ``coalesce`` literals,
so they pipeline into the consumer's whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.moments import centres, grouped_moments, swept
from ..functions.quantiles import medians as column_medians
from ..functions.stats import chi2_sf, t_sf_two_sided
from .nearest import knn_impute
from .profile import mode_profile


def _is_num(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NumericType)


def _column_stats(df: DataFrame, cols: list[str], medians: bool = False) -> dict:
    """One pass over all columns: row count, null count, mean (numeric),
    median (optional) and whether the column holds at most one distinct
    non-null value (``min == max``: exact, no distinct-count expansion)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"nn{i}"),
                 (F.coalesce(F.min(c) == F.max(c), F.lit(True))).alias(f"one{i}")]
        if _is_num(df, c):
            aggs.append(F.avg(F.col(c).cast("double")).alias(f"mu{i}"))
    row = df.agg(*aggs).first().asDict()
    n = row["__n"]
    mids = column_medians(df, [c for c in cols if _is_num(df, c)]) if medians else {}
    out = {}
    for i, c in enumerate(cols):
        out[c] = {"null_frac": (row[f"nn{i}"] / n) if n else 0.0, "at_most_one": row[f"one{i}"],
                  "mean": row.get(f"mu{i}"), "median": mids.get(c), "numeric": _is_num(df, c)}
    return out


def _distinct_le(df: DataFrame, cols: list[str], k: int) -> dict:
    """Exact ``count(distinct c) <= k`` per column without buffering
    unbounded sets: values are stacked, de-duplicated by a distributed
    groupBy (map-side combine) and counted per column."""
    if not cols:
        return {}
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                           for c in cols]))).where(F.col("v").isNotNull())
    nd = stacked.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("nd"))
    got = {r["column"]: r["nd"] for r in nd.collect()}
    return {c: got.get(c, 0) <= k for c in cols}


def _modes(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    return {r["column"]: r["mode"] for r in mode_profile(df, cols).collect()}


@dataclass
class MissingParams:
    drop_missing: list = field(default_factory=list)
    drop_unique: list = field(default_factory=list)
    fill: dict = field(default_factory=dict)        # column -> (method, value)
    mechanisms: dict = field(default_factory=dict)  # column -> MCAR/MAR/MNAR
    regression: dict = field(default_factory=dict)  # column -> (intercept, {pred: coef}, medians)
    nearest: dict = field(default_factory=dict)     # column -> predictors of a vote of the nearest rows
    reference: DataFrame | None = None              # the rows that vote

    def rows(self):
        """Long parameter rows: (column, action, fill_num, fill_str)."""
        out = [(c, "drop_missing", None, None) for c in self.drop_missing]
        out += [(c, "drop_unique", None, None) for c in self.drop_unique]
        for c, (m, v) in self.fill.items():
            if c in self.nearest:
                m = "fallback_" + m
            num = float(v) if isinstance(v, (int, float)) and v is not None else None
            out.append((c, f"impute_{m}", num, None if num is not None else v))
        for c, (b0, coefs, med) in self.regression.items():
            out.append((c, "impute_regression", float(b0), ",".join(sorted(coefs))))
            out += [(c, "coefficient", float(b), x) for x, b in coefs.items()]
            out += [(c, "predictor_median", None if med[x] is None else float(med[x]), x) for x in coefs]
        out += [(c, "impute_knn", None, ",".join(preds)) for c, preds in self.nearest.items()]
        return out

    def store(self):
        """All that is needed to build the parameters anew: ``rows`` and the mechanisms."""
        return self.rows() + [(c, "mechanism", None, m) for c, m in self.mechanisms.items()]

    @classmethod
    def restored(cls, rows, reference: DataFrame | None = None) -> MissingParams:
        """The parameters from their stored rows; votes need the reference rows again."""
        p = cls(reference=reference)
        for c, action, num, text in rows:
            if action in ("drop_missing", "drop_unique"):
                getattr(p, action).append(c)
            elif action == "impute_regression":
                p.regression[c] = (num, {}, {})
            elif action == "impute_knn":
                p.nearest[c] = text.split(",")
            elif action == "mechanism":
                p.mechanisms[c] = text
            elif action.startswith("impute_"):
                p.fill[c] = (action[7:].removeprefix("fallback_"), text if num is None else num)
        for c, action, num, text in rows:
            if action in ("coefficient", "predictor_median"):
                p.regression[c][1 if action == "coefficient" else 2][text] = num
        return p

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "column string, action string, fill_num double, fill_str string")


def fit_missing_simple(df: DataFrame, cols: list[str] | None = None, threshold_missing=0.70,
                       threshold_unique=1, threshold_impute=0.10) -> MissingParams:
    """Drop if null share > threshold_missing; then drop if distinct <=
    threshold_unique; then for 0 < null share < threshold_impute learn the
    mean (numeric) or mode (other). Columns in between are left alone."""
    cols = cols or df.columns
    st = _column_stats(df, cols)
    p = MissingParams()
    p.drop_missing = [c for c in cols if st[c]["null_frac"] > threshold_missing]
    rest = [c for c in cols if c not in p.drop_missing]
    if threshold_unique == 1:
        few = {c: st[c]["at_most_one"] for c in rest}
    else:
        few = _distinct_le(df, rest, threshold_unique)
    p.drop_unique = [c for c in rest if few[c]]
    rest = [c for c in rest if c not in p.drop_unique]
    to_impute = [c for c in rest if 0 < st[c]["null_frac"] < threshold_impute]
    modes = _modes(df, [c for c in to_impute if not st[c]["numeric"]])
    for c in to_impute:
        p.fill[c] = ("mean", st[c]["mean"]) if st[c]["numeric"] else ("mode", modes[c])
    return p


def transform_missing(df: DataFrame, p: MissingParams) -> DataFrame:
    """Drop learned columns, fill learned values and regressions by projection;
    then columns that the nearest training rows decide, by the filled values."""
    out = _projected(df, p)
    for c, preds in p.nearest.items():
        preds = [x for x in preds if x in out.columns]
        if c in out.columns and preds and p.reference is not None:
            out = knn_impute(out, c, preds, reference=_projected(p.reference, p))
        if c in out.columns and p.fill.get(c, (None, None))[1] is not None:  # no row to vote: the mode
            out = out.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(p.fill[c][1])))
    return out


def _projected(df: DataFrame, p: MissingParams) -> DataFrame:
    drop = set(p.drop_missing) | set(p.drop_unique)
    sel = []
    for c in df.columns:
        if c in drop:
            continue
        x = F.col(c)
        if c in p.regression:
            b0, coefs, med = p.regression[c]
            pred = F.lit(b0)
            for k, b in coefs.items():
                pred = pred + F.lit(b) * F.coalesce(F.col(k).cast("double"), F.lit(med[k]))
            x = F.coalesce(x.cast("double"), pred)
        elif c in p.fill and c not in p.nearest:
            v = p.fill[c][1]
            if v is not None:
                x = F.coalesce(x, F.lit(v).cast(df.schema[c].dataType))
        sel.append(x.alias(c))
    return df.select(*sel)


# ---------------------------------------------------------------- diagnostics
def little_mcar_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Simplified Little statistic over numeric ``cols``: patterns grouped by a
    null bitmask (one groupBy), overall mean/variance from one agg. Returns one
    row: statistic, dof, n_patterns."""
    pat = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    g = df.groupBy(pat.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}")
                                         for i, c in enumerate(cols)])
    tot = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"o{i}") for i, c in enumerate(cols)],
                 *[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    term = F.lit(0.0)
    for i, _ in enumerate(cols):
        o, v = tot[f"o{i}"], tot[f"v{i}"]
        if v is None or v <= 0 or o is None:
            continue
        term = term + F.when(F.col(f"m{i}").isNotNull(),
                             F.col("n") * F.pow(F.col(f"m{i}") - F.lit(o), 2) / F.lit(v)).otherwise(0.0)
    return g.agg(F.sum(F.when(F.col("n") > 1, term).otherwise(0.0)).alias("statistic"),
                 F.count(F.lit(1)).alias("n_patterns")).select(
        F.when(F.col("n_patterns") <= 1, F.lit(0.0)).otherwise(F.col("statistic")).alias("statistic"),
        F.greatest(F.lit(1), (F.col("n_patterns") - 1) * F.lit(len(cols))).cast("bigint").alias("dof"),
        "n_patterns")


def little_mcar_test(df: DataFrame, cols: list[str], alpha: float = 0.05) -> dict:
    cols = [c for c in cols if _is_num(df, c)]
    if not cols:  # no numeric column: a single pattern, nothing to test
        return {"statistic": 0.0, "dof": 1, "p_value": 1.0, "is_mcar": True}
    r = little_mcar_stats(df, cols).first()
    if r["n_patterns"] <= 1:
        return {"statistic": 0.0, "dof": int(r["dof"]), "p_value": 1.0, "is_mcar": True}
    p = chi2_sf(r["statistic"], r["dof"])
    return {"statistic": r["statistic"], "dof": int(r["dof"]), "p_value": p, "is_mcar": p > alpha}


def mar_ttest_stats(df: DataFrame, col: str, predictors: list[str]) -> DataFrame:
    """Pooled two-sample t statistic of each numeric predictor between rows
    where ``col`` is missing and rows where it is observed (one aggregation)."""
    miss = F.col(col).isNull()
    aggs = []
    for i, p in enumerate(predictors):
        x = F.col(p).cast("double")
        xm, xo = F.when(miss, x), F.when(~miss, x)
        aggs += [F.count(xm).alias(f"n1_{i}"), F.avg(xm).alias(f"m1_{i}"), F.var_samp(xm).alias(f"v1_{i}"),
                 F.count(xo).alias(f"n2_{i}"), F.avg(xo).alias(f"m2_{i}"), F.var_samp(xo).alias(f"v2_{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, p in enumerate(predictors):
        n1, n2 = F.col(f"n1_{i}").cast("double"), F.col(f"n2_{i}").cast("double")
        sp2 = ((n1 - 1) * F.col(f"v1_{i}") + (n2 - 1) * F.col(f"v2_{i}")) / (n1 + n2 - 2)
        t = (F.col(f"m1_{i}") - F.col(f"m2_{i}")) / F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
        rows.append(F.struct(F.lit(p).alias("predictor"), F.col(f"n1_{i}").alias("n_missing"),
                             F.col(f"n2_{i}").alias("n_observed"), t.alias("t_stat"),
                             (n1 + n2 - 2).cast("bigint").alias("dof")))
    return wide.select(F.inline(F.array(*rows))).where(
        (F.col("n_missing") > 0) & (F.col("n_observed") > 0))


def mar_chi2_stats(df: DataFrame, col: str, cat: str, yates: bool = True) -> DataFrame:
    """Chi-square of the contingency table category x missing(col); rows with
    a null category are excluded (crosstab semantics); Yates continuity
    correction when dof = 1 (scipy default). The table is pivoted by the flag
    in one groupBy (one row per category); margins come from one tiny agg.
    One output row: statistic, dof."""
    miss = F.col(col).isNull()
    ct = df.where(F.col(cat).isNotNull()).groupBy(F.col(cat).alias("cat")).agg(
        F.sum(miss.cast("long")).alias("o1"), F.sum((~miss).cast("long")).alias("o0"))
    t = ct.agg(F.sum("o0").alias("c0"), F.sum("o1").alias("c1"), F.count(F.lit(1)).alias("nr")).first()
    c0, c1, nr = t["c0"] or 0, t["c1"] or 0, t["nr"] or 0
    n = c0 + c1
    present = [(j, cj) for j, cj in ((0, c0), (1, c1)) if cj > 0]
    dof = (nr - 1) * (len(present) - 1)
    if n == 0 or dof <= 0:
        return ct.sparkSession.createDataFrame([(None, max(dof, 0))], "statistic double, dof bigint")
    term = F.lit(0.0)
    for j, cj in present:
        o = F.col(f"o{j}").cast("double")
        e = (F.col("o0") + F.col("o1")) * F.lit(float(cj)) / F.lit(float(n))
        d = e - o
        adj = o + F.signum(d) * F.least(F.lit(0.5), F.abs(d)) if (yates and dof == 1) else o
        term = term + F.pow(adj - e, 2) / e
    return ct.agg(F.sum(term).alias("statistic")).select("statistic", F.lit(dof).cast("bigint").alias("dof"))


def diagnose(df: DataFrame, col: str, observed: list[str], categorical: list[str] = (),
             mcar_cols: list[str] | None = None, alpha: float = 0.05) -> dict:
    """MCAR (Little) -> MAR (any t / chi-square p < alpha) -> MNAR.
    ``mcar_cols=None`` reproduces the single-column Little test (always
    MCAR); pass the numeric columns to make MAR/MNAR reachable."""
    little = little_mcar_test(df, mcar_cols or [col], alpha)
    out = {"column": col, "little_stat": little["statistic"], "little_dof": little["dof"],
           "little_p": little["p_value"], "significant": []}
    if little["is_mcar"]:
        out["mechanism"] = "MCAR"
        return out
    sig = []
    num = [p for p in observed if p != col]
    if num:
        for r in mar_ttest_stats(df, col, num).collect():
            if r["t_stat"] is not None and t_sf_two_sided(r["t_stat"], r["dof"]) < alpha:
                sig.append(r["predictor"])
    for c in categorical:
        if c == col:
            continue
        r = mar_chi2_stats(df, col, c).first()
        if r["statistic"] is not None and r["dof"] and chi2_sf(r["statistic"], r["dof"]) < alpha:
            sig.append(c)
    out["significant"] = sig
    out["mechanism"] = "MAR" if sig else "MNAR"
    return out


# ------------------------------------------------------------- imputations
def fit_ols(df: DataFrame, y: str, xs: list[str], fill: dict | None = None):
    """OLS with intercept over predictors (nulls by ``fill``; rows with a
    missing target, or a predictor that stays missing, are left out).
    Returns (intercept, {x: coef})."""
    return fit_regressions(df, {y: xs}, fill or {})[y]


def fit_regressions(df: DataFrame, targets: dict, fill: dict) -> dict:
    """OLS with intercept of each target on its predictors: column ->
    (intercept, {predictor: coef}). One matrix of moments serves all: a row
    counts in the group of every target that it holds, and each target's
    regression is its group's matrix swept over its predictors."""
    names = list(dict.fromkeys([x for xs in targets.values() for x in xs] + list(targets)))
    used = {x for xs in targets.values() for x in xs}
    cols = {c: F.col(f"`{c}`").cast("double") for c in names}
    filled = {c: F.coalesce(x, F.lit(float(fill[c]))) if c in used and fill.get(c) is not None else x for c, x in cols.items()}
    shift, scale = centres(df, list(filled.values()))
    groups = []
    for y, xs in targets.items():
        whole = cols[y].isNotNull()
        for x in xs:
            whole = whole & filled[x].isNotNull()
        groups.append(F.when(whole, F.lit(y)))
    # Columns of other targets may be null in a row: any value will do there.
    got = grouped_moments(df, [F.coalesce(x, F.lit(m)) for x, m in zip(filled.values(), shift)], shift, scale, F.array_compact(F.array(*groups)))
    # A target that is a predictor too is filled in the matrix: its own regression needs the rows that hold it, which its group has.
    out = {}
    for y, xs in targets.items():
        if y not in got:
            out[y] = (0.0, {x: 0.0 for x in xs})
            continue
        m = got[y]
        over, at = [names.index(x) for x in xs], names.index(y)
        w = swept(m.centred(), over)[over, at]
        coef = {x: float(b * scale[at] / scale[k]) for x, b, k in zip(xs, w, over)}
        mean = [shift[k] + scale[k] * v for k, v in enumerate(m.mean)]
        out[y] = (float(mean[at] - sum(coef[x] * mean[k] for x, k in zip(xs, over))), coef)
    return out


def fit_missing_advanced(df: DataFrame, cols: list[str] | None = None, threshold_drop=0.70,
                         threshold_simple=0.10, test_mechanism: bool = True,
                         mcar_cols: list[str] | None = None, categorical: list[str] = (),
                         max_tested: int | None = None, max_kept: int | None = None,
                         predictor_null_below: float = 0.3) -> MissingParams:
    """distinct <= 1 -> drop (tested first); null > threshold_drop -> drop;
    (threshold_simple, threshold_drop] -> diagnose, then median/mode (MCAR,
    MNAR), regression on significant predictors (MAR, numeric) or the vote of
    the nearest rows by them (MAR, other); (0, threshold_simple] -> mean/mode."""
    cols = cols or df.columns
    st = _column_stats(df, cols)
    p = MissingParams(reference=df)
    p.drop_unique = [c for c in cols if st[c]["at_most_one"]]
    rest = [c for c in cols if c not in p.drop_unique]
    p.drop_missing = [c for c in rest if st[c]["null_frac"] > threshold_drop]
    rest = [c for c in rest if c not in p.drop_missing]
    adv = [c for c in rest if threshold_simple < st[c]["null_frac"] <= threshold_drop]
    simple = [c for c in rest if 0 < st[c]["null_frac"] <= threshold_simple]
    modes = _modes(df, [c for c in adv + simple if not st[c]["numeric"]])
    for c in simple:
        p.fill[c] = ("mean", st[c]["mean"]) if st[c]["numeric"] else ("mode", modes[c])
    num_all = [c for c in cols if st[c]["numeric"]]
    targets = {}
    for c in adv:
        mech, preds = "MCAR", []
        if test_mechanism:
            cands = [x for x in num_all if x != c and st[x]["null_frac"] < predictor_null_below][:max_tested]
            d = diagnose(df, c, cands, categorical, mcar_cols)
            mech = p.mechanisms[c] = d["mechanism"]
            preds = [x for x in d["significant"] if x in num_all][:max_kept]
        if mech == "MAR" and preds:
            (targets if st[c]["numeric"] else p.nearest)[c] = preds
    mid = column_medians(df, list(dict.fromkeys([c for c in adv if st[c]["numeric"] and c not in targets] + [x for xs in targets.values() for x in xs])))
    for c, (b0, coefs) in (fit_regressions(df, targets, mid) if targets else {}).items():
        p.regression[c] = (b0, coefs, {x: mid[x] for x in coefs})
    for c in adv:
        if c not in targets:
            p.fill[c] = ("median", mid[c]) if st[c]["numeric"] else ("mode", modes[c])
    return p


def impute_median(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill ``cols`` with medians learned on ``train``."""
    med = column_medians(train, cols)
    return df.select(*[F.coalesce(F.col(c), F.lit(med[c]).cast(df.schema[c].dataType)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def impute_regression(train: DataFrame, df: DataFrame, col: str, predictor: str) -> DataFrame:
    """Single-predictor OLS fill using ``regr_slope``/``regr_intercept``."""
    r = train.agg(F.regr_slope(col, predictor).alias("b"), F.regr_intercept(col, predictor).alias("a")).first()
    pred = F.lit(r["a"]) + F.lit(r["b"]) * F.col(predictor).cast("double")
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), pred))
