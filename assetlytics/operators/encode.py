"""Categorical encoders and scaling, fitted on train and applied as
projections / lookup joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup_join


@dataclass
class EncoderParams:
    onehot: dict = field(default_factory=dict)       # col -> sorted levels
    target: dict = field(default_factory=dict)       # col -> DataFrame(col, col_encoded)
    global_mean: float | None = None

    def rows(self):
        out = [(c, "onehot", lv, i == 0) for c, lvls in self.onehot.items() for i, lv in enumerate(lvls)]
        out += [(c, "target", None, False) for c in self.target]
        return out


def fit_encoder(df: DataFrame, cols: list[str], target: str | None = None,
                threshold: int = 10) -> EncoderParams:
    """<= threshold distinct values -> one-hot (levels sorted alphabetically,
    first dropped); otherwise target mean per category. One distinct-count
    pass routes all columns; levels of low-cardinality columns are collected
    (at most ``threshold`` each, so bounded)."""
    from .missing import _distinct_le
    cols = [c for c in cols if c in df.columns]
    few = _distinct_le(df, cols, threshold)
    p = EncoderParams()
    low = [c for c in cols if few[c]]
    if low:
        lv = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in low]).first()
        p.onehot = {c: list(lv[c]) for c in low}
    for c in cols:
        if c not in low and target:
            p.target[c] = df.groupBy(c).agg(F.avg(F.col(target).cast("double")).alias(f"{c}_encoded"))
    if target:
        p.global_mean = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return p


def onehot_columns(col: str, levels: list[str], drop_first: bool = True) -> list:
    """Indicator per kept level; unseen and NULL values -> all zeros."""
    use = levels[1:] if drop_first else levels
    return [F.coalesce((F.col(col).cast("string") == F.lit(lv)).cast("int"), F.lit(0)).alias(f"{col}_{lv}")
            for lv in use]


def transform_encoder(df: DataFrame, p: EncoderParams, global_mean: float | None = None) -> DataFrame:
    gm = p.global_mean if global_mean is None else global_mean
    keep = [c for c in df.columns if c not in p.onehot]
    dummies = [x for c, lv in p.onehot.items() if c in df.columns for x in onehot_columns(c, lv)]
    out = df.select(*keep, *dummies)
    for c, t in p.target.items():
        if c not in out.columns:
            continue
        out = lookup_join(out, t, c, "left")
        enc = F.coalesce(F.col(f"{c}_encoded"), F.lit(gm)) if gm is not None else F.col(f"{c}_encoded")
        out = out.withColumn(f"{c}_encoded", enc).drop(c)
    return out


def fit_standardize(df: DataFrame, cols: list[str], ddof: int = 0) -> dict:
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
               *[sd(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def transform_standardize(df: DataFrame, params: dict) -> DataFrame:
    """(x - mean) / std; a zero std scales by 1 (sklearn behaviour)."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s if s else 1.0)
                           for c, (m, s) in params.items()})
