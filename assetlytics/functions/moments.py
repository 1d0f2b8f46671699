"""Additive moments of many columns in one pass.

A group's count, sums and products are all that a linear fit or a correlation
needs, and they add up over tasks, folds and fractions: every fold's
complement, every prefix of a learning curve, every alpha of a grid comes from
one small table by additions and subtractions, not from another scan. Columns
are shifted and scaled first, so that the products are well-conditioned.
Tasks multiply Arrow batches with BLAS (an aggregate of hundreds of buffers
leaves generated code) and return a row per group; Spark adds the rows up."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds before it returns their sums.
HELD_GROUPS = 1024
ALL = "all"


@dataclass
class Moments:
    """Count, sums and products of scaled columns: (x - shift) / scale."""
    n: float
    total: np.ndarray
    gram: np.ndarray

    def __add__(self, o):
        return Moments(self.n + o.n, self.total + o.total, self.gram + o.gram)

    def __sub__(self, o):
        return Moments(self.n - o.n, self.total - o.total, self.gram - o.gram)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n if self.n else self.total

    def centred(self) -> np.ndarray:
        """Sums of products about the means."""
        return self.gram - np.outer(self.total, self.total) / self.n if self.n else self.gram


def _matrix(batch, p: int) -> np.ndarray:
    return np.column_stack([batch.column(f"x{j}").to_numpy(zero_copy_only=False).astype(np.float64) for j in range(p)])


def _grouped_task(p: int):
    upper = np.triu_indices(p)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["group", "sums"])

    def task(batches):
        held = {}
        for b in batches:
            x = _matrix(b, p)
            groups = b.column("group")  # an array of names: a row counts in each
            at = np.repeat(np.arange(b.num_rows), groups.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            names = groups.flatten().dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
            for k, name in enumerate(names.dictionary.to_pylist()):
                part = x[at[order[cuts[k]:cuts[k + 1]]]]
                sums = np.concatenate([[float(len(part))], part.sum(0), (part.T @ part)[upper]])
                held[name] = held[name] + sums if name in held else sums
            if len(held) > HELD_GROUPS:
                yield rows(held)
                held = {}
        yield rows(held)
    return task


def added(parts: DataFrame, key: str) -> dict:
    """Sums of the arrays ``sums``, place by place, for each value of ``key``."""
    places = parts.select(key, F.posexplode("sums").alias("place", "v")).groupBy(key, "place").agg(F.sum("v").alias("v"))
    out = {}
    for r in places.collect():
        out.setdefault(r[key], {})[r["place"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def scaled(cols: list, shift, scale) -> list:
    return [((c.cast("double") - F.lit(float(m))) / F.lit(float(s))).alias(f"x{j}") for j, (c, m, s) in enumerate(zip(cols, shift, scale))]


def grouped_moments(df: DataFrame, cols: list, shift, scale, group: Column | None = None) -> dict[str, Moments]:
    """Moments of the rows of each group, without rows that lack one of
    ``cols``. ``group`` is a string, or an array of strings where a row counts
    in several groups (None: one group, ``ALL``). A row a group comes to the
    driver, so groups must be few: folds, buckets, columns."""
    p = len(cols)
    group = F.lit(ALL) if group is None else group
    rows = df.select(group.alias("group"), *scaled(cols, shift, scale))
    if rows.schema["group"].dataType.typeName() != "array":
        rows = rows.withColumn("group", F.array("group"))
    rows = rows.dropna(subset=[f"x{j}" for j in range(p)])
    out, upper = {}, np.triu_indices(p)
    for name, s in added(rows.mapInArrow(_grouped_task(p), "group string, sums array<double>"), "group").items():
        gram = np.zeros((p, p))
        gram[upper] = s[1 + p:]
        out[name] = Moments(s[0], s[1:1 + p], gram + np.triu(gram, 1).T)
    return out


def swept(c: np.ndarray, over: list, tolerance: float = 1e-10) -> np.ndarray:
    """The matrix swept over some columns: their regression on each other taken
    out of the rest. Afterwards ``[over, t]`` holds the coefficients of a
    regression of column t on them; a column that the ones before it explain
    is left out (its coefficients are 0)."""
    c, start, out = c.astype(float).copy(), np.diag(c).copy(), []
    for k in over:
        d = c[k, k]
        if d <= tolerance * start[k] or d <= 0:
            out.append(k)
            continue
        row = c[k] / d
        c -= np.outer(c[:, k], row)
        c[k], c[:, k] = row, row
        c[k, k] = -1.0 / d
    c[out, :] = 0.0
    return c


def centres(df: DataFrame, cols: list) -> tuple[list, list]:
    """Means and population deviations of columns (0 and 1 where there is no
    value or no spread), for shifting and scaling."""
    row = df.agg(*[F.avg(c.cast("double")).alias(f"m{j}") for j, c in enumerate(cols)],
                 *[F.stddev_pop(c.cast("double")).alias(f"s{j}") for j, c in enumerate(cols)]).first()
    return [row[f"m{j}"] or 0.0 for j in range(len(cols))], [row[f"s{j}"] or 1.0 for j in range(len(cols))]


def _pairwise_task(p: int):
    def task(batches):
        total = np.zeros((4, p, p))
        for b in batches:
            x = _matrix(b, p)
            here = ~np.isnan(x)
            x, v = np.where(here, x, 0.0), here.astype(np.float64)
            total += np.stack([v.T @ v, x.T @ v, (x * x).T @ v, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([ALL]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part", "sums"])
    return task


def pairwise_moments(df: DataFrame, cols: list, shift, scale) -> np.ndarray:
    """Four matrices over the rows where columns i and j both have a value:
    rows, sums of i, sums of squares of i, sums of products. With nulls as
    zeros and a matrix of presence they are four products, for any pattern of
    nulls; the result has 4 p p numbers whatever the table's size."""
    p = len(cols)
    rows = df.select(*scaled(cols, shift, scale))
    got = added(rows.mapInArrow(_pairwise_task(p), "part string, sums array<double>"), "part")
    return got.get(ALL, np.zeros(4 * p * p)).reshape(4, p, p)


def correlations(df: DataFrame, cols: list) -> np.ndarray:
    """Pairwise-complete Pearson correlations, NaN where a pair has no spread.
    One pass for the centres and one for the products, for any number of columns."""
    n, s, q, prod = pairwise_moments(df, cols, *centres(df, cols))
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = prod - s * s.T / n
        var = q - s * s / n
        # A rest of rounding is no spread.
        var = np.where(var > 1e-12 * q, var, np.nan)
        return cov / np.sqrt(var * var.T)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
