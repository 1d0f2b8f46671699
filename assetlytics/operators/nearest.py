"""Exact k-nearest-neighbour votes over whole tables.

Rows with equal coordinates collapse into one place with its number of rows
and its class counts. Places are dealt into a tree of grid cells: a cell that
holds more than LEAF places is split along its longest dimensions, so dense
regions get deep cells and empty ones none; every cell keeps its bounding box
and its number of rows. Queries go down the tree together, a level at a time: a
query's bound is the smallest distance within which the cells it still holds
are sure to have k rows, and cells that begin beyond it are left out. Only the
leaves that remain are joined with their places. No pair of all rows is made,
nothing is capped, and a hot cell is split by its count; bounds hold exactly in
floating point, because distances to boxes and places are summed alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.joins import checked_broadcast
from ..session import written

#: Places that a cell may hold without being split.
LEAF = 16
#: Halvings of a cell that is split.
SPLIT = 4
#: Neighbours that vote, and the coordinate of a missing predictor.
K = 5
MISSING = -1.0


def _coordinates(df: DataFrame, predictors: list[str], levels: dict) -> DataFrame:
    """``df`` with columns x0..: numbers as they are, strings as the place of
    their level in alphabetical order; missing values and unknown levels -1."""
    for i, p in enumerate(predictors):
        if p in levels:
            table = levels[p].select(F.col("level").alias(f"level{i}"), F.col("code").alias(f"x{i}"))
            df = df.join(checked_broadcast(table), F.col(f"`{p}`") == F.col(f"level{i}"), "left").drop(f"level{i}")
            df = df.withColumn(f"x{i}", F.coalesce(f"x{i}", F.lit(MISSING)))
        else:
            x = F.col(f"`{p}`").cast("double")
            df = df.withColumn(f"x{i}", F.coalesce(F.when(F.abs(x) < float("inf"), x), F.lit(MISSING)))
    return df


def level_codes(df: DataFrame, col: str) -> DataFrame:
    """(level, code): the distinct non-null strings in order, from 0. One row a
    level is all that meets in a task."""
    level = df.select(F.col(f"`{col}`").alias("level")).where("level IS NOT NULL").distinct()
    return level.select("level", (F.row_number().over(Window.orderBy("level")) - 1).cast("double").alias("code"))


def _halved(cells: DataFrame, d: int) -> DataFrame:
    """Columns h0..: how often each dimension of a cell is halved. SPLIT times
    the one whose parts are the longest (the first of equals)."""
    out = cells.withColumns({f"h{j}": F.lit(0) for j in range(d)})
    for _ in range(SPLIT):
        part = [(F.col(f"hi{j}") - F.col(f"lo{j}")) / F.pow(F.lit(2.0), F.col(f"h{j}")) for j in range(d)]
        out = out.withColumn("widest", F.array_max(F.array(*part)))
        pick = reduce(lambda rest, j: F.when(part[j] == F.col("widest"), j).otherwise(rest), reversed(range(d)), F.lit(-1))
        out = out.withColumn("pick", pick).withColumns({f"h{j}": F.col(f"h{j}") + (F.col("pick") == j).cast("int") for j in range(d)})
    return out.drop("widest", "pick")


def _child(d: int):
    """The part of its cell that a place falls into; the places at the ends of
    a halved dimension fall into different parts."""
    at = F.lit(0.0)
    for j in range(d):
        n, ext = F.pow(F.lit(2.0), F.col(f"h{j}")), F.col(f"hi{j}") - F.col(f"lo{j}")
        at = at * n + F.when(ext > 0, F.least(F.floor((F.col(f"x{j}") - F.col(f"lo{j}")) / ext * n), n - 1)).otherwise(0.0)
    return at.cast("int")


def _tree(places: DataFrame, d: int):
    """(levels, leaves): for each level the cells (cell, parent, rows, leaf,
    lo0.., hi0..), and the places with their leaf's level and cell. A split
    tells the ends of a dimension apart, so every cell gets smaller until it
    is a leaf; levels grow with the logarithm of the places, or of the ratio
    of the widest to the narrowest gap where they are very uneven."""
    xs = [f"x{j}" for j in range(d)]
    boxes = [F.min(x).alias(f"lo{j}") for j, x in enumerate(xs)] + [F.max(x).alias(f"hi{j}") for j, x in enumerate(xs)]
    levels, leaves = [], []
    active = places.select(*xs, "n", F.lit(0).cast("long").alias("parent"), F.lit(0).alias("child"))
    while True:
        cells = active.groupBy("parent", "child").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("places"), *boxes)
        cells = _halved(cells.withColumn("leaf", F.col("places") <= LEAF), d)
        cells = written(cells.withColumn("cell", F.monotonically_increasing_id()), "knn-cells")
        levels.append(cells.drop("child", "places", *[f"h{j}" for j in range(d)]))
        dealt = written(active.join(checked_broadcast(cells), ["parent", "child"]).select(
            *xs, "n", "cell", "leaf", F.when(~F.col("leaf"), _child(d)).alias("child")), "knn-places")
        leaves.append(dealt.where("leaf").select(*xs, "n", F.lit(len(levels) - 1).alias("level"), "cell"))
        if cells.where("NOT leaf").isEmpty():
            return levels, reduce(DataFrame.unionByName, leaves)
        active = dealt.where("NOT leaf").select(*xs, "n", F.col("cell").alias("parent"), "child")


def _square(terms):
    return reduce(lambda a, b: a + b, [t * t for t in terms])


def _within(df: DataFrame, k: int, reach: str, near: str) -> DataFrame:
    """Rows of each query whose ``near`` is within the smallest ``reach`` that
    holds k rows (all of them where there are fewer)."""
    far = Window.partitionBy("query").orderBy(reach)
    held = df.withColumn("held", F.sum("rows").over(far))
    bound = F.min(F.when(F.col("held") >= k, F.col(reach))).over(Window.partitionBy("query"))
    return held.withColumn("bound", F.coalesce(bound, F.lit(float("inf")))).where(F.col(near) <= F.col("bound")).drop("held")


def nearest_places(places: DataFrame, queries: DataFrame, d: int, k: int = K) -> DataFrame:
    """(query, x0.., dist): for each query (query, q0..) the places (x0.., n)
    of its k nearest rows and of all rows as far as the k-th; ``dist`` is the
    squared distance."""
    levels, leaves = _tree(places, d)
    qs = [f"q{j}" for j in range(d)]
    near = _square([F.greatest(F.col(f"lo{j}") - F.col(f"q{j}"), F.col(f"q{j}") - F.col(f"hi{j}"), F.lit(0.0)) for j in range(d)])
    far = _square([F.greatest(F.abs(F.col(f"q{j}") - F.col(f"lo{j}")), F.abs(F.col(f"q{j}") - F.col(f"hi{j}"))) for j in range(d)])
    state = ["query", *qs, "level", "cell", "leaf", "rows", "near", "far", "bound"]
    root = levels[0].drop("parent").first()  # one cell holds all
    front = queries.select("*", *[F.lit(v).alias(c) for c, v in root.asDict().items()])
    front = front.withColumns({"level": F.lit(0), "near": near, "far": far, "bound": F.lit(float("inf"))}).select(state)
    for i, cells in enumerate(levels[1:], 1):
        below = cells.withColumnsRenamed({"cell": "child", "leaf": "child_leaf", "rows": "child_rows"})
        split = front.where("NOT leaf").drop("leaf", "rows", "near", "far").join(checked_broadcast(below), F.col("cell") == F.col("parent"))
        split = split.select("query", *qs, F.lit(i).alias("level"), F.col("child").alias("cell"), F.col("child_leaf").alias("leaf"),
                             F.col("child_rows").alias("rows"), near.alias("near"), far.alias("far"), "bound").where("near <= bound")
        front = written(_within(front.where("leaf").unionByName(split), k, "far", "near"), "knn-front")
    at = leaves.withColumnsRenamed({"level": "of_level", "cell": "of_cell", "n": "rows"})
    pairs = front.drop("rows").join(at, (F.col("level") == F.col("of_level")) & (F.col("cell") == F.col("of_cell")))
    dist = _square([F.col(f"q{j}") - F.col(f"x{j}") for j in range(d)])
    pairs = pairs.select("query", *[f"x{j}" for j in range(d)], "rows", dist.alias("dist"), "bound").where("dist <= bound")
    return _within(pairs, k, "dist", "dist").drop("bound")


def knn_impute(df: DataFrame, col: str, predictors: list[str], k: int = K, reference: DataFrame | None = None) -> DataFrame:
    """``df`` with the nulls of ``col`` filled by the majority among the ``k``
    nearest rows of ``reference`` (default: ``df`` itself) that have a value,
    by Euclidean distance over the predictors as they stand; missing (or not
    finite) predictors count as -1, strings as the place of their level in alphabetical order.

    All rows as far away as the k-th vote too, so the order of rows can't
    change a result; equal votes go to the smallest class. Without predictors,
    or where no row of the reference has a value, nulls stay. Column names of
    ``df`` are kept; temporary ones are x0.., so those must be free."""
    if not predictors:
        return df
    reference = df if reference is None else reference
    known = reference.where(F.col(f"`{col}`").isNotNull())
    levels = {p: written(level_codes(reference, p), "knn-levels") for p in dict.fromkeys(predictors) if isinstance(reference.schema[p].dataType, StringType)}
    d = len(predictors)
    xs = [f"x{j}" for j in range(d)]
    votes = written(_coordinates(known, predictors, levels).groupBy(*xs, F.col(f"`{col}`").alias("class")).agg(F.count(F.lit(1)).alias("n")), "knn-votes")
    places = written(votes.groupBy(*xs).agg(F.sum("n").alias("n")), "knn-places")
    if places.isEmpty():
        return df
    gaps = _coordinates(df.where(F.col(f"`{col}`").isNull()), predictors, levels)
    queries = written(gaps.select(*[F.col(x).alias(f"q{j}") for j, x in enumerate(xs)]).distinct().withColumn("query", F.monotonically_increasing_id()), "knn-queries")
    near = written(nearest_places(places, queries, d, k), "knn-near")
    polled = near.select("query", *xs).join(votes, xs).groupBy("query", "class").agg(F.sum("n").alias("n"))
    won = polled.groupBy("query").agg(F.min(F.struct(-F.col("n"), F.col("class").alias("won"))).alias("best")).select("query", "best.won")
    answers = written(queries.join(won, "query").drop("query"), "knn-answers")
    on = reduce(lambda a, b: a & b, [F.col(f"x{j}") == F.col(f"q{j}") for j in range(d)])
    filled = gaps.join(checked_broadcast(answers), on, "left")
    out = [F.col("won").cast(df.schema[col].dataType).alias(c) if c == col else F.col(f"`{c}`") for c in df.columns]
    return df.where(F.col(f"`{col}`").isNotNull()).unionByName(filled.select(*out))
