"""Shared conventions of the registered queries (FIXTURES.md §4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.asset import SPLIT_MOD, TEST_BELOW, load_asset

# Split/fold rule shared by Spark plans and oracle SQL (see sources.asset).
N_FOLDS = 5

SQL_TRAIN = f"asset_id % {SPLIT_MOD} >= {TEST_BELOW}"
SQL_TEST = f"asset_id % {SPLIT_MOD} < {TEST_BELOW}"
SQL_FOLD = f"asset_id % {SPLIT_MOD} % {N_FOLDS}"

# Simulated target with signal (FIXTURES.md §4).
SQL_TARGET_SIM = "gfa_total / 1000.0 * (1.4 - 0.008 * coalesce(energy_score, 50.0)) + emissions / 10.0"


def asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_asset(spark, sf_dir)


def is_train():
    """The asset table's partition flag (= asset_id % 31 >= 6): filters on it
    prune partitions at the scan."""
    return F.col("is_train")


def fold_of(c="asset_id"):
    return (F.col(c) % SPLIT_MOD) % N_FOLDS


def target_sim():
    return (F.col("gfa_total") / F.lit(1000.0)
            * (F.lit(1.4) - F.lit(0.008) * F.coalesce(F.col("energy_score"), F.lit(50.0)))
            + F.col("emissions") / F.lit(10.0))
