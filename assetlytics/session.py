"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "assetlytics", cpus: int | str = "*",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Local session tuned for tests/bench; on a cluster the submitted
    configuration wins because ``getOrCreate`` reuses the active session."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the deployment, and a session
    without one is an error: executors' own disks are not shared. Only a
    ``local`` master gets a scratch folder (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="assetlytics-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if isinstance(spark, SparkSession):  # Dataset checkpoints go to the same folder
        spark.sparkContext.setCheckpointDir(d)
    return d


def app_id(spark: SparkSession) -> str:
    """Application id from the session conf (no SparkContext needed)."""
    return spark.conf.get("spark.app.id", None) or spark.conf.get("spark.app.name", "app")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


@contextmanager
def settings(spark: SparkSession, values: dict):
    """SQL settings that hold while the block runs; those before it come back."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application's written intermediate tables."""
    return shared_path(spark, f"scratch-{app_id(spark)}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back: the lineage is cut,
    and the files outlive a lost executor. ``drop_scratch`` deletes them."""
    spark = df.sparkSession
    path = os.path.join(scratch_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables, on whatever file system
    they are; frames that read them can't be evaluated afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
