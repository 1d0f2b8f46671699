"""File-stream scoring: equals batch scoring and, restarted on the same
checkpoint, appends only files it has not processed (exactly-once)."""

import tempfile

from pyspark.sql import functions as F

from assetlytics.operators import scoring as S
from assetlytics.streaming import run_to_completion


def test_stream_equals_batch_and_resumes(spark, asset_df):
    root = tempfile.mkdtemp(prefix="stream-test-")
    inbox, out, ckpt = f"{root}/inbox", f"{root}/out", f"{root}/ckpt"
    up = asset_df.select("asset_id", "gfa_total", S.map_segment("property_type").alias("building_type_ref"),
                         "energy_score")
    first = up.where(F.col("asset_id") % 2 == 0)
    second = up.where(F.col("asset_id") % 2 == 1)
    first.write.mode("append").parquet(inbox)
    res = run_to_completion(spark, inbox, out, ckpt)
    assert res.count() == first.count()
    second.write.mode("append").parquet(inbox)
    res = run_to_completion(spark, inbox, out, ckpt)
    assert res.count() == up.count()
    assert res.select("asset_id").distinct().count() == up.count()
    batch = S.batch_score(up).select("asset_id", F.col("prediction").alias("b"))
    diff = res.join(batch, "asset_id").where(F.col("prediction") != F.col("b")).count()
    assert diff == 0
