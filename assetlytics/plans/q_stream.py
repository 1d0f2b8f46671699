"""Registered streaming query: file-stream scoring must equal
batch scoring on the same rows."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..session import app_id, shared_path
from ..sources.uploads import encode_upload
from ..streaming import UPLOAD_SCHEMA, run_to_completion, score_uploads_stream
from .common import asset
from .q_scoring import BASE_CTE, BATCH_PRED
from .registry import query


@query("stream_batch_score", BASE_CTE + f"SELECT asset_id, building_type_ref, {BATCH_PRED} AS prediction FROM sb")
def q_stream_batch_score(spark, sf_dir):
    """The asset table is dropped into an inbox as several upload files
    (hash-split on the key); the stream drains them in micro-batches."""
    # A fresh inbox/sink/checkpoint per call: re-running the query must not
    # resume an earlier stream's offsets.
    tag = hashlib.sha1(f"{app_id(spark)}|{sf_dir}|{uuid.uuid4()}".encode()).hexdigest()[:12]
    inbox, out, ckpt = (shared_path(spark, f"stream_{tag}_{x}") for x in ("inbox", "out", "ckpt"))
    up = asset(spark, sf_dir).select("asset_id", "gfa_total", S.map_segment("property_type").alias("building_type_ref"),
                                     "energy_score")
    up.write.mode("overwrite").parquet(inbox)
    res = run_to_completion(spark, inbox, out, ckpt)
    return res.select("asset_id", "building_type_ref", "prediction")


# Asset ids of one upload; every fifth upload lacks the area, some records have a field too many or a score that is no number.
UPLOAD_IDS = 1000
UPLOAD_SQL = BASE_CTE + f"""
, u AS (SELECT *, asset_id // {UPLOAD_IDS} AS upload_id, {BATCH_PRED} AS pred FROM sb)
SELECT upload_id, CASE WHEN asset_id % 97 > 0 AND asset_id % 89 > 0 THEN asset_id END AS asset_id,
       CASE WHEN asset_id % 97 = 0 THEN 'fields' WHEN asset_id % 89 = 0 THEN 'value:energy_score' END AS problem,
       CASE WHEN asset_id % 97 > 0 AND asset_id % 89 > 0 THEN pred END AS prediction
FROM u WHERE upload_id % 5 <> 3
UNION ALL SELECT DISTINCT upload_id, CAST(NULL AS BIGINT), 'missing:gfa_total', CAST(NULL AS DOUBLE) FROM u WHERE upload_id % 5 = 3"""


def encoded_uploads(spark, sf_dir):
    """The asset table as encoded CSV uploads, whose headers differ in order."""
    up = asset(spark, sf_dir).select("asset_id", "gfa_total", S.map_segment("property_type").alias("kind"), "energy_score")
    up = up.withColumn("upload_id", F.floor(F.col("asset_id") / UPLOAD_IDS))
    i, area, kind = F.col("asset_id").cast("string"), F.col("gfa_total").cast("string"), F.concat(F.lit('"'), F.replace(F.col("kind"), F.lit('"'), F.lit('""')), F.lit('"'))
    score = F.when(F.col("asset_id") % 89 == 0, F.lit("none yet")).otherwise(F.coalesce(F.col("energy_score").cast("string"), F.lit("")))
    more = F.when(F.col("asset_id") % 97 == 0, F.lit(",x")).otherwise(F.lit(""))
    odd = F.col("upload_id") % 2 == 1
    line = F.concat(F.when(odd, F.concat_ws(",", kind, i, score, area)).otherwise(F.concat_ws(",", i, area, kind, score)), more)
    area_name = F.when(F.col("upload_id") % 5 == 3, F.lit("area")).otherwise(F.lit("gfa_total"))
    header = F.when(odd, F.concat_ws(",", F.lit("building_type_ref,asset_id,energy_score"), area_name)).otherwise(
        F.concat(F.lit("asset_id,"), area_name, F.lit(",building_type_ref,energy_score")))
    # a list holds the records of UPLOAD_IDS ids at most
    return (up.select("upload_id", line.alias("line")).groupBy("upload_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
            .select("upload_id", encode_upload(F.concat(header, F.lit("\r\n"), F.array_join("lines", "\r\n"))).alias("contents")))


@query("upload_encoded_score", UPLOAD_SQL)
def q_upload_encoded_score(spark, sf_dir):
    """Encoded uploads, decoded and scored as one batch."""
    return S.score_uploads(encoded_uploads(spark, sf_dir), UPLOAD_SCHEMA)


@query("stream_upload_score", UPLOAD_SQL)
def q_stream_upload_score(spark, sf_dir):
    """The same uploads through the file stream."""
    tag = uuid.uuid4().hex[:12]
    inbox, out, ckpt = (shared_path(spark, f"uploads_{tag}_{x}") for x in ("inbox", "out", "ckpt"))
    encoded_uploads(spark, sf_dir).write.parquet(inbox)
    res = run_to_completion(spark, inbox, out, ckpt, score_uploads_stream)
    return res.select("upload_id", "asset_id", "problem", "prediction")
