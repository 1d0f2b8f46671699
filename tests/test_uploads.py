"""Encoded uploads against Python's own base64 and CSV, and what cannot be read."""

import base64
import csv
import io

from pyspark.sql.types import StructType

from assetlytics.operators import scoring as S
from assetlytics.sources.uploads import decode_uploads

SCHEMA = "asset_id bigint, gfa_total double, building_type_ref string"


def payload(text: bytes) -> str:
    return "data:text/csv;base64," + base64.b64encode(text).decode()


def decode(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "upload_id long, contents string")
    out = decode_uploads(df, StructType.fromDDL(SCHEMA), ["gfa_total", "building_type_ref"])
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[1] or 0))


def test_fields_against_csv_module(spark):
    rows = [["7", 'a "quoted", name', "1.5"], ["8", "two\nlines", "2"], ["9", "", ""], ["10", "é, ü", "1e3"]]
    f = io.StringIO()
    csv.writer(f, quoting=csv.QUOTE_ALL).writerows([["asset_id", "building_type_ref", "gfa_total"], *rows])
    got = decode(spark, payload(f.getvalue().encode()), payload("﻿extra,gfa_total,building_type_ref\n\nx, 4 ,Hotel\n".encode()))
    assert [r[1:] for r in got if r[0] == 0] == [
        (i + 1, None, int(a), float(g) if g else None, t or None) for i, (a, t, g) in enumerate(rows)]
    assert got[-1] == (1, 1, None, None, 4.0, "Hotel")


def test_what_cannot_be_read(spark):
    head = b"asset_id,gfa_total,building_type_ref\n"
    got = decode(spark, None, "", "no comma", "data:text/csv;base64,***", payload(b"\xff\xfe"), payload(b""), payload(b"asset_id,x\n1,2\n"), payload(head),
                 payload(head + b"1,2\n2,3,Hotel,4\n3,wide,Hotel\nx,1,Hotel\n4,5,Hotel"), payload(head + b'5,6,"open\n6,7,Hotel'))
    whole = {r[0]: r[1:] for r in got if r[1] is None}
    empty = (None,) * 3
    assert whole == {**{i: (None, "undecodable", *empty) for i in range(5)}, **{5: (None, "missing:gfa_total,building_type_ref", *empty),
                                                                               6: (None, "missing:gfa_total,building_type_ref", *empty)}}
    assert [r[1:] for r in got if r[0] == 8] == [(1, "fields", *empty), (2, "fields", *empty), (3, "value:gfa_total", *empty),
                                                 (4, "value:asset_id", *empty), (5, None, 4, 5.0, "Hotel")]
    assert not [r for r in got if r[0] == 7] and [r[1:] for r in got if r[0] == 9] == [(1, "fields", *empty)]


def test_long_upload_and_scores(spark):
    text = b"gfa_total,building_type_ref,asset_id\n" + b"".join(b'%d,"%s",%d\n' % (i, b"Hotel" if i % 2 else b"x" * 2000, i) for i in range(1, 3001))
    up = spark.createDataFrame([(1, payload(text)), (2, None)], "upload_id long, contents string")
    out = S.score_uploads(up, SCHEMA + ", energy_score double").collect()
    good = {r.asset_id: r.prediction for r in out if r.problem is None}
    assert len(good) == 3000 and all(p is not None for p in good.values())
    assert [(r.upload_id, r.prediction) for r in out if r.problem] == [(2, None)]
    assert S.score_uploads(up.where("false"), SCHEMA + ", energy_score double").count() == 0


def test_each_step_is_reckoned_once_a_record(spark):
    df = spark.createDataFrame([(1, "x")], "upload_id long, contents string")
    plan = decode_uploads(df, StructType.fromDDL(SCHEMA), ["gfa_total"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 3 and plan.count("try_cast(") == 2 and plan.count("replace(record_") == 1
