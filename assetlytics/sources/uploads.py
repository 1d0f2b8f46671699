"""Encoded uploads: a CSV file as base64 text in one column of a row.

Decoding is a projection and a generator, so it serves a batch and a stream
alike; every record of an upload becomes a row, and what cannot be read becomes
a row that says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: A record: text without line breaks, or quoted parts, which may hold some. Blank lines are no records.
_RECORD = r'((?:[^"\r\n]++|"[^"]*+(?:"|\z))++)'
#: A field, with the comma that ends it (one is appended to the record).
_FIELD = r'((?:[^",]++|"[^"]*+")*+),'


def encode_upload(text: Column | str, media_type: str = "text/csv") -> Column:
    """CSV text as a browser uploads it: media type, a comma, base64."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(f"data:{media_type};base64,"), F.base64(F.encode(text, "UTF-8")))


def _fields(record: Column) -> Column:
    """A record's fields: trimmed, without their quotes, doubled quotes as one."""
    def plain(f):
        f = F.trim(f)
        quoted = f.startswith('"') & f.endswith('"') & (F.length(f) >= 2)
        return F.when(quoted, F.replace(F.call_function("substring", f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_FIELD), F.lit(1)), plain)


def decode_uploads(df: DataFrame, schema: StructType, required: list[str], id_col: str = "upload_id",
                   payload_col: str = "contents") -> DataFrame:
    """One row per record: the id, ``line`` (1 is the first record after the
    header), ``problem`` and the schema's columns by the names in the header,
    in whatever order it has them; further columns are left out and absent ones
    are null, as are empty fields.

    ``problem`` is null for a good row. A record of another number of fields
    than the header gives ``fields``; a value that its type cannot hold gives
    ``value:<column>`` (the first such); both rows' columns are null. An upload
    that is no base64 text of UTF-8 gives one row ``undecodable`` (line null);
    one whose header lacks required columns one row ``missing:<columns>``, and
    an empty one lacks all of them. A null payload is undecodable. A line break
    inside quotes belongs to its field; a quote that nothing closes reaches to
    the end of the upload, and its record gives ``fields``. Rows that repeat an id are uploads of their own."""
    binary = F.try_to_binary(F.regexp_replace(F.regexp_extract(F.col(f"`{payload_col}`"), r"^[^,]*,([\s\S]*)$", 1), r"\s", ""), F.lit("base64"))
    has_comma = F.contains(F.col(f"`{payload_col}`"), F.lit(","))
    text = F.when(has_comma, F.try_validate_utf8(binary.cast("string")))
    records = F.regexp_extract_all(F.regexp_replace(text, "^\ufeff", ""), F.lit(_RECORD), F.lit(1))
    up = df.select(F.col(f"`{id_col}`").alias("upload_"), records.alias("records_"))
    up = up.withColumn("header_", F.when(F.size("records_") > 0, _fields(F.try_element_at("records_", F.lit(1)))).otherwise(F.array().cast("array<string>")))
    absent = F.array_except(F.array(*[F.lit(c) for c in required]).cast("array<string>"), F.col("header_"))
    whole = (F.when(F.col("records_").isNull(), "undecodable")
             .when(F.size(absent) > 0, F.concat(F.lit("missing:"), F.array_join(absent, ","))))
    body = F.when(F.size("records_") > 1, F.slice("records_", F.lit(2), F.greatest(F.size("records_") - 1, F.lit(0))))
    # where the header has a column is looked up once an upload; a text, a value and a problem are a projection each, so
    # that each is reckoned once a record and generated methods stay small enough to be compiled
    fields = list(enumerate(schema.fields))
    at = [F.array_position("header_", F.lit(f.name)).cast("int").alias(f"at{i}_") for i, f in fields]
    # an upload that fails as a whole is one row without a record
    rows = (up.withColumn("whole_", whole)
            .select("upload_", F.size("header_").alias("width_"), "whole_", *at,
                    F.posexplode(F.when(F.col("whole_").isNotNull(), F.array(F.lit(None).cast("string")))
                                 .otherwise(F.coalesce(body, F.array().cast("array<string>")))).alias("pos_", "record_")))
    rows = rows.withColumn("fields_", _fields(F.col("record_")))
    closed = F.length(F.replace(F.col("record_"), F.lit('"'), F.lit(""))) % 2 == F.length("record_") % 2
    rows = rows.withColumn("same_", closed & (F.size("fields_") == F.col("width_")))
    kept = ["upload_", "whole_", "pos_", "same_"]
    rows = rows.select(*kept, *[
        F.nullif(F.when(F.col("same_") & (F.col(f"at{i}_") > 0), F.try_element_at("fields_", F.greatest(F.col(f"at{i}_"), F.lit(1)))), F.lit(""))
        .alias(f"text{i}_") for i, _ in fields])
    texts = [f"text{i}_" for i, _ in fields]
    rows = rows.select(*kept, *texts, *[
        (F.col(f"text{i}_") if isinstance(f.dataType, StringType) else F.col(f"text{i}_").try_cast(f.dataType)).alias(f"value{i}_") for i, f in fields])
    bad = F.lit(None).cast("string")
    for i, f in reversed(fields):
        bad = F.when(F.col(f"text{i}_").isNotNull() & F.col(f"value{i}_").isNull(), F.lit(f"value:{f.name}")).otherwise(bad)
    rows = rows.withColumn("problem_", F.coalesce("whole_", F.when(~F.col("same_"), F.lit("fields")), bad))
    good = F.col("problem_").isNull()
    return rows.select(F.col("upload_").alias(id_col), F.when(F.col("whole_").isNull(), F.col("pos_") + 1).alias("line"),
                       F.col("problem_").alias("problem"), *[F.when(good, F.col(f"value{i}_")).alias(f.name) for i, f in fields])
