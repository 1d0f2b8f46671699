"""CSV / JSON sources and sinks with explicit schemas and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header line and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV source with a header and an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_csv_tolerant(spark: SparkSession, path: str, schema: StructType, target: str | None = None,
                      target_default: float = 0.0) -> DataFrame:
    """Tolerant CSV scan by Spark's reader: rows whose field count differs
    from the schema's and header lines are skipped, then rows with a number
    that does not parse; an empty target becomes ``target_default``. Fields may
    be quoted, with doubled quotes inside."""
    bad = "_bad_line"
    strings = StructType([StructField(f.name, StringType()) for f in schema.fields] + [StructField(bad, StringType())])
    raw = (spark.read.schema(strings).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("escape", '"')
           .option("columnPruning", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    header = F.lit(True)
    for f in schema.fields:
        header = header & F.col(f.name).eqNullSafe(F.lit(f.name))
    ok, cols = F.col(bad).isNull() & ~header, []
    for f in schema.fields:
        text = F.when(F.col(f.name) != "", F.col(f.name))
        if isinstance(f.dataType, NumericType):
            v = text.try_cast(f.dataType)
            ok = ok & (text.isNull() | v.isNotNull())
            text = F.coalesce(v, F.lit(target_default).cast(f.dataType)) if f.name == target else v
        cols.append(text.alias(f.name))
    return raw.where(ok).select(*cols)


def check_contract(df: DataFrame, required: list[str]) -> DataFrame:
    """Schema contract of an uploaded table: every required column present."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_preferred(spark: SparkSession, candidates: list[tuple[str, str, StructType | str]]) -> DataFrame:
    """First readable source of ``(format, path, schema)`` candidates (e.g. a
    CSV export preferred, a JSON document as fallback)."""
    from pyspark.errors import AnalysisException
    last = None
    for fmt, path, schema in candidates:
        try:
            reader = spark.read.schema(schema)
            df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
            df.schema  # resolves the path now: a missing source raises here
            return df
        except AnalysisException as e:
            last = e
    raise last if last else ValueError("no candidate source")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
