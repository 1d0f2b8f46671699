"""Column-expression helpers. Everything here returns a ``Column`` built
from built-in functions, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dlit(v) -> Column:
    """Double literal (a bare ``1.0`` in Spark SQL is a DECIMAL)."""
    return F.lit(v).cast("double") if v is not None else F.lit(None).cast("double")


def safe_ratio(a, b, eps: float = 1e-6) -> Column:
    """a / (b + eps) with +-inf and NaN mapped to NULL."""
    q = F.try_divide(col_(a).cast("double"), col_(b).cast("double") + F.lit(eps))
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), dlit(None)).otherwise(q)


def clip(c, lo=None, hi=None) -> Column:
    """Null-preserving clip (``least``/``greatest`` on NULL return the bound)."""
    x = col_(c)
    y = x
    if lo is not None:
        y = F.greatest(y, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        y = F.least(y, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNull(), x.cast("double")).otherwise(y.cast("double"))


def floor_at(c, v: float = 0.0) -> Column:
    x = col_(c)
    return F.when(x.isNull(), x).otherwise(F.greatest(x, F.lit(v)))


def title_case(c) -> Column:
    """Strip all white space around, then a capital at the start of every run
    of letters and small letters after it, as ``str.strip().str.title()``."""
    low = F.lower(F.regexp_replace(col_(c), r"^\s+|\s+$", ""))
    runs = F.regexp_extract_all(low, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), "")


def value_map(c, mapping: dict, keep_other: bool = True) -> Column:
    """Replace values by a small fixed mapping (``Series.replace``)."""
    x = col_(c)
    if not mapping:
        return x
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(m[x], x) if keep_other else m[x]


def null_to_nan_free(c) -> Column:
    """NaN -> NULL at ingest (Spark orders NaN above every number)."""
    x = col_(c)
    return F.when(F.isnan(x), dlit(None)).otherwise(x)


def numeric_columns(schema: StructType, exclude=()) -> list[str]:
    return [f.name for f in schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def non_numeric_columns(schema: StructType, exclude=()) -> list[str]:
    return [f.name for f in schema.fields
            if not isinstance(f.dataType, NumericType) and f.name not in exclude]


def r(c, nd: int = 4) -> Column:
    """Round half-up to ``nd`` places as DOUBLE (stable value hash)."""
    return F.round(col_(c).cast("double"), nd)


def latin1_clean(c) -> Column:
    """Keep ASCII and the Latin-1 letters range, then strip surrounding whitespace."""
    kept = F.regexp_replace(col_(c).cast("string"), r"[^\x00-\x7F\xC0-\xFF]", "")
    return F.regexp_replace(kept, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def round_doubles(df, nd: int = 6):
    """Round every floating column (stable value hashes in result tables)."""
    from pyspark.sql.types import DoubleType, FloatType
    return df.select(*[F.round(F.col(f.name), nd).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
