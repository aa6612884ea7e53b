"""Column roles, schema report, projections, renames, prediction column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def role_of(dt: T.DataType) -> str:
    """``numeric`` (any Spark numeric type), ``categorical`` (text, boolean) or
    ``ignored`` (dates, timestamps, binary, nested)."""
    if isinstance(dt, _NUMERIC):
        return "numeric"
    if isinstance(dt, (T.StringType, T.BooleanType)):
        return "categorical"
    return "ignored"


def split_roles(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns (in input order) among ``columns``."""
    wanted = list(columns) if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in wanted if role_of(types[c]) == "numeric"]
    cat = [c for c in wanted if role_of(types[c]) == "categorical"]
    return num, cat


def column_roles(df: DataFrame) -> DataFrame:
    """``(column, position, data_type, role)`` from the schema (no data read)."""
    rows = [(f.name, i + 1, f.dataType.simpleString(), role_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column string, position int, data_type string, role string")


def type_label(dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, _INTEGRAL):
        return "numerical: integer"
    if isinstance(dt, _NUMERIC):
        return "numerical: float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return dt.simpleString()


def schema_report(df: DataFrame) -> DataFrame:
    """Column -> readable type (``text``, ``numerical: integer``, ``numerical: float``)."""
    rows = [(f.name, i + 1, type_label(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, type string")


def parse_feature_list(text: str) -> list[str]:
    """``"a, b,c"`` -> ``["a", "b", "c"]`` (comma separated, trimmed, no blanks)."""
    return [p.strip() for p in text.split(",") if p.strip()]


def validate_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}; available: {df.columns}")
    return list(columns)


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns (validated); pruning reaches the scan."""
    return df.select(*validate_columns(df, columns))


def drop_columns(df: DataFrame, columns: Sequence[str], protect: Sequence[str] = ()) -> DataFrame:
    """Drop columns; any name in ``protect`` (the target) is never dropped."""
    keep = set(protect)
    return df.drop(*[c for c in columns if c not in keep])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def append_prediction(scored: DataFrame, original_columns: Sequence[str],
                      target: str | None = None, prediction_col: str = "prediction",
                      replace: bool = False) -> DataFrame:
    """Input columns plus the prediction. ``replace=True`` writes it under the
    target's name (replacing that column when present), as the batch scorer of the
    reference does; the default keeps a separate ``prediction`` column."""
    cols = [c for c in original_columns if not (replace and c == target)]
    out_name = target if (replace and target) else prediction_col
    return scored.select(*cols, F.col(prediction_col).alias(out_name))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (a null group is a group)."""
    q = ["`" + k.replace("`", "``") + "`" for k in keys]
    r = right.select(*[F.col(c).alias(f"__key_{i}__") for i, c in enumerate(q)],
                     *[F.col("`" + c.replace("`", "``") + "`") for c in right.columns if c not in keys])
    cond = None
    for i, c in enumerate(q):
        same = left[c].eqNullSafe(r[f"__key_{i}__"])
        cond = same if cond is None else cond & same
    return left.join(r, cond, how).drop(*[f"__key_{i}__" for i in range(len(keys))])
