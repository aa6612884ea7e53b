"""Input quality checks as violation tables (the reference aborts at the first).

Each check is a narrow projection or a single aggregate; ``strict=True`` turns a
non-empty result into an exception, which is the reference's behaviour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estima.functions.tokens import NA_TOKENS
from estima.sources.csv import _lit_name, _number, _q, _reader, headers, sniff_delimiter


class QualityError(ValueError):
    pass


def check_empty(df: DataFrame, strict: bool = False) -> DataFrame:
    """``(n_rows, is_empty)``; an input without data rows is a violation."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", (F.col("n_rows") == 0).alias("is_empty"))
    if strict and out.first()["is_empty"]:
        raise QualityError("input is empty")
    return out


def check_header(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Blank header cells per file: ``(file_path, position, n_columns)``, 1-based.

    Only the first line of each file is read, parsed as CSV (quotes respected). Work is
    spread over files, never the data."""
    sep = sep or sniff_delimiter(spark, path)
    cells = headers(spark, path, sep).select("file_path", F.size("cells").alias("n_columns"), F.posexplode("cells").alias("position", "cell"))
    return cells.where(F.trim("cell") == "").select("file_path", (F.col("position") + 1).alias("position"), "n_columns")


def _cell_kind(c: str, dt: T.DataType, tokens: Sequence[str]):
    v = F.col(_q(c))
    if isinstance(dt, T.StringType):
        return (F.when(v.isNull(), F.lit("null")).when(v == "", F.lit("blank"))
                .when(v.isin(list(tokens)), F.lit("na")))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(v.isNull(), F.lit("null")).when(F.isnan(v), F.lit("na"))
    return F.when(v.isNull(), F.lit("null"))


def check_missing_cells(df: DataFrame, key_cols: Sequence[str], columns: Sequence[str] | None = None,
                        tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Every missing cell: ``(key..., column, position, kind)`` with kind
    ``blank`` (''), ``na`` (NA token or NaN) or ``null``. Rows are identified by
    a key, not a line number (lines have no meaning in a distributed read).
    Narrow: an array of per-cell structs, filtered and exploded in place."""
    columns = [c for c in (columns or df.columns) if c not in key_cols]
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.columns.index(c) + 1).alias("position"),
                               _cell_kind(c, types[c], tokens).alias("kind")) for c in columns])
    return (df.select(*key_cols, F.filter(cells, lambda s: s["kind"].isNotNull()).alias("__cells"))
            .where(F.size("__cells") > 0)
            .select(*key_cols, F.inline("__cells")))


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None,
                      tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Column totals of ``check_missing_cells`` in one aggregate:
    ``(column, position, n_blank, n_na, n_null, n_missing)``."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(columns):
        k = _cell_kind(c, types[c], tokens)
        aggs += [F.count(F.when(k == "blank", 1)).alias(f"b{i}"), F.count(F.when(k == "na", 1)).alias(f"a{i}"),
                 F.count(F.when(k == "null", 1)).alias(f"n{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{_lit_name(c)}, {df.columns.index(c) + 1}, b{i}, a{i}, n{i}" for i, c in enumerate(columns))
    long = wide.selectExpr(f"stack({len(columns)}, {stack}) AS (column, position, n_blank, n_na, n_null)")
    return long.select("column", F.col("position").cast("int"), "n_blank", "n_na", "n_null",
                       (F.col("n_blank") + F.col("n_na") + F.col("n_null")).alias("n_missing"))


def check_mixed_types(df: DataFrame, columns: Sequence[str] | None = None,
                      strict: bool = False) -> DataFrame:
    """Text columns mixing numbers and words: ``(column, n_values, n_numeric, mixed)``;
    mixed when some but not all non-missing values parse as a number."""
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    columns = [c for c in (columns or text_cols) if c in text_cols]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_values bigint, n_numeric bigint, mixed boolean")
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(F.col(_q(c)) != "", F.col(_q(c)))
        aggs += [F.count(v).alias(f"v{i}"), F.count(_number(v)).alias(f"d{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{_lit_name(c)}, v{i}, d{i}" for i, c in enumerate(columns))
    out = wide.selectExpr(f"stack({len(columns)}, {stack}) AS (column, n_values, n_numeric)")
    out = out.withColumn("mixed", (F.col("n_numeric") > 0) & (F.col("n_numeric") < F.col("n_values")))
    if strict:
        bad = [r["column"] for r in out.where("mixed").collect()]
        if bad:
            raise QualityError(f"columns mix numbers and text: {bad}")
    return out


def check_readable(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   sep: str | None = None, strict: bool = False,
                   multi_line: bool = False) -> DataFrame:
    """Malformed rows per file: ``(file_path, n_rows, n_malformed)``.

    A missing path raises ``FileNotFoundError``. Rows are parsed PERMISSIVE against
    the header's column count; rows with a wrong field count or a broken quote land
    in the corrupt-record column and are counted."""
    from pyspark.errors import AnalysisException
    try:
        sep = sep or sniff_delimiter(spark, path)
        if schema is None:
            header = _reader(spark, sep, multi_line).csv(path).columns
            schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    except AnalysisException as exc:
        raise FileNotFoundError(str(exc)) from exc
    bad = "__corrupt"
    full = T.StructType(list(schema.fields) + [T.StructField(bad, T.StringType())])
    df = _reader(spark, sep, multi_line).option("columnNameOfCorruptRecord", bad).schema(full).csv(path)
    # every field is referenced: with CSV column pruning a row is only checked
    # against the columns a query reads (and the corrupt column alone is refused)
    # (an always-false test over all fields that the optimizer cannot fold away)
    touch_all = F.size(F.array_compact(F.array(*[F.col(_q(c)).cast("string") for c in schema.names]))) < 0
    out = (df.select(F.col("_metadata.file_path").alias("file_path"),
                     (F.col(bad).isNotNull() | touch_all).alias("bad"))
           .groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count(F.when(F.col("bad"), 1)).alias("n_malformed")))
    if strict and out.where("n_malformed > 0").limit(1).count():
        raise QualityError(f"malformed rows in {path}")
    return out
