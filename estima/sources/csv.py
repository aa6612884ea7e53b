"""CSV input: delimiter sniffing, NA tokens, one-pass type inference.

CSV is the reference's only input format. Spark's own ``inferSchema`` makes an
extra full pass per read and knows one null token; here the file is read once as
text columns, NA tokens become nulls, and one aggregate decides every column's
type (``infer_types``). The typed frame is a projection of the text frame, so the
whole thing stays lazy and distributed.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estima.functions.tokens import NA_TOKENS


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit_name(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"

# Delimiters tried by the sniffer, in order of preference.
DELIMITERS = (",", ";", "\t", "|")

_INT_PATTERN = r"^[+-]?[0-9]+$"
#: How a number is written: digits with a point and an exponent, or an infinity.
NUMBER_PATTERN = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI]nf(?:inity)?)$"
#: Bytes in which a header must end.
_MAX_HEADER_BYTES = 1 << 24


def sniff_delimiter(spark: SparkSession, path: str, n_lines: int = 20,
                    candidates: Sequence[str] = DELIMITERS) -> str:
    """The delimiter that splits the leading lines into the header's number (> 1) of
    fields most often; quoted cells are respected. Reads only ``n_lines`` lines (a
    ``limit`` on the text scan). A header that no candidate splits is one column (``,``);
    lines that no candidate splits alike raise ``ValueError``."""
    lines = [r["value"].lstrip("\ufeff") for r in spark.read.text(path).limit(n_lines).collect() if r["value"]]
    best, share, split = ",", 0.0, False
    for d in candidates:
        counts = [len(cells) for cells in csv.reader(lines, delimiter=d)]
        if counts and counts[0] > 1:
            split = True
            same = sum(c == counts[0] for c in counts) / len(counts)
            if same > share:
                best, share = d, same
    if split and share < 0.5:
        raise ValueError(f"no delimiter of {list(candidates)} splits the lines of {path} alike")
    return best


def _reader(spark: SparkSession, sep: str, multi_line: bool):
    """Quotes inside quoted cells are doubled; ``multi_line``: cells may hold line breaks
    (such files are read whole by one task each)."""
    return (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE"))


def header_cells(sep: str):
    """mapInPandas body: the header cells of each listed file, in order. A header ends at the first
    line break outside quotes; one that doesn't end within the limit raises."""
    limit = _MAX_HEADER_BYTES

    def header(stream) -> bytes:
        head, at, quoted = b"", 0, False
        while True:
            while (end := head.find(b"\n", at)) >= 0:
                quoted ^= head.count(b'"', at, end) % 2 == 1
                if not quoted:
                    return head[:end]
                at = end + 1
            if len(head) >= limit:
                raise ValueError(f"the header doesn't end within {limit} bytes")
            chunk = stream.read(1 << 16)
            if not chunk:
                return head
            head += chunk

    def run(batches):
        import csv
        import io

        import pandas as pd
        import pyarrow.fs as pafs
        for pdf in batches:
            out = []
            for file_path in pdf["file_path"]:
                # the library knows the object store under one scheme
                fs, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", file_path))
                with fs.open_input_stream(inner) as f:  # compression detected from the name
                    line = header(f).rstrip(b"\r").decode("utf-8", "replace").lstrip("\ufeff")
                out.append((file_path, next(csv.reader(io.StringIO(line, newline=""), delimiter=sep), []) if line else []))
            yield pd.DataFrame(out, columns=["file_path", "cells"])
    return run


def headers(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``(file_path, cells)``: the header of each file. Files are listed without reading
    them; each task then reads the first line of its files."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path"))
    return files.mapInPandas(header_cells(sep), "file_path string, cells array<string>")


def read_csv_text(spark: SparkSession, path: str, sep: str | None = None,
                  multi_line: bool = False) -> DataFrame:
    """All columns as text, header row taken as names; no inference pass.

    In a folder, files with the same names in another order are read by name, in one scan of all
    files whatever the number of orders: cells are read by position, and each file's header says
    which is which. Any file with other names raises ``ValueError``."""
    sep = sep or sniff_delimiter(spark, path)
    plain = _reader(spark, sep, multi_line).option("inferSchema", False)
    if spark.read.format("binaryFile").load(path).select("path").limit(2).count() < 2:
        return plain.csv(path)
    found = headers(spark, path, sep).where(F.size("cells") > 0).persist()
    try:
        kinds = found.groupBy("cells").agg(F.min("file_path").alias("example"), F.count("*").alias("n")).orderBy(F.col("n").desc(), "example").limit(2).collect()
        if len(kinds) <= 1:
            return plain.csv(path)
        names = kinds[0]["cells"]
        alike = F.sort_array("cells") == F.sort_array(F.array(*[F.lit(c) for c in names]))
        odd = found.where(~alike | (F.size(F.array_distinct("cells")) < F.size("cells"))).orderBy("file_path").first()
        if odd is not None:
            raise ValueError(f"{odd['file_path']} has other columns than {kinds[0]['example']}: {odd['cells']}, {names}")
    finally:
        found.unpersist()
    cells = [f"__c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    rows = _reader(spark, sep, multi_line).schema(schema).csv(path).select(F.array(*cells).alias("__cells"), F.col("_metadata.file_path").alias("__file"))
    # one narrow row a file; a file that holds most rows is split as any skewed join side
    order = headers(spark, path, sep).select(F.col("file_path").alias("__file"), F.col("cells").alias("__names"))
    met = rows.join(order, "__file")
    return met.select(*[F.get("__cells", F.array_position("__names", F.lit(c)).cast("int") - 1).alias(c) for c in names])


def na_normalise(df: DataFrame, columns: Sequence[str] | None = None,
                 tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text cells equal to an NA token (or empty) become null; other columns pass."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(columns) if columns is not None else string_cols
    out = []
    for c in df.columns:
        if c in targets and c in string_cols:
            col = F.col(_q(c))
            out.append(F.when(col.isin(list(tokens)) | (col == ""), F.lit(None))
                       .otherwise(col).alias(c))
        else:
            out.append(F.col(_q(c)))
    return df.select(*out)


def _number(v):
    """A text as a number; null unless it is written as one (``10d`` is a code, not a number)."""
    return F.when(v.rlike(NUMBER_PATTERN), v.try_cast("double"))


def infer_types(df: DataFrame) -> DataFrame:
    """One aggregate over text columns deciding ``integer``, ``float``, ``boolean``
    or ``text`` per column (pandas' choices). Result ``(column, position, n_values,
    inferred_type)``; a column without values is ``float`` (all-missing)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(_q(c))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(_INT_PATTERN) & v.try_cast("bigint").isNotNull(), 1)).alias(f"i{i}"),
            F.count(_number(v)).alias(f"d{i}"),
            F.count(F.when(F.lower(v).isin("true", "false"), 1)).alias(f"b{i}"),
        ]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, position int, n_values bigint, inferred_type string")
    wide = df.agg(*aggs)
    stack = ", ".join(f"{_lit_name(c)}, {df.columns.index(c) + 1}, "
                      f"n{i}, i{i}, d{i}, b{i}" for i, c in enumerate(cols))
    long = wide.selectExpr(
        f"stack({len(cols)}, {stack}) as (column, position, n_values, n_int, n_dbl, n_bool)")
    n = F.col("n_values")
    kind = (F.when(n == 0, F.lit("float"))
            .when(F.col("n_int") == n, F.lit("integer"))
            .when(F.col("n_dbl") == n, F.lit("float"))
            .when(F.col("n_bool") == n, F.lit("boolean"))
            .otherwise(F.lit("text")))
    return long.select("column", F.col("position").cast("int"), "n_values",
                       kind.alias("inferred_type"))


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to the inferred types (``try_cast``: never raises)."""
    out = []
    for c in df.columns:
        t, v = types.get(c), F.col(_q(c))
        if t == "boolean":
            v = F.lower(v).try_cast("boolean")
        elif t == "float":
            v = _number(v)
        elif t == "integer":
            v = v.try_cast("bigint")
        out.append(v.alias(c))
    return df.select(*out)


def scan_csv(spark: SparkSession, path: str, sep: str | None = None,
             tokens: Sequence[str] = NA_TOKENS, multi_line: bool = False) -> DataFrame:
    """Typed read of a CSV file or folder: text read, NA tokens to null, inferred
    types applied. The inference is one aggregate; its result (one row per column)
    is the only thing brought to the driver."""
    text = na_normalise(read_csv_text(spark, path, sep, multi_line), tokens=tokens)
    types = {r["column"]: r["inferred_type"] for r in infer_types(text).collect()}
    return apply_types(text, types)


def score_csv_source(spark: SparkSession, path: str, schema: T.StructType, sep: str | None = None,
                     tokens: Sequence[str] = NA_TOKENS, multi_line: bool = False) -> DataFrame:
    """Rows to score: the trained columns, found by name in the file's header (in any order,
    among any others), NA tokens null, cast without raising. A missing column raises."""
    text = read_csv_text(spark, path, sep, multi_line)
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}; it has {text.columns}")
    text = na_normalise(text.select(*[F.col(_q(f.name)) for f in schema.fields]), tokens=tokens)
    return text.select(*[(_number(F.col(_q(f.name))).cast(f.dataType) if isinstance(f.dataType, T.FractionalType)
                          and not isinstance(f.dataType, T.DecimalType)
                          else F.col(_q(f.name)).try_cast(f.dataType)).alias(f.name) for f in schema.fields])
