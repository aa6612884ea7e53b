"""Registered queries: sources, quality checks, column handling, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from estima.operators import columns as C
from estima.operators import quality as Q
from estima.operators import split as L
from estima.plans import sqltext as S
from estima.plans.catalog import LI_KEY_SQL, q, scratch
from estima.plans.frames import LI_KEY, doc_labels, lineitem_frame
from estima.sources import csv as CSV
from estima.sources.inline import inline_source
from estima.sources.tables import load_report, scan_table

# ----------------------------------------------------------------- sources


@q("scan_table", f"SELECT {LI_KEY_SQL}, l_extendedprice, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def scan_table_q(spark, base):
    li = scan_table(spark, base, "lineitem", [*LI_KEY, "l_extendedprice", "l_shipdate"])
    return li.where(F.col("l_shipdate") >= F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))


@q("load_report", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def load_report_q(spark, base):
    return load_report(scan_table(spark, base, "lineitem"))


def _write_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


@q("scan_csv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def scan_csv_q(spark, base):
    path = _write_csv(scan_table(spark, base, "part"), scratch(spark, "part-csv"))
    return CSV.scan_csv(spark, path)


@q("score_csv_source", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def score_csv_source_q(spark, base):
    from pyspark.sql import types as T
    o = scan_table(spark, base, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    path = _write_csv(o, scratch(spark, "orders-csv"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderpriority", T.StringType()),
                           T.StructField("o_totalprice", T.DoubleType())])
    return CSV.score_csv_source(spark, path, schema)


@q("inline_source", "SELECT p_partkey, p_size, p_brand, p_retailprice FROM part")
def inline_source_q(spark, base):
    p = scan_table(spark, base, "part", ["p_partkey", "p_size", "p_brand", "p_retailprice"])
    req = p.select("p_partkey", F.concat_ws(",", F.concat(F.lit("p_size:"), F.col("p_size").cast("string")),
                                            F.concat(F.lit("p_brand:"), F.col("p_brand")),
                                            F.concat(F.lit("p_retailprice:"), F.col("p_retailprice").cast("string")))
                   .alias("request"))
    return inline_source(req, "request", {"p_size": "int", "p_brand": "string", "p_retailprice": "double"},
                         keep=["p_partkey"])


# ----------------------------------------------------------------- quality

@q("check_empty", "SELECT count(*) AS n_rows, count(*) = 0 AS is_empty FROM lineitem")
def check_empty_q(spark, base):
    return Q.check_empty(scan_table(spark, base, "lineitem"))


_DL_TEXT = {2: "text", 3: "lang", 4: "source", 6: "quality", 7: "toxic"}  # position: text column
_MISSING_SQL = S.DL + "\n" + "\nUNION ALL\n".join([
    *[f"SELECT doc_id, '{c}' AS column, {i} AS position, CASE WHEN {c} IS NULL THEN 'null' WHEN {c} = '' THEN 'blank' ELSE 'na' END AS kind "
      f"FROM dl WHERE {c} IS NULL OR {c} = '' OR {c} IN ({S.NA_LIST})" for i, c in _DL_TEXT.items()],
    "SELECT doc_id, 'n_chars', 5, 'null' FROM dl WHERE n_chars IS NULL"])


@q("check_missing_cells", "WITH " + _MISSING_SQL)
def check_missing_cells_q(spark, base):
    return Q.check_missing_cells(doc_labels(spark, base), ["doc_id"])


_MBC = "WITH " + S.DL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {i} AS position, "
    + (f"count(*) FILTER (WHERE {c} = '') AS n_blank, count(*) FILTER (WHERE {c} IN ({S.NA_LIST})) AS n_na, "
       if t == "s" else "CAST(0 AS BIGINT) AS n_blank, CAST(0 AS BIGINT) AS n_na, ")
    + f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    + (f"count(*) FILTER (WHERE {c} = '' OR {c} IN ({S.NA_LIST}) OR {c} IS NULL) AS n_missing FROM dl"
       if t == "s" else f"count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM dl")
    for i, (c, t) in enumerate([("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n"),
                                ("quality", "s"), ("toxic", "s")], start=1))


@q("missing_by_column", _MBC)
def missing_by_column_q(spark, base):
    return Q.missing_by_column(doc_labels(spark, base))


_MIXED = "WITH " + S.DL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(CASE WHEN {c} <> '' THEN {c} END) AS n_values, "
    f"count(try_cast(CASE WHEN {c} <> '' THEN {c} END AS DOUBLE)) AS n_numeric, "
    f"count(try_cast(CASE WHEN {c} <> '' THEN {c} END AS DOUBLE)) > 0 AND "
    f"count(try_cast(CASE WHEN {c} <> '' THEN {c} END AS DOUBLE)) < count(CASE WHEN {c} <> '' THEN {c} END) AS mixed FROM dl"
    for c in _DL_TEXT.values())


@q("check_mixed_types", _MIXED)
def check_mixed_types_q(spark, base):
    return Q.check_mixed_types(doc_labels(spark, base))


_ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_INFER = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {i} AS position, count(v) AS n_values, CASE WHEN count(v) = 0 THEN 'float' "
    f"WHEN count(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(v AS BIGINT) IS NOT NULL THEN 1 END) = count(v) THEN 'integer' "
    f"WHEN count(try_cast(v AS DOUBLE)) = count(v) THEN 'float' "
    f"WHEN count(CASE WHEN lower(v) IN ('true', 'false') THEN 1 END) = count(v) THEN 'boolean' ELSE 'text' END AS inferred_type "
    f"FROM (SELECT CAST({c} AS VARCHAR) AS v FROM orders)"
    for i, c in enumerate(_ORD_COLS, start=1))


@q("infer_types", _INFER)
def infer_types_q(spark, base):
    o = scan_table(spark, base, "orders", _ORD_COLS)
    return CSV.infer_types(o.select(*[F.col(c).cast("string").alias(c) for c in _ORD_COLS]))


@q("na_normalise", "WITH " + S.DL + " SELECT doc_id, " + ", ".join(
    f"CASE WHEN {c} IN ({S.NA_LIST}) OR {c} = '' THEN NULL ELSE {c} END AS {c}" for c in _DL_TEXT.values()) + ", n_chars FROM dl")
def na_normalise_q(spark, base):
    return CSV.na_normalise(doc_labels(spark, base))


@q("check_header", "SELECT 3 AS position, 5 AS n_columns UNION ALL SELECT 5, 5")
def check_header_q(spark, base):
    """Files of parts whose third and fifth header cells are blank."""
    part = scan_table(spark, base, "part").select("p_partkey", "p_name", F.col("p_brand").alias(" "), "p_size", F.col("p_type").alias("  "))
    path = scratch(spark, "part-hdr")
    part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return Q.check_header(spark, path).select("position", "n_columns").distinct()


@q("check_readable", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS n_malformed FROM orders""")
def check_readable_q(spark, base):
    """Orders written without quoting, every seventh key with one cell too many."""
    orders = scan_table(spark, base, "orders").withColumn("o_orderpriority", F.concat("o_orderpriority", F.when(
        F.col("o_orderkey") % 7 == 0, F.lit(",more")).otherwise(F.lit(""))))
    path = scratch(spark, "orders-rd")
    orders.write.option("header", True).option("quote", "\u0000").csv(path)
    return Q.check_readable(spark, path, sep=",").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_malformed").alias("n_malformed"))


# ----------------------------------------------------------------- columns

@q("project_columns", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def project_columns_q(spark, base):
    return C.project_columns(scan_table(spark, base, "orders"), ["o_orderkey", "o_totalprice", "o_orderpriority"])


@q("drop_columns", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def drop_columns_q(spark, base):
    return C.drop_columns(scan_table(spark, base, "part"), ["p_name", "p_type", "p_retailprice"],
                          protect=["p_retailprice"])


@q("rename_columns", "SELECT p_partkey AS part, p_brand AS brand, p_retailprice AS price FROM part")
def rename_columns_q(spark, base):
    p = scan_table(spark, base, "part", ["p_partkey", "p_brand", "p_retailprice"])
    return C.rename_columns(p, {"p_partkey": "part", "p_brand": "brand", "p_retailprice": "price"})


_SPARK_TYPE = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
               "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' "
               "ELSE lower(data_type) END")
_ROLE = ("CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') "
         "OR data_type LIKE 'DECIMAL%' THEN 'numeric' WHEN data_type IN ('VARCHAR', 'BOOLEAN') THEN 'categorical' "
         "ELSE 'ignored' END")
_LABEL = ("CASE WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') "
          "THEN 'numerical: integer' WHEN data_type IN ('FLOAT', 'DOUBLE') OR data_type LIKE 'DECIMAL%' "
          "THEN 'numerical: float' WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE " + _SPARK_TYPE + " END")
_COLS = "FROM information_schema.columns WHERE table_name = 'lineitem'"


@q("column_roles", f"SELECT column_name AS column, CAST(ordinal_position AS INTEGER) AS position, "
   f"{_SPARK_TYPE} AS data_type, {_ROLE} AS role {_COLS}")
def column_roles_q(spark, base):
    return C.column_roles(scan_table(spark, base, "lineitem"))


@q("schema_report", f"SELECT column_name AS column, CAST(ordinal_position AS INTEGER) AS position, "
   f"{_LABEL} AS type {_COLS}")
def schema_report_q(spark, base):
    return C.schema_report(scan_table(spark, base, "lineitem"))


@q("union_lists", f"SELECT column_name AS column, {_ROLE} AS role {_COLS} AND {_ROLE} IN ('numeric', 'categorical')")
def union_lists_q(spark, base):
    roles = C.column_roles(scan_table(spark, base, "lineitem"))
    return roles.where("role = 'numeric'").select("column", "role").unionByName(
        roles.where("role = 'categorical'").select("column", "role"))


# ----------------------------------------------------------------- split

@q("split_train_test", "WITH " + S.LM + f" SELECT {LI_KEY_SQL}, is_test FROM lm")
def split_train_test_q(spark, base):
    return lineitem_frame(spark, base).select(*LI_KEY, "is_test")


@q("union_rows", "WITH " + S.LM + f" SELECT {LI_KEY_SQL}, charge, is_test FROM lm WHERE NOT is_test "
   f"UNION ALL SELECT {LI_KEY_SQL}, charge, is_test FROM lm WHERE is_test")
def union_rows_q(spark, base):
    lf = lineitem_frame(spark, base).select(*LI_KEY, "charge", "is_test")
    return L.train_rows(lf).unionByName(L.test_rows(lf))


@q("kfold", "SELECT o_orderkey, CAST(" + S.bucket("concat_ws('|', o_orderkey, 'fold')", 3) + " AS INTEGER) AS fold FROM orders")
def kfold_q(spark, base):
    return L.kfold(scan_table(spark, base, "orders", ["o_orderkey"]), ["o_orderkey"], 3)


@q("permute_column", """
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey)), o_orderkey) AS r FROM orders),
b AS (SELECT o_totalprice, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, 'o_totalprice|0|0')), o_orderkey) AS r FROM orders)
SELECT a.o_orderkey, b.o_totalprice FROM a JOIN b ON a.r = b.r""")
def permute_column_q(spark, base):
    o = scan_table(spark, base, "orders", ["o_orderkey", "o_totalprice"])
    return L.permute_column(o, ["o_orderkey"], "o_totalprice", repeat=0, seed=0)
