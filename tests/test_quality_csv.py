import os

import pytest

from estima.operators import quality as Q
from estima.sources import csv as CSV


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


HEADER = "CPN,Weight,Region,Supplier,Size,Price\r\n"
ROWS = ["P-{0},{1},{2},Acme,{3},{4}\r\n".format(i, 2 + i % 30, ["North", "South", "East", "West"][i % 4],
                                               ["Small", "Standard", "Large"][i % 3], round(0.2 + i * 0.07, 2))
        for i in range(26)]


def test_scan_csv_infers_types_and_na_tokens(spark, tmp_dir):
    rows = list(ROWS)
    rows[5] = "#N/A,#N/A,North,Acme,Small,1.1\r\n"
    rows[6] = "#N/A,#N/A,South,Acme,Large,1.2\r\n"
    p = _write(f"{tmp_dir}/errors.csv", HEADER + "".join(rows))
    df = CSV.scan_csv(spark, p)
    types = dict(df.dtypes)
    assert types == {"CPN": "string", "Weight": "bigint", "Region": "string", "Supplier": "string",
                     "Size": "string", "Price": "double"}
    miss = {r["column"]: r["n_null"] for r in Q.missing_by_column(df).collect()}
    assert miss["CPN"] == 2 and miss["Weight"] == 2 and miss["Price"] == 0


@pytest.mark.parametrize("sep", [";", "\t", "|"])
def test_sniff_delimiter(spark, tmp_dir, sep):
    text = HEADER.replace(",", sep) + "".join(r.replace(",", sep) for r in ROWS[:5])
    p = _write(f"{tmp_dir}/d.csv", text)
    assert CSV.sniff_delimiter(spark, p) == sep
    assert CSV.scan_csv(spark, p).count() == 5


def test_check_empty_header_only(spark, tmp_dir):
    p = _write(f"{tmp_dir}/empty.csv", HEADER)
    df = CSV.read_csv_text(spark, p, ",")
    r = Q.check_empty(df).first()
    assert r["n_rows"] == 0 and r["is_empty"]
    with pytest.raises(Q.QualityError):
        Q.check_empty(df, strict=True)


def test_check_header_blank_position(spark, tmp_dir):
    p = _write(f"{tmp_dir}/hdr/a.csv", "CPN,Weight,,Supplier\n1,2,3,4\n")
    got = [(r["position"], r["n_columns"]) for r in Q.check_header(spark, p, ",").collect()]
    assert got == [(3, 4)]


def test_check_readable_malformed(spark, tmp_dir):
    p = _write(f"{tmp_dir}/bad.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12\n")
    r = Q.check_readable(spark, p, sep=",").first()
    assert r["n_rows"] == 4 and r["n_malformed"] == 2
    with pytest.raises(FileNotFoundError):
        Q.check_readable(spark, f"{tmp_dir}/missing.csv", sep=",")


def test_check_mixed_types(spark):
    df = spark.createDataFrame([("1", "a", "1.5"), ("x", "b", "2"), ("3", None, "")], "m string, t string, n string")
    got = {r["column"]: r["mixed"] for r in Q.check_mixed_types(df).collect()}
    assert got == {"m": True, "t": False, "n": False}
    with pytest.raises(Q.QualityError):
        Q.check_mixed_types(df, strict=True)


def test_check_missing_cells_kinds(spark):
    df = spark.createDataFrame([(1, "", 1.0), (2, "N/A", float("nan")), (3, None, None), (4, "ok", 2.0)],
                               "k int, s string, x double")
    got = sorted((r["k"], r["column"], r["position"], r["kind"]) for r in Q.check_missing_cells(df, ["k"]).collect())
    assert got == [(1, "s", 2, "blank"), (2, "s", 2, "na"), (2, "x", 3, "na"), (3, "s", 2, "null"), (3, "x", 3, "null")]


def test_infer_types_boolean_and_all_missing(spark):
    df = spark.createDataFrame([("true", None, "1"), ("False", None, "-2"), (None, None, "+3")], "b string, e string, i string")
    got = {r["column"]: r["inferred_type"] for r in CSV.infer_types(df).collect()}
    assert got == {"b": "boolean", "e": "float", "i": "integer"}


def test_check_header_folder_and_quotes(spark, tmp_dir):
    _write(f"{tmp_dir}/many/p1.csv", "a,b,c\n1,2,3\n")
    _write(f"{tmp_dir}/many/p2.csv", '"a","",c,""\n1,2,3,4\n')
    got = sorted((r["file_path"].rsplit("/", 1)[-1], r["position"], r["n_columns"])
                 for r in Q.check_header(spark, f"{tmp_dir}/many", ",").collect())
    assert got == [("p2.csv", 2, 4), ("p2.csv", 4, 4)]


def test_check_readable_unterminated_quote(spark, tmp_dir):
    p = _write(f"{tmp_dir}/q.csv", 'a,b,c\n1,"x,3\n4,5,6\n')
    r = Q.check_readable(spark, p, sep=",").first()
    assert r["n_malformed"] >= 1


def test_check_header_gzip(spark, tmp_dir):
    import gzip
    os.makedirs(f"{tmp_dir}/gz", exist_ok=True)
    with gzip.open(f"{tmp_dir}/gz/a.csv.gz", "wt") as f:
        f.write("x,,z\n1,2,3\n")
    got = [(r["position"], r["n_columns"]) for r in Q.check_header(spark, f"{tmp_dir}/gz", ",").collect()]
    assert got == [(2, 3)]


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_a_folder_of_very_many_header_orders_loses_no_file(spark, tmp_dir):
    import itertools
    names = ["a", "b", "c", "d", "e"]
    folder = os.path.join(tmp_dir, "orders with blanks")
    for i, order in enumerate(itertools.islice(itertools.permutations(names), 115)):
        write(folder, f"f {i}.csv", ",".join(order) + "\n" + ",".join(f"{c}{i}" for c in order) + "\n")
    rows = CSV.read_csv_text(spark, folder)
    assert sorted(rows.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in rows.collect()) == sorted(tuple(f"{c}{i}" for c in names) for i in range(115))
    write(folder, "z last.csv", "a,b,c,d,other\n1,2,3,4,5\n")
    with pytest.raises(ValueError, match="z%20last.csv|z last.csv"):
        CSV.read_csv_text(spark, folder)


def test_a_header_ends_outside_quotes(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "quoted")
    write(folder, "1.csv", '"a\nb",c\n1,2\n')
    write(folder, "2.csv", 'c,"a\nb"\n2,1\n')
    assert [r["cells"] for r in CSV.headers(spark, folder, ",").orderBy("file_path").collect()] == [["a\nb", "c"], ["c", "a\nb"]]
    rows = CSV.read_csv_text(spark, folder, ",", multi_line=True)
    assert [tuple(r) for r in rows.select("c", "`a\nb`").collect()] == [("2", "1"), ("2", "1")]


def test_a_header_beyond_the_limit_raises(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(CSV, "_MAX_HEADER_BYTES", 1000)
    folder = os.path.join(tmp_dir, "long")
    write(folder, "1.csv", ",".join(f"name{i}" for i in range(40_000)) + "\n")
    with pytest.raises(Exception, match="doesn't end within"):
        CSV.headers(spark, folder, ",").collect()
