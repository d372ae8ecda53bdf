"""Types, row numbers, failures and warnings of imported text files."""

import pytest

from quillspark.sources import tabular


@pytest.fixture
def csv(spark, tmp_path):
    def write(text, name="a.csv", encoding="utf-8"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return str(tmp_path / name)

    return write


def test_types_are_the_least_that_hold_all_values(spark, csv):
    columns = {
        "whole": ["1", "-2", "30"], "large": ["1", "12345678901", ""], "exact": ["1.5", "22", "1,234.25"], "float": ["1.5", "2e3", ".5"], "flag": ["true", "FALSE", "NA"], "day": ["2024-02-01", "", "2024-12-31"],
        "moment": ["2024-02-01", "2024-02-01 10:20", "2024-02-01T10:20:30Z"], "code": ["007", "12", "0"], "mixed": ["1", "x", "2"], "none": ["", "null", "-"], "share": ["5%", "6%", "7%"], "long": ["9" * 25, "1.25", "1"],
    }
    text = ";".join(columns) + "\n" + "\n".join(";".join(v[i] for v in columns.values()) for i in range(3)) + "\n"
    rows, report = tabular.import_csv(spark, csv(text), sep=";")
    found = {r.name: r for r in report.collect()}
    assert {n: r.type for n, r in found.items()} == {
        "whole": "int", "large": "bigint", "exact": "decimal(6,2)", "float": "double", "flag": "boolean", "day": "date", "moment": "timestamp", "code": "string", "mixed": "string", "none": "string", "share": "string",
        "long": "decimal(27,2)"}
    assert found["exact"].warnings == ["thousands separators"] and found["code"].warnings == ["leading zeros", "values of several kinds"][:1] and found["mixed"].warnings == ["values of several kinds"]
    assert found["none"].values == 0 and found["none"].without == 3 and found["moment"].warnings == ["dates with and without time"] and found["share"].warnings == ["per cent signs"]
    assert sum(r.failed for r in found.values()) == 0
    first = rows.orderBy("_row").first()
    assert (first._row, first.whole, str(first.exact), first.flag, str(first.day), first.code) == (1, 1, "1.50", True, "2024-02-01", "007")
    assert [str(r.exact) for r in rows.orderBy("_row").collect()] == ["1.50", "22.00", "1234.25"]


def test_rows_are_numbered_over_splits_and_files(spark, csv, tmp_path):
    n = 5000
    for name in ("a.csv", "b.csv"):
        csv("id,v\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(1, n + 1)), name)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, report = tabular.import_csv(spark, str(tmp_path / "*.csv"))
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2 * n and all(r._row == r.id for r in got) and len({r._source for r in got}) == 2
    assert {r.name: r.rows for r in report.collect()} == {"id": 2 * n, "v": 2 * n}


def test_no_row_is_lost(spark, csv):
    path = csv('id,price\n1,10.5\n2\n3,4,5\n4,"1,000.25"\n5,none\n6,\n7,�\n')
    rows, report = tabular.import_csv(spark, path, {"price": "decimal(10,2)"})
    got = {r._row: r for r in rows.collect()}
    assert len(got) == 7 and got[3]._bad_record == "3,4,5" and got[2]._bad_record == "2" and got[2].id is None
    assert str(got[4].price) == "1000.25" and got[5]._failed == ["price"] and got[5].price is None and got[6]._failed == []
    found = {r.name: r for r in report.collect()}
    assert (found["price"].rows, found["price"].values, found["price"].failed, found["price"].type) == (5, 4, 2, "decimal(10,2)")
    assert "encoding" in found["price"].warnings and "thousands separators" in found["price"].warnings
    look, counts = tabular.preview(rows, 3)
    assert [r._row for r in look.collect()] == [1, 2, 3] and tuple(counts.first()) == (7, 2, 2)


def test_headers_encodings_and_empty_files(spark, csv):
    assert tabular.header_of(spark, csv("a,,a\n1,2,3\n")) == ["a0", "_c1", "a2"]
    rows, _ = tabular.import_csv(spark, csv("name\nStraße\n", "l.csv", "latin-1"), encoding="ISO-8859-1")
    assert rows.first().name == "Straße"
    rows, report = tabular.import_csv(spark, csv("a,b\n", "e.csv"))
    assert rows.collect() == [] and all(r.rows == 0 for r in report.collect())
