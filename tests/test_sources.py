"""Reading of relation libraries, and rows of equal revision."""

from hopmill.operators import catalog as C
from hopmill.sources import readers as R


def test_relations_are_csv(spark, tmp_path):
    body = '\ufeffhead,tail,relation,label\n"a,1",b,of,father\n\n"say ""hi""", y,of,son\n"two\nlines",b,of,father\r\na,b,of\na,,of,father\n  \na,b,of,father,\n"",b,of,son\nlast,b,of,mother'
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "lib.csv").write_text(body, encoding="utf-8", newline="")
    rows, bad = R.read_relations(spark, f"file://{tmp_path}/x", True)
    assert sorted(map(tuple, rows.drop("file_path").collect())) == [(2, "a,1", "b", "of", "father"), (4, 'say "hi"', " y", "of", "son"), (5, "two\nlines", "b", "of", "father"), (11, "last", "b", "of", "mother")]
    assert sorted((r.check, int(r.key.rpartition(":")[2])) for r in bad.collect()) == [("bad_line", 6), ("bad_line", 7), ("bad_line", 8), ("bad_line", 9), ("bad_line", 10)]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "lib.csv").write_text("wrong,header,here,x\na,b,of,son\n")
    rows, bad = R.read_relations(spark, f"file://{tmp_path}/y", True)
    assert rows.count() == 1 and [r.check for r in bad.collect()] == ["bad_header"]


def test_csv_is_safe_for_spreadsheets(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "a"), (" +x", 'say "hi", you'), (None, "b")], "x string, y string")
    R.write_csv(df, f"file://{tmp_path}/out", ["x", "y"])
    back = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(f"file://{tmp_path}/out")
    assert {(r.x, r.y) for r in back.collect()} == {("'=1+1", "a"), ("' +x", 'say "hi", you'), (None, "b")}


def test_latest_of_equal_revisions(spark):
    df = spark.createDataFrame([("k", 2, "a"), ("k", 2, "b"), ("k", 1, "z")], "k string, revision int, value string")
    assert [tuple(r) for r in C.latest(df, ["k"]).collect()] == [("k", 2, "b")]
