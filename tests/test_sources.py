"""MPS files: one for each branch of the reader."""

import gzip

import pytest
from pyspark.sql import functions as F

from collinea.jobs import batch
from collinea.operators import near_parallel
from collinea.sources import mps

SPACED = """* a comment
NAME          small

ROWS
 N  cost
 L  lim1
 G  lim2
 E  eqn
 L  unused
 N  other
COLUMNS
    x  cost  1  lim1  1.5
    x  lim2  1
    M1  'MARKER'  'INTORG'
    y  lim1  2  eqn  -1e0
    y  other  5
    z  cost  3
    z  lim2  0
    w  eqn  7xyz
RHS
    rhs  lim1  4
ENDATA
    after  lim1  9
"""
WANT = {("lim1", "x", 1.5), ("lim2", "x", 1.0), ("lim1", "y", 2.0), ("eqn", "y", -1.0), ("eqn", "w", 7.0), ("cost", "x", 1.0), ("cost", "z", 3.0)}
FIXED = "\n".join(
    [
        "NAME          fixed",
        "ROWS",
        " N  cost",
        " L  lim one",
        "COLUMNS",
        "    x a       cost                 1   lim one            2.5",
        "ENDATA",
    ]
)


def found(df):
    return {(r.r, r.c, r.v) for r in df.collect()}


def test_space_separated(spark, tmp_path):
    path = tmp_path / "small.mps"
    path.write_text(SPACED)
    assert found(mps.read(spark, str(path))) == WANT
    assert found(mps.read(spark, str(path), objective="all")) == {x for x in WANT if x[0] != "cost"}
    assert {r.r for r in mps.row_dimension(spark, str(path)).collect()} == {"lim1", "lim2", "eqn", "unused"}
    zipped = tmp_path / "small2.mps.gz"
    zipped.write_bytes(gzip.compress(SPACED.encode()))
    assert found(mps.read(spark, str(zipped))) == WANT
    rows = batch.mps_summary(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all((r.height, r.width, r.cells) == (4, 4, 7) for r in rows)


def test_fixed_width(spark, tmp_path):
    path = tmp_path / "fixed.mps"
    path.write_text(FIXED)
    assert found(mps.read(spark, str(path), fixed_width=True)) == {("lim one", "x a", 2.5)}


@pytest.mark.parametrize("text", ["ROWS\n L  a\nOBJSENSE\n", " x  y  1\nROWS\n", "ROWS\n Q  a\nCOLUMNS\n    x  a  1\n", "ROWS\n L  a\nCOLUMNS\n    x  a  1  a  2  b  3\n", "ROWS\n L  a\nCOLUMNS\n    x  a  1\n    x  a  2\n"])
def test_errors(spark, tmp_path, text):
    path = tmp_path / "bad.mps"
    path.write_text(text)
    with pytest.raises(Exception):
        mps.read(spark, str(path)).collect()


@pytest.mark.parametrize("fixed", [False, True])
def test_written_text_is_read_again(spark, tmp_path, fixed):
    cells = spark.createDataFrame([("m", "a", "x", 1.0), ("m", "b", "x", -2.5), ("m", "b2", "x", 4.0), ("m", "b", "y", 3.0), ("n", "a", "x", 9.0)], "file string, r string, c string, v double")
    costs = spark.createDataFrame([("m", "x", 8.0), ("m", "z", 1.0)], "file string, c string, v double")
    mps.write(mps.text_lines(cells, costs, fixed, F.col("c") == "y"), str(tmp_path / "out"))
    got = mps.read(spark, str(tmp_path / "out"), fixed)
    assert {(r.file.split("=")[-1], r.r, r.c, r.v) for r in got.collect()} == {tuple(r) for r in cells.collect()}
    assert {(r.r, r.c, r.v) for r in mps.read(spark, str(tmp_path / "out" / "file=m"), fixed, objective="all").collect()} == {("a", "x", 1.0), ("b", "x", -2.5), ("b2", "x", 4.0), ("b", "y", 3.0)}


def test_a_split_file_gives_the_rows_of_the_whole_one(spark, tmp_path):
    body = [f"    x{k % 300}  r{k // 300}  {k + 1}" for k in range(3000)]
    text = "\n".join(["NAME big", "ROWS", " N  cost", *(f" L  r{k}" for k in range(10)), "COLUMNS", *body, "RHS", "    rhs  r1  5", "ENDATA", "    x1  r1  99"]) + "\n"
    (tmp_path / "big.mps").write_text(text)
    want = {(f"r{k // 300}", f"x{k % 300}", float(k + 1)) for k in range(3000)}
    assert found(mps.read(spark, str(tmp_path))) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
    try:
        assert mps.lines(spark, str(tmp_path)).select("split").distinct().count() > 20
        assert found(mps.read(spark, str(tmp_path))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_files_are_one_plan(spark, tmp_path):
    rows = [(f"f{k % n}", f"r{k}", f"c{j}", float(k % 4 + j)) for n in (3, 30) for k in range(60) for j in (1, 2, 3)]
    few, many = (spark.createDataFrame([x for x in rows if (int(x[0][1:]) < n)], "file string, r string, c string, v double").dropDuplicates(["file", "r", "c"]) for n in (3, 30))
    plans = [batch.file_summary(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (few, many)]
    assert plans[0] == plans[1]
    report = {row.file: row for row in batch.file_summary(many).collect()}
    assert len(report) == 30
    alone = many.filter("file = 'f0'").select("r", "c", "v")
    assert report["f0"].class_pairs == near_parallel.class_pairs(alone).count() > 0


def test_numbers_are_dense(spark):
    keys = spark.range(50).selectExpr("concat('k', id * 7 % 50) r").repartition(6)
    got = mps.numbered(keys.unionAll(keys), "r", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(50)) and [r.r for r in got] == sorted(r.r for r in got)
