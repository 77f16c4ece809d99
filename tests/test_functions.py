"""Scalar functions, accumulators, reshaping and algebra on small literals."""

import math

import hashlib
import random
import pytest
from pyspark.sql import functions as F

from collinea.functions import scalars
from collinea.operators import aggregates, algebra, reshape
from collinea.sources import cells as source
from collinea.sources.cells import Shape


def one(spark, column, **values):
    kinds = {float: "double", int: "bigint", str: "string", list: "array<double>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_tolerant_scalars(spark):
    v = F.col("v")
    for value, nonzero, low, rest in ((0.0, False, 0.0, 0.0), (1e-11, False, 0.0, 1e-11), (-2e-10, True, -1.0, None), (2.9999999999999, True, 3.0, 0.0), (2.5, True, 2.0, 0.5), (-2.5, True, -3.0, 0.5), (math.nan, False, None, None)):
        assert one(spark, scalars.is_nonzero(v), v=value) is nonzero
        if low is not None:
            assert one(spark, scalars.eps_floor(v), v=value) == low
        if rest is not None:
            assert one(spark, scalars.fractional(v), v=value) == pytest.approx(rest, abs=1e-15)
    assert one(spark, scalars.quantise(v), v=2.5e-10) == 3 and one(spark, scalars.quantise(v), v=-2.5e-10) == -3
    assert one(spark, scalars.quantise(v), v=1e12) is None
    assert one(spark, scalars.trim_all(F.col("s")), s="\t a b\n ") == "a b"
    assert one(spark, scalars.as_binary(F.col("n")), n=5) == "0b" + "101".rjust(63, "0")
    assert one(spark, scalars.as_binary(F.col("n")), n=-1) == "0b" + "1" * 63
    assert one(spark, scalars.tagged((F.col("n") > 3, F.lit("big")), (F.col("n") > 1, F.lit("mid"))), n=2) == "mid"


def test_accumulators(spark):
    values = F.col("v")
    assert one(spark, aggregates.tolerant_min(values), v=[1.0, 1.0 - 5e-11, 0.5]) == 0.5
    assert one(spark, aggregates.tolerant_min(values), v=[1.0, 1.0 - 5e-11]) == 1.0
    assert one(spark, aggregates.tolerant_max(values), v=[1.0, 1.0 + 5e-11]) == 1.0
    assert one(spark, aggregates.compensated_sum(values), v=[1.0] + [1e-16] * 1000) == pytest.approx(1 + 1e-13, abs=1e-16)
    df = spark.createDataFrame([(3, 2.0), (1, 2.0), (2, 8.0), (4, 8.0)], "k int, v double")
    row = df.agg(aggregates.arg_min(F.col("k"), F.col("v")), aggregates.arg_max(F.col("k"), F.col("v")), aggregates.geometric_mean(F.col("v")), aggregates.product_mean(F.col("v")), aggregates.exact_sum(F.col("v"))).first()
    assert (row[0], row[1]) == (1, 2) and row[2] == pytest.approx(4) and row[3] == pytest.approx(4) and row[4] == 20
    nothing = df.limit(0).agg(aggregates.geometric_mean(F.col("v")), aggregates.product_mean(F.col("v"))).first()
    assert tuple(nothing) == (1.0, 1.0)
    h = lambda rows: spark.createDataFrame(rows, "a int").agg(scalars.unordered_hash(F.col("a"))).first()[0]
    assert h([(1,), (2,), (3,)]) == h([(3,), (1,), (2,)]) != h([(1,), (2,)])


def dense(df, shape):
    out = [[0.0] * shape.width for _ in range(shape.height)]
    for r in df.collect():
        out[r.r][r.c] += r.v
    return out


def test_reshape_and_algebra(spark):
    a, shape = source.from_lists(spark, [[1, 2, 0], [0, 3, 4]])
    b, _ = source.from_lists(spark, [[1, 0, 1], [0, -3, 2]])
    assert dense(algebra.add(a, b), shape) == [[2, 2, 1], [0, 0, 6]]
    assert dense(algebra.subtract(a, b), shape) == [[0, 2, -1], [0, 6, 2]]
    assert dense(algebra.add_scaled(a, b, -2), shape) == [[-1, 2, -2], [0, 9, 0]]
    assert dense(algebra.matmul(a, reshape.transpose(b)), Shape(2, 2)) == [[1, -6], [4, -1]]
    assert dense(algebra.elementwise(a, b, F.greatest), shape) == [[1, 2, 1], [0, 3, 4]]
    assert dense(algebra.divide(algebra.scale(a, 4), 2), shape) == [[2, 4, 0], [0, 6, 8]]
    with pytest.raises(ZeroDivisionError):
        algebra.divide(a, 0)
    assert algebra.equal(a, a).first().equal and not algebra.equal(a, b).first().equal
    assert algebra.norm(a).first().norm == pytest.approx(30**0.5)
    assert algebra.nonzero_count(a).first().nonzeros == 4 and algebra.density(a, F.lit(2), F.lit(3)).first().density == pytest.approx(4 / 6)
    assert algebra.density(reshape.clear(a), F.lit(0), F.lit(0)).first().density is None
    stacked, tall = reshape.vstack([(a, shape), (b, shape)])
    assert dense(stacked, tall) == [[1, 2, 0], [0, 3, 4], [1, 0, 1], [0, -3, 2]]
    side, wide = reshape.hstack([(a, shape), (b, shape)])
    assert dense(side, wide) == [[1, 2, 0, 1, 0, 1], [0, 3, 4, 0, -3, 2]]
    with pytest.raises(ValueError):
        reshape.vstack([(a, shape), (b, Shape(2, 4))])
    assert dense(reshape.pad(a, shape, Shape(3, 4), 7.0), Shape(3, 4)) == [[1, 2, 0, 7], [0, 3, 4, 7], [7, 7, 7, 7]]
    with pytest.raises(ValueError):
        reshape.pad(a, shape, Shape(1, 3))
    with pytest.raises(IndexError):
        reshape.slice_cells(a, 0, 3, 0, 1, shape)
    assert dense(reshape.swap_slices(a, 0, 0, 1, 0, Shape(1, 3)), shape) == [[0, 3, 4], [1, 2, 0]]
    assert dense(reshape.assign_slice(a, reshape.slice_cells(b, 0, 1, 0, 2), 1, 1, Shape(1, 2)), shape) == [[1, 2, 0], [0, 1, 0]]
    grown, bigger = reshape.add_column(a, shape, spark.createDataFrame([(0, 9.0), (1, 0.0)], "r long, v double"))
    assert dense(grown, bigger) == [[1, 2, 0, 9], [0, 3, 4, 0]]
    assert dense(reshape.pop_column(a, shape)[0], Shape(2, 2)) == [[1, 2], [0, 3]]
    assert dense(source.constant(spark, Shape(2, 2), 3.0), Shape(2, 2)) == [[3, 3], [3, 3]]
    assert dense(source.unit(spark, Shape(2, 2), 1, 0), Shape(2, 2)) == [[0, 0], [1, 0]]
    assert reshape.element(a, 1, 2).first().v == 4 and reshape.element(a, 0, 2).first().v == 0
    assert source.shape_of(a) == shape and source.shape_of(source.empty(spark)) == Shape(0, 0)


def test_histogram(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (3, "a", 1.0)], "r long, c string, v double")
    assert [(r.nnz, r.n) for r in aggregates.nnz_histogram(cells, 3).orderBy("nnz").collect()] == [(1, 2), (2, 1), (3, 0)]
    rows = spark.range(1, 5).withColumnRenamed("id", "r")
    assert {(r.r, r.nnz) for r in aggregates.row_nnz(cells, rows).collect()} == {(1, 2), (2, 1), (3, 1), (4, 0)}
    assert [r.c for r in aggregates.most_frequent(cells, "c", 1).collect()] == ["a"]


def test_ordered_totals_merge_like_one_fold(spark):
    rng = random.Random(8)
    step = 0.6e-10
    rows = [("a", k, 1.0 - step * k) for k in range(300)]  # falls by less than the tolerance each time
    rows += [("b", k, rng.uniform(-5, 5)) for k in range(2000)] + [("c", 0, None), ("c", 1, 2.5)] + [("d", k, 1e16 if k == 0 else 1.0) for k in range(500)]
    want = {}
    for g in "abcd":
        values = [v for name, _, v in sorted(rows, key=lambda r: (r[0], r[1])) if name == g and v is not None]
        least = most = values[0]
        for v in values:
            least, most = v if v < least - 1e-10 else least, v if v > most + 1e-10 else most
        want[g] = (len(values), math.fsum(values), least, most)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "g string, k int, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r for r in aggregates.ordered_totals(df, "g", "k", "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g, (n, total, least, most) in want.items():
        assert (got[g].n, got[g].least, got[g].most) == (n, least, most) and got[g].total == pytest.approx(total, rel=1e-15)
    assert aggregates.ordered_totals(df.limit(0), "g", "k", "v").count() == 0


def test_product_with_a_hot_inner_key(spark):
    a = spark.createDataFrame([(k, k % 2 * 7, float(k + 1)) for k in range(40)], "r long, c long, v double")
    b = spark.createDataFrame([(k % 2 * 7, k, 2.0) for k in range(30)], "r long, c long, v double")
    want = {(i, j): (i + 1) * 2.0 for i in range(40) for j in range(30) if i % 2 == j % 2}
    for cells in (3, 1000):
        assert {(r.r, r.c): r.v for r in algebra.matmul(a, b, cells).collect()} == want


def test_portable_hashes(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "c int, v double")
    digest = hashlib.md5(b"1=20000000000").hexdigest()
    assert df.select(scalars.portable_hash(scalars.cell_text(F.col("c"), F.col("v")))).first()[0] == int(digest[:15], 16)
    cells = df.agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("cells"))
    assert cells.select(scalars.ordered_hash(F.col("cells"))).first()[0] == hashlib.md5(b"1=20000000000 2=").hexdigest()


def test_assigned_blocks_are_checked(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "r long, c long, v double")
    part = spark.createDataFrame([(0, 0, 5.0)], "r long, c long, v double")
    assert {tuple(r) for r in reshape.assign_slice(cells, part, 1, 1, Shape(1, 1), Shape(2, 2)).collect()} == {(0, 0, 1.0), (1, 1, 5.0)}
    with pytest.raises(IndexError):
        reshape.assign_slice(cells, part, 2, 0, Shape(1, 1), Shape(2, 2))
    wide = spark.createDataFrame([(0, 3, 5.0)], "r long, c long, v double")
    with pytest.raises(Exception, match="outside"):
        reshape.assign_slice(cells, wide, 0, 0, Shape(1, 1), Shape(2, 2)).collect()


def test_dense_factors_meet_by_panels(spark):
    """Few inner keys that most rows hold: no partial product is shuffled, and infinite cells keep their places."""
    rng = random.Random(8)
    a = {(r, c): float(rng.randint(-3, 3) or 1) for r in range(40) for c in range(7) if rng.random() < 0.8}
    b = {(c, f"k{x}"): float(rng.randint(-3, 3) or 1) for c in range(7) for x in range(30) if rng.random() < 0.8}
    table = lambda cells, kinds: spark.createDataFrame([(*at, v) for at, v in cells.items()], kinds)
    left, right = table(a, "r long, c long, v double"), table(b, "r long, c string, v double")
    want = {}
    for (r, c), v in a.items():
        for (c1, x), w in b.items():
            if c == c1:
                want[r, x] = want.get((r, x), 0.0) + v * w
    made = algebra.matmul(left, right, panel_rows=16)
    assert {(x.r, x.c): x.v for x in made.collect()} == {at: v for at, v in want.items() if v}
    assert "sum(" not in made._jdf.queryExecution().executedPlan().toString()
    odd = left.unionByName(spark.createDataFrame([(99, 0, float("inf"))], "r long, c long, v double"))
    assert {(x.r, x.c) for x in algebra.matmul(odd, right, panel_rows=16).collect() if x.r == 99} == {(99, x) for c, x in b if c == 0}


@pytest.mark.parametrize("sizes", [{}, {"panel_rows": 16, "panel_units": 3}])
def test_equal_rows_are_multiplied_once_and_written_in_runs(spark, tmp_path, sizes):
    """Forty kinds of rows, some hot: the product of the definition, a fraction of a byte a cell."""
    cells = {r: {c: float(1 + (r % 40 * (c + 3)) % 11) for c in range(5) if (r % 40 + c) % 7} for r in range(40 * (30 if not sizes else 2))}
    left = spark.createDataFrame([(r, c, v) for r, row in cells.items() for c, v in row.items()], "r long, c long, v double")
    made = algebra.matmul(left, left.select(F.col("c").alias("r"), F.concat(F.lit("x"), F.col("r").cast("string")).alias("c"), "v"), **sizes)
    made.write.parquet(str(tmp_path / "product"))
    found = spark.read.parquet(str(tmp_path / "product"))
    want = {(a % 40, b % 40): sum(v * cells[b][c] for c, v in cells[a].items() if c in cells[b]) for a in range(40) for b in range(40)}
    kind = found.groupBy((F.col("r") % 40).alias("a"), (F.substring("c", 2, 9).cast("long") % 40).alias("b")).agg(F.min("v"), F.max("v"), F.count("*"), F.count_distinct("r", "c")).collect()
    copies = (len(cells) // 40) ** 2
    assert {(x.a, x.b): tuple(x)[2:] for x in kind} == {k: (v, v, copies, copies) for k, v in want.items() if v}
    if not sizes:
        assert sum(part.stat().st_size for part in (tmp_path / "product").glob("*.parquet")) < 0.7 * found.count()


def test_quantise_rounds_as_a_decimal_does(spark):
    rng = random.Random(9)
    values = [0.0, -0.0, 5e-11, -5e-11, 4.9999999999999994e-11, 1.5e-10, -2.5e-10, math.nan, math.inf, -math.inf, 1e300, 9.3e8, -9.3e8, 922337203.6854775807, 450359.96273704955, None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(2000)] + [(rng.randint(-(10**7), 10**7) + 0.5) / 1e10 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.quantise(F.col("v")).alias("q"), F.round(F.col("v") * scalars.GRID).try_cast("bigint").alias("want"))
    assert df.filter("not (q <=> want)").collect() == []
    assert "round(" not in df.select("v", "q")._jdf.queryExecution().executedPlan().toString()
