"""Distances and the near-parallel search: given vectors, differential and property tests."""

import random

import pytest
from pyspark.sql import functions as F

from collinea.operators import distance, meeting, near_parallel, report, reshape
from collinea.sources import cells as source
from collinea.sources.workspace import cut

VECTORS = [
    ("0:1 1:1 2:1", "0:3 1:3 2:3", 0),
    ("0:1 1:1 2:1 3:3", "0:3 1:3 2:3", 1),
    ("0:1 1:1 2:1 5:1", "0:3 1:3 3:2 5:3", 2),
    ("0:1 1:1", "3:2 5:3", 4),
    ("", "3:2 5:3", 2),
    ("0:1 2:2 3:3", "0:1", 2),
]
MAJORITY = [("0:1 1:1 2:1", "0:1 1:1 2:1 4:1", 1), ("0:1 1:1 2:1 5:6", "0:1 1:1 2:1 4:1", 2)]


def row(text):
    return [(int(c), float(v)) for c, v in (pair.split(":") for pair in text.split())]


def test_distance_vectors(spark):
    kind = "array<struct<c:long,v:double>>"
    both = [(row(a), row(b), d) for x, y, d in VECTORS for a, b in ((x, y), (y, x))]
    df = spark.createDataFrame(both, f"x {kind}, y {kind}, want int")
    assert all(r.got == r.want for r in df.select("want", distance.hamming(F.col("x"), F.col("y")).alias("got")).collect())
    df = spark.createDataFrame([(row(a), row(b), d) for a, b, d in MAJORITY], f"x {kind}, y {kind}, want int")
    assert all(r.got == r.want for r in df.select("want", distance.majority_hamming(F.col("x"), F.col("y")).alias("got")).collect())
    df = spark.createDataFrame([(row("0:2 1:4 3:1"), row("0:1 1:2 2:5"))], f"x {kind}, y {kind}")
    assert df.select(distance.hamming_fixed_ratio(F.col("x"), F.col("y"), F.lit(2.0))).first()[0] == 2


def brute(rows, d):
    out = set()
    for i in rows:
        for j in rows:
            if i < j:
                x, y = rows[i], rows[j]
                common = [c for c in x if c in y]
                best = max((sum(abs(x[c] - y[c] * x[a] / y[a]) <= 1e-10 for c in common) for a in common), default=0)
                far = len(x) + len(y) - len(common) - best
                if far <= d:
                    out.add((i, j, far))
    return out


def matrix(seed, height=60, width=14):
    rng = random.Random(seed)
    base = [{c: rng.choice([1.0, 2.0, 3.0, -4.0, 0.5]) for c in rng.sample(range(width), rng.randint(1, 9))} for _ in range(12)]
    rows = {}
    for k in range(height):
        scale = rng.choice([1.0, 2.0, -4.0])
        made = {c: v * scale for c, v in rng.choice(base).items()}
        for _ in range(rng.randint(0, 2)):
            c = rng.randrange(width)
            if rng.random() < 0.4:
                made.pop(c, None)
            else:
                made[c] = scale * rng.choice([1.0, 5.0, 7.0])
        rows[k] = made or {0: 1.0}
    return rows


def as_cells(spark, rows):
    return spark.createDataFrame([(r, c, v) for r, cells in rows.items() for c, v in cells.items()], "r long, c long, v double")


def pairs(df):
    return {(r.i, r.j, r.distance) for r in df.collect()}


@pytest.mark.parametrize("d", [1, 2])
def test_blocked_equals_exhaustive(spark, d):
    rows = matrix(d)
    cells = as_cells(spark, rows)
    want = brute(rows, d)
    assert len(want) > 10 * d
    assert pairs(near_parallel.exhaustive(cells, d)) == want
    assert pairs(near_parallel.blocked(cells, d)) == want


def test_scale_and_column_order_change_nothing(spark):
    rows = matrix(7, 30)
    rng = random.Random(1)
    names = list(range(14))
    rng.shuffle(names)
    other = {r: {names[c]: v * (1.0, 2.0, -0.5)[r % 3] for c, v in cells.items()} for r, cells in rows.items()}
    assert pairs(near_parallel.blocked(as_cells(spark, other), 2)) == brute(rows, 2)
    assert pairs(near_parallel.blocked(as_cells(spark, rows), 2, groups=6, small=5)) == brute(rows, 2)


def test_arguments_are_checked(spark):
    cells = as_cells(spark, {0: {0: 1.0}})
    for bad in ({"d": 0}, {"d": 2, "groups": 2}, {"d": 2, "small": 3}):
        with pytest.raises(ValueError):
            near_parallel.candidate_pairs(cells, **bad)


def test_groups_and_difference(spark):
    rows = {k: cells for k, cells in matrix(3, 40).items() if len(cells) <= 6}
    cells = as_cells(spark, rows)
    found = near_parallel.normalise_pairs(spark.createDataFrame([], "i long, j long"), near_parallel.short_row_groups(cells))
    short = {(i, j) for i, j, _ in brute({k: c for k, c in rows.items() if len(c) <= 6}, 2) if min(len(rows[i]), len(rows[j])) <= 4}
    assert short <= {(r.i, r.j) for r in found.collect()}
    left = spark.createDataFrame([(1, 2), (3, 2), (4, 5)], "i long, j long")
    right = spark.createDataFrame([(2, 1), (9, 9)], "i long, j long")
    assert {(r.i, r.j) for r in near_parallel.pairs_difference(left, right).collect()} == {(2, 3), (4, 5)}


def test_empty_rows_and_reports(spark):
    cells, shape = source.from_lists(spark, [[1, 0, 2], [0, 0, 0], [3, 1e-11, 6]])
    assert (shape.height, shape.width) == (3, 3) and cells.count() == 4
    assert pairs(near_parallel.blocked(cells)) == {(0, 2, 0)}
    assert near_parallel.blocked(reshape.clear(cells)).count() == 0
    text = report.pair_report(near_parallel.blocked(cells), cells, most=1).first().report.split("\n")
    assert text[0] == "(0, 2):" and text[1].split() == ["1.00000", "2.00000"] and text[2].split() == ["3.00000", "6.00000"]
    assert [r.line for r in report.dense_lines(cells, [0, 1, 2], "-", "%.0f").orderBy("r").collect()] == ["{1, -, 2},", "{3, -, 6},"]
    with pytest.raises(ValueError):
        source.from_lists(spark, [[1], [1, 2]])


def candidates(spark, rows, d=2):
    table = near_parallel.numbered_rows(as_cells(spark, rows))
    return near_parallel.long_pairs(table, d, 2 * d, 2 * d, key_rows=8).select("i", "j").distinct().count()


def test_candidates_grow_with_the_rows(spark):
    """Sparse rows, of which many have few or no cells in a choice of groups; and one column that all rows hold.

    Up to the bound of rows in a key their pairs are made, so the bound is low here.
    """
    rng = random.Random(5)
    found = []
    for n in (500, 2000):
        rows = {k: {c: float(rng.randint(1, 9)) for c in rng.sample(range(1, 100_000), 6)} | {0: 1.0} for k in range(n)}
        found.append(candidates(spark, rows))
    assert found[1] <= 5 * max(found[0], 100)


def test_hot_keys_lose_no_pair(spark):
    rng = random.Random(6)
    base = {c: 1.0 for c in range(8)}  # one key for most rows, and the longer keys for many
    rows = {k: {**base, rng.randrange(8): float(rng.randint(1, 3)), rng.randrange(8, 12): 1.0} for k in range(70)}
    want = brute(rows, 2)
    for limit, levels in ((2, 1), (2, 3), (10, 2)):
        table = near_parallel.numbered_rows(as_cells(spark, rows))
        got = {(r.i, r.j) for r in near_parallel.long_pairs(table, 2, 4, 4, limit, levels).select("i", "j").distinct().collect()}
        assert {(i, j) for i, j, _ in want} <= got


def test_many_matrices_at_once(spark):
    one, two = matrix(11, 25), matrix(12, 25)
    keyed = [((name, r), (name, c), v) for name, rows in (("a", one), ("b", two)) for r, cells in rows.items() for c, v in cells.items()]
    cells = spark.createDataFrame(keyed, "r struct<file:string,r:long>, c struct<file:string,c:long>, v double")
    got = {(p.i.file, p.i.r, p.j.r, p.distance) for p in near_parallel.blocked(cells).collect()}
    assert got == {("a", *x) for x in brute(one, 2)} | {("b", *x) for x in brute(two, 2)}


def test_links_of_class_pairs(spark):
    rows = {0: {0: 1.0, 1: 2.0, 2: 3.0}, 1: {0: 2.0, 1: 4.0, 2: 6.0}, 2: {0: 1.0, 1: 2.0, 3: 1.0}, 3: {0: 3.0, 1: 6.0, 3: 3.0}, 4: {9: 1.0, 8: 1.0, 7: 5.0}}
    assert {tuple(r) for r in near_parallel.class_pairs(as_cells(spark, rows)).collect()} == {(0, 2, 2, 4)}


def test_linear_vote_equals_the_distance_where_a_ratio_has_a_majority(spark):
    rng = random.Random(3)
    kind = "array<struct<c:long,v:double>>"
    rows = []
    for n in (1, 5, 40, 200):
        for _ in range(20):
            x = [(c, float(rng.randint(1, 9))) for c in range(n)]
            off = set(rng.sample(range(n), rng.randint(0, (n - 1) // 2)))
            rows.append((x, [(c, v * 2 + (c in off)) for c, v in x]))
    df = spark.createDataFrame(rows, f"x {kind}, y {kind}")
    assert df.filter(distance.majority_hamming(F.col("x"), F.col("y")) != distance.hamming(F.col("x"), F.col("y"))).count() == 0


@pytest.mark.parametrize("width", [14, 60])
def test_rows_are_measured_where_they_meet(spark, width):
    """Dense and sparse groups, hot keys in tiles, both kinds of keys: the pairs of the definition."""
    rows = {k: {c * (width // 14): v for c, v in cells.items()} | ({100 + k % 9: 1.0} if width > 14 else {}) for k, cells in matrix(21, 70).items()}
    table = reshape.sparse_rows(as_cells(spark, rows))
    way = lambda sym, side: table.select(F.lit(7 + sym).cast("long").alias("key"), F.lit(bool(sym)).alias("sym"), F.lit(side).alias("side"), (F.col("r") % 3 == 0).alias("home"), "r")
    want = {(i, j, far) for i, j, far in brute(rows, 2) if i % 3 == 0 or j % 3 == 0}
    assert len(want) > 20
    assert pairs(meeting.near(way(1, 0), table, 2, tile_rows=8)) == want
    both = way(0, 0).filter("r < 30").unionByName(way(0, 1).filter("r >= 30"))
    assert pairs(meeting.near(both, table, 2, tile_rows=8)) == {x for x in want if x[0] < 30 <= x[1]}
    few = {x for x in want if 6 <= len(rows[x[0]]) + len(rows[x[1]]) <= 9}
    assert pairs(meeting.near(way(1, 0), table, 2, 6, 9)) == few


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast_by_their_file_size(spark):
    """A file of equal rows is a hundredth of its rows, which would all go through the driver."""
    cells = spark.range(4000).selectExpr("id as r", "explode(sequence(0L, 6L)) as c").selectExpr("r", "c", "1.0D + (r % 20) * c as v")
    assert "Broadcast" not in plan(near_parallel.class_pairs(cells)) and "Broadcast" not in plan(near_parallel.blocked(cells))


def test_equal_rows_are_expanded_not_measured(spark):
    """Three thousand equal rows meet as one row; a part of the others is near them."""
    rows = {k: {0: 1.0, 1: 2.0, 2: 3.0, 3: 5.0, 4: 7.0} for k in range(3000)} | {5000: {0: 1.0, 1: 2.0, 2: 3.0, 3: 5.0, 9: 1.0}, 5001: {7: 1.0, 8: 2.0, 9: 9.0}}
    found = near_parallel.blocked(as_cells(spark, rows))
    assert {tuple(r) for r in found.groupBy("distance").count().collect()} == {(0, 3000 * 2999 // 2), (2, 3000)}
    near, copies = near_parallel.unlike_pairs(as_cells(spark, rows))
    assert pairs(near) == {(0, 5000, 2)} and copies.count() == 3002


def test_small_matrices_of_a_batch_need_no_keys(spark, monkeypatch):
    from collinea.jobs.batch import summary

    named = {"a": as_cells(spark, matrix(5)), "b": as_cells(spark, matrix(6, 80))}
    by_keys = {name: near_parallel.class_pairs(cells).agg(F.count("*"), F.coalesce(F.sum("links"), F.lit(0))).first() for name, cells in named.items()}
    monkeypatch.setattr(near_parallel, "level_keys", lambda *_: pytest.fail("keys of a small matrix"))
    found = {r.file: (r.class_pairs, r.links) for r in summary(named).collect()}
    assert found == {name: tuple(one) for name, one in by_keys.items()}


@pytest.mark.parametrize("band_classes", [0, 45, 1_000])
def test_small_and_large_matrices_of_a_batch(spark, band_classes):
    held = {"a": as_cells(spark, matrix(5)), "b": as_cells(spark, matrix(6, 30))}
    want = {}
    for name, cells in held.items():
        n, links = near_parallel.class_pairs(cells).agg(F.count("*"), F.coalesce(F.sum("links"), F.lit(0))).first()
        want[name] = (near_parallel.parallel_classes(cells).filter("r = rep").count(), n, links)
    both = [cells.select(F.struct(F.lit(name).alias("file"), F.col("r").cast("string").alias("r")).alias("r"), F.struct(F.lit(name).alias("file"), F.col("c").cast("string").alias("c")).alias("c"), "v") for name, cells in held.items()]
    found = near_parallel.class_tallies(both[0].unionByName(both[1]), band_classes=band_classes)
    assert {r.file: (r.classes, r.class_pairs, r.links) for r in found.collect()} == want


def test_links_are_made_where_pairs_are(spark):
    found = near_parallel.class_pairs(as_cells(spark, {k: {k % 7: float(k)} for k in range(1, 40)}))
    assert "n_i#" not in plan(found)
    # seven columns of 6 or 5 rows: one class each, any two of them near
    assert {(r.distance, r.links) for r in found.collect()} <= {(2, 25), (2, 30), (2, 36)} and found.count() == 21


def test_pairs_of_single_cells(spark):
    rows = {k: {k % 5: float(3 + k)} for k in range(60)}
    held = reshape.sparse_rows(as_cells(spark, rows))
    found = {(r.i, r.j): r.distance for r in near_parallel.single_cell_pairs(held, tile_rows=8).collect()}
    assert found == {(i, j): 0 if i % 5 == j % 5 else 2 for i in range(60) for j in range(i + 1, 60)}


@pytest.mark.parametrize("text", [False, True])
def test_expanded_rows_in_units_and_tiles(spark, text):
    """Units, blocks and runs far smaller than the copies of a row: each pair once, in the order of its keys."""
    held = {k: [k + 10 * n for n in range(1 + 9 * (k % 3))] for k in range(8)}
    name = str if text else int
    kind = "string" if text else "long"
    copies = spark.createDataFrame([(name(r), name(k)) for k, rows in held.items() for r in rows], f"r {kind}, rep {kind}")
    near = {(0, 1, 1), (0, 2, 2), (2, 5, 0), (4, 5, 1), (6, 7, 2)}
    want = sorted((*sorted((name(a), name(b))), far) for i, j, far in near for a in held[i] for b in held[j])
    want = sorted(want + [(*sorted((name(a), name(b))), 0) for rows in held.values() for a in rows for b in rows if a < b])
    for sizes in ({}, {"held_rows": 4, "block_rows": 16, "block_units": 3}):
        found = near_parallel.expanded(spark.createDataFrame([(name(i), name(j), far) for i, j, far in near], f"i {kind}, j {kind}, distance long"), copies, **sizes)
        assert sorted(map(tuple, found.collect())) == want


def test_expanded_pairs_are_written_in_runs(spark, tmp_path):
    """Two hundred rows of twenty copies: a file of their pairs needs a fraction of a byte a pair, not one."""
    copies = spark.range(200 * 20).selectExpr("id as r", "id % 200 as rep")
    near = spark.range(200).selectExpr("id as i").join(spark.range(200).selectExpr("id as j")).filter("i < j and (i + j) % 5 < 2").withColumn("distance", (F.col("i") % 3).cast("long"))
    near_parallel.expanded(near, copies).write.parquet(str(tmp_path / "pairs"))
    written = sum(part.stat().st_size for part in (tmp_path / "pairs").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 3_222_000 and written < 0.6 * 3_222_000


def test_exhaustive_compares_unlike_rows_only(spark, monkeypatch):
    rows = {k: {0: 1.0, 1: 2.0 + k % 3, 2: 3.0} for k in range(300)} | {400: {0: 1.0, 5: 2.0}}
    met, near = [], meeting.near
    monkeypatch.setattr(meeting, "near", lambda entries, rows, *more: met.append(rows.count()) or near(entries, rows, *more))
    assert pairs(near_parallel.exhaustive(as_cells(spark, rows))) == brute(rows, 2) and met == [4]


def test_shapes_are_hashed_as_numbers(spark):
    """Values of rows are numbers on the grid, columns as they are: no text is made for each cell of each row."""
    rows = reshape.sparse_rows(as_cells(spark, matrix(4, 40)))
    made = rows.select("r", F.xxhash64(near_parallel.shape_of(F.col("cells"))).alias("shape"), near_parallel.signature(F.col("cells")).alias("text"))
    assert made.groupBy("text").agg(F.count_distinct("shape").alias("n")).filter("n > 1").isEmpty()
    assert made.groupBy("shape").agg(F.count_distinct("text").alias("n")).filter("n > 1").isEmpty()
    assert "as string" not in plan(near_parallel.class_rows(rows)) and "round(" not in plan(near_parallel.class_rows(rows))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_variants_of_short_rows_are_made_without_a_shuffle(spark, d):
    rows = cut(reshape.sparse_rows(as_cells(spark, matrix(8, 60))), "test-rows")
    entries = near_parallel.short_entries(rows, d, 2 * d)
    assert "Exchange" not in plan(entries) and "array_contains" not in plan(entries)
    assert entries.count() == entries.distinct().count() > 0
