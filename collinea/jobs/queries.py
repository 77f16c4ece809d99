"""Queries over the given tables, each with SQL that any engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from collinea.functions import scalars
from collinea.operators import aggregates, algebra, distance, meeting, near_parallel, report, reshape
from collinea.sources import cells as source, mps
from collinea.sources.cells import Shape
from collinea.sources.workspace import cut, scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ cell tables


def lineitem_cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders by suppliers, summed quantities."""
    return source.from_rows(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", F.sum("l_quantity"))


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    """Customers by order priorities, numbers of orders."""
    return source.from_rows(table(spark, d, "orders"), "o_custkey", "o_orderpriority", F.count("*"))


def event_cells(spark: SparkSession, d: str) -> DataFrame:
    """Users by event types, numbers of events."""
    return source.from_rows(table(spark, d, "events"), "user_id", "event_type", F.count("*"))


def part_cells(spark: SparkSession, d: str) -> DataFrame:
    """Parts by line numbers, numbers of lines."""
    return source.from_rows(table(spark, d, "lineitem"), "l_partkey", F.col("l_linenumber").cast("long"), F.count("*"))


def nation_cells(spark: SparkSession, d: str) -> DataFrame:
    """Nations by market segments, numbers of customers."""
    return source.from_rows(table(spark, d, "customer"), F.col("c_nationkey").cast("long"), "c_mktsegment", F.count("*"))


def embedding_cells(spark: SparkSession, d: str) -> DataFrame:
    return source.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")


def numbered_nations(spark: SparkSession, d: str) -> DataFrame:
    """The nation matrix with segments numbered by name, so that both keys are places."""
    names = mps.numbered(nation_cells(spark, d), "c", "k")
    return nation_cells(spark, d).join(names, "c").select("r", F.col("k").alias("c"), "v")


#: nations and market segments of the benchmark's fixed dimension tables
NATIONS = Shape(25, 5)

SQL_CELLS = {
    "lineitem": "SELECT l_orderkey AS r, l_suppkey AS c, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2 HAVING abs(sum(l_quantity)) > 1e-10",
    "orders": "SELECT o_custkey AS r, o_orderpriority AS c, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2",
    "events": "SELECT user_id AS r, event_type AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2",
    "parts": "SELECT l_partkey AS r, l_linenumber::BIGINT AS c, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2",
    "nations": "SELECT c_nationkey::BIGINT AS r, c_mktsegment AS c, count(*)::DOUBLE AS v FROM customer GROUP BY 1, 2",
    "embeddings": "SELECT vec_id AS r, (p - 1)::BIGINT AS c, embedding[p]::DOUBLE AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(p) WHERE abs(embedding[p]::DOUBLE) > 1e-10",
}
SQL_CELLS["numbered"] = f"SELECT r, dense_rank() OVER (ORDER BY c) - 1 AS c, v FROM ({SQL_CELLS['nations']})"


def with_cells(name: str, rest: str) -> str:
    return f"WITH cell AS ({SQL_CELLS[name]}) {rest}" if not rest.startswith(",") else f"WITH cell AS ({SQL_CELLS[name]}){rest}"


def distance_sql(name: str, d: int, pairs: str = "") -> str:
    """All pairs within d by the definition: the best anchor of each pair, no blocking."""
    limit = f"n.r < o.r AND abs(n.n - o.n) <= {d}" if not pairs else pairs
    return with_cells(
        name,
        f""", n AS (SELECT r, count(*) AS n FROM cell GROUP BY r),
pair AS (SELECT n.r AS i, o.r AS j, n.n + o.n AS total FROM n JOIN n AS o ON {limit}),
common AS (SELECT i, j, a.v AS x, b.v AS y FROM pair JOIN cell a ON a.r = i JOIN cell b ON b.r = j AND b.c = a.c),
anchored AS (SELECT p.i, p.j, p.x / p.y AS ratio, count(*) FILTER (abs(q.x - q.y * (p.x / p.y)) <= 1e-10) AS k, count(*) AS m
             FROM (SELECT DISTINCT i, j, x, y FROM common) p JOIN common q ON p.i = q.i AND p.j = q.j GROUP BY p.i, p.j, p.x, p.y),
best AS (SELECT i, j, max(k) AS k, max(m) AS m FROM anchored GROUP BY i, j)
SELECT pair.i, pair.j, (total - coalesce(m, 0) - coalesce(k, 0))::BIGINT AS distance
FROM pair LEFT JOIN best ON pair.i = best.i AND pair.j = best.j""",
    )


def near_sql(name: str, d: int) -> str:
    return f"SELECT * FROM ({distance_sql(name, d)}) WHERE distance <= {d}"


#: a row with the next row in key order: pairs that grow with the table
NEXT_SQL = "o.r = (SELECT min(z.r) FROM n z WHERE z.r > n.r)"


def next_pairs(cells: DataFrame) -> DataFrame:
    keys = mps.numbered(cells, "r", "k")
    return keys.join(keys.select(F.col("r").alias("j"), (F.col("k") - 1).alias("k")), "k").select(F.col("r").alias("i"), "j")


def measured(spark: SparkSession, d: str, measure: Callable) -> DataFrame:
    """A distance of each event row and the next one."""
    cells = event_cells(spark, d)
    rows = reshape.sparse_rows(cells)
    left, right = rows.select(F.col("r").alias("i"), F.col("cells").alias("x")), rows.select(F.col("r").alias("j"), F.col("cells").alias("y"))
    return next_pairs(cells).join(left, "i").join(right, "j").select("i", "j", measure(F.col("x"), F.col("y")).alias("distance"))


# ------------------------------------------------------------------ queries

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


@query(with_cells("lineitem", "SELECT r, c, v FROM cell"))
def cells_from_lineitem(spark, d):
    return lineitem_cells(spark, d)


@query(with_cells("embeddings", "SELECT r, c, v FROM cell"))
def cells_from_embeddings(spark, d):
    return embedding_cells(spark, d)


@query(with_cells("lineitem", "SELECT o_orderkey AS r, count(c)::BIGINT AS nnz FROM orders LEFT JOIN cell ON r = o_orderkey GROUP BY 1"))
def row_nnz(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("r"))
    return aggregates.row_nnz(lineitem_cells(spark, d), rows)


@query(with_cells("lineitem", ", n AS (SELECT r, count(*) AS n FROM cell GROUP BY r) SELECT range AS nnz, count(n.r)::BIGINT AS n FROM range(1, 11) LEFT JOIN n ON n.n = range GROUP BY range"))
def nnz_histogram(spark, d):
    return aggregates.nnz_histogram(lineitem_cells(spark, d), 10)


@query(with_cells("lineitem", "SELECT c, count(*)::BIGINT AS n FROM cell GROUP BY c ORDER BY n DESC, c LIMIT 10"))
def most_frequent_k(spark, d):
    return aggregates.most_frequent(lineitem_cells(spark, d), "c", 10)


@query(with_cells("events", "SELECT r, count(*)::BIGINT AS nnz, string_agg(c || '=' || v::BIGINT, ' ' ORDER BY c) AS cells FROM cell GROUP BY r"))
def sparse_rows(spark, d):
    rows = reshape.sparse_rows(event_cells(spark, d))
    shown = F.transform("cells", lambda x: F.concat(x["c"], F.lit("="), x["v"].cast("long").cast("string")))
    return rows.select("r", "nnz", scalars.join_text(shown, " ").alias("cells"))


@query(with_cells("orders", "SELECT c, v FROM cell WHERE r = 7"))
def get_row(spark, d):
    return reshape.get_row(order_cells(spark, d), 7)


@query(with_cells("orders", "SELECT r, v FROM cell WHERE c = '1-URGENT'"))
def get_column(spark, d):
    return reshape.get_column(order_cells(spark, d), "1-URGENT")


@query(with_cells("events", "SELECT c AS r, r AS c, v FROM cell"))
def transpose(spark, d):
    return reshape.transpose(event_cells(spark, d))


@query(
    with_cells(
        "events",
        f""", n AS (SELECT DISTINCT r FROM cell), p AS (SELECT n.r AS i, o.r AS j FROM n JOIN n o ON {NEXT_SQL}),
x AS (SELECT i, j, c, v FROM p JOIN cell ON r = i), y AS (SELECT i, j, c, v FROM p JOIN cell ON r = j)
SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, coalesce(x.c, y.c) AS c, coalesce(x.v, 0) AS x, coalesce(y.v, 0) AS y
FROM x FULL JOIN y ON x.i = y.i AND x.j = y.j AND x.c = y.c""",
    )
)
def row_zip(spark, d):
    cells = event_cells(spark, d)
    return reshape.row_zip(next_pairs(cells), cells)


@query(distance_sql("events", 2, NEXT_SQL))
def hamming(spark, d):
    return measured(spark, d, distance.hamming)


@query(
    with_cells(
        "events",
        f""", n AS (SELECT DISTINCT r FROM cell), p AS (SELECT n.r AS i, o.r AS j FROM n JOIN n o ON {NEXT_SQL}),
x AS (SELECT i, j, c, v FROM p JOIN cell ON r = i), y AS (SELECT i, j, c, v FROM p JOIN cell ON r = j)
SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, count(*) FILTER (abs(coalesce(x.v, 0) - coalesce(y.v, 0) * 0.5) > 1e-10)::BIGINT AS distance
FROM x FULL JOIN y ON x.i = y.i AND x.j = y.j AND x.c = y.c GROUP BY 1, 2""",
    )
)
def hamming_fixed_ratio(spark, d):
    return measured(spark, d, lambda x, y: distance.hamming_fixed_ratio(x, y, F.lit(0.5)))


@query(
    with_cells(
        "events",
        f""", n AS (SELECT r, count(*) AS n FROM cell GROUP BY r), p AS (SELECT n.r AS i, o.r AS j, n.n + o.n AS total FROM n JOIN n o ON {NEXT_SQL}),
q AS (SELECT i, j, a.c, a.v AS x, b.v AS y FROM p JOIN cell a ON a.r = i JOIN cell b ON b.r = j AND b.c = a.c),
w AS (SELECT i, j, list_reduce(list_concat([struct_pack(r := 0.0::DOUBLE, n := 0)], list(struct_pack(r := x / y, n := 0) ORDER BY c)), lambda a, b:
             CASE WHEN abs(a.r - b.r) <= 1e-10 THEN struct_pack(r := a.r, n := a.n + 1) WHEN a.n = 0 THEN struct_pack(r := b.r, n := 1) ELSE struct_pack(r := a.r, n := a.n - 1) END).r AS ratio FROM q GROUP BY i, j),
k AS (SELECT i, j, count(*) AS m, count(*) FILTER (abs(x - y * ratio) <= 1e-10) AS k FROM q JOIN w USING (i, j) GROUP BY i, j)
SELECT p.i, p.j, (total - coalesce(m, 0) - coalesce(k, 0))::BIGINT AS distance FROM p LEFT JOIN k ON p.i = k.i AND p.j = k.j""",
    )
)
def majority_hamming(spark, d):
    """The vote on all pairs of neighbouring keys, also where no ratio has a majority."""
    return measured(spark, d, distance.majority_hamming)


@query(near_sql("events", 2))
def near_parallel_exhaustive(spark, d):
    return near_parallel.exhaustive(event_cells(spark, d))


@query(near_sql("nations", 2))
def near_parallel_exhaustive_nations(spark, d):
    return near_parallel.exhaustive(nation_cells(spark, d))


@query(near_sql("events", 2))
def near_parallel_blocked(spark, d):
    return near_parallel.blocked(event_cells(spark, d))


@query(near_sql("orders", 2))
def near_parallel_blocked_orders(spark, d):
    return near_parallel.blocked(order_cells(spark, d))


@query(near_sql("parts", 2))
def near_parallel_blocked_parts(spark, d):
    return near_parallel.blocked(part_cells(spark, d))


@query(near_sql("nations", 3))
def near_parallel_blocked_three(spark, d):
    return near_parallel.blocked(nation_cells(spark, d), 3)


CLASS_SQL = with_cells(
    "lineitem",
    """, ordered AS (SELECT r, list(struct_pack(c := c, v := v) ORDER BY c) AS cells FROM cell GROUP BY r)
, shaped AS (SELECT r, list_transform(cells, lambda x: struct_pack(c := x.c, q := round(x.v / cells[1].v * 1e10)::BIGINT)) AS shape FROM ordered)
SELECT r, min(r) OVER (PARTITION BY shape) AS rep FROM shaped""",
)


@query(CLASS_SQL)
def parallel_classes(spark, d):
    return near_parallel.parallel_classes(lineitem_cells(spark, d))


@query(
    with_cells(
        "nations",
        """, n AS (SELECT r, count(*) AS n FROM cell GROUP BY r) SELECT count(*)::BIGINT AS candidates FROM n JOIN n o ON n.r < o.r AND abs(n.n - o.n) <= 2""",
    )
)
def band_candidates(spark, d):
    return near_parallel.band_candidates(nation_cells(spark, d))


_CLASSES = """ordered AS (SELECT r, list(struct_pack(c := c, v := v) ORDER BY c) AS cells FROM cell GROUP BY r),
shaped AS (SELECT r, list_transform(cells, lambda x: struct_pack(c := x.c, q := round(x.v / cells[1].v * 1e10)::BIGINT)) AS shape FROM ordered),
class AS (SELECT r, min(r) OVER (PARTITION BY shape) AS rep FROM shaped)"""


@query(
    with_cells(
        "lineitem",
        f""", {_CLASSES}, size AS (SELECT rep, count(*) AS n FROM class GROUP BY rep),
rc AS (SELECT cell.* FROM cell JOIN class ON class.r = cell.r AND rep = cell.r), n AS (SELECT r, count(*) AS n FROM rc GROUP BY r),
shared AS (SELECT a.r AS i, b.r AS j, count(*) AS m FROM rc a JOIN rc b ON a.c = b.c AND a.r < b.r GROUP BY 1, 2),
pair AS (SELECT i, j, x.n + y.n AS total, m FROM shared JOIN n x ON x.r = i JOIN n y ON y.r = j WHERE x.n + y.n - 2 * m <= 2
         UNION ALL SELECT x.r, y.r, x.n + y.n, 0 FROM n x JOIN n y ON x.r < y.r AND x.n = 1 AND y.n = 1 ANTI JOIN shared ON i = x.r AND j = y.r),
common AS (SELECT i, j, total, m, a.v AS x, b.v AS y FROM pair LEFT JOIN rc a ON a.r = i AND m > 0 LEFT JOIN rc b ON b.r = j AND b.c = a.c WHERE m = 0 OR b.v IS NOT NULL),
best AS (SELECT p.i, p.j, p.total, p.m, p.x, p.y, count(*) FILTER (abs(q.x - q.y * (p.x / p.y)) <= 1e-10) AS k
         FROM (SELECT DISTINCT * FROM common) p JOIN common q ON p.i = q.i AND p.j = q.j GROUP BY ALL),
near AS (SELECT i, j, min(total - m - k)::BIGINT AS distance FROM best GROUP BY i, j)
SELECT i, j, distance, (a.n * b.n)::BIGINT AS links FROM near JOIN size a ON a.rep = i JOIN size b ON b.rep = j WHERE distance <= 2""",
    )
)
def near_parallel_class_pairs(spark, d):
    """Orders by suppliers over the whole of lineitem, as pairs of classes with the row pairs they stand for."""
    return near_parallel.class_pairs(lineitem_cells(spark, d))


@query(
    with_cells(
        "parts",
        f""", {_CLASSES}, g AS (SELECT c, (row_number() OVER (ORDER BY count(*) DESC, c) - 1) % 4 AS g FROM cell GROUP BY c),
long AS (SELECT cell.r, cell.c, v, g FROM cell JOIN g USING (c) JOIN class ON class.r = cell.r AND rep = cell.r
         WHERE cell.r IN (SELECT r FROM cell GROUP BY r HAVING count(*) > 4)),
mask(mask, a, b) AS (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)),
rows AS (SELECT DISTINCT r FROM long),
part AS (SELECT rows.r, mask, list(struct_pack(c := c, v := v) ORDER BY c) FILTER (c IS NOT NULL) AS cells
         FROM rows CROSS JOIN mask LEFT JOIN long ON long.r = rows.r AND g IN (a, b) GROUP BY 1, 2),
keyed AS (SELECT mask, list_transform(cells, lambda x: struct_pack(c := x.c, q := round(x.v / cells[1].v * 1e10)::BIGINT)) AS key FROM part),
met AS (SELECT mask, key, count(*) AS n FROM keyed GROUP BY 1, 2)
SELECT mask::BIGINT AS mask, coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS raw FROM met GROUP BY mask""",
    )
)
def near_parallel_statistics(spark, d):
    """Row pairs under each choice of column groups at the first level, counted while the search runs."""
    return near_parallel.search_statistics(part_cells(spark, d)).filter("level = 0").select("mask", "raw")


@query(f"SELECT i, j, distance FROM ({near_sql('orders', 2)}) WHERE distance = 2")
def pairs_difference(spark, d):
    """The difference is taken between rows that stand for their equals, whose distances are the same, and then expanded."""
    two, copies = near_parallel.unlike_pairs(order_cells(spark, d))
    apart = near_parallel.pairs_difference(two, two.filter("distance <= 1").select(F.col("j").alias("i"), F.col("i").alias("j")))
    return near_parallel.expanded(apart.withColumn("distance", F.lit(2).cast("long")), copies).filter("distance = 2")


def factorised(cells: DataFrame) -> DataFrame:
    """Factorised candidates of short rows with the keys of long rows, measured where they meet, and expanded."""
    rows, copies = near_parallel.unlike_rows(cut(near_parallel.numbered_rows(cells), "rows"))
    groups = near_parallel.short_row_groups(rows.select("r", F.explode("cells").alias("x")).select("r", "x.c", "x.v"))
    key = F.xxhash64("key", "left", "right").alias("key")
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(name).alias("rows")) for side, name in enumerate(("left", "right")))))
    short = groups.select(key, sides.alias("x")).select("key", F.lit(False).alias("sym"), "x.side", F.lit(True).alias("home"), F.explode("x.rows").alias("r"))
    near = meeting.near(near_parallel.long_entries(rows, 2, 4, 4).unionByName(short), rows, 2).distinct()
    return near_parallel.expanded(cut(near, "near"), copies)


@query(near_sql("nations", 2))
def near_parallel_groups(spark, d):
    return factorised(nation_cells(spark, d))


@query(near_sql("orders", 2))
def near_parallel_groups_orders(spark, d):
    return factorised(order_cells(spark, d))


@query(near_sql("parts", 2))
def near_parallel_groups_parts(spark, d):
    return factorised(part_cells(spark, d))


@query(with_cells("parts", "SELECT DISTINCT c, c % 4 AS grp FROM cell"))
def column_groups(spark, d):
    return near_parallel.column_groups(part_cells(spark, d), 4, F.col("c") % 4)


@query(
    with_cells(
        "parts",
        """, f AS (SELECT r, c % 4 AS g, c, v, first_value(v) OVER (PARTITION BY r, c % 4 ORDER BY c) AS front FROM cell),
s AS (SELECT r, g, string_agg(c || ':' || round(v / front * 1e10)::BIGINT, ' ' ORDER BY c) AS sig FROM f GROUP BY r, g),
k AS (SELECT r, g, n FROM (SELECT r, count(*) AS n FROM cell GROUP BY r), range(4) AS t(g))
SELECT k.r, k.n::BIGINT AS nnz, string_agg(coalesce(sig, ''), '|' ORDER BY k.g) AS blocks FROM k LEFT JOIN s ON s.r = k.r AND s.g = k.g GROUP BY k.r, k.n""",
    )
)
def block_signatures(spark, d):
    found = near_parallel.block_signatures(part_cells(spark, d), 4, F.col("c") % 4)
    shown = F.transform("blocks", lambda block: F.array_join(F.transform(block, lambda x: F.concat(x["c"], F.lit(":"), x["q"])), " "))
    return found.select("r", "nnz", F.array_join(shown, "|").alias("blocks"))


# ------------------------------------------------------------------ algebra


@query(with_cells("nations", "SELECT a.r, b.r AS c, sum(a.v * b.v)::DOUBLE AS v FROM cell a JOIN cell b ON a.c = b.c GROUP BY 1, 2"))
def matmul(spark, d):
    cells = nation_cells(spark, d)
    return algebra.matmul(cells, reshape.transpose(cells))


@query(with_cells("embeddings", "SELECT r, c, round(sum(v), 6) AS v FROM (SELECT a.r, b.label AS c, a.v * (b.label + 1) AS v FROM cell a JOIN embeddings b ON a.c = b.vec_id) GROUP BY r, c HAVING abs(sum(v)) > 1e-10"))
def matmul_embeddings(spark, d):
    """Embeddings times a matrix that gathers their dimensions by the labels of equal number."""
    labels = source.from_rows(table(spark, d, "embeddings"), "vec_id", "label", F.max(F.col("label") + 1))
    return algebra.matmul(embedding_cells(spark, d), labels).select("r", "c", F.round("v", 6).alias("v"))


@query(with_cells("events", "SELECT a.r, b.r AS c, sum(a.v * b.v)::DOUBLE AS v FROM cell a JOIN cell b ON a.c = b.c GROUP BY 1, 2"))
def matmul_events(spark, d):
    """Users by users over event types: few inner keys, each of which holds most rows."""
    cells = event_cells(spark, d)
    return algebra.matmul(cells, reshape.transpose(cells))


SUM_SQL = "SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, {} AS v FROM cell a FULL JOIN other b ON a.r = b.r AND a.c = b.c WHERE abs({}) > 1e-10"
OTHER = ", other AS (SELECT c_nationkey::BIGINT AS r, c_mktsegment AS c, count(*)::DOUBLE AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) "


def two_sided(expression: str) -> str:
    e = expression.replace("x", "coalesce(a.v, 0)").replace("y", "coalesce(b.v, 0)")
    return with_cells("nations", OTHER + SUM_SQL.format(e, e))


def rich_cells(spark: SparkSession, d: str) -> DataFrame:
    """The nation matrix of customers with money."""
    return source.from_rows(table(spark, d, "customer").filter("c_acctbal > 0"), F.col("c_nationkey").cast("long"), "c_mktsegment", F.count("*"))


@query(two_sided("(x + y)"))
def mat_add(spark, d):
    return algebra.add(nation_cells(spark, d), rich_cells(spark, d))


@query(two_sided("(x - y)"))
def mat_sub(spark, d):
    return algebra.subtract(nation_cells(spark, d), rich_cells(spark, d))


@query(two_sided("(x + y * 2.5)"))
def axpy(spark, d):
    return algebra.add_scaled(nation_cells(spark, d), rich_cells(spark, d), 2.5)


@query(two_sided("(x * y + 1)"))
def elementwise(spark, d):
    return algebra.elementwise(nation_cells(spark, d), rich_cells(spark, d), lambda x, y: x * y + 1)


@query(with_cells("orders", "SELECT r, c, v * 1.5 AS v FROM cell"))
def scale(spark, d):
    return algebra.scale(order_cells(spark, d), 1.5)


@query(with_cells("orders", "SELECT r, c, v / 4 AS v FROM cell"))
def divide(spark, d):
    return algebra.divide(order_cells(spark, d), 4)


@query(with_cells("orders", "SELECT coalesce(sum(a.v * b.v), 0)::DOUBLE AS dot FROM cell a JOIN cell b ON a.r = b.r WHERE a.c = '1-URGENT' AND b.c = '5-LOW'"))
def dot(spark, d):
    cells = order_cells(spark, d)
    return algebra.dot(reshape.get_column(cells, "1-URGENT"), reshape.get_column(cells, "5-LOW"))


@query(with_cells("embeddings", "SELECT round(sqrt(sum(v * v)), 6) AS norm FROM cell"))
def norm(spark, d):
    return algebra.norm(embedding_cells(spark, d)).select(F.round("norm", 6).alias("norm"))


@query(with_cells("numbered", "SELECT r, c, v FROM cell UNION ALL SELECT r + 25, c, v * 2 FROM cell"))
def vstack(spark, d):
    cells = numbered_nations(spark, d)
    return reshape.vstack([(cells, NATIONS), (algebra.scale(cells, 2), NATIONS)])[0]


@query(with_cells("numbered", "SELECT r, c, v FROM cell UNION ALL SELECT r, c + 5, v * 2 FROM cell"))
def hstack(spark, d):
    cells = numbered_nations(spark, d)
    return reshape.hstack([(cells, NATIONS), (algebra.scale(cells, 2), NATIONS)])[0]


@query(with_cells("numbered", "SELECT r, c, v FROM cell UNION ALL SELECT r, c, 0.5 FROM range(27) AS a(r), range(7) AS b(c) WHERE r >= 25 OR c >= 5"))
def pad(spark, d):
    return reshape.pad(numbered_nations(spark, d), NATIONS, Shape(27, 7), 0.5)


@query(with_cells("numbered", "SELECT r - 3 AS r, c - 1 AS c, v FROM cell WHERE r >= 3 AND r < 20 AND c >= 1 AND c < 4"))
def slice_cells(spark, d):
    return reshape.slice_cells(numbered_nations(spark, d), 3, 20, 1, 4, NATIONS)


@query(with_cells("numbered", "SELECT r, c, v FROM cell WHERE NOT (r < 5 AND c < 2) UNION ALL SELECT r - 10, c - 2, v FROM cell WHERE r >= 10 AND r < 15 AND c >= 2 AND c < 4"))
def assign_slice(spark, d):
    cells = numbered_nations(spark, d)
    return reshape.assign_slice(cells, reshape.slice_cells(cells, 10, 15, 2, 4), 0, 0, Shape(5, 2), NATIONS)


@query(with_cells("numbered", "SELECT CASE WHEN r < 5 THEN r + 10 WHEN r >= 10 AND r < 15 THEN r - 10 ELSE r END AS r, c, v FROM cell"))
def swap_slices(spark, d):
    return reshape.swap_slices(numbered_nations(spark, d), 0, 0, 10, 0, Shape(5, 5))


@query("SELECT DISTINCT o_custkey AS r, o_custkey AS c, 1.0::DOUBLE AS v FROM orders")
def identity(spark, d):
    return source.identity(table(spark, d, "orders"), "o_custkey")


@query(
    with_cells(
        "numbered",
        """, s AS (SELECT unnest(range(max(r) + 1)) AS r FROM cell), t AS (SELECT unnest(range(max(c) + 1)) AS c FROM cell)
SELECT s.r::BIGINT AS r, t.c::BIGINT AS c, coalesce(cell.v, 0) + 2 AS v FROM s CROSS JOIN t LEFT JOIN cell ON cell.r = s.r AND cell.c = t.c""",
    )
)
def constant(spark, d):
    """The numbered nation matrix plus a constant matrix of its shape."""
    cells = numbered_nations(spark, d)
    return algebra.add(cells, source.constant(spark, source.shape_of(cells), 2.0))


@query(with_cells("numbered", "SELECT r, c, v - CASE WHEN r = (SELECT max(r) FROM cell) AND c = (SELECT max(c) FROM cell) THEN 1 ELSE 0 END AS v FROM cell"))
def unit(spark, d):
    """The matrix less one at its last place, which the shape names."""
    cells = numbered_nations(spark, d)
    shape = source.shape_of(cells)
    return algebra.subtract(cells, source.unit(spark, shape, shape.height - 1, shape.width - 1))


@query("SELECT max(l_partkey) + 1 AS height, max(l_linenumber)::BIGINT + 1 AS width FROM lineitem")
def shape(spark, d):
    """Height and width of the part matrix, as far as its cells show them."""
    found = source.shape_of(part_cells(spark, d))
    return spark.createDataFrame([(found.height, found.width)], "height long, width long")


_UNEQUAL = "EXISTS (SELECT * FROM cell EXCEPT SELECT * FROM {0}) OR EXISTS (SELECT * FROM {0} EXCEPT SELECT * FROM cell)"


@query(with_cells("nations", OTHER + f"SELECT 'rich' AS name, NOT ({_UNEQUAL.format('other')}) AS equal UNION ALL SELECT 'turned twice', NOT ({_UNEQUAL.format('cell')})"))
def mat_equal(spark, d):
    """Nations against those of customers with money, and against themselves turned twice."""
    cells = nation_cells(spark, d)
    named = lambda name, other: algebra.equal(cells, other).select(F.lit(name).alias("name"), "equal")
    return named("rich", rich_cells(spark, d)).unionByName(named("turned twice", reshape.transpose(reshape.transpose(cells))))


@query(with_cells("numbered", "SELECT r, c, v FROM cell UNION ALL SELECT r, 5, sum(v) FROM cell GROUP BY r"))
def add_column(spark, d):
    cells = numbered_nations(spark, d)
    return reshape.add_column(cells, NATIONS, cells.groupBy("r").agg(F.sum("v").alias("v")))[0]


@query(with_cells("numbered", "SELECT r, c, v FROM cell WHERE c < 4"))
def pop_column(spark, d):
    return reshape.pop_column(numbered_nations(spark, d), NATIONS)[0]


@query(with_cells("embeddings", "SELECT count(*)::BIGINT AS nonzeros FROM cell"))
def nonzero_count(spark, d):
    return algebra.nonzero_count(embedding_cells(spark, d))


@query(with_cells("lineitem", "SELECT count(*)::DOUBLE / ((SELECT count(DISTINCT l_orderkey) FROM lineitem) * (SELECT count(DISTINCT l_suppkey) FROM lineitem)) AS density FROM cell"))
def density(spark, d):
    return algebra.density(lineitem_cells(spark, d), F.count_distinct("r"), F.count_distinct("c"))


# ------------------------------------------------------------------ aggregates


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_type, round(CASE WHEN min(value + 1) <= 0 THEN NULL ELSE exp(avg(ln(value + 1))) END, 6) AS geo FROM events WHERE value > -1 GROUP BY 1")
def geo_mean(spark, d):
    return table(spark, d, "events").filter("value > -1").groupBy("event_type").agg(F.round(aggregates.geometric_mean(F.col("value") + 1), 6).alias("geo"))


@query("SELECT event_type, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def min_max(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT event_type, min(event_id) AS at FROM events e WHERE value = (SELECT min(value) FROM events f WHERE f.event_type = e.event_type) GROUP BY 1")
def argmin(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(aggregates.arg_min(F.col("event_id"), F.col("value")).alias("at"))


@query("SELECT event_type, min(event_id) AS at FROM events e WHERE value = (SELECT max(value) FROM events f WHERE f.event_type = e.event_type) GROUP BY 1")
def argmax(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(aggregates.arg_max(F.col("event_id"), F.col("value")).alias("at"))


@query("SELECT user_id, round(fsum(value), 6) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def compensated_sum(spark, d):
    """Kahan's sum and the tolerant folds over each user's events in order."""
    values = aggregates.ordered_values(F.col("event_id"), F.col("value"))
    held = table(spark, d, "events").groupBy("user_id").agg(values.alias("values"))
    return held.select("user_id", F.round(aggregates.compensated_sum(F.col("values")), 6).alias("total"), aggregates.tolerant_min(F.col("values")).alias("least"), aggregates.tolerant_max(F.col("values")).alias("most"))


@query(
    """WITH l AS (SELECT event_type, list(value ORDER BY event_id) AS v FROM (SELECT * FROM events UNION ALL SELECT * REPLACE ('all' AS event_type) FROM events) WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, len(v)::BIGINT AS n, round(list_aggregate(v, 'fsum'), 6) AS total,
       list_reduce(v, lambda a, b: CASE WHEN b < a - 1e-10 THEN b ELSE a END) AS least, list_reduce(v, lambda a, b: CASE WHEN b > a + 1e-10 THEN b ELSE a END) AS most FROM l"""
)
def ordered_totals(spark, d):
    """Kahan's sum and the tolerant folds over each event type, and over all events as one group."""
    events = table(spark, d, "events").select("event_type", "event_id", "value")
    both = events.unionByName(events.withColumn("event_type", F.lit("all")))
    return aggregates.ordered_totals(both, "event_type", "event_id", "value").withColumn("total", F.round("total", 6))


# ------------------------------------------------------------------ scalar functions


@query(
    """SELECT event_id, CASE WHEN abs(value - floor(value) - 1) < 1e-10 THEN floor(value) + 1 ELSE floor(value) END AS low,
round(CASE WHEN abs(value - floor(value) - 1) < 1e-10 THEN 0 ELSE value - floor(value) END, 9) AS rest, abs(value) AS size,
value > 1e-10 AS positive, value < -1e-10 AS negative, abs(value) > 1e-10 AS nonzero, pow(2.0, event_id % 20) AS power, round(value * 1e10)::BIGINT AS grid FROM events"""
)
def scalar_numbers(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id",
        scalars.eps_floor(v).alias("low"),
        F.round(scalars.fractional(v), 9).alias("rest"),
        F.abs(v).alias("size"),
        scalars.is_positive(v).alias("positive"),
        scalars.is_negative(v).alias("negative"),
        scalars.is_nonzero(v).alias("nonzero"),
        scalars.exp2(F.col("event_id") % 20).alias("power"),
        scalars.quantise(v).alias("grid"),
    )


@query(
    r"""SELECT p_partkey, regexp_replace(chr(9) || p_name || ' ' || chr(10), '^\s+|\s+$', '', 'g') AS trimmed,
regexp_replace('  ' || p_name, '^\s+', '') || '.' AS ltrimmed, '.' || regexp_replace(p_name || '  ', '\s+$', '') AS rtrimmed,
array_to_string(string_split(p_name, ' '), ', ') AS joined, '0b' || lpad(bin(p_partkey), 63, '0') AS digits FROM part"""
)
def scalar_texts(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey",
        scalars.trim_all(F.concat(F.lit("\t"), name, F.lit(" \n"))).alias("trimmed"),
        F.concat(scalars.trim_left(F.concat(F.lit("  "), name)), F.lit(".")).alias("ltrimmed"),
        F.concat(F.lit("."), scalars.trim_right(F.concat(name, F.lit("  ")))).alias("rtrimmed"),
        scalars.join_text(F.split(name, " "), ", ").alias("joined"),
        scalars.as_binary(F.col("p_partkey")).alias("digits"),
    )


@query(
    with_cells(
        "events",
        """, t AS (SELECT r, c, c || '=' || round(v * 1e10)::BIGINT AS t FROM cell), h AS (SELECT r, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h FROM t),
o AS (SELECT r, md5(string_agg(t, ' ' ORDER BY c)) AS ordered FROM t GROUP BY r)
SELECT r, sum(h)::VARCHAR AS sum, bit_xor(h) AS xor, ordered, ('0x' || substr(ordered, 1, 8))::BIGINT AS short FROM h JOIN o USING (r) GROUP BY r, ordered""",
    )
)
def row_hash_unordered(spark, d):
    """Ordered and unordered hashes of rows."""
    cells = event_cells(spark, d)
    both = cells.groupBy("r").agg(scalars.unordered_hash(scalars.cell_text(F.col("c"), F.col("v"))).alias("h"))
    ordered = reshape.sparse_rows(cells).select("r", scalars.ordered_hash(F.col("cells")).alias("ordered"), scalars.row_hash(F.col("cells")).alias("short"))
    return both.join(ordered, "r").select("r", F.col("h.sum").cast("string").alias("sum"), F.col("h.xor").alias("xor"), "ordered", "short")


# ------------------------------------------------------------------ text


def order_matrices(spark: SparkSession, d: str) -> DataFrame:
    """(file, r, c, v): a hundred matrices of customers by order priorities, with names fit for MPS."""
    keyed = order_cells(spark, d)
    return keyed.select((F.col("r") % 100).cast("string").alias("file"), F.concat(F.lit("c"), "r").alias("r"), F.substring("c", 1, 1).alias("c"), "v")


SQL_MATRICES = f"SELECT (r % 100)::VARCHAR AS file, 'c' || r AS r, c[1:1] AS c, v FROM ({SQL_CELLS['orders']})"


def read_back(spark: SparkSession, d: str, fixed_width: bool, objective: str) -> DataFrame:
    """The matrices written as MPS text, with an objective, markers and two pairs a line, and read again."""
    cells = order_matrices(spark, d)
    costs = cells.groupBy("file", "c").agg(F.sum("v").alias("v"))
    path = scratch(spark, "mps")
    mps.write(mps.text_lines(cells, costs, fixed_width, F.col("c") == "3"), path)
    found = mps.read(spark, path, fixed_width, objective)
    return found.select(F.regexp_extract("file", "file=([^/]*)$", 1).alias("file"), "r", "c", "v")


@query(f"SELECT file, r, c, v FROM ({SQL_MATRICES})")
def mps_space_separated(spark, d):
    return read_back(spark, d, False, "last")


@query(f"SELECT file, r, c, v FROM ({SQL_MATRICES})")
def mps_fixed_width(spark, d):
    return read_back(spark, d, True, "all")


@query(f"SELECT DISTINCT file, r FROM ({SQL_MATRICES})")
def mps_row_dimension(spark, d):
    path = scratch(spark, "mps")
    mps.write(mps.text_lines(order_matrices(spark, d)), path)
    return mps.row_dimension(spark, path).select(F.regexp_extract("file", "file=([^/]*)$", 1).alias("file"), "r")


def _wide_sql(line: str) -> str:
    return with_cells("numbered", f", w AS (SELECT r, max(v) FILTER (c = 0) AS a, max(v) FILTER (c = 1) AS b, max(v) FILTER (c = 2) AS d, max(v) FILTER (c = 3) AS e, max(v) FILTER (c = 4) AS f FROM cell GROUP BY r), z AS (SELECT max(greatest(1, len(v::BIGINT::VARCHAR))) AS n FROM cell) {line}")


_PADDED = " || ', ' || ".join(f"lpad(coalesce({x}::BIGINT::VARCHAR, '-'), n::INT, ' ')" for x in "abdef")
_PLAIN = " || ' ' || ".join(f"coalesce({x}, 0)::BIGINT" for x in "abdef")


@query(_wide_sql(f"SELECT r, '{{' || {_PADDED} || '}},' AS line FROM w, z"))
def matrix_text(spark, d):
    return report.dense_lines(numbered_nations(spark, d), [0, 1, 2, 3, 4], "-", "%.0f")


@query(_wide_sql(f"SELECT r, {_PLAIN} AS line FROM w"))
def numeric_text(spark, d):
    lines = report.plain_lines(numbered_nations(spark, d), [0, 1, 2, 3, 4])
    return lines.select("r", F.regexp_replace("line", r"\.0\b", "").alias("line"))


@query(
    f"""WITH p AS (SELECT i, j FROM ({near_sql('nations', 2)})), cell AS ({SQL_CELLS['nations']}),
k AS (SELECT DISTINCT i, j, c FROM p JOIN cell ON r = i OR r = j),
z AS (SELECT k.i, k.j, k.c, printf('%20.5f', coalesce(a.v, 0)) AS x, printf('%20.5f', coalesce(b.v, 0)) AS y
      FROM k LEFT JOIN cell a ON a.r = k.i AND a.c = k.c LEFT JOIN cell b ON b.r = k.j AND b.c = k.c)
SELECT i, j, '(' || i || ', ' || j || '):' || chr(10) || string_agg(x, '' ORDER BY c) || chr(10) || string_agg(y, '' ORDER BY c) AS report FROM z GROUP BY i, j"""
)
def pair_report(spark, d):
    cells = nation_cells(spark, d)
    return report.pair_report(near_parallel.blocked(cells), cells)


@query(
    f"""WITH p AS ({near_sql('nations', 2)})
SELECT 0 AS part, 'graph G {{' AS line UNION ALL SELECT 3, '}}'
UNION ALL SELECT 1, '  "' || n_nationkey || '" [label="' || n_name || CASE WHEN n_regionkey = 0 THEN '", style=filled, fillcolor="gray' ELSE '' END || '"];' FROM nation
UNION ALL SELECT 2, '  "' || i || '" -- "' || j || '" [label="' || distance || '"];' FROM p"""
)
def dot_graph(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.when(F.col("n_regionkey") == 0, F.lit("gray")).alias("fill"))
    edges = near_parallel.blocked(nation_cells(spark, d)).select(F.col("i").alias("source"), F.col("j").alias("target"), F.col("distance").alias("label"))
    return report.dot_graph(nodes, edges)


def _batch_sql(matrices: str, d: int = 2) -> str:
    """Shape, classes and near pairs of classes of each file, by the definition of the distance."""
    return f"""WITH m AS ({matrices}), cell AS (SELECT file || '/' || r AS r, file, file || '/' || c AS c, v FROM m), {_CLASSES},
size AS (SELECT rep, count(*) AS n FROM class GROUP BY rep),
rc AS (SELECT cell.* FROM cell JOIN class ON class.r = cell.r AND rep = cell.r), n AS (SELECT r, file, count(*) AS n FROM rc GROUP BY r, file),
pair AS (SELECT x.r AS i, y.r AS j, x.file, x.n + y.n AS total FROM n x JOIN n y ON x.file = y.file AND x.r < y.r AND abs(x.n - y.n) <= {d}),
common AS (SELECT i, j, a.v AS x, b.v AS y FROM pair JOIN rc a ON a.r = i JOIN rc b ON b.r = j AND b.c = a.c),
anchored AS (SELECT p.i, p.j, count(*) FILTER (abs(q.x - q.y * (p.x / p.y)) <= 1e-10) AS k, count(*) AS m
             FROM (SELECT DISTINCT * FROM common) p JOIN common q ON p.i = q.i AND p.j = q.j GROUP BY p.i, p.j, p.x, p.y),
best AS (SELECT i, j, max(k) + max(m) AS saved FROM anchored GROUP BY i, j),
near AS (SELECT pair.file, a.n * b.n AS links FROM pair LEFT JOIN best USING (i, j) JOIN size a ON a.rep = i JOIN size b ON b.rep = j WHERE total - coalesce(saved, 0) <= {d}),
shape AS (SELECT file, count(DISTINCT r) AS height, count(DISTINCT c) AS width, count(*) AS cells FROM cell GROUP BY file),
classes AS (SELECT file, count(*) AS classes FROM n GROUP BY file), pairs AS (SELECT file, count(*) AS class_pairs, sum(links) AS links FROM near GROUP BY file)
SELECT file, height, width, cells, classes, coalesce(class_pairs, 0)::BIGINT AS class_pairs, coalesce(links, 0)::BIGINT AS links
FROM shape JOIN classes USING (file) LEFT JOIN pairs USING (file)"""


@query(_batch_sql(SQL_MATRICES))
def batch_files(spark, d):
    """A hundred matrices written as MPS files and reported in one plan."""
    from collinea.jobs.batch import mps_summary

    path = scratch(spark, "mps")
    mps.write(mps.text_lines(order_matrices(spark, d)), path)
    return mps_summary(spark, path).withColumn("file", F.regexp_extract("file", "file=([^/]*)$", 1))


@query(_batch_sql(" UNION ALL ".join(f"SELECT '{name}' AS file, r::VARCHAR AS r, c::VARCHAR AS c, v FROM ({SQL_CELLS[name]})" for name in ("events", "nations", "orders", "parts"))))
def batch_report(spark, d):
    """Shape, cells and near-parallel classes of each of the matrices in the given tables."""
    from collinea.jobs.batch import summary

    named = {"events": event_cells, "nations": nation_cells, "orders": order_cells, "parts": part_cells}
    return summary({name: cells(spark, d) for name, cells in named.items()})
