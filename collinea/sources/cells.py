"""Cell tables: one row (r, c, v) for each stored value of a sparse matrix.

Keys keep the names of the source, so no result depends on an order of columns. A missing
cell is zero; values within the tolerance of zero are not stored; cells of one place are
summed. Shape is carried apart, since empty rows and columns have no cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from collinea.functions.scalars import is_nonzero


@dataclass(frozen=True)
class Shape:
    height: int
    width: int


def from_rows(df: DataFrame, r: str | Column, c: str | Column, v: Column) -> DataFrame:
    """Cells of a table: ``v`` is an aggregate that folds the rows of one place."""
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return df.groupBy(r.alias("r"), c.alias("c")).agg(v.cast("double").alias("v")).filter(is_nonzero(F.col("v")))


def from_arrays(df: DataFrame, r: str, values: str) -> DataFrame:
    """Cells of dense rows held as arrays; near-zero elements are dropped."""
    return df.select(F.col(r).alias("r"), F.posexplode(values).alias("c", "v")).select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v")).filter(is_nonzero(F.col("v")))


def from_lists(spark: SparkSession, rows: list[list[float]]) -> tuple[DataFrame, Shape]:
    """A literal matrix; ragged rows are an error."""
    width = len(rows[0]) if rows else 0
    if any(len(row) != width for row in rows):
        raise ValueError("rows of different lengths")
    cells = [(i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)]
    df = spark.createDataFrame(cells, "r long, c long, v double")
    return df.filter(is_nonzero(F.col("v"))), Shape(len(rows), width)


def constant(spark: SparkSession, shape: Shape, value: float) -> DataFrame:
    """A matrix of one value; ``range`` and integer arithmetic, no join."""
    cells = spark.range(shape.height * shape.width)
    return cells.select((F.col("id") / shape.width).cast("long").alias("r"), (F.col("id") % shape.width).alias("c"), F.lit(float(value)).alias("v")).filter(is_nonzero(F.col("v")))


def unit(spark: SparkSession, shape: Shape, r: int, c: int) -> DataFrame:
    """A single one; out of the shape is an error."""
    if not (0 <= r < shape.height and 0 <= c < shape.width):
        raise IndexError("no such place")
    return spark.range(1).select(F.lit(r).cast("long").alias("r"), F.lit(c).cast("long").alias("c"), F.lit(1.0).alias("v"))


def identity(keys: DataFrame, key: str) -> DataFrame:
    """Ones on the diagonal of the given keys."""
    return keys.select(F.col(key).alias("r"), F.col(key).alias("c"), F.lit(1.0).alias("v")).distinct()


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "r long, c long, v double")


def shape_of(cells: DataFrame) -> Shape:
    """Height and width of numbered cells, as far as cells show it; one small aggregate."""
    row = cells.agg(F.coalesce(F.max("r") + 1, F.lit(0)), F.coalesce(F.max("c") + 1, F.lit(0))).first()
    return Shape(int(row[0]), int(row[1]))
