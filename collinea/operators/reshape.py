"""Access and reshaping: every operator is a filter, a rename or an offset on cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from collinea.functions.scalars import is_nonzero
from collinea.sources.cells import Shape


def get_column(cells: DataFrame, c: object) -> DataFrame:
    return cells.filter(F.col("c") == F.lit(c)).select("r", "v")


def get_row(cells: DataFrame, r: object) -> DataFrame:
    return cells.filter(F.col("r") == F.lit(r)).select("c", "v")


def element(cells: DataFrame, r: object, c: object) -> DataFrame:
    """One row with the value at a place, zero where no cell is."""
    return cells.filter((F.col("r") == F.lit(r)) & (F.col("c") == F.lit(c))).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


def sparse_rows(cells: DataFrame) -> DataFrame:
    """(r, nnz, cells): each row as an array of (c, v) in column order."""
    return cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("cells")).select("r", F.size("cells").cast("long").alias("nnz"), "cells")


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def slice_cells(cells: DataFrame, r0: int, r1: int, c0: int, c1: int, shape: Shape | None = None) -> DataFrame:
    """The half-open ranges of numbered cells, re-based to zero."""
    if shape and not (0 <= r0 <= r1 <= shape.height and 0 <= c0 <= c1 <= shape.width):
        raise IndexError("slice out of range")
    inside = (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    return cells.filter(inside).select((F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), "v")


def assign_slice(cells: DataFrame, part: DataFrame, r0: int, c0: int, part_shape: Shape, shape: Shape | None = None) -> DataFrame:
    """The cells with a block replaced by ``part``.

    A block that leaves ``shape`` is an error, and so is a cell of ``part`` outside of ``part_shape``.
    """
    if r0 < 0 or c0 < 0 or (shape and (r0 + part_shape.height > shape.height or c0 + part_shape.width > shape.width)):
        raise IndexError("the block leaves the matrix")
    inside = F.col("r").between(r0, r0 + part_shape.height - 1) & F.col("c").between(c0, c0 + part_shape.width - 1)
    fits = F.col("r").between(0, part_shape.height - 1) & F.col("c").between(0, part_shape.width - 1)
    value = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a cell outside of the block's shape")).cast("double"))
    return cells.filter(~inside).unionByName(part.select((F.col("r") + r0).alias("r"), (F.col("c") + c0).alias("c"), value.alias("v")))


def swap_slices(cells: DataFrame, r0: int, c0: int, r1: int, c1: int, shape: Shape) -> DataFrame:
    """Two blocks of one shape exchanged: one pass, no join. Overlapping blocks are an error."""
    if abs(r0 - r1) < shape.height and abs(c0 - c1) < shape.width:
        raise ValueError("the blocks overlap")
    at = lambda r, c: F.col("r").between(r, r + shape.height - 1) & F.col("c").between(c, c + shape.width - 1)
    move = lambda name, a, b: F.when(at(r0, c0), F.col(name) + (b - a)).when(at(r1, c1), F.col(name) - (b - a)).otherwise(F.col(name))
    return cells.select(move("r", r0, r1).alias("r"), move("c", c0, c1).alias("c"), "v")


def pad(cells: DataFrame, old: Shape, new: Shape, fill: float = 0.0) -> DataFrame:
    """Numbered cells in a larger shape; the new places hold ``fill``. Shrinking is an error.

    Only the new border is generated; the old cells pass unchanged.
    """
    if new.height < old.height or new.width < old.width:
        raise ValueError("a matrix can't be padded to a smaller shape")
    if fill == 0.0:
        return cells
    spark = cells.sparkSession
    right = spark.range(new.height * (new.width - old.width)) if new.width > old.width else None
    parts = [cells]
    if right is not None:
        width = new.width - old.width
        parts.append(right.select(F.floor(F.col("id") / width).alias("r"), (F.col("id") % width + old.width).alias("c"), F.lit(fill).alias("v")))
    if new.height > old.height and old.width:
        below = spark.range((new.height - old.height) * old.width)
        parts.append(below.select((F.floor(F.col("id") / old.width) + old.height).alias("r"), (F.col("id") % old.width).alias("c"), F.lit(fill).alias("v")))
    return reduce(DataFrame.unionByName, parts)


def vstack(parts: list[tuple[DataFrame, Shape]]) -> tuple[DataFrame, Shape]:
    """Matrices of one width below one another."""
    if len({shape.width for _, shape in parts}) > 1:
        raise ValueError("different widths")
    out, height = [], 0
    for cells, shape in parts:
        out.append(cells.select((F.col("r") + height).alias("r"), "c", "v"))
        height += shape.height
    return reduce(DataFrame.unionByName, out), Shape(height, parts[0][1].width)


def hstack(parts: list[tuple[DataFrame, Shape]]) -> tuple[DataFrame, Shape]:
    """Matrices of one height side by side."""
    if len({shape.height for _, shape in parts}) > 1:
        raise ValueError("different heights")
    stacked, shape = vstack([(transpose(cells), Shape(s.width, s.height)) for cells, s in parts])
    return transpose(stacked), Shape(shape.width, shape.height)


def add_column(cells: DataFrame, shape: Shape, values: DataFrame, shift: int = 0, keep_zeros: bool = False) -> tuple[DataFrame, Shape]:
    """A new last column from ``values(r, v)``, moved down by ``shift``."""
    new = values.select((F.col("r") + shift).cast("long").alias("r"), F.lit(shape.width).cast("long").alias("c"), F.col("v").cast("double").alias("v"))
    return cells.unionByName(new if keep_zeros else new.filter(is_nonzero(F.col("v")))), Shape(shape.height, shape.width + 1)


def pop_column(cells: DataFrame, shape: Shape) -> tuple[DataFrame, Shape]:
    return cells.filter(F.col("c") < shape.width - 1), Shape(shape.height, shape.width - 1)


def clear(cells: DataFrame) -> DataFrame:
    return cells.limit(0)


def row_zip(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(i, j, c, x, y) for each column that row i or row j holds; the absent value is zero.

    Both sides keep their cells under the pair, so one grouped pass replaces a full join.
    """
    left = pairs.join(cells, pairs["i"] == cells["r"]).select("i", "j", "c", F.col("v").alias("x"), F.lit(0.0).alias("y"))
    right = pairs.join(cells, pairs["j"] == cells["r"]).select("i", "j", "c", F.lit(0.0).alias("x"), F.col("v").alias("y"))
    return left.unionByName(right).groupBy("i", "j", "c").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
