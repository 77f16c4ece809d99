"""Scalar functions with the library's tolerance; all are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: values this close to zero are zero; absolute, not relative
EPSILON = 1e-10
#: steps of the grid on which ratios are compared
GRID = 1e10


def is_nonzero(v: Column) -> Column:
    """Beyond the tolerance on either side; NaN, which Spark sorts above all, is not."""
    return ((v < -EPSILON) | (v > EPSILON)) & ~F.isnan(v)


def is_positive(v: Column) -> Column:
    return (v > EPSILON) & ~F.isnan(v)


def is_negative(v: Column) -> Column:
    return v < -EPSILON


def eps_floor(v: Column) -> Column:
    """Floor as a double; a value just below an integer counts as that integer."""
    low = F.floor(v).cast("double")
    return F.when(F.abs(v - low - 1) < EPSILON, low + 1).otherwise(low)


def fractional(v: Column) -> Column:
    """What is above the floor; zero just below an integer."""
    low = F.floor(v).cast("double")
    return F.when(F.abs(v - low - 1) < EPSILON, F.lit(0.0)).otherwise(v - low)


def exp2(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def quantise(v: Column) -> Column:
    """The nearest grid step, half away from zero; null where no 64-bit number holds it.

    Doubles from 2^52 on are whole; below, what is above the floor is exact, which ``round`` finds by a decimal.
    """
    x = v * GRID
    size = F.abs(x)
    low = F.floor(size)
    nearest = low + F.when(size - low >= 0.5, F.lit(1)).otherwise(F.lit(0))
    return F.when(size < 2.0**52, F.when(x < 0, -nearest).otherwise(nearest)).otherwise(x.try_cast("bigint"))


def trim_all(s: Column) -> Column:
    """Without any white space at the ends, tabs and line ends included."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def trim_left(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def trim_right(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def join_text(parts: Column, delimiter: str) -> Column:
    return F.array_join(parts, delimiter)


def as_binary(n: Column, bits: int = 63) -> Column:
    """``0b`` and a fixed number of binary digits; 63 for a bigint leaves the sign out."""
    return F.concat(F.lit("0b"), F.right(F.lpad(F.bin(n.cast("bigint")), 64, "0"), F.lit(bits)))


def portable_hash(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts' texts; any engine with md5 finds the same number."""
    text = F.concat_ws(chr(31), *(F.coalesce(part.cast("string"), F.lit("")) for part in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cell_text(c: Column, v: Column) -> Column:
    """Column and value on the grid, as ``c=steps``; the same in any engine."""
    return F.concat(c.cast("string"), F.lit("="), F.coalesce(quantise(v).cast("string"), F.lit("")))


def ordered_hash(cells: Column) -> Column:
    """The MD5 of a row's cells in their order."""
    return F.md5(F.array_join(F.transform(cells, lambda cell: cell_text(cell["c"], cell["v"])), " "))


def row_hash(cells: Column) -> Column:
    """A 32-bit hash of a row: the beginning of its ordered hash."""
    return F.conv(F.substring(ordered_hash(cells), 1, 8), 16, 10).cast("bigint")


def unordered_hash(*parts: Column) -> Column:
    """An aggregate that no order of rows changes: sum and xor of their hashes.

    The sum of 60-bit numbers is a decimal of 38 digits, which no table overflows.
    """
    h = portable_hash(*parts)
    return F.struct(F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum"), F.bit_xor(h).alias("xor"))


def tagged(*cases: tuple[Column, Column]) -> Column:
    """The value of the first case whose condition holds; null if none does."""
    return reduce(lambda made, case: made.when(*case), cases[1:], F.when(*cases[0]))
