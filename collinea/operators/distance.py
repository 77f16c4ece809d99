"""Scale-invariant Hamming distance of sparse rows.

For an anchor column that both rows hold, the rows are compared at the ratio of the two
values; the distance is the least number of differing places over all anchors. With n_x and
n_y cells, m common columns and k of them agreeing under the best anchor, that is
n_x + n_y - m - k. All of it is one higher-order expression on two cell arrays, without a
shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from collinea.functions.scalars import EPSILON


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def common_values(x: Column, y: Column) -> Column:
    """Array of (x, y) values of the columns that both cell arrays hold.

    A merge: the cells of both in column order, where a column of both has two neighbours.
    """
    of = lambda cells, side: F.transform(cells, lambda cell: F.struct(cell["c"].alias("c"), F.lit(side).alias("s"), cell["v"].alias("v")))
    met = lambda both: F.transform(F.sequence(F.lit(0), F.size(both) - 2), lambda k: F.struct(F.get(both, k).alias("a"), F.get(both, k + 1).alias("b")))
    pairs = bound(F.sort_array(F.concat(of(x, 0), of(y, 1))), lambda both: F.when(F.size(both) > 1, met(both)).otherwise(F.slice(met(both), 1, 0)))
    return F.transform(F.filter(pairs, lambda p: p["a"]["c"] == p["b"]["c"]), lambda p: F.struct(p["a"]["v"].alias("x"), p["b"]["v"].alias("y")))


def agreeing(common: Column, ratio: Column) -> Column:
    """How many common columns agree at a ratio."""
    return F.size(F.filter(common, lambda p: F.abs(p["x"] - p["y"] * ratio) <= EPSILON))


def hamming(x: Column, y: Column) -> Column:
    """The distance of two arrays of (c, v), whose values are all nonzero."""

    def measure(common: Column) -> Column:
        ratios = F.array_distinct(F.transform(common, lambda anchor: anchor["x"] / anchor["y"]))
        best = F.array_max(F.transform(ratios, lambda ratio: agreeing(common, ratio)))
        return (F.size(x) + F.size(y) - F.size(common) - F.coalesce(best, F.lit(0))).cast("long")

    return bound(common_values(x, y), measure)


def may_be_within(x: Column, y: Column, d: int) -> Column:
    """Whether the distance may be at most ``d``; false only where it is greater.

    At most d common columns disagree at the best ratio, so one of any d + 1 has that ratio but
    for the tolerance; the others are compared at a tolerance widened by as much.
    """

    def measure(common: Column) -> Column:
        need = F.size(x) + F.size(y) - F.size(common) - d
        slack = lambda p, a: 2 * EPSILON * (1 + F.abs(p["y"] / a["y"])) + 1e-12 * F.abs(p["x"])
        close = lambda a: F.size(F.filter(common, lambda p: F.abs(p["x"] - p["y"] * (a["x"] / a["y"])) <= slack(p, a)))
        return (need <= 0) | ((need <= F.size(common)) & F.exists(F.slice(common, 1, d + 1), lambda a: close(a) >= need))

    return bound(common_values(x, y), measure)


def within_at(x: Column, y: Column, ratios: Column, d: int) -> Column:
    """Whether the rows differ in at most ``d`` places at one of the known ratios; linear in the cells.

    The tolerance is widened by what two anchors of one true ratio may differ in, so no pair is lost.
    """

    def measure(common: Column) -> Column:
        need = F.size(x) + F.size(y) - F.size(common) - d
        least = F.array_min(F.transform(common, lambda p: F.abs(p["y"])))
        slack = lambda p: 2 * EPSILON * (1 + F.abs(p["y"]) / least) + 1e-12 * F.abs(p["x"])
        close = lambda ratio: F.size(F.filter(common, lambda p: F.abs(p["x"] - p["y"] * ratio) <= slack(p)))
        return (need <= 0) | ((need <= F.size(common)) & F.exists(ratios, lambda ratio: close(ratio) >= need))

    return bound(common_values(x, y), measure)


def hamming_fixed_ratio(x: Column, y: Column, ratio: Column) -> Column:
    """Differing places of x and ratio * y; one-sided places differ unless within tolerance."""
    held_x, held_y = F.map_from_entries(x), F.map_from_entries(y)
    keys = F.array_union(F.transform(x, lambda cell: cell["c"]), F.transform(y, lambda cell: cell["c"]))
    value = lambda held, c: F.coalesce(F.try_element_at(held, c), F.lit(0.0))
    return F.size(F.filter(keys, lambda c: F.abs(value(held_x, c) - value(held_y, c) * ratio) > EPSILON)).cast("long")


def majority_hamming(x: Column, y: Column) -> Column:
    """The distance at the ratio that most common places share, with one tolerance throughout.

    One fold over the common places in column order keeps a candidate ratio and its balance: a
    place within the tolerance adds one, another takes one away, and at zero the next place's
    ratio is the candidate. One more pass counts its places. Equal to ``hamming`` whenever more
    than half of the common places share a ratio; else an upper bound of it.
    """

    def step(held: Column, ratio: Column) -> Column:
        same = F.abs(held["ratio"] - ratio) <= EPSILON
        return F.when(same, F.struct(held["ratio"].alias("ratio"), (held["n"] + 1).alias("n"))).otherwise(
            F.when(held["n"] == 0, F.struct(ratio.alias("ratio"), F.lit(1).alias("n"))).otherwise(F.struct(held["ratio"].alias("ratio"), (held["n"] - 1).alias("n")))
        )

    def measure(common: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("ratio"), F.lit(0).alias("n"))
        winner = F.aggregate(F.transform(common, lambda p: p["x"] / p["y"]), start, step, lambda held: held["ratio"])
        agreed = bound(winner, lambda ratio: agreeing(common, ratio))
        return (F.size(x) + F.size(y) - F.size(common) - agreed).cast("long")

    return bound(common_values(x, y), measure)


def pair_distances(pairs: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """(i, j, distance) of pairs of rows from ``sparse_rows``; of those within ``most`` if given."""
    left, right = rows.select(F.col("r").alias("i"), F.col("cells").alias("x")), rows.select(F.col("r").alias("j"), F.col("cells").alias("y"))
    joined = pairs.join(left, "i").join(right, "j")
    if most is not None:
        joined = joined.filter(may_be_within(F.col("x"), F.col("y"), most))
    measured = joined.select("i", "j", hamming(F.col("x"), F.col("y")).alias("distance"))
    return measured if most is None else measured.filter(F.col("distance") <= most)
