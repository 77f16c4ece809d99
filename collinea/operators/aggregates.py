"""Aggregates: counts, histograms, and the accumulators with their tolerant forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from collinea.functions.scalars import EPSILON
from collinea.sources.workspace import cut


def row_nnz(cells: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(r, nnz); with a row dimension, empty rows count zero."""
    counted = cells.groupBy("r").agg(F.count("*").alias("nnz"))
    return counted if rows is None else rows.select("r").distinct().join(counted, "r", "left").select("r", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def nnz_histogram(cells: DataFrame, sizes: int) -> DataFrame:
    """How many rows hold exactly 1, 2, ... ``sizes`` cells; empty buckets are shown."""
    found = row_nnz(cells).groupBy("nnz").agg(F.count("*").alias("n"))
    buckets = cells.sparkSession.range(1, sizes + 1).withColumnRenamed("id", "nnz")
    return buckets.join(found, "nnz", "left").select("nnz", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def most_frequent(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def geometric_mean(v: Column) -> Column:
    """The n-th root of the product, from a mean of logarithms; 1 without values, 0 with a zero."""
    return F.coalesce(F.when(F.min(v) <= 0, F.when(F.min(v) == 0, F.lit(0.0))).otherwise(F.exp(F.avg(F.ln(F.greatest(v, F.lit(1e-300)))))), F.when(F.count(v) == 0, F.lit(1.0)))


def product_mean(v: Column) -> Column:
    """The n-th root of the plain product: overflows as the product does; 1 without values."""
    return F.coalesce(F.pow(F.product(v), F.lit(1.0) / F.greatest(F.count(v), F.lit(1))), F.lit(1.0))


def arg_min(index: Column, v: Column) -> Column:
    """The least index among those of the least value."""
    return F.min_by(index, F.struct(v.alias("v"), index.alias("k")))


def arg_max(index: Column, v: Column) -> Column:
    """The least index among those of the greatest value."""
    return F.max_by(index, F.struct(v.alias("v"), (-index).alias("k")))


def ordered_values(order: Column, v: Column) -> Column:
    """The non-null values of a group as an array in a stated order; for bounded groups."""
    return F.transform(F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct(order.alias("k"), v.alias("v"))))), lambda x: x["v"])


def tolerant_min(values: Column) -> Column:
    """A fold that only a value smaller by more than the tolerance replaces; null without any."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda least, v: F.when(least.isNull() | (v < least - EPSILON), v).otherwise(least))


def tolerant_max(values: Column) -> Column:
    return F.aggregate(values, F.lit(None).cast("double"), lambda most, v: F.when(most.isNull() | (v > most + EPSILON), v).otherwise(most))


def compensated_state(values: Column) -> Column:
    """Kahan's sum and compensation of an array in its order."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(state: Column, v: Column) -> Column:
        y = v - state["c"]
        t = state["s"] + y
        return F.struct(t.alias("s"), ((t - state["s"]) - y).alias("c"))

    return F.aggregate(values, start, step)


def compensated_sum(values: Column) -> Column:
    """Kahan's sum of an array in its order."""
    return compensated_state(values)["s"]


def exact_sum(v: Column) -> Column:
    """A distributed sum without rounding drift: decimal partial sums of any order agree."""
    return F.sum(v.cast("decimal(38,12)")).cast("double")


def ordered_totals(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, n, total, least, most): Kahan's sum and the tolerant folds of each group in order.

    A group may be the whole table. Rows are put in ranges of (group, order) and written once; each
    range makes a state for each of its groups, and the states of a group are merged in order:

    * the sum's state is a pair of sum and compensation; sums and compensations of all ranges are
      added by the same rule;
    * only a strictly new extreme can move a tolerant fold, so a state is the values that are new
      extremes within their range, and the fold goes over these. They are few unless values fall
      (or rise) all along.
    """
    held = df.select(F.col(group).alias("g"), F.col(order).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    ranged = cut(held.repartitionByRange("g", "k").withColumn("range", F.spark_partition_id()), "ordered-ranges")
    before = Window.partitionBy("g", "range").orderBy("k", "v").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.min("v").over(before), F.max("v").over(before)
    marked = ranged.withColumn("low", low).withColumn("high", high)
    entry = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.struct("k", "v"))))
    values = lambda entries: F.transform(entries, lambda x: x["v"])
    states = marked.groupBy("g", "range").agg(
        F.count("*").alias("n"),
        entry(F.lit(True)).alias("all"),
        entry(F.col("low").isNull() | (F.col("v") < F.col("low"))).alias("falls"),
        entry(F.col("high").isNull() | (F.col("v") > F.col("high"))).alias("rises"),
    )
    part = compensated_state(values(F.col("all")))
    state = F.struct("range", part.alias("part"), values(F.col("falls")).alias("falls"), values(F.col("rises")).alias("rises"))
    merged = states.groupBy("g").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(state)).alias("states"))
    sums = F.flatten(F.transform("states", lambda x: F.array(x["part"]["s"], -x["part"]["c"])))
    chain = lambda name: F.flatten(F.transform("states", lambda x: x[name]))
    return merged.select(F.col("g").alias(group), "n", compensated_sum(sums).alias("total"), tolerant_min(chain("falls")).alias("least"), tolerant_max(chain("rises")).alias("most"))
