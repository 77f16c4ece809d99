"""Text reports: matrices, pairs of rows, graphs and batch summaries, one string a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from collinea.operators.reshape import row_zip


def dense_lines(cells: DataFrame, columns: list[object], missing: str = "-", number: str = "%s") -> DataFrame:
    """(r, line): ``{a, b},`` with every value padded to the longest one of the matrix."""
    shown = cells.withColumn("t", F.format_string(number, F.col("v")))
    width = shown.agg(F.greatest(F.coalesce(F.max(F.length("t")), F.lit(0)), F.lit(len(missing))).alias("w"))
    wide = shown.groupBy("r").pivot("c", columns).agg(F.first("t"))
    values = F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(missing)) for c in columns))
    padded = F.transform(values, lambda t: F.concat(F.repeat(F.lit(" "), (F.col("w") - F.length(t)).cast("int")), t))
    return wide.crossJoin(F.broadcast(width)).select("r", F.concat(F.lit("{"), F.array_join(padded, ", "), F.lit("},")).alias("line"))


def plain_lines(cells: DataFrame, columns: list[object]) -> DataFrame:
    """(r, line): the values of a row separated by spaces, for numeric tools; zeros are shown."""
    wide = cells.groupBy("r").pivot("c", columns).agg(F.first("v"))
    values = F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).cast("string") for c in columns))
    return wide.select("r", F.array_join(values, " ").alias("line"))


def pair_report(pairs: DataFrame, cells: DataFrame, most: int | None = None, number: str = "%20.5f") -> DataFrame:
    """(i, j, report): a heading, and both rows over the columns that either of them holds."""
    if most is not None:
        pairs = pairs.orderBy("i", "j").limit(most)
    zipped = row_zip(pairs.select("i", "j"), cells).groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("c", "x", "y"))).alias("z"))
    line = lambda name: F.array_join(F.transform("z", lambda p: F.format_string(number, p[name])), "")
    head = F.concat(F.lit("("), F.col("i").cast("string"), F.lit(", "), F.col("j").cast("string"), F.lit("):"))
    return zipped.select("i", "j", F.concat_ws("\n", head, line("x"), line("y")).alias("report"))


def dot_nodes(nodes: DataFrame, labels: bool = True) -> DataFrame:
    """(part, line) of nodes (id, label, fill); a null fill is left out."""
    attributes = F.concat_ws(", ", F.concat(F.lit('label="'), F.col("label"), F.lit('"')) if labels else F.lit('label=""'), F.concat(F.lit('style=filled, fillcolor="'), F.col("fill"), F.lit('"')))
    return nodes.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" ['), attributes, F.lit("];")).alias("line"))


def dot_edges(edges: DataFrame, labels: bool = True, directed: bool = False) -> DataFrame:
    """(part, line) of edges (source, target, label)."""
    mark = F.concat(F.lit(' [label="'), F.col("label").cast("string"), F.lit('"]')) if labels else F.lit("")
    arrow = '" -> "' if directed else '" -- "'
    return edges.select(F.lit(2).alias("part"), F.concat(F.lit('  "'), F.col("source").cast("string"), F.lit(arrow), F.col("target").cast("string"), F.lit('"'), mark, F.lit(";")).alias("line"))


def dot_graph(nodes: DataFrame, edges: DataFrame, name: str = "G", labels: bool = True, directed: bool = False) -> DataFrame:
    """The lines of a graph text; parts 0 to 3 give their order."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, f"{'digraph' if directed else 'graph'} {name} {{"), (3, "}")], "part int, line string")
    return frame.unionByName(dot_nodes(nodes, labels)).unionByName(dot_edges(edges, labels, directed))


def write_lines(lines: DataFrame, path: str, *order: Column) -> None:
    """A text folder whose files, in name order, hold the lines in the given order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
