"""MPS text: reader and writer of mixed-integer-program matrices.

Files are split like any text: no task holds a file. A line's place is its split and its order
there; the section it lies in is the last header before it, found inside its split and, for lines
before a split's first header, carried over from the splits before (one small row for each split).
Archives ending in ``.gz`` are decompressed by Spark's text source, as one split.

A folder of instances is one job: each matrix has its ``file`` key. What the writer makes is a
folder of ordered part files for each matrix, ``file=name/part-...``, which is read as one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from collinea.functions.scalars import is_nonzero, trim_right
from collinea.sources.workspace import cut

#: fixed values: section headers, matched as prefixes
HEADERS = ("NAME", "ROWS", "COLUMNS", "RHS", "BOUNDS", "RANGES", "OBJECT", "ENDATA")
#: fixed values: start and width of the six fields of a fixed-width line, counted from 0
FIELDS = ((1, 2), (4, 8), (14, 8), (24, 12), (39, 8), (49, 12))
#: fixed value: the longest numeric beginning of a text
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, text, section) of the lines that count.

    ``split`` and ``at`` order the lines of a file: by part file and first byte of the split, then
    by the order in which the split is read.
    """
    source = spark.read.option("recursiveFileLookup", "true").text(path)
    name = F.col("_metadata.file_path")
    raw = source.select(
        F.regexp_replace(name, r"/part-[^/]*$", "").alias("file"),
        F.struct(F.regexp_extract(name, r"[^/]*$", 0).alias("part"), F.col("_metadata.file_block_start").alias("start")).alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", r"\r$", "").alias("text"),
    )
    kept = raw.filter(~(F.trim("text") == "") & ~F.col("text").startswith("*"))
    known = F.lit(None).cast("string")
    for header in HEADERS:
        known = F.when(F.col("text").startswith(header), header).otherwise(known)
    unknown = F.raise_error(F.concat(F.lit("unknown section: "), F.col("text"))).cast("string")
    marked = kept.withColumn("header", F.when(~F.col("text").startswith(" "), F.coalesce(known, unknown)))
    # a row for each split: its last header, and whether the file has ended by then
    ends = marked.groupBy("file", "split").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("at"))).alias("last"), F.max(F.coalesce(F.col("header") == "ENDATA", F.lit(False))).alias("ended"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("carried"), F.coalesce(F.max("ended").over(before), F.lit(False)).alias("over"))
    so_far = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("own", F.last("header", ignorenulls=True).over(so_far)).withColumn("closed", F.max(F.coalesce(F.col("header") == "ENDATA", F.lit(False))).over(so_far))
    live = placed.filter(~F.col("closed")).join(carried, ["file", "split"]).filter(~F.col("over"))
    stray = F.raise_error(F.concat(F.lit("data before any section: "), F.col("text"))).cast("string")
    section = F.coalesce("own", "carried", stray)
    # written here: else the checks of a section's fields could run before a line's section is known
    return cut(live.filter("header is null").select("file", "split", "at", "text", section.alias("section")), "mps-lines")


def fields(text: Column, fixed_width: bool) -> Column:
    """The six fields of a line; absent ones are empty. More than six words are an error."""
    if fixed_width:
        return F.array(*(trim_right(F.substring(text, start + 1, width)) for start, width in FIELDS))
    words = F.split(F.trim(F.regexp_replace(F.substring(text, 5, 1 << 20), r"\s+", " ")), " ")
    checked = F.when(F.size(words) > 5, F.raise_error(F.concat(F.lit("too many fields: "), text)).cast("array<string>")).otherwise(words)
    head = F.trim(F.substring(text, 2, 2))
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.when(k == 0, head).otherwise(F.coalesce(F.get(checked, k - 1), F.lit(""))))


def row_types(placed: DataFrame, fixed_width: bool) -> DataFrame:
    """(file, place, type, row_name) of the ROWS section; a type other than E, L, G, N fails."""
    split = placed.filter("section = 'ROWS'").withColumn("f", fields(F.col("text"), fixed_width))
    letter = F.substring(F.trim(F.get("f", F.lit(0))), 1, 1)
    wrong = F.raise_error(F.concat(F.lit("unknown row type: "), F.col("text"))).cast("string")
    return split.select("file", F.struct("split", "at").alias("place"), F.when(letter.isin("E", "L", "G", "N"), letter).otherwise(wrong).alias("type"), F.trim(F.get("f", F.lit(1))).alias("row_name"))


def read(spark: SparkSession, path: str, fixed_width: bool = False, objective: str = "last") -> DataFrame:
    """Cells (file, r, c, v) of the constraint matrices of all files under ``path``.

    Objective rows are left out: the last N row (``objective="last"``) or ``"all"`` of them.
    Marker lines and near-zero values are dropped; a repeated place is an error.
    """
    placed = lines(spark, path)
    types = row_types(placed, fixed_width).filter("type = 'N'")
    gone = types.groupBy("file").agg(F.max_by("row_name", "place").alias("r")) if objective == "last" else types.select("file", F.col("row_name").alias("r"))
    columns = placed.filter("section = 'COLUMNS'").withColumn("f", fields(F.col("text"), fixed_width)).filter(F.get("f", F.lit(2)) != "'MARKER'")
    pair = lambda k: F.struct(F.trim(F.get("f", F.lit(k))).alias("r"), F.get("f", F.lit(k + 1)).alias("number"))
    pairs = columns.select("file", F.trim(F.get("f", F.lit(1))).alias("c"), F.explode(F.array(pair(2), pair(4))).alias("p")).select("file", "p.r", "c", F.regexp_extract("p.number", NUMBER, 1).try_cast("double").alias("v"))
    # one name for each file: the objective of a file is a handful of rows
    kept = pairs.filter("r != ''").join(gone.distinct(), ["file", "r"], "left_anti").filter(is_nonzero(F.col("v")))
    repeated = F.raise_error(F.concat(F.lit("repeated place: "), F.col("r"), F.lit(" "), F.col("c"))).cast("double")
    return kept.groupBy("file", "r", "c").agg(F.first("v").alias("v"), F.count("*").alias("n")).select("file", "r", "c", F.when(F.col("n") == 1, F.col("v")).otherwise(repeated).alias("v"))


def row_dimension(spark: SparkSession, path: str, fixed_width: bool = False) -> DataFrame:
    """(file, r) of every constraint row that the ROWS section names, empty ones included."""
    return row_types(lines(spark, path), fixed_width).filter("type != 'N'").select("file", F.col("row_name").alias("r"))


def numbered(cells: DataFrame, key: str, name: str) -> DataFrame:
    """Dense numbers for keys, in key order: counts for each range partition, then offsets.

    Only one number for each partition is gathered. The ranges are written once and reread, so
    that counts and rows see the same partition numbers, whatever adaptive execution merges.
    """
    keys = cut(cells.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = keys.groupBy("_p").agg(F.count("*").alias("n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("_p").orderBy(key)
    return keys.withColumn("k", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_p").select(key, (F.col("k") + F.col("start")).cast("long").alias(name))


def text_lines(cells: DataFrame, objective: DataFrame | None = None, fixed_width: bool = False, integer: Column | None = None) -> DataFrame:
    """(file, section, key, text): the ordered lines of the matrices of ``cells(file, r, c, v)``.

    The objective's coefficients are ``objective(file, c, v)``. A column's cells stand two to a
    line. Columns for which ``integer`` holds lie between markers, one pair of markers each.
    """
    name = lambda c: F.col(c).cast("string")
    cells = cells.select(name("file").alias("file"), name("r").alias("r"), name("c").alias("c"), F.col("v").cast("string").alias("v"))
    heads = [(0, "NAME"), (1, "ROWS"), (2, " N  objective"), (4, "COLUMNS"), (6, "RHS"), (7, "ENDATA")]
    frame = F.explode(F.array(*(F.struct(F.lit(k).alias("section"), F.lit("").alias("key"), F.lit(text).alias("text")) for k, text in heads)))
    rows = cells.select("file", "r").distinct().select("file", F.lit(3).alias("section"), F.col("r").alias("key"), F.concat(F.lit(" E  "), "r").alias("text"))
    all_cells = cells
    if objective is not None:
        all_cells = cells.unionByName(objective.select(name("file").alias("file"), F.lit("objective").alias("r"), name("c").alias("c"), F.col("v").cast("string").alias("v")))
    held = all_cells.groupBy("file", "c").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("held"))
    pad = (lambda c, n: F.rpad(c, n, " ")) if fixed_width else (lambda c, n: F.concat(c, F.lit("  ")))
    number = (lambda c: F.concat(F.lpad(c, 12, " "), F.lit("   "))) if fixed_width else (lambda c: F.concat(c, F.lit("  ")))

    def line(k: Column) -> Column:
        pair = lambda at: F.coalesce(F.concat(pad(F.get("held", at)["r"], 10), number(F.get("held", at)["v"])), F.lit(""))
        return trim_right(F.concat(F.lit("    "), pad(F.col("c"), 10), pair(k), pair(k + 1)))

    body = F.transform(F.sequence(F.lit(0), F.size("held") - 1, F.lit(2)), line)
    if integer is not None:
        marker = lambda kind: F.concat(F.lit("    "), pad(F.lit("MARKER"), 10), pad(F.lit("'MARKER'"), 10), F.lit(kind))
        body = F.when(integer, F.concat(F.array(marker("'INTORG'")), body, F.array(marker("'INTEND'")))).otherwise(body)
    columns = held.select("file", F.lit(5).alias("section"), F.col("c").alias("key"), F.array_join(body, "\n").alias("text"))
    return cells.select("file").distinct().select("file", frame.alias("h")).select("file", "h.*").unionByName(rows).unionByName(columns)


def write(lines: DataFrame, path: str) -> None:
    """Lines of ``text_lines`` as ordered part files below ``path/file=name``; a large matrix is written by many tasks."""
    order = ["file", "section", "key"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("file", "text").write.partitionBy("file").text(path)
