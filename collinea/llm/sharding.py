"""Operator 4, sharding by extendible hashing.

Documents are placed by the bits of a hash. A directory, indexed by hash-prefix bits, points
to buckets; only a bucket over its byte limit splits on one more bit, until every shard fits.
Byte sums per directory cell are taken with map-side sums, so the work that decides the
splits is one small table; documents then join their cell, which spreads evenly.

DataFrame functions only. Rows that share id and text have one hash, which no bit can part:
such a bucket over the limit is dealt out in numbered parts, by counts per partition of a table
that holds those rows alone. The directory is broadcast if its counted cells are few enough.

Defined results: a null text has no bytes; a null id hashes like the word null; one document
larger than the limit is a shard of its own, marked ``over_limit``; an empty table gives no
shards; extra columns are ignored by ``assign`` and kept by ``write_shards``. Ids must be integers
or texts of such, else the job ends with a cast error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from collinea.llm.common import cut, free_name

SHARD_BYTES = 4 * 1024 * 1024
HASH_BITS = 60
FIRST_BITS = 20
#: cells of a directory that is broadcast; about 80 bytes each, so 40 MB at most
BROADCAST_CELLS = 500_000


def hash_bits() -> Column:
    """60 bits from the id and the text; any SQL engine with md5 finds the same."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _nodes(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Every prefix of ``low..high`` bits of the cells, with its sums."""
    depths = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return depths.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))


def directory(hashed: DataFrame, limit: int) -> list[tuple[int, DataFrame, int]]:
    """[(bits, table of cell -> bucket, its cells)]: one table for each round of deeper bits."""
    total = hashed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(FIRST_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 6)
    tables, low, rest = [], 0, hashed
    while True:
        cell = F.expr(f"shiftright(hash, {HASH_BITS - bits})")
        cells = cut(
            rest.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"), F.min("hash").alias("least"), F.max("hash").alias("most")),
            "shard-cells",
        )
        paths = _nodes(cells, low, bits)
        nodes = paths.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"), (F.min("least") == F.max("most")).alias("single"))
        fits = nodes.filter((F.col("shard_bytes") <= limit) | F.col("single"))
        # the shallowest prefix that fits is the bucket
        leaf = paths.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs", "single")).alias("leaf"))
        found = cut(leaf.select("cell", "leaf.*"), "shard-directory")
        n_found = found.count()
        tables.append((bits, found, n_found))
        if bits == HASH_BITS or cells.count() == n_found:
            return tables
        rest = rest.withColumn("cell", cell).join(found.select("cell"), "cell", "left_anti").drop("cell")
        low, bits = bits + 1, min(HASH_BITS, bits + FIRST_BITS)


def _sized(table: DataFrame, cells: int) -> DataFrame:
    """A directory with its way to the rows: broadcast up to ``BROADCAST_CELLS`` counted cells, else a shuffle."""
    return F.broadcast(table) if cells <= BROADCAST_CELLS else table.hint("merge")


def assign(docs: DataFrame, limit: int = SHARD_BYTES, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes and shard of each document row; with ``carry`` the row itself as ``doc``.

    ``shard`` is the bucket's bit string, with ``.part`` after it where equal rows were dealt.
    """
    result = [*RESULT, *(["doc"] if carry else [])]
    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", *(["struct(*) doc"] if carry else []))
    hashed = source.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits().alias("hash"), *(["doc"] if carry else []))
    rounds = directory(hashed.select("n_bytes", "hash"), limit)
    placed, rest = None, hashed
    for k, (bits, table, cells) in enumerate(rounds):
        keyed = rest.withColumn("cell", F.expr(f"shiftright(hash, {HASH_BITS - bits})"))
        here = keyed.join(_sized(table, cells), "cell").drop("cell")
        placed = here if placed is None else placed.unionByName(here)
        if k + 1 < len(rounds):
            rest = keyed.join(_sized(table.select("cell"), cells), "cell", "left_anti").drop("cell")
    bit_string = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("right(lpad(bin(prefix), 64, '0'), depth)"))
    placed = placed.withColumn("shard", bit_string)
    crowded = F.col("single") & (F.col("shard_docs") > 1) & (F.col("shard_bytes") > limit)
    plain = placed.filter(~crowded).withColumn("over_limit", F.col("shard_bytes") > limit)
    # equal rows are written once with their partition, so that counts and rows see the same ones
    equal = cut(placed.filter(crowded).withColumn("from", F.spark_partition_id()), "shard-equal-rows")
    return plain.select(*result).unionByName(_dealt(equal, limit).select(*result))


RESULT = ["doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "over_limit"]


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows in numbered parts that fit; numbered within each input partition, then offset."""
    # all rows of one hash have equal bytes, or no bytes at all
    per_part = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1)).cast("long")
    counts = rows.groupBy("hash", "from").agg(F.count("*").alias("n"))
    before = Window.partitionBy("hash").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("hash", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("hash", "from").orderBy(F.lit(0))
    numbered = rows.withColumn("k", F.row_number().over(within) - 1).join(offsets, ["hash", "from"])
    part = F.floor((F.col("k") + F.col("offset")) / per_part).cast("long")
    parted = numbered.withColumn("part", part).withColumn("per_part", per_part)
    size = F.least(F.col("per_part"), F.col("shard_docs") - F.col("part") * F.col("per_part"))
    return (
        parted.withColumn("size", size)
        .withColumn("shard", F.concat("shard", F.lit("."), F.col("part").cast("string")))
        .withColumn("shard_docs", F.col("size"))
        .withColumn("shard_bytes", F.col("size") * F.col("n_bytes"))
        .withColumn("over_limit", F.col("shard_bytes") > limit)
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, tasks: int = 200) -> None:
    """Write the documents as one folder for each shard, named by ``shard_bits`` (``_`` before it if a column has that name)."""
    rows = assign(docs, limit, carry=True)
    bits = free_name("shard_bits", docs)
    rows.repartition(tasks, "shard").select("doc.*", F.col("shard").alias(bits)).write.partitionBy(bits).parquet(path)
