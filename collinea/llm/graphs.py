"""Connected components of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (summed on the map side) and an equi-join on the node, so a
hub with very many links is split by adaptive execution; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from collinea.llm.common import cut


#: links in one partition: fewer partitions than the session's for few links, more for many
PARTITION_LINKS = 100_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges(a, b)``."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        # the tables of a step need no more partitions than their size asks for
        parts = state[0] // PARTITION_LINKS + 1
        edges = edges.coalesce(parts)
        # large star: greater neighbours move to the least node around their lesser end, if it has a lesser one
        least = edges.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m"))
        large = edges.join(least, "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()
        # small star: u and its lesser neighbours move to the least of them
        large = cut(large, "large-star").coalesce(parts)
        below = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(below, "b").select(F.col("m").alias("x"), "a").filter("x < a").select(F.col("x").alias("a"), F.col("a").alias("b"))
        small = moved.unionAll(below.select(F.col("m").alias("a"), "b")).coalesce(parts).distinct()
        edges = cut(small, "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("component")), F.struct(F.col("b").alias("node"), F.col("a").alias("component"))))
    nodes = edges.coalesce(state[0] // PARTITION_LINKS + 1).select(ends.alias("e")).select("e.*")
    return nodes.groupBy("node").agg(F.min("component").alias("component"))


def linked_groups(postings: DataFrame, attributes: list[str], star_possible: Callable[[str, str], Column], pair_possible: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], traits: DataFrame) -> DataFrame:
    """(node, component) of the exact links between rows that share a token.

    ``postings`` holds token, doc and attributes of each row under a token, and the same of the
    token's first and last row (``doc_first``, ``name_last``). First every row is verified
    against these two, a number of pairs linear in the postings. Then only rows of different
    groups that share a token are paired, so rows already in one group are never expanded into
    all pairs; as every pair of different groups is still verified, no link between groups is
    lost.

    The two conditions take the suffixes of the two rows' attributes; that of the second round
    sees the columns of ``traits(doc, ...)``, too, small digests that rule most pairs out inside
    the join. ``verify`` maps pairs (a, b) to those that are links.
    """
    ends = [postings.filter(F.col(f"doc{end}") != F.col("doc")).filter(star_possible(end, "")).select(F.least(f"doc{end}", "doc").alias("a"), F.greatest(f"doc{end}", "doc").alias("b")) for end in ("_first", "_last")]
    star = cut(ends[0].unionAll(ends[1]).distinct(), "star")
    links = cut(verify(star), "star-links")
    group = cut(components(links), "star-groups")

    placed = postings.select("token", "doc", *attributes).join(group.withColumnRenamed("node", "doc"), "doc", "left").withColumn("g", F.coalesce("component", "doc")).drop("component")
    open_tokens = placed.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high").select("token")
    left = cut(placed.join(open_tokens, "token", "left_semi").join(traits, "doc"), "open-postings")
    right = left.select("token", *(F.col(c).alias(f"{c}_b") for c in left.columns if c != "token"))
    second = left.join(right, "token").filter("doc < doc_b and g != g_b").filter(pair_possible("", "_b"))
    pairs = second.select(F.col("doc").alias("a"), F.col("doc_b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = cut(verify(pairs), "pair-links")
    return group if more.isEmpty() else cut(components(links.unionByName(more)), "groups")
