"""Operator 1, n-gram Jaccard join: a blocked sparse product of documents by n-grams.

The incidence matrix has a row for each distinct shingle set and a column for each shingle.
All counts are exact and taken in column blocks, packed arrays of a bounded number of entries:

1. A row reaches the threshold with another only if ``ceil(t n)`` of its columns are shared.
   A fixed range of column hashes (``LOW`` of all) is counted over all rows first; a row with
   more unshared columns there than the size bound allows is discarded. Rows of at most
   ``WHOLE_ROWS`` shingles are judged by all columns; rows that may be linked with such a one
   are counted in all columns, too. The whole columns of the rest, the open rows, are multiplied.
2. In each block every row meets the least and the greatest row of each of its columns, and
   overlaps are accumulated over the blocks. A count that reaches what the sizes ask for is a
   link, links form groups; counts of at least half of it form areas, which hold the groups.
3. Inside an area the parts of its rows are multiplied part by part: only rows of different
   groups, bounded from above by sizes and parity sketches, then counted on the whole sets.
4. Columns are ordered by count, then hash. Rows of different areas are multiplied only in the
   first ``n - need + k`` columns of a row, where pairs that reach the threshold, and so share
   ``need`` columns by their sizes, have at least ``k`` in common: pairs that short parity sketches
   rule out, or whose accumulated count is below ``k``, are discarded, and the rest is bounded and
   counted like those of an area.

So a group of near copies is never expanded into all pairs, columns that many rows share come
last, and no link between different groups is lost: the result is exact. No column or row
list is collected or broadcast, except id lists of at most ``BROADCAST_IDS``.

Defined results: a null or empty text has no shingles and is linked with nothing; a text of
fewer words than a shingle is one shingle; equal sets are one row of the matrix; rows that
repeat a ``doc_id`` count as one document with the links of them all; rows with a null id are
not linked and have a null component; extra columns are ignored; ties need no rule, since
components do not depend on order. A very long text is one row: its words are hashed in one
piece, about 50 bytes of memory for each byte of the text. Ids must be integers, or texts of
such; other ids end the job with Spark's cast error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from collinea.llm.common import LOWER, NOT_SPACE, Chunk, RangeHash, chunks, cut, free_name, mix, segment_index, word_spans
from collinea.llm.graphs import components

WORDS = 5
PERCENT = 75
#: text bytes hashed at a time
HASHED_BYTES = 1_000_000
#: the share of column hashes that is counted for all rows; it must exceed 1 - threshold
LOW = 0.375
#: rows of at most so many shingles are judged by all their columns in the first count
WHOLE_ROWS = 256
#: entries of a column block, and those that a task holds before it deals them to blocks
BLOCK_ENTRIES = 250_000
HELD_ENTRIES = 750_000
#: entries of a part of an area's rows
PART_ENTRIES = 200_000
#: pairs expanded at a time inside a block
EXPANDED = 2_000_000
#: a row's prefix holds one column more for each so many shingles; pairs must share as many more
PER_COLUMN = 16
COLUMN_BLOCKS = 8
#: least bits of a row's parity sketch, four words
SKETCH_BITS = 256
#: so many ids, 8 bytes each, may be broadcast; more are joined by a shuffle
BROADCAST_IDS = 300_000


def shingle_sets(chunk: Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows one after another, ends of the rows)."""
    data = LOWER[chunk.data]
    start, end, row = word_spans(Chunk(chunk.lo, chunk.hi, data, chunk.offsets), NOT_SPACE)
    hashes = RangeHash(data).of(start, end)
    counts = np.bincount(row, minlength=chunk.rows)
    last = np.cumsum(counts)[row] if len(row) else row
    place = np.arange(len(row))
    first = place == last - counts[row] if len(row) else np.zeros(0, bool)
    at = np.flatnonzero((place + words <= last) | (first & (counts[row] < words)))
    total = np.zeros(len(at), np.uint64)
    factor = 1
    for k in range(words):
        factor = factor * 0x9E3779B97F4A7C15 + 0xD1342543DE82EF95 & (1 << 64) - 1 | 1
        inside = at + k < last[at]
        total += np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] * np.uint64(factor), np.uint64(k + 1)) if len(at) else total
    total = mix(total)
    n_at = np.bincount(row[at], minlength=chunk.rows)
    edges = np.concatenate([[0], np.cumsum(n_at)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[edges[:-1][n_at > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])[edges]
    return total[new], kept


def set_signatures(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each row's set."""
    sums = lambda values: np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    a, b = sums(hashes), sums(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return (a[edges[1:]] - a[edges[:-1]]).view(np.int64), (b[edges[1:]] - b[edges[:-1]]).view(np.int64)


#: column hashes below are counted for all rows
LOW_END = np.uint64(int(LOW * (1 << 64)))


def judged(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """By how many leading columns each row is judged in the first count."""
    low = np.concatenate([[0], np.cumsum(hashes < LOW_END)])
    n = np.diff(edges)
    return np.where(n <= WHOLE_ROWS, n, low[edges[1:]] - low[edges[:-1]])


def shown(hashes: np.ndarray, edges: np.ndarray, percent: int) -> np.ndarray:
    """How many leading columns of each row belong to the first count.

    A row judged by all its columns must see all columns of any row that it may be linked with.
    """
    n = np.diff(edges)
    return np.where(percent * n <= 100 * WHOLE_ROWS, n, judged(hashes, edges))


def row_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, shown and judged columns and set signatures of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text", HASHED_BYTES):
                hashes, edges = shingle_sets(chunk, words)
                a, b = set_signatures(hashes, edges)
                columns = [np.diff(edges).astype(np.int64), shown(hashes, edges, percent).astype(np.int64), judged(hashes, edges).astype(np.int64), a, b]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.lo, chunk.rows), *map(pa.array, columns)], ["doc_id", "n_shingles", "n_shown", "n_judged", "set_a", "set_b"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, n_shown long, n_judged long, set_a long, set_b long")


def node_of(several: bool | Column, doc_id: object, set_a: object) -> object:
    """A set's node: its least document id, or a negative number of its own if that id has several sets."""
    if isinstance(several, Column):
        return F.when(several, F.lit(-1) - F.shiftrightunsigned(set_a, 1)).otherwise(doc_id)
    return -1 - ((int(set_a) & (1 << 64) - 1) >> 1) if several else doc_id


ENTRY = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4")])


def dealt(rows: DataFrame, blocks: int, read) -> DataFrame:
    """Packed entries of column blocks; ``read`` gives (doc, n, tokens) of the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            held.clear()
            block = (entries["token"] % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            entries, block = entries[order], block[order]
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            parts = np.split(entries, at[1:])
            columns = [pa.array([np.ascontiguousarray(p[name]).tobytes() for p in parts], pa.binary()) for name in ENTRY.names]
            return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int64)), *columns], ["block", *ENTRY.names])

        for batch in batches:
            for doc, n, tokens in read(batch):
                for lo in range(0, len(tokens), HELD_ENTRIES):
                    part = tokens[lo : lo + HELD_ENTRIES]
                    entries = np.empty(len(part), ENTRY)
                    entries["token"], entries["doc"], entries["n"] = part, doc, n
                    held.append(entries)
                    n_held += len(part)
                    if n_held >= HELD_ENTRIES:
                        yield flush()
                        n_held = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "block long, token binary, doc binary, n binary")


def block_columns(block: pa.Table) -> tuple[np.ndarray, ...]:
    """(token, doc, n, column, first and last entry of the column) of columns with two rows or more."""
    token, doc, n = (np.frombuffer(b"".join(block.column(name).to_pylist()), ENTRY[name]) for name in ENTRY.names)
    order = np.lexsort((doc, token))
    token, doc, n = token[order], doc[order], n[order]
    new = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))
    token, doc, n = token[new], doc[new], n[new]
    new = np.append(True, token[1:] != token[:-1])
    group = np.cumsum(new) - 1
    keep = np.bincount(group)[group] > 1
    token, doc, n, new = token[keep], doc[keep], n[keep], new[keep]
    first = np.flatnonzero(new)
    return token, doc, n, np.cumsum(new) - 1, first, np.append(first[1:], len(token))[: len(first)] - 1


def shared_counts(docs: DataFrame, blocks: int, words: int, percent: int) -> DataFrame:
    """(doc, shared): how many of the columns that a row is judged by another row has, too."""

    def read(batch: pa.RecordBatch):
        for chunk in chunks(batch, "text", HASHED_BYTES):
            hashes, edges = shingle_sets(chunk, words)
            until, whole = edges[:-1] + shown(hashes, edges, percent), (judged(hashes, edges) == np.diff(edges)).tolist()
            ids, several, signature = batch.column("doc_id").slice(chunk.lo, chunk.rows).to_pylist(), batch.column("several").slice(chunk.lo, chunk.rows).to_pylist(), set_signatures(hashes, edges)[0]
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), until.tolist())):
                yield node_of(several[k], ids[k], signature[k]), whole[k], hashes[a:b]

    def count(block: pa.Table) -> pa.Table:
        token, doc, whole = block_columns(block)[:3]
        doc, n = np.unique(doc[(whole > 0) | (token < LOW_END)], return_counts=True)
        return pa.table([pa.array(doc), pa.array(n)], ["doc", "shared"])

    counted = dealt(docs, blocks, read).groupBy("block").applyInArrow(count, "doc long, shared long")
    return counted.groupBy("doc").agg(F.sum("shared").alias("shared"))


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc, n, hashes, sketch): the sorted shingle set of each row as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text", HASHED_BYTES):
                hashes, edges = shingle_sets(chunk, words)
                parts = [hashes[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                ids, several, signature = batch.column("doc_id").slice(chunk.lo, chunk.rows).to_pylist(), batch.column("several").slice(chunk.lo, chunk.rows).to_pylist(), set_signatures(hashes, edges)[0]
                nodes = [node_of(*x) for x in zip(several, ids, signature.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(np.diff(edges).astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([sketch(p) for p in parts], pa.binary())], ["doc", "n", "hashes", "sketch"]
                )

    return docs.mapInArrow(run, "doc long, n long, hashes binary, sketch binary").filter("n > 0").dropDuplicates(["doc"])


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes in a power of two of bits, at least as many as hashes."""
    bits = max(SKETCH_BITS, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the hashes that only one of two sets has.

    Such a hash flips a parity. The longer sketch is folded: its halves' parities add up.
    """
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


FOLDED = ["s0", "s1", "s2", "s3"]


def folded(sets: DataFrame) -> DataFrame:
    """(doc, s0, ..., s3): each sketch folded to ``SKETCH_BITS``, whose differing bits bound a pair's, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.bitwise_xor.reduce(np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, len(FOLDED)), 0) for x in batch.column("sketch")]
            words = np.array(short, np.uint64).reshape(-1, len(FOLDED)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(np.ascontiguousarray(c)) for c in words.T)], ["doc", *FOLDED])

    return sets.select("doc", "sketch").mapInArrow(run, "doc long, " + ", ".join(f"{c} long" for c in FOLDED))


def row_need(n: Column, percent: int) -> Column:
    """The overlap that a row of ``n`` columns needs with any other."""
    return F.ceil(percent * n / 100).cast("long")


def pair_need(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / (100 + percent)).cast("long")


def kept_columns(n: Column, percent: int) -> Column:
    """``k``: pairs that reach the threshold share the least of their ``k`` in their prefixes."""
    return F.least(row_need(n, percent), 1 + F.floor(n / PER_COLUMN)).cast("long")


def multiplied(sets: DataFrame, blocks: int) -> DataFrame:
    """Two kinds of rows of the product over all columns of the open rows.

    Kind 0: rows x and y (the first or last of a column of x), their sizes n and m, and the
    overlap counted in this block. Kind 1: token x of row y with n columns, shared by ``c`` rows.
    """

    def read(batch: pa.RecordBatch):
        for doc, n, hashes in zip(batch.column("doc").to_pylist(), batch.column("n").to_pylist(), batch.column("hashes")):
            yield doc, n, np.frombuffer(hashes.as_buffer(), np.uint64)

    def product(block: pa.Table) -> pa.Table:
        token, doc, n, group, first, last = block_columns(block)
        ends = np.concatenate([first[group], last[group]]) if len(token) else np.zeros(0, np.int64)
        own = np.tile(np.arange(len(token)), 2)
        apart = doc[own] != doc[ends]
        own, ends = own[apart], ends[apart]
        swap = doc[own] > doc[ends]
        a, b = np.where(swap, ends, own), np.where(swap, own, ends)
        order = np.lexsort((token[a], doc[b], doc[a]))
        a, b = a[order], b[order]
        once = np.append(True, (doc[a][1:] != doc[a][:-1]) | (doc[b][1:] != doc[b][:-1]) | (token[a][1:] != token[a][:-1]))[: len(a)]
        a, b = a[once], b[once]  # a pair once for each column
        new = np.flatnonzero(np.append(True, (doc[a][1:] != doc[a][:-1]) | (doc[b][1:] != doc[b][:-1]))[: len(a)])
        c = np.diff(np.append(new, len(a)))
        size = np.bincount(group)[group] if len(group) else group
        stars, entries = (np.zeros(len(new)), doc[a][new], doc[b][new], n[a][new], n[b][new], c), (np.ones(len(token)), token.view(np.int64), doc, n, np.zeros(len(token)), size)
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(stars, entries)], PRODUCT)

    PRODUCT = ["kind", "x", "y", "n", "m", "c"]
    return dealt(sets.select("doc", "n", "hashes"), blocks, read).groupBy("block").applyInArrow(product, ", ".join(f"{name} long" for name in PRODUCT))


def crossing_pairs(prefixes: DataFrame, blocks: int, percent: int) -> DataFrame:
    """(a, b, n, m, c): pairs of different groups that share columns of both prefixes, with their counts.

    A pair's prefixes are those that its own sizes ask for: of its first ``k`` common columns each
    has ``need - k`` common ones after it at least, so it is one of the first ``n - need + k`` of its
    row. ``place`` numbers a row's columns in their order.
    """

    def product(block: pa.Table) -> pa.Table:
        token, g, doc, n, place, *sketch = (block.column(name).to_numpy() for name in ("token", "g", "doc", "n", "place", *FOLDED))
        order = np.lexsort((doc, g, token))
        token, g, doc, n, place, *sketch = (x[order] for x in (token, g, doc, n, place, *sketch))
        kept = np.minimum(-(-percent * n // 100), 1 + n // PER_COLUMN)
        last_of_token = np.searchsorted(token, token, "right")
        new_group = np.append(True, (token[1:] != token[:-1]) | (g[1:] != g[:-1]))
        group = np.cumsum(new_group) - 1
        group_end = np.append(np.flatnonzero(new_group)[1:], len(token))[group]
        many = last_of_token - group_end  # the rows of other groups that follow under the token
        found: list[tuple[np.ndarray, ...]] = []
        total, lo = np.concatenate([[0], np.cumsum(many)]), 0
        while lo < len(token):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + EXPANDED, "right")) - 1)
            owner, inside = segment_index(many[lo:hi])
            i, j = owner + lo, group_end[owner + lo] + inside
            room = np.minimum(kept[i], kept[j]) + percent * (n[i] + n[j]) // -(100 + percent)  # k - need
            near = (percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])) & (place[i] <= n[i] + room) & (place[j] <= n[j] + room)
            i, j = i[near], j[near]
            apart, total_ = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in sketch), n[i] + n[j]
            near = (100 + percent) * (total_ - apart) >= 2 * percent * total_
            i, j = i[near], j[near]
            swap = doc[i] > doc[j]
            found.append(_counted(*(np.where(swap, x[j], x[i]) for x in (doc, n)), *(np.where(swap, x[i], x[j]) for x in (doc, n)), np.ones(len(i), np.int64)))
            if sum(len(x[0]) for x in found) > 2 * EXPANDED:  # counts of one pair are put together
                found = [_counted(*(np.concatenate(x) for x in zip(*found)))]
            lo = hi
        a, n_a, b, n_b, c = _counted(*(np.concatenate(x) for x in zip(*found)))
        return pa.table([pa.array(x) for x in (a, b, n_a, n_b, c)], ["a", "b", "n", "m", "c"])

    block = F.pmod("token", F.lit(blocks)).alias("block")
    counted = prefixes.select(block, "token", "g", "doc", "n", "place", *FOLDED).groupBy("block").applyInArrow(product, "a long, b long, n long, m long, c long")
    enough = F.col("c") >= F.least(kept_columns(F.col("n"), percent), kept_columns(F.col("m"), percent))
    return counted.groupBy("a", "b", "n", "m").agg(F.sum("c").alias("c")).filter(enough)


def _counted(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs once each, with summed counts."""
    order = np.lexsort((b, a))
    a, n, b, m, c = (x[order] for x in (a, n, b, m, c))
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return a[new], n[new], b[new], m[new], (np.add.reduceat(c, new) if len(new) else c)


def overlap(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold; counts are accumulated by column block."""
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if need > min(len(a), len(b)):
        return False
    ends = np.arange(1, COLUMN_BLOCKS, dtype=np.uint64) * np.uint64((1 << 64) // COLUMN_BLOCKS)
    at, bt = np.concatenate([[0], np.searchsorted(a, ends), [len(a)]]), np.concatenate([[0], np.searchsorted(b, ends), [len(b)]])
    count = 0
    for k in range(COLUMN_BLOCKS):
        x, y = a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]]
        both = np.concatenate([x, y])
        both.sort()
        count += int((both[1:] == both[:-1]).sum())
        if count >= need:
            return True
        if count + min(len(a) - at[k + 1], len(b) - bt[k + 1]) < need:
            return False
    return False


def screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave room for enough overlap."""
    room = pairs.select("a", "b", (F.col("n") + F.col("m")).alias("total"))
    side = lambda name, value: sets.select(F.col("doc").alias(name), F.col("sketch").alias(value))
    joined = room.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "total", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("total").to_numpy()
            apart = np.array([differing(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"))], np.int64)
            keep = (100 + percent) * (total - apart) >= 2 * percent * total
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    close = cut(screened(pairs, sets, percent), "jaccard-close")
    side = lambda name, value: sets.select(F.col("doc").alias(name), F.col("hashes").alias(value))
    joined = close.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def area_tasks(rows: DataFrame) -> DataFrame:
    """(task, side, doc, g): the pairs of row parts of each area; ``rows`` holds doc, n, area, g.

    A part holds ``PART_ENTRIES`` entries or so. A group that fills parts has parts of its own,
    which don't meet each other; an area of one group has no task.
    """
    weights = rows.groupBy("area", "g").agg(F.sum("n").alias("w"))
    large = F.col("w") > PART_ENTRIES
    mixed = weights.groupBy("area").agg(F.sum(F.when(large, 0).otherwise(F.col("w"))).alias("small"), F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high")
    slots = lambda w: F.greatest(F.ceil(w / PART_ENTRIES), F.lit(1))
    planned = weights.join(mixed.select("area", "small"), "area").select("area", "g", large.alias("large"), F.when(large, slots(F.col("w"))).otherwise(slots(F.col("small"))).alias("slots"))
    of_large, of_small = F.pmod(F.xxhash64("doc"), "slots"), F.pmod(F.xxhash64("g"), "slots")
    part = F.struct("large", F.when(F.col("large"), F.col("g")).otherwise(0).alias("own"), F.when(F.col("large"), of_large).otherwise(of_small).alias("k"))
    placed = cut(rows.join(planned, ["area", "g"]).select("area", "g", "doc", part.alias("part")), "jaccard-parts")
    parts = placed.select("area", "part").distinct()
    tasks = parts.join(parts.withColumnRenamed("part", "other"), "area").filter("part <= other and not (part.large and other.large and part.own = other.own)")
    tasks = tasks.withColumn("task", F.xxhash64("area", "part", "other"))
    slot = lambda part: F.xxhash64("area", part)
    ends = tasks.select("task", slot("part").alias("slot"), F.lit(0).alias("side")).unionAll(tasks.filter("part < other").select("task", slot("other"), F.lit(1)))
    return placed.withColumn("slot", slot("part")).join(ends, "slot").select("task", "side", "doc", "g")


def area_links(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the groups of each area, enough of them to join what is linked.

    The two parts of a task are multiplied row by row: sizes and parity sketches bound each
    overlap from above, and the rest is counted on whole sets unless its groups are joined yet.
    """

    def product(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("doc").to_numpy(), table.column("side").to_numpy()))
        table = table.take(pa.array(order))
        side, doc, g, n = (table.column(name).to_numpy() for name in ("side", "doc", "g", "n"))
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        folded = Folded([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("sketch")])
        second = int(np.searchsorted(side, 1))
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                x = parent[x] = parent.get(y, y)
            return x

        found: list[tuple[int, int]] = []
        for i in range(second if second < len(doc) else len(doc)):
            lo = second if second < len(doc) else i + 1
            total = n[i] + n[lo:]
            possible = (g[lo:] != g[i]) & (percent * np.maximum(n[i], n[lo:]) <= 100 * np.minimum(n[i], n[lo:]))
            at = np.flatnonzero(possible)
            if not len(at):
                continue
            apart = folded.differing(i, at + lo)
            for j in (at[(100 + percent) * (total[at] - apart) >= 2 * percent * total[at]] + lo).tolist():
                x, y = top(int(g[i])), top(int(g[j]))
                if x != y and overlap(hashes[i], hashes[j], percent):
                    parent[max(x, y)] = min(x, y)
                    found.append((int(min(doc[i], doc[j])), int(max(doc[i], doc[j]))))
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return tasks.join(sets, "doc").select("task", "side", "doc", "g", "n", "hashes", "sketch").groupBy("task").applyInArrow(product, "a long, b long")


class Folded:
    """Parity sketches of many rows, folded to each length that occurs."""

    def __init__(self, sketches: list[np.ndarray]):
        self.size = np.array([len(x) for x in sketches], np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            self.rows[size] = np.zeros((len(sketches), size), np.uint64)
            for k in np.flatnonzero(self.size >= size):
                self.rows[size][k] = np.bitwise_xor.reduce(sketches[k].reshape(-1, size), 0)

    def differing(self, i: int, others: np.ndarray) -> np.ndarray:
        """Lower bounds of the hashes that only one of the sets ``i`` and each other has."""
        size = np.minimum(self.size[i], self.size[others])
        out = np.zeros(len(others), np.int64)
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            out[at] = np.bitwise_count(self.rows[k][others[at]] ^ self.rows[k][i]).sum(1, dtype=np.int64)
        return out


def bounded(ids: DataFrame) -> DataFrame:
    """The ids with a broadcast hint if their number allows it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def between_groups(edges: DataFrame, group: DataFrame) -> DataFrame:
    """The edges (a, b) of nodes as distinct edges of their groups, without those inside one."""
    for end in ("a", "b"):
        named = group.select(F.col("node").alias(end), F.col("component").alias("g"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("g", end)).drop("g")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def merged(nodes: DataFrame, group: DataFrame, upper: DataFrame) -> DataFrame:
    """(node, g, component): each node's group, and the component of groups that holds it."""
    placed = nodes.join(group.select("node", F.col("component").alias("g")), "node", "left").withColumn("g", F.coalesce("g", "node"))
    return placed.join(upper.select(F.col("node").alias("g"), "component"), "g", "left").select("node", "g", F.coalesce("component", "g").alias("component"))


def open_row_groups(source: DataFrame, members: DataFrame, own_links: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of linked sets; ``members`` holds each set's node, size, shown and judged columns."""
    blocks = lambda entries: int((entries or 0) // BLOCK_ENTRIES) + 1
    counts = shared_counts(source, blocks(members.agg(F.sum("n_shown")).first()[0]), words, percent)
    unshared = F.col("n_judged") - F.coalesce("shared", F.lit(0))
    opened = members.join(counts.withColumnRenamed("doc", "node"), "node", "left").filter(F.col("n_shingles") - unshared >= row_need(F.col("n_shingles"), percent))
    opened = cut(opened.select("node", "doc_id", "n_shingles"), "jaccard-open")
    ids = opened.select("doc_id").distinct()
    sets = cut(whole_sets(source.join(bounded(ids), "doc_id", "left_semi"), words), "jaccard-sets")

    n_blocks = blocks(sets.agg(F.sum("n")).first()[0])
    product = cut(multiplied(sets, n_blocks), "jaccard-product")
    stars = product.filter("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b"), "n", "m").agg(F.sum("c").alias("c"))
    need = pair_need(F.col("n"), F.col("m"), percent)
    stars = cut(stars.filter((2 * F.col("c") >= need) & (percent * F.greatest("n", "m") <= 100 * F.least("n", "m"))).withColumn("linked", F.col("c") >= need), "jaccard-stars")
    links = stars.filter("linked").select("a", "b").unionByName(own_links)
    group = cut(components(links), "jaccard-groups")
    nodes = sets.select(F.col("doc").alias("node")).unionByName(group.select("node")).distinct()
    near = components(between_groups(stars.select("a", "b"), group))
    areas = cut(merged(nodes, group, near).select(F.col("node").alias("doc"), "g", F.col("component").alias("area")), "jaccard-areas")
    rows = areas.join(sets.select("doc", "n"), "doc").select("doc", "n", "area", "g")
    sketched = cut(areas.join(folded(sets), "doc").select("doc", "area", *FOLDED), "jaccard-sketched")
    inner = cut(area_links(area_tasks(rows), sets, percent), "jaccard-area-links")

    each_row = Window.partitionBy("doc")
    entries = product.filter("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("doc"), "n", "c")
    ranked = entries.withColumn("rank", F.row_number().over(each_row.orderBy("c", "token"))).withColumn("shared", F.count("*").over(each_row))
    n = F.col("n")
    # the unshared columns come first
    place = n - F.col("shared") + F.col("rank")
    inside = (F.col("shared") >= row_need(n, percent)) & (place <= n - row_need(n, percent) + kept_columns(n, percent))
    placed = ranked.filter(inside).withColumn("place", place).join(sketched, "doc").select("token", F.col("area").alias("g"), "doc", "n", "place", *FOLDED)
    placed = cut(placed, "jaccard-prefixes")
    pairs = cut(crossing_pairs(placed, blocks(placed.count()), percent), "jaccard-pairs")
    more = between_groups(inner.unionByName(verified(pairs, sets, percent)), group)
    return cut(merged(nodes, group, components(more)).select("node", "component"), "jaccard-components")


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (least id with the same set) and component_id of each row."""
    if 100 * LOW <= 100 - percent:
        raise ValueError("LOW must exceed 1 - percent / 100")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows = cut(row_table(docs, words, percent), "jaccard-rows")
    key = ["set_a", "set_b", "n_shingles"]
    filled = rows.filter("n_shingles > 0 and doc_id is not null")
    several = cut(filled.groupBy("doc_id").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).filter("low < high").select("doc_id", F.lit(True).alias("several")), "jaccard-several")
    # one node for each set: its least id, unless that id stands for several sets
    least = filled.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("n_shown").alias("n_shown"), F.max("n_judged").alias("n_judged"))
    flagged = least.join(several.withColumnRenamed("doc_id", "rep"), "rep", "left")
    classes = cut(flagged.select(*key, "rep", "n_shown", "n_judged", node_of(F.coalesce("several", F.lit(False)), F.col("rep"), F.col("set_a")).alias("node")), "jaccard-classes")
    named = rows.select("doc_id", *key).join(classes.drop("n_shown", "n_judged"), key, "left")
    of_one = named.join(several, "doc_id", "left_semi").filter("node is not null")
    own_links = of_one.join(of_one.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a < b").distinct()

    reps = cut(classes.select(F.col("rep").alias("doc_id")).distinct(), "jaccard-reps")
    copies = cut(filled.select("doc_id").distinct().join(reps, "doc_id", "left_anti"), "jaccard-copies")
    source = docs.filter("doc_id is not null").join(bounded(copies), "doc_id", "left_anti").join(bounded(several), "doc_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    groups = open_row_groups(source, classes.select("node", F.col("rep").alias("doc_id"), "n_shingles", "n_shown", "n_judged"), own_links, words, percent)

    found = named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = found.filter("doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return found.join(label, "component", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), own.alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, of which each linked group keeps the one with the least id.

    Rows with a null id stay.
    """
    linked = link_documents(docs, words, percent)
    gone_id = free_name("gone", docs)
    gone = cut(linked.filter("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "jaccard-gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
