"""Operator 7, line dedup: a segment-partition edit join over distinct lines.

A line (trimmed of ASCII white space, at least ``MIN_BYTES`` UTF-8 bytes long) is cut into
threshold-plus-one segments. If two lines are within the threshold, a segment of the shorter
occurs unchanged in the longer, near its own place: each line indexes its segments under its
length, and probes the indexes of its own and slightly smaller lengths with the substrings
that the multi-match-aware windows allow. Lines under a common key are verified with banded
bit-parallel edit distance on their bytes; linked lines form classes. The first line of a
class, by (doc_id, line number), stays; its later copies and near copies go.

Keys travel as packed blocks of bounded size; equal lines are one line of the join; a class
of very many variants is found without pairing all of them (see ``graphs.linked_groups``).
Texts of candidate lines are fetched through a bit table of fixed size.

``equal_least`` is the least length of lines that are compared for equality, ``least`` for the
edit join (both in bytes); ``points`` counts edits, lengths and segments in code points, not in
bytes. The registered query and the pipeline compare equal lines of every length and count
code points (``WHOLE``); lines of fewer than ``MIN_BYTES`` bytes have no near copies.

Defined results: null and empty texts have no lines to compare and stay; shorter lines are
never compared; rows with a null id stay whole and lend no first line; rows that repeat an id
count as one document, and a line goes only where both number and content agree; extra
columns pass through ``remove_lines``. Ties go to the least (doc_id, line number). A very long
text is walked in one piece, with about 50 bytes of memory for each of its bytes. Ids must be
integers, or texts of such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from collinea.llm.common import NOT_SPACE, Chunk, RangeHash, chunks, cut, free_name, mix
from collinea.llm.graphs import linked_groups

THRESHOLD = 2
MIN_BYTES = 20
#: arguments of the registered query and the pipeline: all equal lines, edits of code points
WHOLE = {"equal_least": 1, "points": True}
BLOCK_ENTRIES = 750_000
#: classes of byte values whose counts are compared before two lines are
CLASSES = 16
#: bits of the table through which candidate lines are fetched: 4 MB, whatever the input
TABLE_BITS = 1 << 25

ENTRY = np.dtype([("token", "<u8"), ("doc", "<i8"), ("size", "<i4"), ("side", "<i1")])


def chunk_lines(chunk: Chunk, least: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, line number) of the trimmed lines that are long enough."""
    breaks = np.flatnonzero(chunk.data == 10)
    rows = np.concatenate([np.arange(chunk.rows), np.searchsorted(chunk.offsets, breaks, "right") - 1])
    start = np.concatenate([chunk.offsets[:-1], breaks + 1])
    order = np.lexsort((start, rows))
    start, rows = start[order], rows[order]
    end = np.concatenate([start[1:] - 1, chunk.offsets[-1:]])
    last = np.append(rows[1:] != rows[:-1], True)
    end[last] = chunk.offsets[rows[last] + 1]
    first_line = np.searchsorted(rows, np.arange(chunk.rows))
    number = np.arange(len(rows)) - first_line[rows]
    # trim: the first and last byte that is not white space
    solid = np.flatnonzero(NOT_SPACE[chunk.data])
    if not len(solid):
        return (np.zeros(0, np.int64),) * 4
    at = np.searchsorted(solid, start)
    begin = np.where(at < len(solid), solid[np.minimum(at, len(solid) - 1)], chunk.offsets[-1])
    until = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1
    keep = (begin < end) & (until - begin >= least)
    return begin[keep], until[keep], rows[keep], number[keep]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each code point as one number, and the place of its first byte."""
    tail = np.append((data & 0xC0) == 0x80, [False] * 3)
    at = np.flatnonzero(~tail[: len(data)])
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    values, more = padded[at], np.ones(len(at), bool)
    for k in (1, 2, 3):
        more &= tail[at + k]
        values |= np.where(more, padded[at + k] << np.uint32(8 * k), np.uint32(0))
    return values, at


def segment(length: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of the k-th of ``parts`` even segments (the longer ones come last)."""
    small = length // parts
    longer = length - small * parts
    before = np.maximum(k - (parts - longer), 0)
    return small * k + before, small + (k >= parts - longer)


def line_keys(hashes: RangeHash, start: np.ndarray, end: np.ndarray, threshold: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, line places, side) of all index (1) and probe (2) entries of the lines."""
    size, parts = end - start, threshold + 1
    for gap in range(threshold + 1):
        length = size - gap
        lines = np.flatnonzero(length >= least)
        length = length[lines]
        for k in range(parts):
            place, width = segment(length, k, parts)
            salt = mix((length * parts + k).astype(np.uint64))
            for shift in range(max(-k, gap - (threshold - k)), min(k, gap + threshold - k) + 1):
                inside = (place + shift >= 0) & (place + shift + width <= size[lines])
                at = start[lines[inside]] + place[inside] + shift
                key = mix(hashes.of(at, at + width[inside]) ^ salt[inside])
                yield key, lines[inside], 2
                if gap == 0 and shift == 0:
                    yield key, lines[inside], 1


def within(a: bytes | str, b: bytes | str, threshold: int) -> bool:
    """Whether the edit distance is at most the threshold; banded and bit-parallel.

    A bit of ``rows[e]`` is a diagonal of the band that is reached with ``e`` edits.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # common prefix by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # common suffix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if not a or not b:
        return max(len(a), len(b)) <= threshold
    band = (1 << 2 * threshold + 1) - 1
    rows = [0] * (threshold + 1)
    rows[0] = 1 << threshold
    for e in range(1, threshold + 1):
        rows[e] = (rows[e - 1] << 1 | rows[e - 1]) & band
    for j, byte in enumerate(b):
        match = 0
        for diagonal in range(2 * threshold + 1):
            i = j + diagonal - threshold
            if 0 <= i < len(a) and a[i] == byte:
                match |= 1 << diagonal
        before = rows[0]
        rows[0] &= match
        for e in range(1, threshold + 1):
            now = rows[e] & match | before | before >> 1 | rows[e - 1] << 1
            before, rows[e] = rows[e], now & band
        if not any(rows):
            return False
    end = threshold + len(a) - len(b)
    return any(row >> end & 1 for row in rows)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, number, line, n_lines): content hash of each comparable line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                start, end, row, number = chunk_lines(chunk, least)
                lines = RangeHash(chunk.data).of(start, end).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.lo, chunk.rows).take(pa.array(row)), pa.array(number), pa.array(lines)], ["doc_id", "number", "line"])

    return docs.mapInArrow(run, "doc_id long, number long, line long")


def _shared_keys(docs: DataFrame, blocks: int, threshold: int, least: int, points: bool = False) -> DataFrame:
    """Postings of the keys that two distinct lines or more have."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            held.clear()
            block = (entries["token"] % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            entries, block = entries[order], block[order]
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            parts = np.split(entries, at[1:])
            columns = [pa.array([np.ascontiguousarray(p[name]).tobytes() for p in parts], pa.binary()) for name in ENTRY.names]
            return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), *columns], ["block", *ENTRY.names])

        for batch in batches:
            for chunk in chunks(batch, "text"):
                start, end, _, _ = chunk_lines(chunk, least)
                hashes = RangeHash(chunk.data)
                lines, first = np.unique(hashes.of(start, end), return_index=True)
                start, end = start[first], end[first]
                if points:
                    values, places = code_points(chunk.data)
                    hashes = RangeHash(values)
                    start, end = np.searchsorted(places, start), np.searchsorted(places, end)
                # a code point has at most four bytes
                for key, at, side in line_keys(hashes, start, end, threshold, -(-least // 4) if points else least):
                    entries = np.empty(len(key), ENTRY)
                    entries["token"], entries["doc"], entries["size"], entries["side"] = key, lines[at].view(np.int64), (end - start)[at], side
                    held.append(entries)
                if sum(map(len, held)) >= BLOCK_ENTRIES:
                    yield flush()
        if any(map(len, held)):
            yield flush()

    names = ["token", *(f"{c}_{end}" for end in ("first", "last") for c in ("doc", "size", "side")), "doc", "size", "side"]

    def meet(block: pa.Table) -> pa.Table:
        token, doc, size, side = (np.frombuffer(b"".join(block.column(name).to_pylist()), ENTRY[name]) for name in ENTRY.names)
        order = np.lexsort((doc, token))
        token, doc, size, side = token[order], doc[order], size[order], side[order]
        at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])))
        token, doc, size, side = token[at], doc[at], size[at], np.bitwise_or.reduceat(side, at)
        new = np.append(True, token[1:] != token[:-1])
        group = np.cumsum(new) - 1
        keep = np.flatnonzero(np.bincount(group)[group] > 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(token)) - 1
        columns = [token.view(np.int64), *(x for at in (first, last) for x in (doc[at][group], size[at][group], side[at][group])), doc, size, side]
        return pa.table([pa.array(c[keep].astype(np.int64)) for c in columns], names)

    dealt = docs.select("text").mapInArrow(deal, "block int, token binary, doc binary, size binary, side binary")
    return dealt.groupBy("block").applyInArrow(meet, ", ".join(f"{name} long" for name in names))


def _line_texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(doc, content) of the wanted line hashes."""
    bit = F.expr(f"doc & {TABLE_BITS - 1}")
    words = wanted.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(doc & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    rows = words.toArrow()  # at most TABLE_BITS / 64 rows
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    table[np.array(rows["word"]).astype(np.int64)] = np.array(rows["mask"]).astype(np.int64).view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for chunk in chunks(batch, "text"):
                start, end, _, _ = chunk_lines(chunk, least)
                lines, first = np.unique(RangeHash(chunk.data).of(start, end), return_index=True)
                low = lines & np.uint64(TABLE_BITS - 1)
                hit = np.flatnonzero(table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                raw = chunk.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(lines[hit].view(np.int64)), pa.array([raw[start[k] : end[k]] for k in first[hit]], pa.binary())], ["doc", "content"])

    found = docs.select("text").mapInArrow(run, "doc long, content binary")
    return found.groupBy("doc").agg(F.min("content").alias("content")).join(wanted, "doc", "left_semi")


def _bags(texts: DataFrame, points: bool = False) -> DataFrame:
    """(doc, b0, ...): counts of byte (or code point) classes of each line, four to a word, modulo 2**16."""

    def values(x: pa.Scalar) -> np.ndarray:
        data = np.frombuffer(x.as_buffer(), np.uint8)
        if not points or data.max(initial=0) < 128:
            return data
        found = code_points(data)[0]
        return found ^ found >> 8 ^ found >> 16 ^ found >> 24

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([np.bincount((values(x) % CLASSES).astype(np.int64), minlength=CLASSES) for x in batch.column("content")], np.int64).reshape(-1, CLASSES)
            words = np.ascontiguousarray((counts & 0xFFFF).astype("<u2")).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["doc", *(f"b{k}" for k in range(CLASSES // 4))])

    return texts.mapInArrow(run, "doc long, " + ", ".join(f"b{k} long" for k in range(CLASSES // 4)))


def _bag_distance(x: str, y: str) -> str:
    """Summed differences of the class counts: an edit changes it by two at most."""
    lane = lambda side, k: f"(shiftright(b{k // 4}{side}, {16 * (k % 4)}) & 65535)"
    gaps = [f"abs({lane(x, k)} - {lane(y, k)})" for k in range(CLASSES)]
    return " + ".join(f"least({gap}, 65536 - {gap})" for gap in gaps)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int, points: bool = False) -> DataFrame:
    read = (lambda x: x.decode("utf-8", "surrogateescape")) if points else (lambda x: x)
    joined = pairs.join(texts.select(F.col("doc").alias("a"), F.col("content").alias("x")), "a").join(texts.select(F.col("doc").alias("b"), F.col("content").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(read(x), read(y), threshold) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_BYTES, equal_least: int | None = None, points: bool = False) -> DataFrame:
    """(doc_id, number, line, class, near) of each line that repeats an earlier one.

    ``class`` is the least content hash of the lines linked with it; ``near`` tells that no
    equal line came earlier, only a similar one.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").filter("doc_id is not null")
    lines = cut(_lines(docs, least if equal_least is None else min(equal_least, least)), "lines")
    entries_per_line = sum(1 for _ in line_keys(RangeHash(np.zeros(1000, np.uint8)), np.zeros(1, np.int64), np.full(1, 900), threshold, least))
    blocks = lines.count() * entries_per_line // BLOCK_ENTRIES + 1
    postings = cut(_shared_keys(docs, blocks, threshold, least, points), "line-keys")
    texts = cut(_line_texts(docs, postings.select("doc").distinct(), least), "line-texts")
    close = lambda x, y: F.abs(F.col(f"size{x}") - F.col(f"size{y}")) <= threshold
    sides = lambda x, y: F.expr(f"((side{x} & 1) > 0 and (side{y} & 2) > 0 and size{x} <= size{y}) or ((side{x} & 2) > 0 and (side{y} & 1) > 0 and size{y} <= size{x})")
    alike = lambda x, y: F.expr(f"{_bag_distance(x, y)} <= {2 * threshold}")
    groups = linked_groups(postings, ["size", "side"], close, lambda x, y: close(x, y) & sides(x, y) & alike(x, y), lambda pairs: _verified(pairs, texts, threshold, points), _bags(texts, points))

    first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("n"))
    named = first.join(groups.withColumnRenamed("node", "line"), "line", "left").withColumn("class", F.coalesce("component", "line"))
    whole = named.groupBy("class").agg(F.min("first").alias("class_first"), F.sum("n").alias("class_n")).filter("class_n > 1")
    known = cut(named.select("line", "first", "class").join(whole, "class"), "line-classes")
    place = F.struct("doc_id", "number")
    return lines.join(known, "line").filter(place != F.col("class_first")).select("doc_id", "number", "line", "class", (place == F.col("first")).alias("near"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_BYTES, equal_least: int | None = None, points: bool = False) -> DataFrame:
    """One row per document: lines removed, of these near copies only, their numbers and classes."""
    gone = repeated_lines(docs, threshold, least, equal_least, points)
    each = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("number", "class", "near"))).alias("gone"))
    base = docs.selectExpr("cast(doc_id as long) doc_id", "cast(coalesce(length(text) - length(replace(text, '\\n', '')) + 1, 0) as long) n_lines")
    none = F.expr("array()")
    return base.join(each, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(F.filter("gone", lambda x: x["near"])), F.lit(0)).cast("long").alias("n_removed_near"),
        F.coalesce(F.transform("gone", lambda x: x["number"]), none.cast("array<long>")).alias("removed"),
        F.coalesce(F.transform("gone", lambda x: x["class"]), none.cast("array<long>")).alias("class_ids"),
    )


def remove_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_BYTES, equal_least: int | None = None, points: bool = False) -> DataFrame:
    """The documents, all columns, without the lines that repeat an earlier one."""
    schema = docs.schema
    own_id, own_gone = free_name("id", docs), free_name("gone", docs)
    gone = repeated_lines(docs, threshold, least, equal_least, points).groupBy("doc_id").agg(F.collect_set(F.struct("number", "line")).alias(own_gone))
    joined = docs.join(gone.withColumnRenamed("doc_id", own_id), F.col("doc_id").cast("long") == F.col(own_id), "left").drop(own_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            gone = batch.column(own_gone).to_pylist()
            texts = batch.column(place).to_pylist()
            for k, cuts in enumerate(gone):
                if not cuts or texts[k] is None:
                    continue
                raw = texts[k].encode()
                chunk = Chunk(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                start, end, _, number = chunk_lines(chunk, least if equal_least is None else min(equal_least, least))
                found = dict(zip(number.tolist(), RangeHash(chunk.data).of(start, end).view(np.int64).tolist()))
                drop = {c["number"] for c in cuts if found.get(c["number"]) == c["line"]}
                texts[k] = "\n".join(line for n, line in enumerate(texts[k].split("\n")) if n not in drop)
            arrays = list(batch.columns)
            arrays[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).select(docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(run, schema)
