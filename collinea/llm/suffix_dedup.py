"""Operator 6, suffix-array dedup: bytes covered by a 100-byte string that starts earlier.

Only suffixes that may share 100 bytes with another one are sorted. Every 100-byte window is
put under its anchor, the 50-byte string of least hash in it; equal windows have equal
anchors at equal places. Runs of windows under one anchor travel as two hashes:

* equal runs need no sorting: all but the first are covered as a whole. Repeats inside a task
  are settled there, so a passage found everywhere sends one entry for each task;
* runs with a common anchor but other surroundings are the ends of repeated passages. Their
  suffixes are sorted block by block: a bucket holds the suffixes with the same 75 bytes or so
  around the anchor. A bucket's suffixes are sorted by their first ``COVER`` bytes, and ties
  by precomputed ranks of a difference-cover sample, so no comparison reads on; memory is
  bounded by a slice of buckets. Neighbours that share 100 bytes form runs of equal strings.

Contexts lie in the sorted buffer with their anchors at multiples of the cover's period, so
strings that may be equal have equal residues and one sample offset serves them.

Defined results: null and empty texts have no bytes; texts under 100 bytes lose none; a row
with a null id loses what repeats earlier in itself, and no other row has a part in that; equal rows with one id are one document;
the unlike texts of one id are parts of it that matches don't cross, and of two equal strings in
different parts the one in the part of lesser text hash counts as earlier; extra columns are
ignored. A very long text is held whole, with a few 8-byte arrays over its bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from collinea.llm.common import Chunk, RangeHash, chunks, cut, mix

LENGTH = 100
ANCHOR = 50
COVER = 32
BLOCK_ENTRIES = 750_000
BLOCK_CONTEXTS = 60_000
SLICE_CONTEXTS = 3_000

ENTRY = np.dtype([("token", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("part", "<i8"), ("at", "<i4"), ("size", "<i2"), ("turn", "<i2")])


def anchored_runs(chunk: Chunk, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first window, windows, anchor, token, run hash).

    The anchor of a window is its leftmost ``anchor``-byte string of least hash.
    """
    n, width = len(chunk.data), length - anchor + 1
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    hashes = RangeHash(chunk.data)
    place = np.arange(n - anchor + 1)
    h = hashes.of(place, place + anchor)
    low, span = h, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(h) - width + 1], low[width - span : width - span + len(h) - width + 1])
    # windows inside one row
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))[: len(low)]
    valid = place[: len(low)] + length <= chunk.offsets[row + 1]
    new = np.append(True, (low[1:] != low[:-1]) | (valid[1:] != valid[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    # places whose hash is the least of some window: only these can be anchors
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high, span = padded, 1
    while span * 2 <= width:
        high = np.maximum(high[:-span], high[span:])
        span *= 2
    high = np.maximum(high[: len(h)], high[width - span : width - span + len(h)])
    chosen = np.flatnonzero(high == h)
    starts, ends, anchors = [], [], []
    while len(first):
        value = low[first]
        k = np.searchsorted(chosen, first)
        while len(wrong := np.flatnonzero(h[chosen[k]] != value)):
            k[wrong] += 1
        at = chosen[k]
        until = np.minimum(last, at)
        starts.append(first)
        ends.append(until)
        anchors.append(at)
        more = last > at
        first, last = at[more] + 1, last[more]
    start, end, at = np.concatenate(starts), np.concatenate(ends), np.concatenate(anchors)
    run = hashes.of(start, end + length) ^ mix((end - start + 1).astype(np.uint64))
    return row[start], start, end - start + 1, at, h[at], run


def _deal(entries: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(block, kind="stable")
    entries, block = entries[order], block[order]
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    parts = np.split(entries, at[1:])
    columns = [pa.array([np.ascontiguousarray(p[name]).tobytes() for p in parts], pa.binary()) for name in ENTRY.names]
    return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), *columns], ["block", *ENTRY.names])


def _repeats(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries sorted by token, run and place; and which of them repeat an earlier run."""
    entries = entries[np.lexsort((entries["at"], entries["part"], entries["doc"], entries["run"], entries["token"]))]
    new = np.append(True, (entries["token"][1:] != entries["token"][:-1]) | (entries["run"][1:] != entries["run"][:-1]))
    first = entries[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return entries, (entries[["doc", "part", "at"]] != first[["doc", "part", "at"]])


def _runs(docs: DataFrame, blocks: int) -> DataFrame:
    """(kind, doc, part, at, size, turn): covered runs (0), and first runs whose anchor has others (1)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            entries, again = _repeats(np.concatenate(held))
            held.clear()
            if not again.all():
                yield _deal(entries[~again], (entries["token"][~again] % np.uint64(blocks)).astype(np.int64))
            if again.any():  # settled here; blocks of their own pass them through
                yield _deal(entries[again], blocks + entries["doc"][again] % blocks)

        for batch in batches:
            ids, parts, salts = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "part", "salt"))
            for chunk in chunks(batch, "text", 1_000_000):
                row, start, size, at, token, run = anchored_runs(chunk)
                entries = np.empty(len(row), ENTRY)
                entries["token"], entries["run"], entries["doc"] = token ^ salts[chunk.lo + row].view(np.uint64), run, ids[chunk.lo + row]
                entries["part"] = parts[chunk.lo + row]
                entries["at"], entries["size"], entries["turn"] = start - chunk.offsets[row], size, at - start
                held.append(entries)
                if sum(map(len, held)) >= BLOCK_ENTRIES:
                    yield from flush()
        if any(map(len, held)):
            yield from flush()

    def settle(block: pa.Table) -> pa.Table:
        entries = np.empty(sum(map(len, block.column("doc").to_pylist())) // 8, ENTRY)
        for name in ENTRY.names:
            entries[name] = np.frombuffer(b"".join(block.column(name).to_pylist()), ENTRY[name])
        if block.column("block")[0].as_py() >= blocks:
            kind = np.zeros(len(entries), np.int64)
        else:
            entries, again = _repeats(entries)
            new = np.append(True, entries["token"][1:] != entries["token"][:-1])
            group = np.cumsum(new) - 1
            several = np.bincount(group, weights=~again)[group] > 1
            keep = again | several
            kind = np.where(again, 0, 1)[keep]
            entries = entries[keep]
        columns = [kind, *(entries[name].astype(np.int64) for name in ("doc", "part", "at", "size", "turn"))]
        return pa.table([pa.array(c) for c in columns], ["kind", "doc", "part", "at", "size", "turn"])

    dealt = docs.select("key", "part", "salt", "text").mapInArrow(deal, "block int, " + ", ".join(f"{name} binary" for name in ENTRY.names))
    return dealt.groupBy("block").applyInArrow(settle, "kind long, doc long, part long, at long, size long, turn long")


def _contexts(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """(bucket, doc, part, at, size, turn, content): the bytes of open runs, in halves around the anchor.

    Windows that start close before the anchor share the bytes after it, the others the bytes
    before it; those shared bytes name the bucket.
    """
    half = (LENGTH - ANCHOR) // 2
    wanted = open_runs.groupBy("doc", "part").agg(F.collect_list(F.struct("at", "size", "turn")).alias("runs"))
    joined = docs.join(wanted.withColumnRenamed("doc", "key"), ["key", "part"]).select("key", "part", "salt", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            lists, values = np.asarray(runs.offsets), runs.values
            at, size, turn = (np.asarray(values.field(k)) for k in range(3))
            ids, parts, salts = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "part", "salt"))
            for chunk in chunks(batch, "text", 1_000_000):
                lo, hi = int(lists[chunk.lo]), int(lists[chunk.hi])
                row = np.repeat(np.arange(chunk.rows), np.diff(lists[chunk.lo : chunk.hi + 1]))
                base = chunk.offsets[row]
                first = base + at[lo:hi]
                last, anchor = first + size[lo:hi] - 1, first + turn[lo:hi]
                hashes, raw = RangeHash(chunk.data), chunk.data.tobytes()
                for side in (0, 1):  # windows near the anchor, and those far before it
                    a, b = (np.maximum(first, anchor - half), last) if side == 0 else (first, np.minimum(last, anchor - half - 1))
                    here = np.flatnonzero(a <= b)
                    if not len(here):
                        continue
                    a, b, p = a[here], b[here], anchor[here]
                    shared = hashes.of(p, p + LENGTH - half) if side == 0 else hashes.of(p - half - 1, p + ANCHOR)
                    bucket = mix(shared ^ np.uint64(side + 1) ^ salts[chunk.lo + row[here]].view(np.uint64)).view(np.int64)
                    content = pa.array([raw[x : y + LENGTH] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), pa.array(ids[chunk.lo + row[here]].astype(np.int64)), pa.array(parts[chunk.lo + row[here]].astype(np.int64)), pa.array(a - base[here]), pa.array(b - a + 1), pa.array(p - a), content], ["bucket", "doc", "part", "at", "size", "turn", "content"]
                    )

    return joined.mapInArrow(run, "bucket long, doc long, part long, at long, size long, turn long, content binary")


def difference_cover(period: int) -> np.ndarray:
    """Residues of which every difference modulo the period is a difference of two."""
    step = math.isqrt(period - 1) + 1
    return np.unique(np.concatenate([np.arange(step), np.arange(0, period, step)]))


def _words(buffer: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes at each place as big-endian numbers, most significant word first."""
    padded = -(-size // 8) * 8
    view = np.lib.stride_tricks.sliding_window_view(buffer, padded)
    block = view[places].copy()
    block[:, size:] = 0
    return block.view(">u8").astype(np.uint64)


def _rank(words: np.ndarray) -> np.ndarray:
    order = np.lexsort(words.T[::-1])
    new = np.append(False, (words[order][1:] != words[order][:-1]).any(axis=1))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def repeated_strings(contents: list[bytes], turns: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, docs: np.ndarray, parts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, part, place) of the strings in a slice of whole buckets that an equal earlier one precedes.

    Context ``k`` holds ``sizes[k]`` strings; the first starts at ``places[k]`` of its document
    and ``turns[k]`` bytes before its anchor.
    """
    period = COVER
    # contexts are laid out so that each anchor lies at a multiple of the period
    lengths = np.array([len(c) for c in contents])
    lead = -turns % period
    room = -(-(lead + lengths) // period) * period
    base = np.cumsum(room) - room + lead
    buffer = np.zeros(int(room.sum()) + 4 * LENGTH, np.uint8)
    for at, content in zip(base.tolist(), contents):
        buffer[at : at + len(content)] = np.frombuffer(content, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    suffix = base[owner] + offset
    # ranks of the difference-cover sample; a tie of COVER bytes is settled by the next sample place
    residues = np.zeros(period, bool)
    residues[difference_cover(period)] = True
    jump = np.array([next(d for d in range(period) if residues[(r + d) % period]) for r in range(period)])
    residue = suffix % period
    sample, back = np.unique(suffix + jump[residue], return_inverse=True)
    rank = _rank(_words(buffer, sample, LENGTH))[back]
    head = _words(buffer, suffix, COVER)
    order = np.lexsort((rank, residue, *head.T[::-1], buckets[owner]))
    owner, offset = owner[order], offset[order]
    whole = _words(buffer, suffix[order], LENGTH)
    new = np.append(True, (whole[1:] != whole[:-1]).any(axis=1) | (buckets[owner[1:]] != buckets[owner[:-1]]))
    group, doc, part, place = np.cumsum(new) - 1, docs[owner], parts[owner], places[owner] + offset
    by_place = np.lexsort((place, part, doc, group))
    group, doc, part, place = (x[by_place] for x in (group, doc, part, place))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[group]
    later = (doc != doc[first]) | (part != part[first]) | (place != place[first])
    return doc[later], part[later], place[later]


def _settled_contexts(contexts: DataFrame) -> DataFrame:
    """(doc, part, start, end) spans of repeated strings, from the sorted buckets."""

    def settle(block: pa.Table) -> pa.Table:
        bucket, doc, part, at, size, turn = (block.column(name).to_numpy() for name in ("bucket", "doc", "part", "at", "size", "turn"))
        order = np.argsort(bucket, kind="stable")
        new = np.append(True, bucket[order][1:] != bucket[order][:-1])
        group = np.cumsum(new) - 1
        order = order[np.bincount(group)[group] > 1]
        contents = block.column("content").take(pa.array(order)).to_pylist()
        bucket, doc, part, at, size, turn = (x[order] for x in (bucket, doc, part, at, size, turn))
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
        spans, lo = [(np.zeros(0, np.int64),) * 3], 0
        while lo < len(bucket):
            hi = int(edges[max(np.searchsorted(edges, lo + SLICE_CONTEXTS, "right") - 1, np.searchsorted(edges, lo) + 1)])
            spans.append(repeated_strings(contents[lo:hi], turn[lo:hi], size[lo:hi], bucket[lo:hi], doc[lo:hi], part[lo:hi], at[lo:hi]))
            lo = hi
        doc, part, place = (np.concatenate(x) for x in zip(*spans))
        order = np.lexsort((place, part, doc))
        doc, part, place = doc[order], part[order], place[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (place[1:] > place[:-1] + 1)) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[: len(first)] - 1
        return pa.table([pa.array(doc[first]), pa.array(part[first]), pa.array(place[first]), pa.array(place[last] + LENGTH)], ["doc", "part", "start", "end"])

    blocks = contexts.count() // BLOCK_CONTEXTS + 1
    dealt = contexts.withColumn("block", F.pmod("bucket", F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(settle, "doc long, part long, start long, end long")


def _parted(docs: DataFrame) -> DataFrame:
    """doc_id, text and how a row takes part: key, part, salt.

    ``part`` is 0, or the text's hash where the id stands for several texts. Rows without an id have a
    key of their own and a salt for each text, which keeps their strings from all others.
    """
    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    lone = F.col("doc_id").isNull()
    several = source.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).filter("low != high").select("doc_id")
    clash = F.lit(False)
    if not several.isEmpty():
        source = source.join(several.withColumn("clash", F.lit(True)), "doc_id", "left")
        clash = F.coalesce("clash", F.lit(False))
    own = F.xxhash64(F.lit("without an id"), "text")
    part = F.when(lone, own).when(clash, F.xxhash64("text")).otherwise(0)
    return source.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("key"), part.alias("part"), F.when(lone, own).otherwise(0).alias("salt"))


def repeated_spans(parted: DataFrame) -> DataFrame:
    """(doc, part, start, end) byte spans that hold every byte to remove; spans may overlap."""
    docs = parted
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total * 2 // (LENGTH - ANCHOR + 2)) // BLOCK_ENTRIES + 1
    runs = cut(_runs(docs, blocks), "suffix-runs")
    contexts = cut(_contexts(docs, runs.filter("kind = 1")), "suffix-contexts")
    whole = runs.filter("kind = 0").select("doc", "part", F.col("at").alias("start"), (F.col("at") + F.col("size") - 1 + LENGTH).alias("end"))
    return whole.unionByName(_settled_contexts(contexts))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with the kept bytes if asked."""
    source = _parted(docs)
    spans = cut(repeated_spans(source), "suffix-spans").groupBy("doc", "part").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = source.join(spans.withColumnRenamed("doc", "key"), ["key", "part"], "left").select("doc_id", "text", "starts", "ends")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, removed, count = raw, 0, 0
                if starts.is_valid:
                    start, end = np.asarray(starts.values), np.asarray(ends.values)
                    order = np.argsort(start, kind="stable")
                    start, until = start[order], np.maximum.accumulate(end[order])
                    gap = np.append(True, start[1:] > until[:-1])
                    first = np.flatnonzero(gap)
                    begin, until = start[first], until[np.append(first[1:], len(start)) - 1]
                    edges = [0, *np.stack([begin, until], 1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    removed, count = len(raw) - len(kept), len(begin)
                rows.append((len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept)[: len(names) - 1])
            columns = [pa.array(c) for c in zip(*rows)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
