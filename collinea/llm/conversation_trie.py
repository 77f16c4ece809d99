"""Operator 13, conversation prefix trie: one row for each node, with aggregates of its subtree.

A conversation is the path of its turns; a node stands for a distinct prefix. The paths are
put in order and dealt to shards at splitter paths:

* The splitters are quantiles of a bounded sample of paths (``SAMPLE`` for each shard; the sample
  only places the borders, all paths are dealt). A node can lie in several shards only if it is a
  prefix of a splitter. The trie of the splitters, the skeleton, is broadcast; splitters are cut
  to ``SKELETON_BYTES`` in all, so its size doesn't grow with the data.
* A shard reads its paths in order and holds the open path alone. A node that the path leaves is
  finished, and so is its row, except for nodes of the skeleton: of these a shard has a part.
* Parts of skeleton nodes are reduced with grouped sums and minima, and a pass over the skeleton
  adds up its own subtrees. Rows below it learn their parent's id from its rows.

A node's end members come in order of ids, as paths are sorted by ids next. Digests of skeleton
nodes are made from stretches of ids that are read one after the other, so a conversation that
very many ids share is spread over shards and never held whole.

Turns are compared by MD5 of role and text. A conversation is one record, 16 bytes and a word
count for each turn; texts stay in the first scan.

Defined results: rows with a null conv_id belong to no conversation and are ignored; a null role
or text is empty; a null turn comes first; rows of one turn go by role, then by digest; equal rows
are turns of their own; a conversation without a turn left ends at the root; an empty table gives
an empty result; extra columns are ignored. A very long text or conversation stays whole.
``conv_id % 20`` has the sign of conv_id, as in SQL. Ids and turns must be integers or texts of
such, else the job ends with a cast error.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from collinea.llm.common import cut

WIDTH = 16  # bytes of a turn's digest
SAMPLE = 16
SKELETON_BYTES = 32_000_000
SHARD_PATHS = 50_000
STRETCH = 4_096  # ids in one row of a skeleton node's end members

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [c.split(" ")[0] for c in NODE.split(", ")]


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, words)."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    entry = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", digest.alias("digest"), words.alias("words"))
    lists = turns.select("conv_id", entry.alias("entry")).groupBy("conv_id").agg(F.sort_array(F.collect_list("entry")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def branched(lists: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations rebuilt: the first turns of the conversation at the next lower multiple of ``every``, then their own later ones."""
    base = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, heads - 1).alias("base"))
    joined = lists.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % every).join(base, "base_id", "left")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.expr("slice(turns, 1, 0)")
    own = F.slice("turns", head + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("base", F.lit(1), head), none), own).alias("turns"))


def paths_of(lists: DataFrame) -> DataFrame:
    """(path, conv_id, words): the digests of all turns in one value that sorts like the path."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return lists.select(path.alias("path"), "conv_id", F.transform("turns", lambda t: t["words"]).alias("words"))


def splitters_of(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Sorted (path, conv_id) borders between shards; long paths are cut."""
    most = max(1, SKELETON_BYTES // (WIDTH * max(shards, 1))) * WIDTH
    keys = paths.select(F.expr(f"substring(path, 1, {most})").alias("path"), F.expr(f"if(length(path) > {most}, null, conv_id)").alias("conv_id"))
    few = keys.orderBy(F.xxhash64("path", "conv_id")).limit(SAMPLE * shards).collect()
    # a cut path stands for its first extension, whatever the id
    sample = sorted((bytes(path), -(1 << 63) if conv is None else conv) for path, conv in few)
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def skeleton_of(splitters: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Numbers of the nodes that may lie in several shards: all prefixes of splitters, the root first."""
    nodes = {path[:k] for path, _ in splitters for k in range(0, len(path) + 1, WIDTH)} | {b""}
    return {path: n for n, path in enumerate(sorted(nodes))}


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * WIDTH).reshape(n, WIDTH) for s in (a, b))
    return int((x != y).any(axis=1).argmax())


class _Node:
    __slots__ = ("low", "convs", "children", "leaves", "saved", "words", "digest", "ended", "stretch", "waiting", "number")

    def __init__(self, words: int, number: int | None):
        self.low, self.convs, self.children, self.leaves, self.saved, self.words = None, 0, 0, 0, 0, words
        self.digest, self.ended, self.stretch = (hashlib.sha256() if number is None else None), False, []
        self.waiting: list[tuple] = []  # finished children that lack their parent's id
        self.number = number


class _Shard:
    """Reads sorted paths and collects finished rows."""

    def __init__(self, skeleton: dict[bytes, int]):
        self.skeleton, self.path, self.open, self.seq = skeleton, b"", [], 0
        self.rows: list[tuple] = []  # kind, number, seq, ids, node columns

    def add(self, path: bytes, conv: int, words: list[int]) -> None:
        if self.open:
            self.leave(common_turns(self.path, path) + 1)
        self.path = path
        for depth in range(len(self.open), len(path) // WIDTH + 1):
            number = None
            if depth == 0 or self.open[-1].number is not None:
                number = self.skeleton.get(path[: depth * WIDTH])
            self.open.append(_Node(words[depth - 1] if depth else 0, number))
        self.end(self.open[-1], conv)

    def end(self, node: _Node, conv: int) -> None:
        node.convs += 1
        node.low = conv if node.low is None else min(node.low, conv)
        if node.number is None:
            node.digest.update((b"," if node.ended else b"") + str(conv).encode())
            node.ended = True
            return
        node.stretch.append(conv)
        if len(node.stretch) >= STRETCH:
            self.hand_over(node)

    def hand_over(self, node: _Node) -> None:
        if node.stretch:
            self.rows.append(("ends", node.number, self.seq, ",".join(map(str, node.stretch)), *([None] * len(NAMES))))
            self.seq += 1
            node.stretch = []

    def leave(self, size: int) -> None:
        """Finish open nodes until ``size`` are left."""
        while len(self.open) > size:
            node, depth = self.open.pop(), len(self.open)
            above = self.open[-1] if self.open else None
            if above is not None:
                above.convs += node.convs
                above.low = node.low if above.low is None else min(above.low, node.low)
            if node.number is not None:
                self.hand_over(node)
                self.rows.extend(("below", node.number, None, None, *row) for row in node.waiting)
                self.rows.append(("part", node.number, None, None, node.low, depth, node.words, node.convs, node.children, node.leaves, node.saved, None))
                continue
            leaves = node.leaves or 1
            saved = node.saved + (node.convs - 1) * node.words
            self.rows.extend(("whole", None, None, None, row[0], row[1], node.low, *row[3:]) for row in node.waiting)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            above.waiting.append((node.low, depth, None, node.convs, node.children, leaves, saved, node.digest.hexdigest()))
            if above.number is not None and len(above.waiting) >= STRETCH:
                self.rows.extend(("below", above.number, None, None, *row) for row in above.waiting)
                above.waiting = []


ROW = "shard long, kind string, number long, seq long, ids string, " + NODE


def shard_rows(paths: DataFrame, splitters: list[tuple[bytes, int]], shards: int) -> DataFrame:
    """Rows of nodes and parts of skeleton nodes, from sorted shards."""
    context = paths.sparkSession.sparkContext
    borders = context.broadcast(pickle.dumps((splitters, skeleton_of(splitters))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, _ = pickle.loads(borders.value)
        for batch in batches:
            shard = [bisect_right(edges, key) for key in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], ["shard", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, skeleton = pickle.loads(borders.value)
        now, state = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if state is not None and state.rows:
                columns = list(zip(*state.rows))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(state.rows), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["shard", "kind", "number", "seq", "ids", *NAMES])
                state.rows = []

        for batch in batches:
            for shard, path, conv, words in zip(*(batch.column(name).to_pylist() for name in ("shard", "path", "conv_id", "words"))):
                if shard != now:
                    if state is not None:
                        state.leave(0)
                        yield from flush()
                    now, state = shard, _Shard(skeleton)
                state.add(path, conv, words)
                if len(state.rows) >= 10_000:
                    yield from flush()
        if state is not None:
            state.leave(0)
            yield from flush()

    placed = paths.mapInArrow(place, "shard long, path binary, conv_id long, words array<long>")
    dealt = placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(walk, ROW)


def _digests(ends: DataFrame) -> DataFrame:
    """(number, ends_sha256): stretches of ids are read in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for number, ids in zip(batch.column("number").to_pylist(), batch.column("ids").to_pylist()):
                if number != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = number, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["number", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["number", "ends_sha256"])

    ordered = ends.repartition("number").sortWithinPartitions("number", "shard", "seq")
    return ordered.select("number", "ids").mapInArrow(run, "number long, ends_sha256 string")


def _skeleton_rows(rows: DataFrame, skeleton: dict[bytes, int]) -> DataFrame:
    """(number, node columns): parts reduced, then summed along the skeleton.

    The reduced parts are as many as the skeleton's nodes, whose paths the driver holds already.
    """
    spark = rows.sparkSession
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    # a part carries its last turn's words in the place of the parent's id
    parts = rows.filter("kind = 'part'").groupBy("number").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("words"), *sums)
    found = {row.number: row.asDict() for row in parts.collect()}
    paths = sorted(skeleton, key=len, reverse=True)
    for path in paths:  # deepest first: each node adds itself to the one above
        node = found.get(skeleton[path])
        if node is None:
            continue
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        if path:
            above = found[skeleton[path[:-WIDTH]]]
            node["parent_conv_id"] = above["conv_id"]
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
    table = [(number, *(node.get(c) for c in NAMES[:-1])) for number, node in sorted(found.items())]
    nodes = spark.createDataFrame(table, "number long, " + NODE.rsplit(", ", 1)[0])
    digests = _digests(rows.filter("kind = 'ends'"))
    return nodes.join(digests, "number", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def trie(lists: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each node of the trie of ``lists(conv_id, turns)``."""
    spark = lists.sparkSession
    paths = cut(paths_of(lists), "trie-paths")
    wanted = paths.count() // SHARD_PATHS + 1
    shards = shards or max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = splitters_of(paths, shards)
    rows = cut(shard_rows(paths, splitters, shards), "trie-rows")
    top = cut(_skeleton_rows(rows, skeleton_of(splitters)), "trie-skeleton")
    above = F.broadcast(top.select("number", F.col("conv_id").alias("above")))  # bounded by SKELETON_BYTES
    below = rows.filter("kind = 'below'").join(above, "number").withColumn("parent_conv_id", F.col("above"))
    return rows.filter("kind = 'whole'").select(*NAMES).unionByName(below.select(*NAMES)).unionByName(top.select(*NAMES))


def branched_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(branched(turn_lists(conversations)), shards)
