"""Operator 11, substring dedup: words covered by a 50-word window that starts in a lesser document.

Suffixes are word sequences, cut at 50 words, of the windows of all documents; a repeat is an
internal node of depth 50 in their tree. The tree is built in parts that never meet:

* A suffix's prefix runs from its first word through its anchor, the leftmost ``ANCHOR``-word
  string of least hash in its window, so prefixes have 8 to 50 words. Equal suffixes have equal
  prefixes. Neighbouring suffixes with one anchor travel as a run, which holds their words once.
* Equal runs are one path with many owners, of which the least and the greatest document are
  kept (a grouped minimum, summed up before the shuffle). Anchors of one document are leaves
  without a repeat and go.
* The other runs are dealt by anchor to groups of bounded size, and each group builds its
  subtree from the words themselves: names of strings of doubling length sort the suffixes, and
  neighbours alike in 50 words lie below one deep node, whose least document it learns.
* An anchor with more than ``SPLIT_RUNS`` unlike runs gets longer prefixes, of all 50 words. Such a
  group is a single node, so a grouped minimum settles it and no task holds the anchor's runs.

Deep nodes give each path its repeated windows with their least documents; owners in greater
documents lose them. Windows are judged on the input.

Defined results: null, empty and short texts (under 50 words) lose nothing; rows with a null
doc_id stay whole and lend no window; rows with one doc_id are equal in rank, so none of them
takes words from another, whether their texts are equal or not; an empty table gives an empty
result; extra columns are ignored. A very long text is held whole with a few 8-byte arrays over
its words. Ids must be integers or texts of such, else the job ends with a cast error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from collinea.llm.common import NOT_SPACE, Chunk, RangeHash, chunks, cut, segment_index, word_spans
from collinea.llm.suffix_dedup import anchored_runs

LENGTH = 50
ANCHOR = 8
TEXT_BYTES = 1_000_000
GROUP_RUNS = 20_000
SPLIT_RUNS = 5_000
SLICE_WORDS = 1_000_000


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("part", F.xxhash64("text"))


def _owners(source: DataFrame, length: int, anchor: int) -> DataFrame:
    """(token, run, doc, part, at, size): each run of windows that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("doc_id", "part"))
            for chunk in chunks(batch, "text", TEXT_BYTES):
                start, end, row = word_spans(chunk, NOT_SPACE)
                codes = RangeHash(chunk.data).of(start, end)
                words = Chunk(chunk.lo, chunk.hi, codes, np.searchsorted(row, np.arange(chunk.rows + 1)))
                row, first, size, _, token, runs = anchored_runs(words, length, anchor)
                columns = [token.view(np.int64), runs.view(np.int64), ids[chunk.lo + row], parts[chunk.lo + row], first - words.offsets[row], size]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["token", "run", "doc", "part", "at", "size"])

    return source.filter("doc_id is not null").select("doc_id", "part", "text").mapInArrow(run, "token long, run long, doc long, part long, at long, size long")


def _paths(owners: DataFrame) -> DataFrame:
    """(token, run, doc, part, at, size, last, n): unlike runs of anchors that two documents hold.

    ``doc`` is the least owner, whose text the path is read from, ``last`` the greatest, and ``n``
    the unlike runs of the anchor.
    """
    paths = owners.groupBy("token", "run").agg(F.min(F.struct("doc", "part", "at", "size")).alias("first"), F.max("doc").alias("last"))
    shared = paths.groupBy("token").agg(F.min("first.doc").alias("low"), F.max("last").alias("high"), F.count("*").alias("n")).filter("low < high")
    return paths.join(shared.select("token", "n"), "token").select("token", "run", "first.*", "last", "n")


def _with_texts(source: DataFrame, paths: DataFrame) -> DataFrame:
    wanted = paths.groupBy(F.col("doc").alias("doc_id"), "part").agg(F.collect_list(F.struct("token", "run", "at", "size", "last")).alias("runs"))
    return source.join(wanted, ["doc_id", "part"]).select("doc_id", "text", "runs")


def _path_words(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For each chunk of texts: (raw bytes, word starts, word ends), and of each run (first word, token, run, doc, size, last)."""
    runs = batch.column("runs")
    lists, values = np.asarray(runs.offsets), runs.values
    token, name, at, size, last = (np.asarray(values.field(k)) for k in range(5))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for chunk in chunks(batch, "text", TEXT_BYTES):
        start, end, row = word_spans(chunk, NOT_SPACE)
        own = slice(int(lists[chunk.lo]), int(lists[chunk.hi]))
        holder = np.repeat(np.arange(chunk.rows), np.diff(lists[chunk.lo : chunk.hi + 1]))
        first = np.searchsorted(row, holder) + at[own]
        yield chunk.data.tobytes(), start, end, first, token[own], name[own], ids[chunk.lo + holder], size[own], last[own]


def _contents(source: DataFrame, paths: DataFrame, length: int) -> DataFrame:
    """(token, run, doc, size, last, words): each path with its bytes."""
    names = ["token", "run", "doc", "size", "last", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, start, end, first, token, name, doc, size, last in _path_words(batch):
                a, b = start[first], end[first + size + length - 2]
                words = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in (token, name, doc, size, last)), words], names)

    return _with_texts(source, paths).mapInArrow(run, "token long, run long, doc long, size long, last long, words binary")


def _single_nodes(source: DataFrame, paths: DataFrame, length: int) -> DataFrame:
    """(token, run, lo, size, least) of anchors with many unlike runs: prefixes of full length."""
    names = ["node", "token", "run", "lo", "doc", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, start, end, first, token, name, doc, size, last in _path_words(batch):
                path, lo = segment_index(size)
                at = first[path] + lo
                nodes = [hashlib.md5(b" ".join(raw[start[k] : end[k]] for k in range(p, p + length))).digest() for p in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), *(pa.array(c.astype(np.int64)) for c in (token[path], name[path], lo, doc[path], last[path]))], names)

    leaves = cut(_with_texts(source, paths).mapInArrow(run, "node binary, token long, run long, lo long, doc long, last long"), "substring-leaves")
    least = leaves.groupBy("node").agg(F.min("doc").alias("least"), F.max("last").alias("most")).filter("least < most").select("node", "least")
    return leaves.join(least, "node").filter("least < last").select("token", "run", "lo", F.lit(1).cast("long").alias("size"), "least")


def deep_nodes(words: np.ndarray, suffixes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes in the tree, and where a new node of depth ``length`` begins in it.

    ``words`` are word numbers. Strings of 2, 4, 8, ... words get ranks as names from the names
    of their halves; two overlapping ones name a suffix.
    """
    rank, span = words, 1
    while span * 2 <= length:
        pair = rank[:-span].astype(np.int64) * (int(rank.max()) + 1) + rank[span:]
        rank, span = np.unique(pair, return_inverse=True)[1], span * 2
    head, tail = rank[suffixes], rank[suffixes + length - span]
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    return order, np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))


def subtree(contents: list[bytes], token: np.ndarray, run: np.ndarray, doc: np.ndarray, size: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(token, run, lo, size, least): windows lo to lo + size - 1 of a path lie below deep nodes of that least document."""
    data = b"".join(contents)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
    start, end, row = word_spans(Chunk(0, len(contents), np.frombuffer(data, np.uint8), offsets), NOT_SPACE)
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))
    path, lo = segment_index(size)
    order, new = deep_nodes(words, np.searchsorted(row, np.arange(len(contents)))[path] + lo, length)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[path][order], np.flatnonzero(new))[node]
    keep = least < last[path]
    path, lo, least = path[keep], lo[keep], least[keep]
    if not len(path):
        return (np.zeros(0, np.int64),) * 5
    first = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (lo[1:] != lo[:-1] + 1) | (least[1:] != least[:-1])))
    count = np.diff(np.append(first, len(path)))
    return token[path[first]], run[path[first]], lo[first], count, least[first]


def _subtrees(contents: DataFrame, groups: int, length: int) -> DataFrame:
    """(token, run, lo, size, least) from the subtree of each group of anchors."""
    names = ["token", "run", "lo", "size", "least"]

    def build(block: pa.Table) -> pa.Table:
        token, run, doc, size, last = (block.column(name).to_numpy() for name in ("token", "run", "doc", "size", "last"))
        order = np.argsort(token, kind="stable")
        words = block.column("words").take(pa.array(order)).to_pylist()
        token, run, doc, size, last = (x[order] for x in (token, run, doc, size, last))
        # slices of whole anchors, so that the arrays of names stay small
        weight = np.cumsum(size + length)
        edges = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
        found, lo = [], 0
        while lo < len(token):
            most = np.searchsorted(weight, (weight[lo - 1] if lo else 0) + SLICE_WORDS, "right")
            hi = int(edges[max(np.searchsorted(edges, most, "right") - 1, np.searchsorted(edges, lo, "right"))])
            found.append(subtree(words[lo:hi], token[lo:hi], run[lo:hi], doc[lo:hi], size[lo:hi], last[lo:hi], length))
            lo = hi
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names)

    return contents.withColumn("bin", F.pmod(F.xxhash64("token"), F.lit(groups))).groupBy("bin").applyInArrow(build, "token long, run long, lo long, size long, least long")


def repeated_spans(source: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, split_runs: int = SPLIT_RUNS) -> DataFrame:
    """(doc, part, start, end) word spans to remove; spans of a document may overlap."""
    owners = cut(_owners(source, length, anchor), "substring-owners")
    paths = cut(_paths(owners), "substring-paths")
    narrow, wide = paths.filter(F.col("n") <= split_runs), paths.filter(F.col("n") > split_runs)
    groups = narrow.count() // GROUP_RUNS + 1
    groups = max(groups, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = _subtrees(_contents(source, narrow, length), groups, length)
    if not wide.isEmpty():
        nodes = nodes.unionByName(_single_nodes(source, wide, length))
    nodes = cut(nodes, "substring-nodes").withColumnRenamed("size", "windows")
    found = owners.join(nodes, ["token", "run"]).filter("least < doc")
    return found.select("doc", "part", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("lo") + F.col("windows") + (length - 1)).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, split_runs: int = SPLIT_RUNS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with the kept words, joined by spaces, if asked."""
    source = _source(docs)
    spans = repeated_spans(source, length, anchor, split_runs).groupBy(F.col("doc").alias("doc_id"), "part").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = source.join(spans, ["doc_id", "part"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            lists, values = np.asarray(spans.offsets), spans.values
            begin, until = np.asarray(values.field(0)), np.asarray(values.field(1))
            for chunk in chunks(batch, "text", TEXT_BYTES):
                start, end, row = word_spans(chunk, NOT_SPACE)
                base = np.searchsorted(row, np.arange(chunk.rows + 1))
                own = slice(int(lists[chunk.lo]), int(lists[chunk.hi]))
                holder = np.repeat(base[:-1], np.diff(lists[chunk.lo : chunk.hi + 1]))
                depth = np.bincount(holder + begin[own], minlength=len(start) + 1) - np.bincount(holder + until[own], minlength=len(start) + 1)
                kept = np.cumsum(depth)[: len(start)] == 0
                n_kept = np.bincount(row[kept], minlength=chunk.rows)
                # each kept word with a space after it
                word, at = segment_index(end[kept] - start[kept] + 1)
                bytes_ = np.append(chunk.data, np.uint8(32))[start[kept][word] + at]
                stop = np.cumsum(end[kept] - start[kept] + 1)
                bytes_[stop - 1] = 32
                edges = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(n_kept)])].tolist()
                raw = bytes_.tobytes()
                texts = [raw[a : max(a, b - 1)] for a, b in zip(edges, edges[1:])]
                n_words = np.diff(base)
                columns = [batch.column("doc_id").slice(chunk.lo, chunk.rows), pa.array(n_words), pa.array(n_words - n_kept), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
