"""Operator 12, phrase collocation mining: top-order marginalisation of padded lead windows.

Every word of a piece starts one window: the word and its three successors (lead columns), padded
with nulls where the piece ends. Only these longest windows are counted. As a phrase is a prefix
of exactly the windows that start with it, Spark's ROLLUP over (lang, w1, w2, w3, w4) sums the
counts of all shorter phrases and each language's number of words; there is no explosion for
each order.

A phrase below the support can't be a candidate nor a part of one, and neither can a longer one that
holds it. So a window is padded from the first word on with which it is certainly rare. Two tables
of ``BUCKETS`` saturating counters, filled over all texts, bound counts from above: one for pairs of
neighbours, the next for strings of three and four words without a rare pair. They never pad away a
phrase with support. Windows left are about as many as phrases with support; where very many strings
share a counter, as in far larger corpora, less is padded and the windows' own number is the cost.
A table's bits (one for each counter, a constant 4 MB) are the only thing broadcast.

Windows are summed up by text before each shuffle, so a hot pair or word is one row of each task.
The first 2,000 of a language are taken among ``SLICES`` slices of phrases first, so no task holds
all candidates of a language. All arithmetic is on decimals of 38 digits or comparisons of such.

Defined results: null and empty texts have no words; a null lang is ``und`` (and joins a language
of that name); rows of one id count as often as they occur, ids are not read at all; an empty table
gives an empty result; extra columns are ignored; ties in score and count go by the phrase's
bytes. A very long text is held whole with a few 8-byte arrays over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from collinea.llm.common import LOWER, Chunk, RangeHash, chunks, cut, mix, segment_index, string_buffer, word_spans

SUPPORT = 30
TOP = 2_000
ORDER = 4
SCALE = 2_000_000
SLICES = 64
TEXT_BYTES = 1_000_000
BUCKETS = 1 << 25
BLOCK = 1 << 13

#: bytes that end a piece, and bytes of words
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
MEMBER = ~ENDS
MEMBER[[32, 9]] = False


def _words(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(lower-cased chunk, start, end, row, hashes, joined): of strings of 2, 3, 4 words from each word; whether its successor is in its piece."""
    names, offsets = string_buffer(batch.column("lang"))
    langs = mix(RangeHash(names[: offsets[-1]]).of(offsets[:-1], offsets[1:]) + np.uint64(1))
    for raw in chunks(batch, "text", TEXT_BYTES):
        chunk = Chunk(raw.lo, raw.hi, LOWER[raw.data], raw.offsets)
        start, end, row = word_spans(chunk, MEMBER)
        if not len(start):
            continue
        codes = RangeHash(chunk.data).of(start, end) ^ langs[chunk.lo + row]
        ends = np.append(0, np.cumsum(ENDS[chunk.data], dtype=np.int32))
        joined = np.append((ends[start[1:]] == ends[end[:-1]]) & (row[1:] == row[:-1]), False)
        hashes = [codes]
        for k in range(1, ORDER):
            hashes.append(mix(hashes[-1] * np.uint64(2 * k + 1) + _later(codes, k)))
        yield chunk, start, end, row, hashes[1:], joined


def _later(values: np.ndarray, k: int) -> np.ndarray:
    """Each place's value ``k`` places on; zeros behind the end."""
    out = np.zeros_like(values)
    out[: max(len(values) - k, 0)] = values[k:]
    return out


def _frequent(bits: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    return ((bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1).astype(bool)


def _unbroken(joined: np.ndarray) -> list[np.ndarray]:
    """From which words strings of 2, 3 and 4 words go through joints that hold."""
    out = [joined]
    for k in range(1, ORDER - 1):
        out.append(out[-1] & _later(joined, k))
    return out


def support_filter(texts: DataFrame, support: int = SUPPORT, buckets: int = BUCKETS, pairs: np.ndarray | None = None) -> np.ndarray:
    """One bit for each counter: whether the strings that share it occur ``support`` times together.

    Counts pairs; given the pairs' bits, strings of three and four words whose pairs all are frequent.
    """
    most = min(support, 255)
    blocks = -(-buckets // BLOCK)
    shared = None if pairs is None else texts.sparkSession.sparkContext.broadcast(pairs.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(blocks * BLOCK, np.uint8)
        for batch in batches:
            for _, _, _, _, hashes, joined in _words(batch):
                if shared is None:
                    counted = hashes[0][joined]
                else:
                    holds = _unbroken(joined & _frequent(np.frombuffer(shared.value, np.uint8), hashes[0], buckets))
                    counted = np.concatenate([h[ok] for h, ok in zip(hashes[1:], holds[1:])])
                bucket, n = np.unique((counted % np.uint64(buckets)).astype(np.int64), return_counts=True)
                table[bucket] = np.minimum(table[bucket] + n, most)
        for lo in range(0, blocks, 256):
            part = table[lo * BLOCK : (lo + 256) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                block, edge = np.unique(at // BLOCK, return_index=True)
                place = [(p % BLOCK).astype(np.uint16).tobytes() for p in np.split(at, edge[1:])]
                held = [c.tobytes() for c in np.split(part[at], edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(lo + block), pa.array(place, pa.binary()), pa.array(held, pa.binary())], ["block", "place", "held"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; one block is summed at a time."""
        now, sums = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(sums >= most).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, place, held in zip(batch.column("block").to_pylist(), batch.column("place").to_pylist(), batch.column("held").to_pylist()):
                if block != now:
                    if now is not None and (sums >= most).any():
                        yield done()
                    now = block
                    sums[:] = 0
                sums[np.frombuffer(place, np.uint16)] += np.frombuffer(held, np.uint8)
        if now is not None and (sums >= most).any():
            yield done()

    counted = texts.mapInArrow(count, "block long, place binary, held binary")
    found = counted.repartition("block").sortWithinPartitions("block").mapInArrow(total, "block long, bits binary")
    bits = np.zeros(blocks * BLOCK // 8, np.uint8)
    for block, part in found.collect():  # at most a bit for each counter
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(part, np.uint8)
    return bits


def lead_windows(texts: DataFrame, pairs: np.ndarray, longer: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): padded longest windows, summed up within runs of texts."""
    shared = texts.sparkSession.sparkContext.broadcast((pairs.tobytes(), longer.tobytes()))
    columns = [f"w{k + 1}" for k in range(ORDER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = [np.frombuffer(bits, np.uint8) for bits in shared.value]
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)
            for chunk, start, end, row, hashes, joined in _words(batch):
                # a lead is there if all strings that its window then holds may be frequent
                open_ = [joined & _frequent(frequent[0], hashes[0], buckets)]
                for k in range(2, ORDER):
                    open_.append(open_[-1] & _later(open_[-1], 1) & _frequent(frequent[1], hashes[k - 1], buckets))
                # exact numbers of words, from their bytes
                word, at = segment_index(end - start)
                offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
                texts_ = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(chunk.data[start[word] + at]))
                coded = texts_.dictionary_encode()
                ids = coded.indices.to_numpy().astype(np.int64) + 1
                leads = [ids, *(np.where(open_[k - 1], _later(ids, k), 0) for k in range(1, ORDER))]  # 0 pads
                many = len(coded.dictionary) + 1
                name = lang[chunk.lo + row]
                for lead in leads:
                    name = np.unique(name * many + lead, return_inverse=True)[1]
                _, first, count = np.unique(name, return_index=True, return_counts=True)
                words = [coded.dictionary.take(pa.array(np.maximum(lead[first] - 1, 0), mask=lead[first] == 0)).cast(pa.string()) for lead in leads]
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[chunk.lo + row[first]])), *words, pa.array(count)], ["lang", *columns, "n"])

    return texts.mapInArrow(run, "lang string, " + ", ".join(f"{c} string" for c in columns) + ", n long")


def phrase_counts(docs: DataFrame, support: int = SUPPORT, buckets: int = BUCKETS) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of at most four words with support; size 0: words of the language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = support_filter(texts, support, buckets)
    longer = support_filter(texts, support, buckets, pairs)
    keys = ["lang", *(f"w{k + 1}" for k in range(ORDER))]
    windows = lead_windows(texts, pairs, longer, buckets).groupBy(*keys).agg(F.sum("n").alias("n"))
    sums = windows.rollup(*keys).agg(F.sum("n").alias("f"), F.grouping_id().alias("summed"))
    size = F.lit(ORDER) - F.bit_count("summed")  # a bit for each column that is summed over
    phrase = F.concat_ws(" ", *keys[1:])
    last = F.get(F.array(*keys), size)
    kept = (size >= 0) & last.isNotNull() & ((size == 0) | (F.col("f") >= support))
    return sums.filter(kept).select("lang", size.alias("size"), phrase.alias("phrase"), "f")


def best_cuts(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): each candidate with its lowest-scoring cut, of equal ones the first."""
    candidates = phrases.filter("size >= 2").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    counts = phrases.filter(f"size between 1 and {ORDER - 1}").select("lang", "phrase", "f")
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({SCALE} as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "size", "a", "low.l", "low.r", "low.score")


def without_inner(scored: DataFrame) -> DataFrame:
    """Candidates that no longer one holds with 80 percent of their count."""
    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    held = scored.filter("size > 2").withColumn("words", words).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = "longer is null or cast(longer as decimal(20,0)) * cast(100 as decimal(3,0)) < cast(a as decimal(20,0)) * cast(80 as decimal(3,0))"
    return scored.join(most, ["lang", "phrase"], "left").filter(kept).drop("longer")


def first_of(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank, by way of the first of each slice."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    few = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("slice")


def mine(docs: DataFrame, support: int = SUPPORT, top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations."""
    phrases = cut(phrase_counts(docs, support, buckets), "phrases")
    totals = phrases.filter("size = 0").select("lang", F.col("f").alias("n"))
    best = first_of(without_inner(cut(best_cuts(phrases), "phrase-cuts")), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
