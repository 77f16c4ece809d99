"""Operator 8, benchmark decontamination with a generalised suffix automaton.

The normalised test items form one automaton over word numbers; every text is streamed
through it word by word, and the longest match that ends at each word is tracked. A word
is hit if it lies in an occurrence of a window: ``window`` consecutive words of an item, or
a whole item of fewer words. With one block of items this is one Arrow pass over the
documents without a shuffle.

The items are dealt by hash into blocks of about ``block_bytes`` of text at most, whose number
grows with the item table. One block at a time is fetched and broadcast, so neither the driver
nor an executor ever holds the table. With several blocks, one pass over the texts first asks a
filter of all windows' hashes (``FILTER_BITS`` bits, made by Spark) which rows may hold a window;
only those are streamed through each block's automaton, and the hit spans of all blocks are
merged per document row before anything is judged or cut. A window that many items share is one
mark with one set of items, and equal items are one sequence, so repeats cost no more than one.

Defined results: null or empty texts have no words and no hits; items without words (null,
too) give no window; repeated items count each under their own id; null item ids give
hits, but no name in the list; a null document id stays null; repeated rows are judged row by
row; windows that nest or overlap count each word once; a very long text is scanned whole, in
one piece, with about 50 bytes of memory for each of its bytes; extra columns pass through
``remove_spans``. Document ids must be integers, or texts of such.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from collinea.llm.common import ALNUM, LOWER, Chunk, RangeHash, chunks, cut, free_name, word_spans

WINDOW = 13
#: bytes of item text in one automaton: about 40 bytes of automaton for each byte of text
BLOCK_BYTES = 4_000_000
#: bits of the filter before several blocks: 16 MB
FILTER_BITS = 1 << 27


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with suffix links and item marks.

    ``marks`` names, for a state, the distinct windows that end in it: (length, set of items), one
    for each length however many items hold it. A window belongs to the state that holds it; a
    state of a longer match reaches the states of all its suffixes by suffix links. ``sets`` lists
    the items of each set; windows with the same items share one.
    """

    def __init__(self, sequences: list[tuple[object, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        equal: dict[tuple[int, ...], list] = {}
        for item, words in sequences:
            equal.setdefault(tuple(words), []).append(item)
        for words in equal:
            self._add(words)
        holders: dict[tuple[int, int], list[int]] = {}  # (state, length) -> numbers of unlike sequences
        for number, words in enumerate(equal):
            need = min(window, len(words))
            state, matched = 0, 0
            for k, word in enumerate(words):
                state, matched = self.step(state, matched, word)
                if k + 1 >= need:
                    held = holders.setdefault((self.holding(state, need), need), [])
                    if not held or held[-1] != number:
                        held.append(number)
        items = list(equal.values())
        self.sets: list[list] = []
        self.marks: dict[int, list[tuple[int, int]]] = {}
        known: dict[tuple[int, ...], int] = {}
        for (state, need), held in holders.items():
            key = tuple(held)
            if key not in known:
                known[key] = len(self.sets)
                self.sets.append([item for number in held for item in items[number]])
            self.marks.setdefault(state, []).append((need, known[key]))
        #: for each state the nearest state on its suffix path, itself included, with a mark
        self.marked = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]] if self.link[state] >= 0 else -1

    def _add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        to = self.next[last].get(word)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            to = self.next[p][word]
            self.link[state] = to if self.length[to] == self.length[p] + 1 else self._split(p, word, to)
        return state

    def _split(self, p: int, word: int, to: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[to]), self.link[to])
        while p >= 0 and self.next[p].get(word) == to:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[to] = copy
        return copy

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The state and length of the longest match that ends with ``word``."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, matched + 1)

    def holding(self, state: int, length: int) -> int:
        """The state on the suffix path that holds the suffix of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def ending(self, state: int, matched: int) -> Iterator[tuple[int, int]]:
        """The windows (length, set of items) that end where the match ends."""
        at = self.marked[state]
        while at > 0:
            for need, held in self.marks[at]:
                if need <= matched:
                    yield need, held
            at = self.marked[self.link[at]]


def normalised_words(text: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(text, np.uint8)]
    start, end, _ = word_spans(Chunk(0, 1, data, np.array([0, len(data)])), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start, end)]


class ItemMatcher:
    """Streams texts through the automaton of one block of items."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        words = [(item, normalised_words((text or "").encode())) for item, text in items]
        number: dict[bytes, int] = {}
        sequences = [(k, [number.setdefault(w, len(number)) for w in found]) for k, (_, found) in enumerate(words) if found]
        names = [item for item, _ in words]
        self.automaton = SuffixAutomaton(sequences, window)
        #: names of the items of each set of the automaton
        self.names = [sorted({str(names[k]) for k in held if names[k] is not None}) for held in self.automaton.sets]
        self.least = min((min(window, len(s)) for _, s in sequences), default=0)
        vocabulary = b"".join(number)
        ends = np.cumsum([len(w) for w in number], dtype=np.int64)
        hashes = RangeHash(np.frombuffer(vocabulary, np.uint8)).of(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if number else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.known, self.numbers = hashes[order], np.arange(len(number))[order]

    def match(self, chunk) -> tuple[np.ndarray, list[tuple[int, int, int, int]], tuple[np.ndarray, ...]]:
        """Words per row; (row, first word, last word + 1, set of items) of each occurrence; words."""
        data = LOWER[chunk.data]
        start, end, row = word_spans(Chunk(chunk.lo, chunk.hi, data, chunk.offsets), ALNUM)
        n_words = np.bincount(row, minlength=chunk.rows)
        hits: list[tuple[int, int, int, int]] = []
        if self.least and len(start):
            hashes = RangeHash(data).of(start, end)
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            known = self.known[at] == hashes
            # only unbroken runs of item words, as long as the shortest window, can match
            border = np.flatnonzero(np.diff(row)) + 1
            cuts = np.union1d(np.union1d(np.flatnonzero(np.diff(known)) + 1, border), [0, len(known)]).astype(np.int64)
            first, last = cuts[:-1], cuts[1:]
            runs = known[first] & (last - first >= self.least)
            automaton = self.automaton
            nexts, link, length, marked, step, ending = automaton.next, automaton.link, automaton.length, automaton.marked, automaton.step, automaton.ending
            for a, b in zip(first[runs].tolist(), last[runs].tolist()):
                state = matched = 0
                for k, word in enumerate(self.numbers[at[a:b]].tolist(), a):
                    to = nexts[state].get(word)
                    if to is None:
                        state, matched = step(state, matched, word)
                    else:
                        state, matched = to, matched + 1
                    if marked[state] > 0:
                        for need, held in ending(state, matched):
                            hits.append((int(row[a]), k + 1 - need, k + 1, held))
        return n_words, hits, (start, end, row)


#: the matcher that a worker built last: its tasks share it
_built: dict[str, ItemMatcher] = {}


def _matcher(key: str, items: Broadcast, window: int) -> ItemMatcher:
    if key not in _built:
        _built.clear()
        _built[key] = ItemMatcher(items.value, window)
    return _built[key]


def window_filter(items: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """(bits of all windows' hashes, their lengths in words): a constant ``FILTER_BITS`` bits, built by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                codes, row = _word_codes(chunk)
                lengths = np.bincount(row, minlength=chunk.rows)
                need = np.minimum(lengths, window)[row]
                at = np.arange(len(row))
                whole = at + need <= np.cumsum(lengths)[row]
                places = RangeHash(codes).of(at[whole], at[whole] + need[whole]) % np.uint64(FILTER_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(need[whole])], ["place", "need"])

    places = cut(items.select("text").mapInArrow(run, "place long, need long"), "item-windows")
    lengths = sorted(row.need for row in places.select("need").distinct().collect())  # at most ``window`` of them
    blocks = places.select(F.bitmap_bucket_number(F.col("place") + 1).alias("block"), F.bitmap_bit_position(F.col("place") + 1).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, part in blocks.collect():  # FILTER_BITS in all
        bits[(block - 1) * 4096 : block * 4096] = np.frombuffer(part, np.uint8)[: max(0, len(bits) - (block - 1) * 4096)]
    return bits, lengths


def _word_codes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[chunk.data]
    start, end, row = word_spans(Chunk(chunk.lo, chunk.hi, data, chunk.offsets), ALNUM)
    return RangeHash(data).of(start, end), row


def possible_rows(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(row_key, doc_id, n_words, text): all rows, with the text of those alone that may hold a window of an item."""
    bits, lengths = window_filter(items, window)
    shared = docs.sparkSession.sparkContext.broadcast((bits.tobytes(), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for batch in batches:
            for chunk in chunks(batch, "text"):
                codes, row = _word_codes(chunk)
                hashes, possible = RangeHash(codes), np.zeros(chunk.rows, bool)
                for need in lengths:
                    at = np.arange(max(len(codes) - need + 1, 0))
                    at = at[row[at] == row[at + need - 1]]
                    place = (hashes.of(at, at + need) % np.uint64(FILTER_BITS)).astype(np.int64)
                    possible[row[at[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]]] = True
                part = batch.slice(chunk.lo, chunk.rows)
                texts = pc.if_else(pa.array(possible), part.column("text"), pa.scalar(None, part.column("text").type))
                yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("doc_id"), pa.array(np.bincount(row, minlength=chunk.rows)), texts], ["row_key", "doc_id", "n_words", "text"])

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, "row_key long, doc_id long, n_words long, text string")


def dealt_items(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(item_id, text, block) of the items with a text, and the number of blocks.

    Several blocks are dealt by hash, half full on average, so that each stays near its size.
    """
    known = items.selectExpr("item_id", "cast(text as string) text").filter("octet_length(text) > 0")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    return known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), int(blocks if total else 0)


def _items_of(dealt: DataFrame, block: int) -> list[tuple[object, str]]:
    """The items of one block, the only ones on the driver at that time."""
    return [(row.item_id, row.text) for row in dealt.filter(F.col("block") == block).toLocalIterator()]


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a span; the spans may nest, overlap and repeat."""
    change = np.zeros(n + 1, np.int64)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def _scan(docs: DataFrame, items: list[tuple[object, str]], window: int) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared, window)
        for batch in batches:
            for chunk in chunks(batch, "text"):
                n_words, hits, (_, _, row) = matcher.match(chunk)
                base = np.concatenate([[0], np.cumsum(n_words)])
                hit = _covered([(a, b) for _, a, b, _ in hits], len(row))
                border = np.append(True, row[1:] != row[:-1])[: len(row)]
                first = np.flatnonzero(hit & (border | ~np.append(False, hit)[:-1]))
                until = np.flatnonzero(hit & (np.append(border[1:], True)[: len(row)] | ~np.append(hit[1:], False)[: len(row)])) + 1
                spans: list[list[dict]] = [[] for _ in range(chunk.rows)]
                names: list[set[str]] = [set() for _ in range(chunk.rows)]
                sets = {(r, held) for r, _, _, held in hits}
                for r, a, b in zip(row[first].tolist(), first.tolist(), until.tolist()):
                    spans[r].append({"first": a - int(base[r]), "until": b - int(base[r])})
                for r, held in sets:
                    names[r].update(matcher.names[held])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_key").slice(chunk.lo, chunk.rows),
                        batch.column("doc_id").slice(chunk.lo, chunk.rows),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("until", pa.int64())]))),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                    ],
                    ["row_key", "doc_id", "n_words", "spans", "items"],
                )

    return docs.mapInArrow(run, "row_key long, doc_id long, n_words long, spans array<struct<first:long,until:long>>, items array<string>")


def _merge(spans: F.Column) -> F.Column:
    """Sorted spans joined where they touch or overlap."""
    kind = "array<struct<first:long,until:long>>"
    return F.aggregate(
        F.sort_array(spans),
        F.array().cast(kind),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["until"] >= x["first"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["until"], x["until"]).alias("until"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """The rows with numbers, written first, so that every pass sees the same ones."""
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed-documents")


def _found_by_block(source: DataFrame, dealt: DataFrame, blocks: int, window: int) -> DataFrame:
    """(row_key, spans, items) of the rows with hits; one block of items is fetched at a time."""
    union = None
    for block in range(blocks):
        found = _scan(source, _items_of(dealt, block), window).filter(F.size("spans") > 0).select("row_key", "spans", "items")
        part = cut(found, "block-hits")
        union = part if union is None else union.unionAll(part)
    return union.groupBy("row_key").agg(_merge(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit word spans, names of the items found, for each document row."""
    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    dealt, blocks = dealt_items(items, block_bytes)
    if blocks <= 1:
        found = _scan(source.selectExpr("0L row_key", "doc_id", "text"), _items_of(dealt, 0) if blocks else [], window)
    else:
        counted = cut(possible_rows(_keyed(source, "row_key"), items.selectExpr("cast(text as string) text"), window), "possible-documents")
        hits = _found_by_block(counted.filter("text is not null").select("row_key", "doc_id", "text"), dealt, blocks, window)
        counted = counted.select("row_key", "doc_id", "n_words")
        none = _scan(source.limit(0), [], window).schema
        found = counted.join(hits, "row_key", "left").select(
            "row_key", "doc_id", "n_words", *(F.coalesce(name, F.array().cast(none[name].dataType)).alias(name) for name in ("spans", "items"))
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["until"] - x["first"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("row_key")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, drop_contaminated: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without hit spans; those beyond the coverage limit go as a whole.

    Every hit word is cut with its surroundings up to the next kept word's start, so the kept
    text has no trace of the passage. Untouched texts stay byte for byte. With several blocks
    each scans the original texts; the limit and the cut apply once, to the spans of all.
    """
    dealt, blocks = dealt_items(items, block_bytes)
    if not blocks:
        return docs
    schema = docs.schema

    def clean(part: pa.RecordBatch, chunk: Chunk, n_words: np.ndarray, words: tuple[np.ndarray, ...], spans: list[tuple[int, int]]) -> pa.RecordBatch:
        if not spans:
            return part
        start, _, row = words
        place = part.schema.get_field_index("text")
        hit = _covered(spans, len(start))
        n_hit = np.bincount(row[hit], minlength=chunk.rows)
        keep = ~((n_hit > 0) & (20 * n_hit >= n_words)) if drop_contaminated else np.ones(chunk.rows, bool)
        texts = part.column(place).to_pylist()
        for r in np.flatnonzero(keep & (n_hit > 0)):
            alive = np.ones(int(chunk.offsets[r + 1] - chunk.offsets[r]), bool)
            mine = np.flatnonzero(row == r)
            for k in mine[hit[mine]]:
                until = start[k + 1] if k + 1 <= mine[-1] else chunk.offsets[r + 1]
                alive[start[k] - chunk.offsets[r] : until - chunk.offsets[r]] = False
            texts[r] = chunk.data[chunk.offsets[r] : chunk.offsets[r + 1]][alive].tobytes().decode()
        arrays = list(part.columns)
        arrays[place] = pa.array(texts, part.column(place).type)
        return pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array(keep))

    if blocks == 1:
        held, key = docs.sparkSession.sparkContext.broadcast(_items_of(dealt, 0)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, held, window)
            for batch in batches:
                for chunk in chunks(batch, "text"):
                    n_words, hits, words = matcher.match(chunk)
                    yield clean(batch.slice(chunk.lo, chunk.rows), chunk, n_words, words, [(a, b) for _, a, b, _ in hits])

        return docs.mapInArrow(run, schema)

    row_key, found_key, spans = (free_name(name, docs) for name in ("row_key", "found_key", "spans"))
    keyed = _keyed(docs, row_key)
    texts = keyed.select(F.col(row_key).alias("row_key"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    possible = cut(possible_rows(texts, items.selectExpr("cast(text as string) text"), window).filter("text is not null"), "possible-documents")
    found = _found_by_block(possible.select("row_key", "doc_id", "text"), dealt, blocks, window)
    found = found.select(F.col("row_key").alias(found_key), F.col("spans").alias(spans))

    def run_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(spans)
            for chunk in chunks(batch, "text"):
                part = batch.slice(chunk.lo, chunk.rows).select(schema.names)
                mine = found.slice(chunk.lo, chunk.rows).to_pylist()
                if not any(mine):
                    yield part
                    continue
                data = LOWER[chunk.data]
                words = word_spans(Chunk(chunk.lo, chunk.hi, data, chunk.offsets), ALNUM)
                n_words = np.bincount(words[2], minlength=chunk.rows)
                base = np.cumsum(n_words) - n_words
                yield clean(part, chunk, n_words, words, [(int(base[r]) + x["first"], int(base[r]) + x["until"]) for r, own in enumerate(mine) for x in own or ()])

    joined = keyed.join(found, F.col(row_key) == F.col(found_key), "left").select(*schema.names, spans)
    return joined.mapInArrow(run_merged, schema)


def digest_items(names: F.Column) -> F.Column:
    return F.sha2(F.array_join(names, ",").cast("binary"), 256)
