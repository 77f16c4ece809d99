"""Operator 10, quality rules: line-first cleaning.

Every line of a text is judged on its own, by features that need no language:

* punctuation: too many symbols, too few letters and digits, or cut off by an ellipsis;
* navigation: separators between few words, link-like words, or a run of short lines of which
  none ends like a sentence;
* boilerplate: phrases of page furniture in a short line, or a short line that the document
  repeats again and again.

Failing lines go; a document that loses too much of its text, or that fails the document rules,
is rejected. One Arrow pass, no shuffle; memory is bounded by one text chunk.

Defined results: a null or empty text has no words, no lines with a word, and fails for
having too few words; a null id is kept as null; repeated rows are judged row by row;
extra columns are passed through by ``clean_documents`` and ignored by ``judge``; an empty
table gives an empty result; ties can't occur, since each limit is exact; a very long text is
judged in one piece, with about 100 bytes of memory for each of its bytes. Ids must be integers,
or texts of such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from collinea.llm.common import NOT_SPACE, RangeHash, chunks, word_spans


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; a share is given in percent."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: punctuation: symbols among the non-space characters of a line
    max_symbol_percent: int = 8
    #: navigation: separators a line may hold for each ten words
    max_separators_per_ten_words: int = 3
    min_separators: int = 3
    #: punctuation: the least share of letters and digits among the non-space characters
    min_letter_percent: int = 40
    #: punctuation: the most words of a line that an ellipsis cuts off
    max_ellipsis_words: int = 12
    #: navigation: the least share of words that are addresses
    min_link_percent: int = 50
    #: navigation: so many lines in a row, of so few words each, none ending like a sentence
    run_lines: int = 4
    run_words: int = 3
    #: boilerplate: a line of so few words that occurs so often in the document
    often_lines: int = 4
    often_words: int = 10
    #: a document that loses more of its non-space characters than this is rejected
    max_lost_percent: int = 50


#: fixed values: phrases of page furniture, lower case
BOILERPLATE = re.compile(
    rb"javascript is (?:required|disabled)|enable javascript|enable cookies|we use cookies|accept (?:all )?cookies|cookie policy"
    rb"|all rights reserved|terms of (?:use|service)|privacy policy|sign up for our newsletter|subscribe to our newsletter"
    rb"|log in to (?:comment|reply)|click here to|skip to (?:main )?content|share (?:this )?on (?:facebook|twitter)|lorem ipsum"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[np.frombuffer(b"|>\\", np.uint8)] = True
_LETTER = np.zeros(256, bool)  # a first byte of a letter, a digit or any code point beyond ASCII
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:] = True
#: fixed values: ends of sentences, ends that cut a line off, beginnings of addresses
SENTENCE_ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "\u2026".encode(), "\u3002".encode(), "\uff01".encode(), "\uff1f".encode(), "\u201d".encode(), "\u2019".encode(), "\u00bb".encode())
ELLIPSES = (b"...", "\u2026".encode())
ADDRESS = re.compile(rb"https?://|www\.")
_POINT = np.ones(256, bool)  # the first byte of a code point
_POINT[0x80:0xC0] = False

VERDICT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_failed_lines long, lost_percent double, kept boolean"


def _sums(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[hi] - total[lo]


def _lines(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every line; a row without bytes has one empty line."""
    breaks = np.flatnonzero(chunk.data == 10)
    row_of_break = np.searchsorted(chunk.offsets, breaks, "right") - 1
    starts = np.concatenate([chunk.offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(chunk.rows), row_of_break])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.concatenate([starts[1:] - 1, chunk.offsets[-1:]])
    last = np.append(rows[1:] != rows[:-1], True)
    ends[last] = chunk.offsets[rows[last] + 1]
    return starts, ends, rows


def _ending(data: np.ndarray, first: np.ndarray, end: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """Whether the bytes up to each end, from ``first`` on, end with one of the marks."""
    found = np.zeros(len(end), bool)
    for mark in marks:
        fits = end - first >= len(mark)
        for k, byte in enumerate(mark):
            fits &= data[np.maximum(end - len(mark) + k, 0)] == byte if len(data) else False
        found |= fits
    return found


def _in_runs(short: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Which entries stand in a run of at least ``least`` marked entries of one row."""
    if not len(short):
        return short
    run = np.cumsum(np.append(True, (short[1:] != short[:-1]) | (row[1:] != row[:-1]))) - 1
    return short & (np.bincount(run)[run] >= least)


def judge_chunk(chunk, rules: QualityRules) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """The measures of each row, and its lines as (start, end, row, failed)."""
    n, lo, hi = chunk.rows, chunk.offsets[:-1], chunk.offsets[1:]
    inside = NOT_SPACE[chunk.data]
    w_start, w_end, w_row = word_spans(chunk, NOT_SPACE)
    n_words = np.bincount(w_row, minlength=n)
    points = _POINT[chunk.data] & inside
    symbols = _SYMBOL[chunk.data]
    hashes = RangeHash(chunk.data)

    l_start, l_end, l_row = _lines(chunk)
    total_words = np.searchsorted(w_start, l_end) - np.searchsorted(w_start, l_start)
    l_hash = hashes.of(l_start, l_end)
    by_hash = np.lexsort((l_start, l_hash, l_row))
    again = np.zeros(len(by_hash), bool)
    again[1:] = (l_hash[by_hash][1:] == l_hash[by_hash][:-1]) & (l_row[by_hash][1:] == l_row[by_hash][:-1])
    dup = np.zeros(len(by_hash), bool)
    dup[by_hash] = again
    dup &= total_words > 0

    word_hash = hashes.of(w_start, w_end)
    repeat = np.zeros(len(w_start) + 1, np.int64)
    if len(w_start) > 2:
        at = np.flatnonzero(w_row[2:] == w_row[:-2])
        window = word_hash[at] * np.uint64(0x9E3779B97F4A7C15) + (word_hash[at + 1] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD1342543DE82EF95) + word_hash[at + 2]
        order = np.lexsort((window, w_row[at]))
        same = (window[order][1:] == window[order][:-1]) & (w_row[at][order][1:] == w_row[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(repeat, at[twice], 1)
        np.add.at(repeat, at[twice] + 3, -1)
    covered = np.cumsum(repeat[:-1]) > 0
    n_repeat = np.bincount(w_row[covered], minlength=n)

    l_points = _sums(points, l_start, l_end)
    l_symbols = _sums(symbols, l_start, l_end)
    l_separators = _sums(_SEPARATOR[chunk.data], l_start, l_end)
    failed = 100 * l_symbols > rules.max_symbol_percent * np.maximum(l_points, 1)
    failed |= (l_separators >= rules.min_separators) & (10 * l_separators > rules.max_separators_per_ten_words * np.maximum(total_words, 1))
    failed |= 100 * _sums(_LETTER[chunk.data], l_start, l_end) < rules.min_letter_percent * l_points
    # from the first byte of the first word to the end of the last one
    word_from, word_to = np.searchsorted(w_start, l_start), np.searchsorted(w_start, l_end)
    filled = np.flatnonzero(word_to > word_from)
    first, last = np.zeros(len(l_start), np.int64), np.zeros(len(l_start), np.int64)
    first[filled], last[filled] = w_start[word_from[filled]], w_end[word_to[filled] - 1]
    failed |= (total_words <= rules.max_ellipsis_words) & _ending(chunk.data, first, last, ELLIPSES)
    raw = chunk.data.tobytes()
    addresses = np.intersect1d(np.array([m.start() for m in ADDRESS.finditer(raw)], np.int64), w_start)  # at a word's beginning
    links = np.bincount(np.searchsorted(l_start, addresses, "right") - 1, minlength=len(l_start))
    failed |= (links > 0) & (100 * links >= rules.min_link_percent * total_words)
    short = (total_words[filled] <= rules.run_words) & ~_ending(chunk.data, first[filled], last[filled], SENTENCE_ENDS)
    failed[filled] |= _in_runs(short, l_row[filled], rules.run_lines)
    same = np.append(True, (l_hash[by_hash][1:] != l_hash[by_hash][:-1]) | (l_row[by_hash][1:] != l_row[by_hash][:-1]))[: len(by_hash)]
    often = np.zeros(len(l_start), np.int64)
    often[by_hash] = np.bincount(np.cumsum(same) - 1)[np.cumsum(same) - 1] if len(by_hash) else 0
    failed |= (often >= rules.often_lines) & (total_words <= rules.often_words)
    for found in BOILERPLATE.finditer(raw.lower()):
        k = int(np.searchsorted(l_start, found.start(), "right")) - 1
        if found.end() <= l_end[k] and total_words[k] <= 30:  # furniture, not prose that names it
            failed[k] = True
    failed &= total_words > 0
    word_chars = _sums(points, lo, hi)
    lost = np.bincount(l_row, weights=l_points * failed, minlength=n)
    lost_percent = 100.0 * lost / np.maximum(word_chars, 1)
    base = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _sums(symbols, lo, hi),
        "n_dup_lines": np.bincount(l_row[dup], minlength=n),
        "n_repeat_words": n_repeat,
        "base_failed": base,
        "n_lines": np.bincount(l_row[total_words > 0], minlength=n),
        "n_failed_lines": np.bincount(l_row[failed], minlength=n),
        "lost_percent": lost_percent,
        "kept": ~base & (lost_percent <= rules.max_lost_percent),
    }, (l_start, l_end, l_row, failed)


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row of measures and verdicts for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                found, _ = judge_chunk(chunk, rules)
                ids = batch.column("doc_id").slice(chunk.lo, chunk.rows)
                arrays = [ids] + [pa.array(v if v.dtype in (bool, float) else v.astype(np.int64)) for v in found.values()]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *found])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, VERDICT_SCHEMA)


def clean_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The kept documents, all their columns, with the failing lines cut from the text."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for chunk in chunks(batch, "text"):
                found, (start, end, row, failed) = judge_chunk(chunk, rules)
                part = batch.slice(chunk.lo, chunk.rows)
                texts = part.column(place).to_pylist()
                raw = chunk.data.tobytes()
                for k in np.unique(row[failed]):
                    mine = np.flatnonzero((row == k) & ~failed)
                    texts[k] = b"\n".join(raw[start[i] : end[i]] for i in mine).decode()
                arrays = list(part.columns)
                arrays[place] = pa.array(texts, part.column(place).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, schema)
