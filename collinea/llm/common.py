"""Byte-level text helpers for the Arrow side, and the shared folder for cut lineage.

Python tasks receive Arrow batches; the helpers below walk a string column as one byte
buffer with numpy, a few megabytes at a time, so a batch of very long texts never needs
memory beyond one chunk (or one single text).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2_000_000

# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint directory.

    Only where the session names none (tests, a laptop) one is set, under the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext.getCheckpointDir()
        found = context or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return the reread table.

    The written files replace the lineage: a lost executor costs a reread, not a rerun.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/collinea/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(wanted: str, *tables: DataFrame) -> str:
    """``wanted``, or a longer name, that no column of the tables has (in any case of letters)."""
    taken = {name.lower() for table in tables for name in table.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


# ---------------------------------------------------------------- Arrow chunks


@dataclass
class Chunk:
    """Rows ``lo:hi`` of a batch with their texts as one byte buffer."""

    lo: int
    hi: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, hi - lo + 1 entries, offsets[0] == 0

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a batch into runs of rows of at most ``most`` text bytes, one row at least."""
    data, offsets = string_buffer(batch.column(column))
    lo, n = 0, len(batch)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        part = data[offsets[lo] : offsets[hi]]
        yield Chunk(lo, hi, part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


# ---------------------------------------------------------------- words and hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words between white space
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: bytes of words made of letters and digits (after lower-casing) and all non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def word_spans(chunk: Chunk, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of member bytes; runs end at row borders."""
    if not len(chunk.data):
        return (np.zeros(0, np.int64),) * 3
    inside = np.empty(len(chunk.data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = member[chunk.data]
    change = inside[1:] != inside[:-1]
    start = np.flatnonzero(change & inside[1:])
    end = np.flatnonzero(change & inside[:-1])
    border = chunk.offsets[1:-1]
    border = np.unique(border[(border > 0) & (border < len(chunk.data))])
    border = border[inside[border] & inside[border + 1]]  # a run crosses this row border
    if len(border):
        start, end = np.sort(np.concatenate([start, border])), np.sort(np.concatenate([end, border]))
    return start, end, np.searchsorted(chunk.offsets, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, kept per process."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = _power_table(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        codes = _BYTE_VALUES[values] if values.dtype == np.uint8 else mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def segment_index(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): owners (0 0 2 2 2) and places inside (0 1 0 1 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner]
