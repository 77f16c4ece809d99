"""Operator 2, SentencePiece encoding and decoding with byte offsets.

A text is normalised by longest-prefix lookups in the model's compiled character map, which
record for each normalised byte the source byte it came from; pieces are found on the
normalised text and projected back to byte spans of the source. The model's bytes (a fixed,
checked size) are broadcast; encoding is one Arrow pass without a shuffle.

Defined results: a null or empty text gives no pieces and decodes to the empty text; null
ids and repeated rows are kept row by row; extra columns pass through ``encode``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

SPACE = "▁"
MODEL_BYTES = 64_000_000


class CharacterMap:
    """The compiled character map: a double-array trie of prefixes with their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes | None]:
        """Length and replacement of the longest mapped prefix of ``text[at:]``; (0, None) if none."""
        if not self.units:
            return 0, None
        found = (0, None)
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)])
        return found


class Normaliser:
    """Longest-prefix normalisation that records source alignment."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.identity = not self.map.units and not self.squeeze and self.escape and self.prefix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte."""
        if self.identity:
            if not text:
                return "", np.zeros(1, np.int64)
            source = np.frombuffer(text.encode(), np.uint8)
            origin = np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1))
            return SPACE + text.replace(" ", SPACE), np.concatenate([[0, 0, 0], origin, [len(source)]])
        raw, out, origin = text.encode(), bytearray(), []
        space = SPACE.encode() if self.escape else b" "
        at, before_space = 0, self.squeeze
        while at < len(raw):
            length, new = self.map.longest(raw, at)
            if not length:
                length = 1 + sum(b & 0xC0 == 0x80 for b in raw[at + 1 : at + 4][: (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)])
                new = raw[at : at + length]
            for byte in new:
                if byte == 32:
                    if self.squeeze and before_space:
                        continue
                    out += space
                    origin += [at] * len(space)
                else:
                    out.append(byte)
                    origin.append(at)
                before_space = byte == 32
            at += length
        end = len(raw)
        if self.squeeze:
            while out.endswith(space):
                end = origin[len(out) - len(space)]
                del out[-len(space) :], origin[-len(space) :]
        if self.prefix and out:
            out[:0] = space
            origin[:0] = [origin[0]] * len(space)
        return out.decode(), np.array([*origin, end], np.int64)


class Encoder:
    """Encodes and decodes texts with one model; one per Python process."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalise = Normaliser(proto.normalizer_spec)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = np.array([p.type == 2 for p in proto.pieces])
        self.decimal = [str(k) for k in range(len(proto.pieces))]
        spec = proto.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids, and source alignment of the normalised bytes."""
        normal, origin = self.normalise(text)
        return (self.plain.encode(normal, return_type="numpy") if normal else np.zeros(0, np.int32)), origin

    def spans(self, text: str, ids: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte span of each piece."""
        sizes = self.bytes_of[ids]
        at = np.flatnonzero(self.unknown[ids])
        if len(at):  # an unknown piece is as long as what it stands for
            pieces = self.plain.encode(self.normalise(text)[0], return_type=str)
            sizes[at] = [len(pieces[k].encode()) for k in at]
        edges = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=edges[1:])
        places = origin[edges]
        return places[:-1], places[1:]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def _model(spark: SparkSession, path: str):
    """The model's bytes, read on the driver and broadcast; their size is checked."""
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model holds more than {MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(model)


def _texts(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows; a null is an empty text."""
    column = batch.column("text")
    lo, size, texts = 0, 0, []
    for k in range(len(column)):
        texts.append(column[k].as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield lo, texts
            lo, size, texts = k + 1, 0, []
    if texts:
        yield lo, texts


def encode(docs: DataFrame, model_path: str, spans: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``piece_ids`` and, if asked for, source byte spans."""
    held = _model(docs.sparkSession, model_path)
    built: list[Encoder] = []
    extra = ["piece_ids", *(["piece_begin", "piece_end"] if spans else [])]
    base = docs.drop(*extra)
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Encoder(held.value))
        coder = built[0]
        for batch in batches:
            for lo, texts in _texts(batch):
                columns: list[list] = [[] for _ in extra]
                for text in texts:
                    ids, origin = coder.encode(text)
                    found = (ids, *coder.spans(text, ids, origin)) if spans else (ids,)
                    for column, value in zip(columns, found):
                        column.append(value.astype(np.int32))
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(_packed, columns)], [*part.schema.names, *extra])

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the text of ``piece_ids`` (null: empty)."""
    held = _model(encoded.sparkSession, model_path)
    built: list[Encoder] = []
    base = encoded.drop("decoded")
    schema = T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Encoder(held.value))
        for batch in batches:
            texts = [built[0].decode(ids or []) for ids in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(run, schema)


def _packed(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))


def encode_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Round trip of every text inside one pass: counts, span check and digests.

    ``n_span_bytes`` is the number of source bytes that the pieces' spans cover; ``with_ids``
    adds the ids themselves.
    """
    held = _model(docs.sparkSession, model_path)
    built: list[Encoder] = []
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes", *(["piece_ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Encoder(held.value))
        coder = built[0]
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for lo, texts in _texts(batch):
                rows, kept = [], []
                for text in texts:
                    ids, origin = coder.encode(text)
                    begin, end = coder.spans(text, ids, origin)
                    if with_ids:
                        kept.append(ids)
                    ids = ids.tolist()
                    rows.append((len(ids), digest(",".join(map(coder.decimal.__getitem__, ids))), digest(coder.decode(ids)), int((end - begin).sum())))
                n, ids_sha, decoded_sha, covered = zip(*rows)
                columns = [batch.column("doc_id").slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha), pa.array(covered, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([_packed(kept)] if with_ids else [])], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long" + ", piece_ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
