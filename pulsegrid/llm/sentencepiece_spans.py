"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for.

The normaliser replaces the longest matching prefix through the model's compiled character map (a double-array trie
over byte strings, followed by the replacements) and records where each normalised byte came from. A piece's place in
the normalised text then gives its span in the original.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices
from pulsegrid.llm.word_cache import WordEncoder

SPACE = "▁".encode()  # how a blank is written in pieces
BYTE_PIECE = 6  # type number of byte pieces in the model file


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement through a compiled map; empty map: every character stands for itself."""

    def __init__(self, compiled: bytes = b""):
        self.units, self.texts = None, b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled[4 : 4 + size], dtype="<u4").tolist()
            self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for n in range(at, len(data)):
            node ^= data[n]
            unit = units[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:  # a key ends here
                found = n + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normalizer:
    """Normalised bytes of a text and, for each of them and the end, the original byte it comes from."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))
        self.plain = self.map.units is None and not self.trim and self.escape

    def align(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        return self._align_plain(data) if self.plain else self._align_mapped(data)

    def _align_plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(data, dtype=np.uint8)
        width = np.where(raw == 0x20, 3, 1)
        places = np.repeat(np.arange(len(raw)), width)
        prefix = SPACE if self.dummy_prefix else b""
        text = prefix + data.replace(b" ", SPACE)
        return text, np.concatenate([np.zeros(len(prefix), dtype=np.int64), places, [len(raw)]])

    def _align_mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts, at = [], 0  # (start, end, replacement) of each prefix
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units is not None else None
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, data[at : at + size]
            parts.append((at, at + hit[0], hit[1]))
            at += hit[0]
        if self.trim:
            while parts and not parts[0][2].strip(b" "):
                parts.pop(0)
        if not parts:
            return b"", np.array([len(data)])
        blank = SPACE if self.escape else b" "
        text, places = bytearray(), []
        if self.dummy_prefix:
            text += blank
            places += [parts[0][0]] * len(blank)
        after_blank = self.trim
        for start, end, new in parts:
            while after_blank and new.startswith(b" "):
                new = new[1:]
            if new:
                written = new.replace(b" ", blank)
                text += written
                places += [start] * len(written)
                after_blank = self.trim and new.endswith(b" ")
        if self.trim:
            while text.endswith(blank):
                del text[-len(blank) :]
                last = places[-len(blank)]
                del places[-len(blank) :]
                parts.append((last, last, b""))
        return bytes(text), np.array([*places, parts[-1][1]])


class SpanEncoder:
    """Ids exactly as the sentencepiece library's, and the original byte span of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.normalizer = Normalizer(next((v for k, v in fields if k == 3), b""))
        pieces = [dict(_fields(v)) for k, v in fields if k == 1]
        self.width = np.array([1 if p.get(3, 1) == BYTE_PIECE else len(p.get(1, b"")) for p in pieces], dtype=np.int64)
        self.unknown = next((n for n, p in enumerate(pieces) if p.get(3, 1) == 2), None)
        joined = [p.get(1, b"").decode() for p in pieces]
        # Cutting before a blank is exact only if no piece reaches over such a place.
        self.by_word = self.normalizer.plain and self.normalizer.dummy_prefix and not any(
            b == "▁" != a for piece in joined for a, b in zip(piece, piece[1:], strict=False)
        )
        self.words = WordEncoder(lambda words: self.processor.encode(words, num_threads=1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the first position of each row."""
        parts = pc.split_pattern(texts, " ")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "▁"))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        if not self.by_word or pc.any(odd).as_py():  # such rows are one word each
            whole = np.ones(len(texts), dtype=bool) if not self.by_word else odd.to_numpy(zero_copy_only=False)
            parts = pa.array([[t] if w else p for t, w, p in zip(texts.to_pylist(), whole, parts.to_pylist(), strict=True)], pa.list_(pa.string()))
        return self.words.encode(parts)

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end byte of the original text for each id of a text."""
        text, places = self.normalizer.align(data)
        if self.unknown is not None and (ids == self.unknown).any():  # an unknown id has no width of its own
            proto = self.processor.encode(data.decode(), return_type="proto")
            width = np.array([len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        else:
            width = self.width[ids]
        ends = np.cumsum(width)
        if len(ids) and int(ends[-1]) != len(text):
            raise ValueError("pieces do not cover the normalised text")
        return places[ends - width], places[ends]


@lru_cache(maxsize=4)
def span_encoder(path: str) -> SpanEncoder:
    """One per worker process."""
    return SpanEncoder(path)


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(model)
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            ids, starts = encoder.encode(texts)
            begins, ends = np.empty_like(ids), np.empty_like(ids)
            for n, text in enumerate(texts.to_pylist()):
                own = slice(starts[n], starts[n + 1])
                begins[own], ends[own] = encoder.spans(text.encode(), ids[own])
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "ids", "begins", "ends"])

    return run


def _digest(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(model)
        names = [str(n) for n in range(encoder.processor.get_piece_size())]
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [encoder.processor.decode(x) for x in lists]
            covered, gaps = [], []
            for begins, ends in zip(batch.column("begins"), batch.column("ends"), strict=True):
                b, e = begins.values.to_numpy(), ends.values.to_numpy()
                covered.append(int(e[-1]) if len(e) else 0)
                gaps.append(int((b[1:] != e[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in lists], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array(covered, pa.int64()),
                    pa.array(gaps, pa.int64()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "span_gaps"],
            )

    return run


def _run(docs: DataFrame, id_col: str, text_col: str, run, columns: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, {columns}").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids, begins, ends of every row: token ids and the UTF-8 byte span of each in the original text.

    Whole texts, without begin or end ids. A null or empty text gives empty arrays; repeated rows repeat; other columns
    are ignored. Texts are taken in slices of a few megabytes; a longer text has a slice alone. No shuffle.
    """
    return _run(docs, id_col, text_col, _encode(model), "ids array<int>, begins array<int>, ends array<int>")


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``encode_documents`` gives, as checksums: n_tokens, ids_sha256, decoded_sha256, covered_bytes, span_gaps.

    The ids are decoded again in the same task. ``covered_bytes`` is the last original byte that a span reaches;
    ``span_gaps`` counts spans that do not begin where the one before ended (byte pieces of one character share no bytes).
    """
    encode, digest = _encode(model), _digest(model)
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, span_gaps long"
    return _run(docs, id_col, text_col, lambda batches: digest(encode(batches)), columns)
