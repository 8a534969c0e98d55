"""Byte-level BPE: a segment tree over byte positions finds the leftmost pair of least rank, merge by merge.

Texts are cut into matches of the public pattern (contractions, letters, numbers, other signs, white space). Each match
starts as its bytes. Leaf i of its tree holds the rank of the pair that starts at byte i, with i as the lower digits, so
the root names the leftmost pair of least rank. A merge writes the new token at its left position, takes the right one
out of the list of live neighbours, and updates three leaves (the merged pair, the dead one, the pair before) on their
paths to the root: logarithmic work a merge. Short matches of one tree size are merged side by side in numpy; a long
one alone in plain numbers, so a match of a million letters is a million times some twenty steps, not their square.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices
from pulsegrid.llm.word_cache import WordEncoder, ranges

# The pattern whose matches are encoded separately; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 2 * 1024 * 1024
SIDE_BY_SIDE = 64  # matches of up to so many bytes are merged together with others of their tree size
NONE = np.iinfo(np.int64).max  # a leaf without a pair
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


class Ranks:
    """Tokens of a rank file and the pairs that merge: (left, right) to the rank of the joined bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        absent = [b for b in range(256) if bytes([b]) not in self.rank]
        if absent:
            raise ValueError(f"the rank file has no token for {len(absent)} of the 256 bytes")
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bytes, self.begin, self.size = self._token_bytes()

    def _token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens in a row, with the place and length of each rank."""
        size = np.zeros(max(self.rank.values()) + 1, dtype=np.int64)
        by_rank = sorted(self.rank, key=self.rank.get)
        size[[self.rank[t] for t in by_rank]] = [len(t) for t in by_rank]
        return np.frombuffer(b"".join(by_rank), dtype=np.uint8), np.cumsum(size) - size, size

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of joined pairs; NONE where a pair is no token."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each match. A match that is a token as a whole is that token."""
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            whole = self.rank.get(word)
            if whole is not None:
                out[n] = [whole]
            elif not word:
                out[n] = []
            elif len(word) <= SIDE_BY_SIDE:
                groups.setdefault((len(word) - 1).bit_length(), []).append(n)
            else:
                out[n] = merge_alone(self, word)
        for depth, own in groups.items():
            for n, ids in zip(own, merge_together(self, [words[n] for n in own], depth), strict=True):
                out[n] = ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids in a row, and the first byte of each id (and the end)."""
        size = self.size[ids]
        return self.bytes[ranges(self.begin[ids], size)], np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_alone(ranks: Ranks, word: bytes) -> list[int]:
    """Token ids of one match of at least two bytes."""
    n = len(word)
    depth = (n - 1).bit_length()
    leaves, low, pairs = 1 << depth, (1 << depth) - 1, ranks.pairs
    ids = array("q", ranks.of_byte[np.frombuffer(word, dtype=np.uint8)].tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    first = ranks.of_pairs(np.frombuffer(ids, dtype=np.int64)[:-1], np.frombuffer(ids, dtype=np.int64)[1:])
    levels = np.full(2 * leaves, NONE, dtype=np.int64)
    place = np.arange(n - 1)
    levels[leaves : leaves + n - 1] = np.where(first == NONE, NONE, (np.where(first == NONE, 0, first) << depth) | place)
    for level in range(depth - 1, -1, -1):
        width = 1 << level
        levels[width : 2 * width] = np.minimum(levels[2 * width : 4 * width : 2], levels[2 * width + 1 : 4 * width : 2])
    tree, none = array("q", levels.tobytes()), int(NONE)

    def put(position: int, value: int) -> None:
        node = leaves + position
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            value = other if other < value else value
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    def pair(left: int) -> int:
        right = after[left]
        rank = pairs.get((ids[left] << 32) | ids[right]) if right < n else None
        return none if rank is None else (rank << depth) | left

    while tree[1] != none:
        position = tree[1] & low
        ids[position] = tree[1] >> depth
        gone = after[position]
        after[position] = beyond = after[gone]
        ids[gone] = -1
        if beyond < n:
            before[beyond] = position
        put(gone, none)
        put(position, pair(position))
        if before[position] >= 0:
            put(before[position], pair(before[position]))
    return [token for token in ids if token >= 0]


def merge_together(ranks: Ranks, words: list[bytes], depth: int) -> list[list[int]]:
    """Token ids of matches whose trees have ``2 ** depth`` leaves; each step merges one pair of every open match.

    All trees are columns of one table: row v holds node v of each (the root is 1, leaf i is row ``leaves + i``).
    """
    many, leaves = len(words), 1 << depth
    size = np.fromiter(map(len, words), dtype=np.int64, count=many)
    ids = np.full((many, leaves + 1), -1, dtype=np.int64)
    inside = np.arange(leaves + 1) < size[:, None]
    ids[inside] = ranks.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    after = np.tile(np.arange(1, leaves + 2), (many, 1))
    before = np.tile(np.arange(-1, leaves), (many, 1))
    tree = np.full((2 * leaves, many), NONE, dtype=np.int64)
    row, left = np.nonzero(inside[:, 1:])  # a pair starts at every byte but the last
    found = ranks.of_pairs(ids[row, left], ids[row, left + 1])
    known = found != NONE
    tree[leaves + left[known], row[known]] = (found[known] << depth) | left[known]
    for level in range(depth - 1, -1, -1):
        width = 1 << level
        tree[width : 2 * width] = np.minimum(tree[2 * width : 4 * width : 2], tree[2 * width + 1 : 4 * width : 2])

    def put(column: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
        node = leaves + position
        tree[node, column] = value
        while node[0] > 1:  # all nodes are on one level
            value = np.minimum(value, tree[node ^ 1, column])
            node = node >> 1
            tree[node, column] = value

    def pair(column: np.ndarray, position: np.ndarray) -> np.ndarray:
        right = after[column, position]
        inner = right < size[column]
        rank = np.full(len(column), NONE)
        rank[inner] = ranks.of_pairs(ids[column[inner], position[inner]], ids[column[inner], right[inner]])
        return np.where(rank == NONE, NONE, (np.where(rank == NONE, 0, rank) << depth) | position)

    column = np.flatnonzero(tree[1] != NONE)
    while len(column):
        root = tree[1, column]
        position = root & (leaves - 1)
        ids[column, position] = root >> depth
        gone = after[column, position]
        beyond = after[column, gone]
        after[column, position] = beyond
        ids[column, gone] = -1
        before[column, np.minimum(beyond, leaves)] = position
        put(column, gone, np.full(len(column), NONE))
        put(column, position, pair(column, position))
        earlier = before[column, position]
        has = earlier >= 0
        if has.any():
            put(column[has], earlier[has], pair(column[has], earlier[has]))
        column = column[tree[1, column] != NONE]
    live = ids >= 0
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point, asked from the tiktoken library, whose tables decide where texts are cut."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        library = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        matched = bytes(library.encode_ordinary(everything)).decode()
        classes[np.frombuffer(matched.encode("utf-32-le"), dtype="<u4")] = kind
    return classes


def match_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Which characters begin a match of ``PATTERN``, for texts that lie one after another.

    A run of one class is a match, but for three rules: of white space before something else, the last character stands
    alone, or belongs to what follows if it is a blank; an apostrophe that begins a match takes the letters of a
    contraction from the run after it; and the rest of that run is a match of its own.
    """
    n = len(points)
    kind = character_classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[text_starts] = True
    first[n] = True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    last_blank = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    starts[last_blank] = True
    starts[last_blank[points[last_blank] == ord(" ")] + 1] = False
    mark = np.flatnonzero(starts[:-1] & (points[:-1] == ord("'")) & (kind[1:] == LETTER) & ~first[1:n])
    one = points[mark + 1]
    second = np.minimum(mark + 2, n - 1)
    two = np.where((mark + 2 < n) & ~first[mark + 2], points[second], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(mark), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    for chosen, letters in ((short, 1), (long, 2)):
        begin = mark[chosen]
        starts[begin + 1] = False
        starts[begin[begin + letters + 1 < n] + letters + 1] = True
    return starts


def cut_matches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All matches of a column of texts as bytes, and the first match of each text (and the end)."""
    size = np.array([len(t) for t in texts.to_pylist()], dtype=np.int64)
    data = b"".join(t.encode() for t in texts.to_pylist())
    points = np.frombuffer(data.decode().encode("utf-32-le"), dtype="<u4")
    bounds = np.concatenate([[0], np.cumsum(size)])
    if not len(points):
        return pa.array([], pa.large_binary()), np.zeros(len(size) + 1, dtype=np.int64)
    at = np.flatnonzero(match_starts(points, bounds[:-1][size > 0]))
    raw = np.frombuffer(data, dtype=np.uint8)
    byte_of = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
    offsets = np.append(byte_of[at], len(data)).astype(np.int64)
    matches = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return matches, np.searchsorted(at, bounds)


@lru_cache(maxsize=4)
def match_encoder(path: str) -> WordEncoder:
    return WordEncoder(load_ranks(path).encode)


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts and the first position of each row (and the end)."""
    matches, rows = cut_matches(texts)
    ids, ends = match_encoder(path).encode_flat(matches)
    return ids, ends[rows]


def encode_documents(
    docs: DataFrame, ranks_path: str, text_col: str = "text", prefix: str = "", with_ids: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """Adds [ids], n_tokens, ids_sha256 and decoded_sha256 to every row, their names led by ``prefix``.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit numbers, ``decoded_sha256`` of the bytes that the ids
    stand for. Whole texts are encoded in their own tasks, without a shuffle; nothing is kept between tasks. A null or
    empty text has no ids. Repeated rows are encoded alike, an empty table stays empty. The columns of ``keep`` (default:
    all) are kept; one that has a new column's name is replaced (choose a ``prefix`` to keep it). A slice of texts has about two megabytes or
    is one longer text; a match without a break needs about thirty times its size.
    """
    added = [f"{prefix}{name}" for name in (["ids"] if with_ids else []) + ["n_tokens", "ids_sha256", "decoded_sha256"]]
    kinds = (["array<int>"] if with_ids else []) + ["long", "string", "string"]
    kept = [name for name in (docs.columns if keep is None else keep) if name not in added]
    text = f"{prefix}__text"
    while text in docs.columns:
        text += "_"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields), *(f"`{n}` {k}" for n, k in zip(added, kinds, strict=True))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        for batch in slices(batches, text, SLICE_BYTES):
            ids, starts = encode_texts(ranks_path, batch.column(text))
            data, places = ranks.decode(ids)
            bounds = places[starts]
            words = ids.astype("<u4")
            columns = [batch.column(name) for name in kept]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))
            columns.append(pa.array(np.diff(starts), pa.int64()))
            columns.append(pa.array([hashlib.sha256(words[a:b]).hexdigest() for a, b in zip(starts, starts[1:], strict=False)]))
            columns.append(pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return docs.select(*kept, F.coalesce(text_col, F.lit("")).alias(text)).mapInArrow(encode, schema)


def decode_ids(rows: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Replaces or adds ``text_col``: the bytes that the ids stand for, as binary. Null ids give null."""
    kept = [name for name in rows.columns if name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields), f"`{text_col}` binary"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        for batch in batches:
            found = [None if ids is None else ranks.decode(np.array(ids, dtype=np.int64))[0].tobytes() for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, pa.binary())], names=[*kept, text_col])

    return rows.select(*kept).mapInArrow(decode, schema)
