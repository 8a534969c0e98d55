"""Encode texts word by word, asking the tokenizer once for each distinct word of a slice."""

from __future__ import annotations

import os
from collections.abc import Callable, Hashable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What a worker remembers across slices: words of so many characters at most, so many words and ids. About 60 MB.
KNOWN_LENGTH = 32
KNOWN_WORDS = 300_000
KNOWN_IDS = 8 * KNOWN_WORDS
CHUNK_WORDS = 4096  # words asked for at once; their results are turned into numbers before the next ones


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Token ids of lists of words, with a bounded memory of words across slices.

    ``encode_words`` gives the ids of each of a list of words (texts or bytes); the caller cuts texts only where the
    tokenizer's result for the whole text is the concatenation of its results for the parts. The memory changes speed,
    never ids: it holds at most ``limit`` words of ``KNOWN_LENGTH`` characters and ``KNOWN_IDS`` ids, and takes no others.
    """

    def __init__(self, encode_words: Callable[[list], Sequence[Sequence[int]]], limit: int = KNOWN_WORDS):
        self.encode_words, self.limit = encode_words, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[Hashable, int] = {}
        self.start, self.length = np.zeros(1024, dtype=np.int32), np.zeros(1024, dtype=np.int32)
        self.flat, self.used = np.zeros(4096, dtype=np.int32), 0

    def _ask(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of new words; only one chunk's result objects are alive at a time."""
        lengths, flat = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for begin in range(0, len(words), CHUNK_WORDS):
            found = self.encode_words(words[begin : begin + CHUNK_WORDS])
            lengths.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths[-1].sum())))
        return np.concatenate(lengths), np.concatenate(flat)

    def _remember(self, words: list, length: np.ndarray, flat: np.ndarray) -> None:
        fits = np.fromiter((len(w) <= KNOWN_LENGTH for w in words), dtype=bool, count=len(words))
        first, room = len(self.known), min(self.limit - len(self.known), KNOWN_WORDS)
        chosen = np.flatnonzero(fits)[: max(room, 0)]
        chosen = chosen[self.used + np.cumsum(length[chosen]) <= KNOWN_IDS]
        if not len(chosen):
            return
        sizes = length[chosen]
        own = flat[ranges((np.cumsum(length) - length)[chosen], sizes)]
        self.start, self.length = _room(self.start, first + len(chosen)), _room(self.length, first + len(chosen))
        self.flat = _room(self.flat, self.used + len(own))
        self.start[first : first + len(chosen)] = self.used + np.cumsum(sizes) - sizes
        self.length[first : first + len(chosen)] = sizes
        self.flat[self.used : self.used + len(own)] = own
        self.used += len(own)
        self.known.update(zip((words[i] for i in chosen.tolist()), range(first, first + len(chosen)), strict=True))

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order, and for each row (and the end) its first position there."""
        ids, ends = self.encode_flat(words.flatten())
        offsets = words.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def encode_flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and for each word (and the end) its first position there."""
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        where = np.fromiter(map(self.known.get, distinct, [-1] * len(distinct)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(where < 0)
        if len(self.known) >= self.limit and 2 * len(missing) > len(distinct):
            self.forget()  # other data than what filled the memory
            where[:], missing = -1, np.arange(len(distinct))
        new = [distinct[i] for i in missing.tolist()]
        del distinct
        new_length, new_flat = self._ask(new)
        hit = np.flatnonzero(where >= 0)
        length = np.empty(len(where), dtype=np.int64)
        length[hit], length[missing] = self.length[where[hit]], new_length
        start = np.cumsum(length) - length
        flat = np.empty(int(length.sum()), dtype=np.int32)
        flat[ranges(start[hit], length[hit])] = self.flat[ranges(self.start[where[hit]].astype(np.int64), length[hit])]
        flat[ranges(start[missing], new_length)] = new_flat
        self._remember(new, new_length, new_flat)
        word_length = length[codes]
        return flat[ranges(start[codes], word_length)], np.concatenate([[0], np.cumsum(word_length)])


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """The same numbers with room for ``size``, growing by doubling."""
    if size <= len(held):
        return held
    grown = np.zeros(max(size, 2 * len(held)), dtype=held.dtype)
    grown[: len(held)] = held
    return grown


@lru_cache(maxsize=4)
def bpe_word_encoder(path: str) -> WordEncoder:
    """Encoder of the ``tokenizers`` file at ``path``, one per worker process, in one thread: tasks share the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return WordEncoder(lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)])


@lru_cache(maxsize=4)
def folds_words(path: str) -> bool:
    """Whether the file's tokenizer lower-cases, drops white space and never joins a letter or digit with a stop mark.

    Then texts of Latin letters may be lower-cased and cut between a letter or digit and the marks after it.
    """
    import json

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    normal = [part.get("type") for part in (parts.get("normalizer") or {}).get("normalizers", [])]
    cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = cuts[0].get("pattern", {}).get("Regex", "") if cuts and cuts[0].get("type") == "Split" else ""
    return "Lowercase" in normal and r"[\p{L}]+" in pattern.split("|") and r"[^\s\p{L}\p{N}]+" in pattern.split("|")


# Rows with other letters (or marks that could combine with a letter), or what may be the name of a special token, are
# cut at white space only.
ODD_TEXT = r"<\||[^\x00-\x{24F}]"
MARK_AFTER_LETTER = "([a-z0-9À-ÖØ-öø-ÿ])([.,;:!?])"


def split_at_spaces(texts: pa.Array) -> pa.ListArray:
    """Cut at blanks and line feeds, where tokenizers that drop white space never join two parts."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def split_words(texts: pa.Array) -> pa.ListArray:
    """As ``split_at_spaces``, with Latin texts lower-cased and cut before stop marks: fewer distinct words."""
    folded = pc.replace_substring_regex(pc.ascii_lower(texts), MARK_AFTER_LETTER, r"\1 \2")
    return split_at_spaces(pc.if_else(pc.match_substring_regex(texts, ODD_TEXT), texts, folded))


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (null: empty) and the first position of each row, for a tokenizer that drops white space."""
    split = split_words if folds_words(path) else split_at_spaces
    return bpe_word_encoder(path).encode(split(pc.fill_null(texts, "")))
