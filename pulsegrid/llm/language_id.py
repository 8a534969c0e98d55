"""Language identification with Bloom filters whose slots are language bitmasks.

Character 3-grams are counted per language over all training texts. A gram belongs to every language that has it, unless
it is so much rarer there than elsewhere that wrong labels explain it. All languages share one Bloom filter: a slot holds
one bit per language, and the AND of a gram's slots is the set of languages that contain it. Each language's hits over a
text, less the hits its own filter density would give by chance, decide. Where a script has thousands of letters, nearly
every 3-gram is rare, so there a letter alone is the gram.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import mix64, slices

UNKNOWN = "und"
HASHES = 3
# A gram counts for a language from this share of the language's grams on, so a language has at most 1 / MIN_SHARE.
MIN_SHARE = 1e-5
# Up to this part of a gram's largest share it may come from texts with a wrong label.
NOISE = 0.02
# Added to a language's grams when shares are compared: a label with a few texts has no grams of a large share.
SMOOTHING = 1 / MIN_SHARE
SLOTS_PER_GRAM = 16
BLANK = 0x20
# Scripts with thousands of letters: Han, Yi, Hangul, cuneiform, hieroglyphs, Tangut and Khitan, the Han supplements.
LARGE_SCRIPTS = ((0x3400, 0x4DBF), (0x4E00, 0xA48F), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0x12000, 0x1467F), (0x17000, 0x18DFF), (0x20000, 0x3FFFF))
TEXT_BYTES = 1024 * 1024  # of a slice; its grams take about fifty times as much


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or a blank where it is no letter."""
    table = np.full(sys.maxunicode + 1, BLANK, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        letter = chr(point)
        if letter.isalpha():
            lower = letter.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


@lru_cache(maxsize=1)
def _large_scripts() -> np.ndarray:
    """For each code point whether its script has thousands of letters."""
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for first, last in LARGE_SCRIPTS:
        table[first : last + 1] = True
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """3-grams of letters and single blanks: the grams, the row of each, and which rows have a letter.

    A letter of a large script is a gram by itself and a blank to its neighbours.
    """
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts) + 1), np.array([1, *(len(t) + 1 for t in texts)]))  # a row's blank comes after it
    folded = _folding()[points]
    blank = folded == BLANK
    lettered = np.bincount(rows[~blank], minlength=len(texts) + 1)[1:] > 0
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    letters, rows = folded[keep].astype(np.uint64), rows[keep]
    if len(letters) < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), lettered
    large = _large_scripts()[letters]
    around = np.where(large, np.uint64(BLANK), letters) if large.any() else letters
    found = (around[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | around[2:]
    np.copyto(found, letters[1:-1], where=large[1:-1])
    inside = letters[1:-1] != BLANK  # grams with a blank in the middle would join words, and texts
    return found[inside], rows[1:-1][inside] - 1, lettered


@dataclass(frozen=True)
class LanguageFilters:
    """``slots``: one row of language bits (eight to a byte) per slot; ``chance``: false positive rate per language.

    ``usual``: known share of each language's own training texts, taken together.
    """

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    usual: np.ndarray

    def places(self, found: np.ndarray) -> Iterator[np.ndarray]:
        mixed = mix64(found)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                yield ((mixed + np.uint64(k) * step) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def masks(self, found: np.ndarray) -> np.ndarray:
        """For each gram the bits of the languages that contain it."""
        out = None
        for place in self.places(found):
            out = self.slots[place] if out is None else out & self.slots[place]
        return out


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n over all texts with a language. Counted per slice in Python, then combined before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            found, rows, _ = grams(batch.column("text").to_pylist())
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy()[rows]
            for n, lang in enumerate(langs.dictionary.to_pylist()):
                own, times = np.unique(found[code == n], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "n"]
                )

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_filters(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Filters of every language in ``docs``, from all its texts.

    Rows without text or language teach nothing; without any the result knows no language. What reaches the driver
    is bounded by 1 / MIN_SHARE grams a language, whatever the size of the corpus. Languages are ordered by how much
    text they have (then by name), which is also the order in which ties are decided. Shares are compared after adding
    SMOOTHING to the language's total, so a label with little text cannot take grams from a language with much.
    """
    counts = gram_counts(docs, text_col, lang_col)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").where(F.col("n") / F.col("total") >= MIN_SHARE)
    shares = shares.select("lang", "gram", (F.col("n") / F.col("total")).alias("own"), (F.col("n") / (F.col("total") + SMOOTHING)).alias("share"))
    best = F.max("share").over(Window.partitionBy("gram"))  # at most one row per language
    kept = shares.withColumn("best", best).where(F.col("share") >= NOISE * F.col("best")).select("gram", "lang", "own")
    order = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    table = kept.toArrow()
    if not order or not table.num_rows:
        return LanguageFilters([], np.zeros((1, 1), dtype=np.uint8), np.zeros(0), np.zeros(0))
    found = table["gram"].to_numpy().astype(np.uint64)
    code = pc.index_in(table["lang"], pa.array(order)).to_numpy()
    size = 1 << max(16, int(SLOTS_PER_GRAM * len(np.unique(found)) - 1).bit_length())
    slots = np.zeros((size, (len(order) + 7) // 8), dtype=np.uint8)
    usual = np.bincount(code, weights=table["own"].to_numpy(), minlength=len(order))
    filters = LanguageFilters(order, slots, np.zeros(len(order)), usual)
    for place in filters.places(found):
        np.bitwise_or.at(slots, (place, code // 8), (1 << (code % 8)).astype(np.uint8))
    filled = np.array([((slots[:, n // 8] >> (n % 8)) & 1).mean() for n in range(len(order))])
    return LanguageFilters(order, slots, filled**HASHES, usual)


def judge(filters: LanguageFilters, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and known share (grams of the text that the decided language contains) of each text."""
    found, rows, lettered = grams(texts)
    total = np.bincount(rows, minlength=len(texts)).astype(np.float64)
    n_langs = len(filters.languages)
    if not n_langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    masks = filters.masks(found)
    shares = np.zeros((n_langs, len(texts)))
    for n in range(n_langs):
        hits = np.bincount(rows, weights=(masks[:, n // 8] >> (n % 8)) & 1, minlength=len(texts))
        chance = filters.chance[n]
        true = (hits - chance * total) / (1 - chance) if chance < 1 else np.zeros(len(texts))
        shares[n] = np.clip(true, 0, None) / np.maximum(total, 1)
    best = shares.argmax(axis=0)
    top, every = shares.max(axis=0), shares.sum(axis=0)
    score = np.where(lettered & (every > 0), top / np.where(every > 0, every, 1), 0.0)
    names = [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
    return names, score, np.where(lettered, np.minimum(top, 1.0), 0.0)


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """Adds pred, score and known (after ``prefix``) to every row, replacing columns of those names.

    Whole texts, no shuffle. A null text or one without letters is ``und`` with score 0; so is every text if no language
    was learned. A text with letters but no known gram gets the language with most training text and score 0.
    """
    added = [f"{prefix}{name}" for name in ("pred", "score", "known")]
    kept = docs.drop(*added)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, TEXT_BYTES):
            names, score, known = judge(filters, [t or "" for t in batch.column(text_col).to_pylist()])
            columns = [pa.array(names, pa.string()), pa.array(score), pa.array(known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, f"{schema}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` double")
