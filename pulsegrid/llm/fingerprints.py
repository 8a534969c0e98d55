"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by its own symbols: runs of equal symbols become one, deterministic coin tossing turns each
symbol and its left neighbour into a label from a tiny alphabet in which neighbours always differ, and a phrase starts
at every local maximum of the labels. Phrases are named by their content, and the names are the symbols of the next
level. A boundary depends on a few symbols around it only, so equal passages get equal names inside, wherever they stand.
The fingerprint samples the names of two levels by minimum hashing into 64 bins; a bin holds 16 scrambled bits of its
64-bit minimum, so that the minima of long texts, all near zero, do not look alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import mix64, slices

LEVELS = 3
SAMPLED = (2, 3)
BINS = 64
EMPTY = 0xFFFF
NO_HASH = np.uint64(2**64 - 1)
TOSSES = 3  # 64-bit names to labels below 128, below 14, below 8
_POWERS = np.cumprod(np.concatenate([[1], np.full(63, 0x9E3779B97F4A7C15, dtype=np.uint64)]).astype(np.uint64))
_DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
_PLACES = np.zeros(64, dtype=np.uint8)
for _k in range(64):
    _PLACES[(((1 << _k) * 0x03F79D71B4CB0A89) & (2**64 - 1)) >> 58] = _k


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit place where a symbol differs from its left neighbour, plus its own bit there."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = ~symbols[first]  # a text's first symbol differs everywhere: place 0
    differ = symbols ^ left
    low = differ & (~differ + symbols.dtype.type(1))
    if symbols.dtype == np.uint64:
        place = _PLACES[((low * _DE_BRUIJN) >> np.uint64(58)).astype(np.uint8)]
    else:
        place = _LOW_PLACE[low]
    return (place << 1) | ((symbols & low) != 0).astype(np.uint8)


_LOW_PLACE = np.zeros(256, dtype=np.uint8)
for _k in range(8):
    _LOW_PLACE[1 << _k] = _k


def _next_level(names: np.ndarray, rows: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and rows of the phrases of one level; ``rows`` ascends."""
    # Runs of one name become one symbol that knows the length of its run.
    start = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])]))
    run = np.diff(np.append(start, len(names))).astype(np.uint64)
    symbols, rows = mix64(names[start] + run * _POWERS[1]), rows[start]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    labels = symbols
    for _ in range(TOSSES):
        labels = _toss(labels, first)
    peak = np.ones(len(labels), dtype=bool)
    peak[1:] = labels[1:] > labels[:-1]
    peak[:-1] &= labels[:-1] >= labels[1:]
    last = np.append(first[1:] - 1, len(labels) - 1)
    peak[last] = False  # what follows is another text
    peak[first] = True
    at = np.flatnonzero(peak)
    size = np.diff(np.append(at, len(labels)))
    place = np.minimum(np.arange(len(labels)) - np.repeat(at, size), 63)
    return mix64(np.add.reduceat(symbols * _POWERS[place], at) + np.uint64(level)), rows[at]


def phrases(texts: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts at a level, and the row of each; an empty text has none."""
    return list(_parse(texts, level))[-1]


def _parse(texts: list[str], levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names = points.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for level in range(1, levels + 1):
            if len(names):
                names, rows = _next_level(names, rows, level)
            yield names, rows


def signatures(texts: list[str]) -> np.ndarray:
    """One row of bins per text: of the least hash of the sampled phrase names that fall into each bin, 16 scrambled bits."""
    out = np.full((len(texts), BINS), EMPTY, dtype=np.uint16)
    parsed = [p for level, p in enumerate(_parse(texts, LEVELS), 1) if level in SAMPLED]
    names, rows = np.concatenate([p[0] for p in parsed]), np.concatenate([p[1] for p in parsed])
    if len(names):
        mixed = mix64(names)
        cell = rows * BINS + (mixed >> np.uint64(58)).astype(np.int64)
        least = np.full(len(texts) * BINS, NO_HASH, dtype=np.uint64)
        np.minimum.at(least, cell, mixed)
        filled = np.flatnonzero(least != NO_HASH)
        value = mix64(least[filled]) >> np.uint64(48)
        out.reshape(-1)[filled] = np.minimum(value, np.uint64(EMPTY - 1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those filled in either signature, row by row; two without phrases are alike."""
    filled = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & filled).sum(axis=1)
    return np.where(filled.any(axis=1), equal / np.maximum(filled.sum(axis=1), 1), 1.0)


def as_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fingerprint (64 four-digit hexadecimal bins) of every row; whole texts, no shuffle.

    Equal texts have equal fingerprints. A null or empty text has no phrase: every bin is ``ffff``. Repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = as_text(signatures([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], names=["id", "fingerprint"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, fingerprint string").withColumnRenamed("id", id_col)


OWN, NEXT, FIRST = 0, 1, 2


def in_order_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, pid, kind, sorted so that each row is followed by the next one in ascending order of the id.

    Ids are cut into ranges, one per shuffle partition; a range's first document is also sent to the range before it
    (kind NEXT), and the first of all to the last range (kind FIRST). So the texts are shuffled once and no order runs
    through one task. Null ids come first; equal ids stay together in the order of a hash of their text.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.select("id").repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("p"))
    # One id per range reaches the driver.
    ranges = dealt.agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    cuts = sorted({r["first"] for r in ranges if r["first"] is not None})
    with_null = any(r["nulls"] for r in ranges)
    id_type = docs.schema[id_col].dataType
    literal = F.array(*(F.lit(c) for c in cuts)).cast(f"array<{id_type.simpleString()}>")
    pid = F.coalesce(F.size(F.filter(literal, lambda c: c <= F.col("id"))), F.lit(0)).cast("int")
    first_of_all = F.col("id").isNull() if with_null else F.col("id") == F.lit(cuts[0]) if cuts else F.lit(False)
    places = [
        F.struct(pid.alias("pid"), F.lit(OWN).alias("kind")),
        F.when(F.array_contains(literal, F.col("id")), F.struct((pid - 1).alias("pid"), F.lit(NEXT).alias("kind"))),
        F.when(first_of_all, F.struct(F.lit(len(cuts)).alias("pid"), F.lit(FIRST).alias("kind"))),
    ]
    placed = rows.select("id", "text", F.explode(F.array_compact(F.array(*places))).alias("at")).select("id", "text", "at.pid", "at.kind")
    return placed.repartitionById(len(cuts) + 1, "pid").sortWithinPartitions("pid", "kind", "id", F.xxhash64("text"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text replaces the last quarter of the code points (rounded down) by as many first ones of the next
    document in ascending order of the id, or all it has; after the last comes the first, and a single document follows
    itself. Columns: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty; two texts without phrases have likeness 1, one beside a filled one 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last own row, whose successor comes with the next slice
        for batch in slices(batches, "text"):
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("pid", "kind", "id", "text")), strict=True))
            pairs = [n for n in range(len(rows) - 1) if rows[n][1] == OWN and rows[n + 1][0] == rows[n][0]]
            held = rows[-1:] if rows[-1][1] == OWN else []
            if not pairs:
                continue
            texts = [r[3] for r in rows]
            edited = []
            for n in pairs:
                quarter = len(texts[n]) // 4
                edited.append(texts[n][: len(texts[n]) - quarter] + texts[n + 1][:quarter])
            own, changed = signatures(texts), signatures(edited)
            at = np.array(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[n][2] for n in pairs], batch.schema.field("id").type),
                    pa.array([len(texts[n]) for n in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(as_text(own[at]), pa.string()),
                    pa.array(as_text(changed), pa.string()),
                    pa.array(likeness(own[at], changed)),
                    pa.array(likeness(own[at], own[at + 1])),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order_with_next(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
