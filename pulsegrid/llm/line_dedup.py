"""Repeated passages of lines, found by content-defined chunks and removed after comparing their bytes.

A rolling hash over the hashes of two neighbouring lines chooses where a chunk ends, so the cut depends on the lines
around it and not on what stands before the passage. A line of 50 words or more is a chunk by itself. Chunks of several
lines, and those long lines, are removed wherever they repeat; the first place in ascending order of the id keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import BROADCAST_ROWS, drop_staged, slices, stage, staged_into

# A chunk ends after a line whose rolling hash is a multiple of this, so short lines form chunks of about as many.
DIVISOR = 4
BASE, MODULUS = 257, 2**31 - 1
LONG_WORDS = 50
MARK_BITS = 1 << 26


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.md5(line.encode()).digest()[:4], "big")


def word_count(line: str) -> int:
    return len(line.encode().split())


def chunk_ends(hashes: list[int], words: list[int]) -> list[int]:
    """Past-the-end line of each chunk."""
    ends = []
    for n in range(len(hashes) - 1):
        rolling = (hashes[n] + BASE * (hashes[n - 1] if n else 0)) % MODULUS
        if rolling % DIVISOR == 0 or words[n] >= LONG_WORDS or words[n + 1] >= LONG_WORDS:
            ends.append(n + 1)
    return [*ends, len(hashes)]


def chunk_rows(text: str) -> list[tuple[int, int, str]]:
    """Lines, words and text of each chunk of a text; joined by line feeds they are the text."""
    lines = text.split("\n")
    words = [word_count(line) for line in lines]
    out, start = [], 0
    for end in chunk_ends([line_hash(line) for line in lines], words):
        out.append((end - start, sum(words[start:end]), "\n".join(lines[start:end])))
        start = end
    return out


def _movable(n_lines: int, n_words: int) -> bool:
    return n_words >= LONG_WORDS or (n_lines > 1 and n_words > 0)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds lines, chunks and the hash of each chunk (null where it must stay) to rows with a text."""
    for batch in slices(batches, "text"):
        n_lines, hashes = [], []
        for text in batch.column("text").to_pylist():
            chunks = chunk_rows(text) if text is not None else []
            n_lines.append(sum(n for n, _, _ in chunks))
            hashes.append([hashlib.md5(part.encode()).digest() if _movable(n, w) else None for n, w, part in chunks])
        columns = [pa.array(n_lines, pa.int64()), pa.array(hashes, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lines", "hashes"])


def _marks(repeated: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the place of every repeated hash is set."""
    place = F.conv(F.hex(F.substring("hash", 1, 4)), 16, 10).cast("long") % MARK_BITS
    words = repeated.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w"))
    # At most MARK_BITS / 64 rows reach the driver.
    rows = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b")).toArrow()
    marks = np.zeros(MARK_BITS // 64, dtype=np.int64)
    marks[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return marks.view(np.uint64)


def _parts(marks: np.ndarray):
    """The chunks that may be removed and whose hash may be repeated, with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, out = [], {"no": [], "n": [], "hash": [], "part": []}
            for row, text in enumerate(batch.column("text").to_pylist()):
                for no, (n, w, part) in enumerate(chunk_rows(text) if text is not None else []):
                    if _movable(n, w):
                        digest = hashlib.md5(part.encode()).digest()
                        place = int.from_bytes(digest[:4], "big") % MARK_BITS
                        if int(marks[place // 64]) >> place % 64 & 1:
                            rows.append(row)
                            for name, value in zip(out, (no, n, digest, part), strict=True):
                                out[name].append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.string())
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("uid", "id")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["uid", "id", *out])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the chunks named in ``gone``."""
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        for row, gone in enumerate(batch.column("gone").to_pylist()):
            if gone:
                gone = set(gone)
                texts[row] = "\n".join(part for no, (_, _, part) in enumerate(chunk_rows(texts[row])) if no not in gone)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def _removed(rows: DataFrame) -> DataFrame:
    """uid, no, n of the chunks that go: of equal chunks all but the first, compared byte by byte."""
    hashes = rows.select(F.explode("hashes").alias("hash")).where(F.col("hash").isNotNull())
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("hash")
    id_type = rows.schema["id"].dataType.simpleString()
    repeated = stage(repeated, "hashes")
    parts = rows.select("uid", "id", "text").mapInArrow(_parts(_marks(repeated)), f"uid long, id {id_type}, no int, n long, hash binary, part string")
    candidates = stage(parts.join(repeated, "hash"), "repeated")
    place = F.struct("id", "uid", "no")
    firsts = candidates.groupBy("hash", "part").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    firsts = firsts.select("hash", F.col("part").alias("same"), "first")
    removed = candidates.join(firsts, "hash").where((F.col("part") == F.col("same")) & (place != F.col("first")))
    return removed.select("uid", "no", "n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of every row, the text without repeated chunks, and n_lines, n_chunks, removed_lines, removed_chunks.

    Kept: the first chunk by id (nulls first), then by row and place; so repeated rows and ids, and passages repeated
    within one text, lose all but one. Blank chunks stay. A null text stays null, an empty one empty; a text of which
    all is repeated elsewhere becomes empty, but the row stays. Columns named as the four added ones (after ``prefix``)
    are replaced.
    Order of work: chunk hashes are counted; only chunks whose hash repeats are compared byte by byte (grouped by hash and
    text, combined before the shuffle); what they tell is joined by hash, where the adaptive join splits a hot passage;
    then each row drops its own. A bitmap of fixed size (8 MB) keeps nearly all other chunks from being shuffled at all.
    Rows to change are broadcast while they are counted to be few; beyond that the same join shuffles.
    """
    added = [f"{prefix}{name}" for name in ("n_lines", "n_chunks", "removed_lines", "removed_chunks")]
    others = [c for c in docs.columns if c not in (text_col, *added)]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.struct(*(F.col(c).alias(f"c{n}") for n, c in enumerate(others))).alias("rest"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields)
    # Stored once, so that row numbers cannot change when a task is repeated; narrow steps read only the hashes.
    rows = stage(numbered.mapInArrow(_hashed, f"{schema}, lines long, hashes array<binary>"), "lines")

    inner: list[str] = []
    with staged_into(inner):
        removed = _removed(rows)
    removed = stage(removed, "removed")
    drop_staged(docs.sparkSession, inner)  # tables with text that only led to the removed chunks
    gone = removed.groupBy("uid").agg(F.collect_list("no").alias("gone"), F.sum("n").alias("gone_lines"))
    gone = F.broadcast(gone) if removed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone

    joined = rows.drop("id").withColumn("chunks", F.size("hashes").cast("long")).drop("hashes").join(gone, "uid", "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields)
    cleaned = joined.mapInArrow(_without, schema)
    out = {c: F.col(f"rest.c{n}") for n, c in enumerate(others)} | {text_col: F.col("text")}
    return cleaned.select(
        *(out[c].alias(c) for c in docs.columns if c not in added),
        F.col("lines").alias(added[0]),
        F.col("chunks").alias(added[1]),
        F.coalesce("gone_lines", F.lit(0)).alias(added[2]),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(added[3]),
    )
