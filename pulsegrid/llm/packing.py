"""Best-fit packing of token pieces into sequences under several capacities at once.

A piece takes tokens, one document place and attention cost (its length squared) from its sequence. Pieces come
longest first; of the open sequences that have room in every dimension, the one that scores best takes the piece, by
the weighted norm of what would be left or by the weighted dot product of the piece and the room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, stage
from pulsegrid.llm.word_cache import encode_texts

# Pieces packed together in one task; each group leaves a few sequences partly filled at its end.
GROUP_PIECES = 16_384


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. By default documents and cost follow from the tokens, so they never bind first."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], dtype=np.float64)


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``limits.tokens`` ids: doc_id, piece, start, length, ids_crc32, [ids]. Only longer texts are cut.

    A null or empty text has the one piece that holds ``end_id``. Repeated rows give repeated pieces. A piece must also
    fit the cost: where ``limits.cost`` is smaller than the square of the tokens, pieces are cut to its root.
    """
    size = int(min(limits.vector()[0], np.sqrt(limits.vector()[2])))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, starts = encode_texts(tokenizer, batch.column("text"))
            rows, pieces, begins, lengths, crcs, tokens = [], [], [], [], [], []
            for n in range(batch.num_rows):
                own = np.append(ids[starts[n] : starts[n + 1]], end_id).astype("<u4")
                for k, begin in enumerate(range(0, len(own), size)):
                    part = own[begin : begin + size]
                    rows.append(n)
                    pieces.append(k)
                    begins.append(begin)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        tokens.append(part.astype(np.int32))
            columns = [batch.column("id").take(pa.array(rows)), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (begins, lengths, crcs))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` must not ascend."""
    capacity = limits.vector()
    weights = np.array(limits.weights)
    items = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1)
    room = np.empty((len(lengths), 3))  # of open sequences, in units of the sequence
    open_bins = np.empty(len(lengths), dtype=np.int64)
    used = np.zeros(len(lengths), dtype=np.int64)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    n_open = n_bins = 0
    smallest = int(lengths[-1]) if len(lengths) else 0
    for i, item in enumerate(items):
        rooms = room[:n_open]
        fits = np.flatnonzero((rooms[:, 0] >= item[0]) & (rooms[:, 1] >= 1) & (rooms[:, 2] >= item[2]))
        if len(fits):
            left = rooms[fits]
            if limits.rule == "dot":
                at = fits[np.argmax((left / capacity * (item / capacity)) @ weights)]
            else:
                at = fits[np.argmin((((left - item) / capacity) ** 2) @ weights)]
        else:
            at, n_open = n_open, n_open + 1
            room[at], open_bins[at], n_bins = capacity, n_bins, n_bins + 1
        own = open_bins[at]
        bins[i], offsets[i] = own, used[own]
        used[own] += int(item[0])
        room[at] -= item
        if room[at, 0] < smallest or room[at, 1] < 1 or room[at, 2] < smallest**2:  # nothing fits any more
            n_open -= 1
            room[at], open_bins[at] = room[n_open], open_bins[n_open]
    return bins, offsets


def pack_pieces(pieces: DataFrame, limits: Limits = Limits(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` column (1 to the token capacity).

    Pieces that fill a sequence get one each. The rest is dealt by hash of a row number, never by document, into groups
    of about ``group_pieces`` (so repeated rows cannot pile up) that are packed independently; the loss against one
    big group is the open end of each group. An empty table stays empty. Needs stored pieces (see ``stage``): the
    row number must not change when a task is repeated.
    """
    schema = pieces.schema
    full = limits.vector()[0]
    numbered = pieces.withColumn("__row", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") >= full)
    rest = numbered.where(F.col("length") < full)
    groups = max(1, -(-rest.count() // group_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "__row"], ascending=[False, True], kind="stable")
        bins, offsets = best_fit(group["length"].to_numpy(), limits)
        group["sequence_id"] = group["__group"].to_numpy().astype(np.int64) * (1 << 32) + bins
        group["offset"] = offsets
        return group.drop(columns=["__row", "__group"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", sequence_id long, offset long"
    packed = (
        rest.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int"))
        .repartition(groups, "__group")
        .groupBy("__group")
        .applyInPandas(pack, out)
    )
    # Numbers below zero belong to the sequences of one piece.
    alone = whole.select(*schema.names, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset. See the two steps."""
    return pack_pieces(stage(tokenize_pieces(docs, tokenizer, end_id, limits, id_col, text_col, with_ids), "pieces"), limits)
