"""Token ids in length-delimited binary records with masked checksums and an offset index beside each file.

Record: length of the payload (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the payload
(u32). Payload: flags (u8; 1: the id is null, 2: four bytes a token instead of two), id (i64), token ids. All numbers
are little endian. The checksum is CRC-32 (zlib), masked by a rotation and an addition so that a checksum of data that
holds checksums stays useful. Index file (``.idx`` beside ``.rec``): one u64 offset a record, the end of the data
as one more u64, and a masked checksum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import new_shared_path, slices, stage
from pulsegrid.llm.word_cache import encode_texts

FILE_BYTES = 64 * 1024 * 1024
MASK_ADD = 0xA282EAD8
NULL_ID, WIDE = 1, 2


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (NULL_ID if doc_id is None else 0) | (WIDE if wide else 0)
    payload = struct.pack("<Bq", flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def parse(record: bytes) -> tuple[int | None, np.ndarray]:
    """Id and tokens of one whole record; a record that does not match its checksums raises ValueError."""
    length, check = struct.unpack_from("<QI", record)
    if masked(record[:8]) != check or len(record) != 16 + length:
        raise ValueError("damaged record length")
    payload = record[12:-4]
    if masked(payload) != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("damaged record")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & WIDE else "<u2", offset=9).astype(np.uint32)
    return (None if flags & NULL_ID else doc_id), ids


class TokenFile:
    """Random access to one file through its index."""

    def __init__(self, path: str):
        fs, place = FileSystem.from_uri(path)
        with fs.open_input_stream(place.removesuffix(".rec") + ".idx") as f:
            index = f.read()
        if masked(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise ValueError("damaged index")
        self.offsets = np.frombuffer(index[:-4], dtype="<u8").astype(np.int64)
        self.file = fs.open_input_file(place)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def record(self, n: int) -> tuple[int | None, np.ndarray]:
        self.file.seek(int(self.offsets[n]))
        return parse(self.file.read(int(self.offsets[n + 1] - self.offsets[n])))

    def close(self) -> None:
        self.file.close()


class _Writer:
    """Files of one task under names of its own, so a repeated task never touches what another attempt wrote."""

    def __init__(self, folder: str, part: int, file_bytes: int):
        self.folder, self.part, self.limit, self.number = folder, part, file_bytes, 0
        self.fs, self.place = FileSystem.from_uri(folder)
        self.fs.create_dir(self.place, recursive=True)
        self.out = None

    def add(self, record: bytes) -> dict | None:
        done = self.close() if self.out is not None and self.offsets[-1] + len(record) > self.limit else None
        if self.out is None:
            self.name = f"{self.part:06d}-{self.number:04d}-{uuid.uuid4().hex}.rec"
            self.out, self.offsets = self.fs.open_output_stream(f"{self.place}/{self.name}"), [0]
        self.out.write(record)
        self.offsets.append(self.offsets[-1] + len(record))
        return done

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        index = np.array(self.offsets, dtype="<u8").tobytes()
        with self.fs.open_output_stream(f"{self.place}/{self.name.removesuffix('.rec')}.idx") as f:
            f.write(index + struct.pack("<I", masked(index)))
        row = {"part": self.part, "number": self.number, "path": f"{self.folder}/{self.name}", "records": len(self.offsets) - 1, "bytes": self.offsets[-1]}
        self.out, self.number = None, self.number + 1
        return row


MANIFEST = "part int, number int, path string, records long, bytes long"


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Tokenise whole texts and write them in ascending order of an integer id; returns the manifest, a row per file.

    Rows are sorted by range partitions (null ids first, repeated ids in any order); each task writes its own files of
    at most ``file_bytes`` (a longer record has a file alone). A null or empty text gives one record that holds only
    ``end_id``; an empty table gives no files; other columns are ignored. ``folder`` must be one that every executor
    can write (default: in the shared folder). Only files in the manifest count: what a lost task left is not in it.
    """
    folder = folder or new_shared_path(docs.sparkSession, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, TaskContext.get().partitionId(), file_bytes)
        done = []
        for batch in slices(batches, "text"):
            ids, starts = encode_texts(tokenizer, batch.column("text"))
            for n, doc_id in enumerate(batch.column("id").to_pylist()):
                row = writer.add(frame(doc_id, np.append(ids[starts[n] : starts[n + 1]], end_id)))
                done += [row] if row else []
        row = writer.close()
        done += [row] if row else []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_arrow(MANIFEST))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return stage(ordered.mapInArrow(write, MANIFEST), "manifest")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every record of the files in the manifest: part, number, record, doc_id, n_tokens, ids_crc32, before, [ids].

    ``before`` counts the tokens before the record in its file. Lengths and checksums are verified; damage raises.
    """
    schema = "part int, number int, record long, doc_id long, n_tokens long, ids_crc32 long, before long"
    schema += ", ids array<int>" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, before, out, held = TokenFile(row["path"]), 0, [], 0
                for n in range(len(file)):
                    doc_id, ids = file.record(n)
                    out.append({"part": row["part"], "number": row["number"], "record": n, "doc_id": doc_id, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "before": before})
                    if with_ids:
                        out[-1]["ids"] = ids.astype(np.int32)
                    before, held = before + len(ids), held + len(ids) * with_ids
                    if len(out) >= 5000 or held > 1_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))
                        out, held = [], 0
                file.close()
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def token_positions(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, ``start`` counting the tokens of all records before it."""
    records = stage(read_token_files(manifest, with_ids=False), "records")
    totals = records.groupBy("part", "number").agg(F.sum("n_tokens").alias("tokens"))
    # One row per file in this window; the sum is broadcast, a row per file as well.
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", "number", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"))
    return records.join(F.broadcast(totals), ["part", "number"]).select(
        "doc_id", (F.col("tokens_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
