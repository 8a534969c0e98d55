"""A message queue as a streaming source: bounded batches, acknowledged once stored, delivered again until then.

The queue is a folder on shared storage: segments (files of one message a line, taken in order of their names) and a
marker that holds how far messages are acknowledged. Spark commits a batch after its rows are stored; only then does
the marker move. A stream that starts again from its checkpoint repeats the batch it was in; one without a checkpoint
starts at the marker. Either way nothing is lost, and what comes twice has the ids it had before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BATCH_MESSAGES = 500
PIECE_MESSAGES = 50_000  # lines that one task reads at most
MARKER = "_acknowledged"
START = {"segment": "", "line": 0}  # everything up to this line of this segment is done


@dataclass
class Lines(InputPartition):
    """Some lines of one segment."""

    segment: str
    first: int
    last: int  # past the end
    at: int = 0  # byte at which the line ``seen`` starts, from where on the segment is read
    seen: int = 0


class MessageQueue:
    """The folder of a queue. A segment is written once and does not change."""

    def __init__(self, folder: str):
        self.files, self.place = FileSystem.from_uri(folder)

    def segments(self, after: str = "") -> list[str]:
        """Names from ``after`` on; hidden files are no segments."""
        found = self.files.get_file_info(FileSelector(self.place, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == FileType.File and f.base_name[0] not in "._" and f.base_name >= after)

    def lines(self, segment: str, first: int = 0, last: int | None = None, at: int = 0, seen: int = 0) -> Iterator[str]:
        """Lines ``first`` to ``last``; what lies before byte ``at``, where the line ``seen`` starts, is not read."""
        with self.files.open_input_file(f"{self.place}/{segment}") as stream:
            stream.seek(at)
            rest, number = b"", seen
            while chunk := stream.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    if first <= number and (last is None or number < last):
                        yield line.decode()
                    number += 1
                if last is not None and number >= last:
                    return
            if rest and first <= number and (last is None or number < last):
                yield rest.decode()

    def pieces(self, segment: str, first: int, last: int | None) -> list[Lines]:
        """The lines ``first`` to ``last`` in pieces of a bounded size. Line ends are counted, lines are not taken apart."""
        starts, number, at, tail = [(first, 0, 0)] if not first else [], 0, 0, b""
        with self.files.open_input_stream(f"{self.place}/{segment}") as stream:
            while (last is None or number < last) and (chunk := stream.read(1 << 20)):
                ends = np.flatnonzero(np.frombuffer(chunk, dtype=np.uint8) == 10)
                # Line k of the segment starts behind its k-th line end.
                k = max(0, first - number - 1)
                k += -(number + 1 + k - first) % PIECE_MESSAGES
                starts += [(number + 1 + j, at + int(ends[j]) + 1, number + 1 + j) for j in range(k, len(ends), PIECE_MESSAGES)]
                number, at, tail = number + len(ends), at + len(chunk), chunk[-1:]
        if tail not in (b"", b"\n") and (last is None or number < last):
            number += 1  # a last line without an end
        stop = number if last is None else min(number, last)
        starts = [s for s in starts if s[0] < stop]
        ends = [*(s[0] for s in starts), stop][1:]
        return [Lines(segment, line, end, at, seen) for (line, at, seen), end in zip(starts, ends, strict=True)]

    def put(self, name: str, data: str) -> None:
        """A file that appears whole or not at all."""
        self.files.create_dir(self.place, recursive=True)
        hidden = f"{self.place}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden) as stream:
            stream.write(data.encode())
        self.files.move(hidden, f"{self.place}/{name}")

    def enqueue(self, segment: str, messages: Sequence[str]) -> None:
        self.put(segment, "".join(f"{m}\n" for m in messages))

    def acknowledged(self) -> dict:
        if self.files.get_file_info(f"{self.place}/{MARKER}").type != FileType.File:
            return dict(START)
        with self.files.open_input_stream(f"{self.place}/{MARKER}") as stream:
            return json.loads(stream.read())

    def acknowledge(self, offset: dict) -> None:
        self.put(MARKER, json.dumps(offset))

    def parts(self, start: dict, limit: int | None = None, end: dict | None = None) -> tuple[list[Lines], dict]:
        """Lines from ``start`` on, at most ``limit`` or up to ``end``, and where they stop."""
        found, stop, left = [], dict(start), limit
        for segment in self.segments(start["segment"]):
            if (left is not None and left <= 0) or (end is not None and segment > end["segment"]):
                break
            first = start["line"] if segment == start["segment"] else 0
            last = end["line"] if end is not None and segment == end["segment"] else None
            if left is not None:
                last = first + left if last is None else min(last, first + left)
            pieces = self.pieces(segment, first, last)
            if pieces:
                found += pieces
                size = pieces[-1].last - first
                stop = {"segment": segment, "line": first + size}
                left = left - size if left is not None else None
        return found, stop


class QueueReader(DataSourceStreamReader):
    """Plans batches on the driver, where it looks at no more lines than a batch may have; tasks read the segments."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.position: dict | None = None

    def initialOffset(self) -> dict:
        return MessageQueue(self.folder).acknowledged()

    def latestOffset(self) -> dict:
        start = self.position or self.initialOffset()
        self.position = MessageQueue(self.folder).parts(start, self.limit)[1]
        return self.position

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if (end["segment"], end["line"]) <= (start["segment"], start["line"]):
            return []
        if self.position is None or (self.position["segment"], self.position["line"]) < (end["segment"], end["line"]):
            self.position = end  # a batch repeated after a restart
        return MessageQueue(self.folder).parts(start, end=end)[0]

    def read(self, partition: Lines) -> Iterator[tuple]:
        lines = MessageQueue(self.folder).lines(partition.segment, partition.first, partition.last, partition.at, partition.seen)
        for number, line in enumerate(lines, partition.first):
            yield line, partition.segment, number

    def commit(self, end: dict) -> None:
        queue = MessageQueue(self.folder)
        done = queue.acknowledged()
        if (end["segment"], end["line"]) > (done["segment"], done["line"]):
            queue.acknowledge(end)


class QueueSource(DataSource):
    """``spark.readStream.format("message_queue")`` with options ``folder`` and ``max_messages``."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return "data string, segment string, line bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QueueReader(self.options["folder"], int(self.options.get("max_messages", BATCH_MESSAGES)))


def read_queue_stream(spark: SparkSession, folder: str, max_messages: int = BATCH_MESSAGES) -> DataFrame:
    """Messages as rows (data, source_file, arrival), at most ``max_messages`` a batch; see ``read_metric_stream``."""
    spark.dataSource.register(QueueSource)
    rows = spark.readStream.format("message_queue").option("folder", folder).option("max_messages", max_messages).load()
    return rows.select("data", F.col("segment").alias("source_file"), F.struct("segment", "line").alias("arrival"))


def drain_queue(
    spark: SparkSession, folder: str, each: Callable[[DataFrame, int], None], checkpoint: str, max_messages: int = BATCH_MESSAGES
) -> None:
    """Work off batch by batch what is in the queue now, then stop; a failure is raised and leaves its batch unacknowledged.

    A stream of "what is there now" would be one batch, as this kind of source cannot be asked for several. Spark
    acknowledges a batch when it plans the next; the last one is acknowledged here.
    """
    stream = read_queue_stream(spark, folder, max_messages)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        last = query.lastProgress
    finally:
        query.stop()
    if last and (end := json.loads(last.json)["sources"][0]["endOffset"]):
        QueueReader(folder, max_messages).commit(end)
