"""The message queue: batch sizes, acknowledgement, redelivery; and appends that happen once."""

import pytest
from pyspark.errors import StreamingQueryException

from pulsegrid.operators.ingest import recent_target
from pulsegrid.sources.tables import write_metrics_table
from pulsegrid.streaming import jobs, queue_source
from pulsegrid.streaming.queue_source import START, MessageQueue, QueueReader, drain_queue


def test_positions(tmp_path):
    queue = MessageQueue(str(tmp_path / "q"))
    assert queue.segments() == [] and queue.acknowledged() == START and queue.parts(START, 5) == ([], START)
    queue.enqueue("s1", ["a", "b", "c"])
    queue.enqueue("s2", [])
    queue.enqueue("s3", ["d", "é" * 700_000, ""])
    parts, end = queue.parts(START, 4)
    assert [(p.segment, p.first, p.last) for p in parts] == [("s1", 0, 3), ("s3", 0, 1)] and end == {"segment": "s3", "line": 1}
    parts, end = queue.parts(end, 4)
    assert [len(x) for x in queue.lines(parts[0].segment, parts[0].first, parts[0].last)] == [700_000, 0] and end["line"] == 3
    assert queue.parts(end, 4) == ([], end)
    assert [p.segment for p in queue.parts({"segment": "s1", "line": 2}, end={"segment": "s3", "line": 1})[0]] == ["s1", "s3"]
    queue.acknowledge(end)
    assert queue.acknowledged() == end and queue.segments() == ["s1", "s2", "s3"]


def test_batches_are_bounded_and_repeated_until_acknowledged(spark, tmp_path):
    folder = str(tmp_path / "q")
    queue = MessageQueue(folder)
    for n in range(3):
        queue.enqueue(f"s{n}", [f"m{n}-{i}" for i in range(300)])
    seen, breaks = [], iter((False, True))

    def each(batch, batch_id):
        seen.append((batch_id, sorted(r["data"] for r in batch.collect())))
        if next(breaks, False):
            raise RuntimeError("killed after reading")

    with pytest.raises(StreamingQueryException):
        drain_queue(spark, folder, each, str(tmp_path / "cp"))
    assert queue.acknowledged() == {"segment": "s1", "line": 200}
    drain_queue(spark, folder, each, str(tmp_path / "cp"))
    assert [len(rows) for _, rows in seen] == [500, 400, 400] and seen[1] == seen[2]
    assert sorted(x for _, rows in seen[2:] for x in rows) == sorted(f"m{n}-{i}" for n in (0, 1, 2) for i in range(300) if (n, i) >= (1, 200))
    assert queue.acknowledged() == {"segment": "s2", "line": 300}
    queue.enqueue("s3", ["late"])
    drain_queue(spark, folder, each, str(tmp_path / "lost-checkpoint"))
    assert seen[-1][1] == ["late"] and len(seen) == 4


LINE = '{{"event_id": "e{0}", "service": "s", "metric": "m", "value": 1.0, "timestamp": "2024-01-{1:02d}T00:00:00Z", "labels": {{}}}}'


def test_torn_writes_and_replays(spark, tmp_path):
    store = jobs.Store(str(tmp_path / "store"))
    store.prepare(spark)
    batch = spark.createDataFrame([(LINE.format(i, 1 + i % 5), "f") for i in range(20)], "data string, source_file string")
    failing = iter((True,))

    def torn(rows, path):
        write_metrics_table(rows.where("event_id < 'e15'") if next(failing, False) else rows, path)
        if len(list((tmp_path / "store" / "metrics_published").iterdir())) == 1:
            raise OSError("gone")

    jobs.ingest_batch(store, torn)(batch, 1)
    assert store.metrics(spark).count() == 20 and store.metrics(spark).select("event_id").distinct().count() == 20
    rollup = sorted(jobs.stored_rollup(spark, store).collect())
    # The same batch again, as after a crash before its accounting row: same rows, same parts, same counts.
    counts = store.load(spark, "accounting").collect()
    jobs.ingest_batch(store)(batch, 1)
    assert store.load(spark, "accounting").collect() == counts and counts[0]["inserted"] == 20
    assert sorted(jobs.stored_rollup(spark, store).collect()) == rollup and store.metrics(spark).count() == 20
    jobs.ingest_batch(store)(spark.createDataFrame([(LINE.format(i, 7), "f") for i in range(18, 23)], batch.schema), 2)
    rows = sorted(map(str, store.metrics(spark).collect()))
    assert len(rows) == 25
    assert jobs.compact_metrics(spark, store, "c1") == 2
    assert sorted(map(str, store.metrics(spark).collect())) == rows and jobs.compact_metrics(spark, store, "c2") == 1


def test_only_the_batchs_days_are_opened(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = spark.sql("SELECT timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, id) AS timestamp, id FROM range(30)")
    rows.withColumn("event_date", rows["timestamp"].cast("date")).write.partitionBy("event_date").parquet(path)
    target = recent_target(spark.read.parquet(path), rows.where("id IN (0, 29)"))
    assert sorted(r["id"] for r in target.collect()) == [0, 29]
    assert recent_target(spark.read.parquet(path), rows.where("id < 0")).isEmpty()


def test_a_segment_is_read_in_pieces(tmp_path, monkeypatch):
    """One segment is many partitions, each of which starts at its own byte; together they give every line once."""
    monkeypatch.setattr(queue_source, "PIECE_MESSAGES", 10)
    queue = MessageQueue(str(tmp_path / "q"))
    lines = [f"é{n}" * (1 + n % 3) for n in range(95)]
    queue.put("s", "\n".join(lines))  # the last line has no end
    reader = QueueReader(str(tmp_path / "q"), 500)
    for first, last in ((0, 95), (7, 95), (10, 41), (94, 95)):
        parts = reader.partitions({"segment": "s", "line": first}, {"segment": "s", "line": last})
        assert len(parts) == -(-(last - first) // 10) and all(p.last - p.first <= 10 for p in parts)
        assert [row for p in parts for row in reader.read(p)] == [(lines[n], "s", n) for n in range(first, last)]
        assert all(p.at == len("".join(f"{x}\n" for x in lines[: p.first]).encode()) for p in parts)
