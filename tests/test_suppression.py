"""Suppression as state against the batch replay, by batches in order and over restarts."""

import random
from datetime import timedelta

import pytest
from rows import BASE

from pulsegrid.operators.incidents import suppress_cooldown
from pulsegrid.streaming import jobs
from pulsegrid.streaming.suppression import STATE_STORE, keyed_state, stream_suppress

SCHEMA = "incident_id string, service string, metric string, started_at timestamp"


def incidents(spark, starts, service="s"):
    """(name, seconds after the base) pairs of one series."""
    rows = [(f"{service}-{n}", service, "m", None if s is None else BASE + timedelta(seconds=s)) for n, s in starts]
    return spark.createDataFrame(rows, SCHEMA)


def streamed(spark, tmp_path, batches, cooldown, **options):
    """Each batch is a stream run of its own over one checkpoint, so state also lives through restarts."""
    queue, out, checkpoint = (str(tmp_path / n) for n in ("queue", "out", "checkpoint"))
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(queue)
        stream = stream_suppress(spark.readStream.schema(SCHEMA).parquet(queue), cooldown, **options)
        with keyed_state(spark):
            jobs.run_to_table(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def names(df):
    return sorted(r["incident_id"] for r in df.collect())


def test_batches_in_order_equal_the_batch_replay(spark, tmp_path):
    draw = random.Random(7)
    every = [(s, k, draw.randint(0, 3000)) for s in ("a", "b") for k in range(40)]
    cut = [[(k, t) for s2, k, t in every if s2 == s and lo <= t < lo + 1100] for lo in (0, 1100, 2200) for s in ("a", "b")]
    batches = [incidents(spark, cut[i], "a").unionByName(incidents(spark, cut[i + 1], "b")) for i in (0, 2, 4)]
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert names(streamed(spark, tmp_path, batches, 300)) == names(suppress_cooldown(whole, 300))
    assert spark.conf.get(STATE_STORE).endswith("HDFSBackedStateStoreProvider")  # as it was before


@pytest.mark.parametrize(("second", "fires"), [(299.999999, False), (300, True)])
def test_exactly_at_the_cooldown_it_fires(spark, tmp_path, second, fires):
    out = streamed(spark, tmp_path, [incidents(spark, [(0, 0)]), incidents(spark, [(1, second)])], 300)
    assert names(out) == ["s-0", "s-1"][: 1 + fires]


def test_state_goes_when_its_cooldown_is_over(spark, tmp_path):
    later = incidents(spark, [(9, 9000), (8, None)], "other")
    out = streamed(
        spark, tmp_path, [incidents(spark, [(0, 0), (1, 250)]), incidents(spark, [(2, 310)]), later], 300,
        horizon="10 seconds", report_expiry=True,
    )
    rows = sorted((r["what"], r["service"], r["incident_id"], (r["started_at"] - BASE).total_seconds()) for r in out.collect())
    # Only the last firing of the series had state left to forget; the other series still has its own.
    assert rows == [("expired", "s", None, 310.0), ("fired", "other", "other-9", 9000.0), ("fired", "s", "s-0", 0.0), ("fired", "s", "s-2", 310.0)]
