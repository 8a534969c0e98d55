"""Plans must keep their shape: pruned scans, no cross joins, no Python where the JVM suffices."""

import re

import pytest
from compare import plan

from __spark_entry__ import queries
from pulsegrid.operators import ingest, rollup
from pulsegrid.plans import detection, training
from pulsegrid.plans.fixtures import AS_OF, World

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parse_events", "chrono_split", "inject_anomalies", "alert_cycle", "incident_feed"])
def test_no_python_where_the_jvm_suffices(spark, name):
    text = plan(queries()[name](spark, SF))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", text)


def test_detection_screens_before_python(spark):
    """Readings inside a model's core are filtered below the Python step."""
    w = World(spark, SF)
    split = training.split_window(w.readings, AS_OF)
    models = training.fit_models(split, AS_OF)
    text = plan(detection.detect(w.readings, models, models))
    assert text.count("ArrowEvalPython") == 1
    below = text[text.index("ArrowEvalPython"):]
    assert "_low" in below and "_high" in below


def test_scans_read_only_what_they_need(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    w = World(spark, SF)
    text = plan(rollup.rollup_1min(w.readings))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    assert "partial_avg(value" in text
    one = rollup.of_series(rollup.in_range(w.readings, "2024-01-05 00:00:00", "2024-01-06 00:00:00"), "svc-1", "click")
    pushed = plan(one.select("value"))
    assert "EqualTo(event_type,click)" in pushed and "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed


def test_a_message_is_parsed_once(spark):
    valid, _ = ingest.validate_events(ingest.parse_events(World(spark, SF).messages))
    assert plan(valid).count("from_json(StructField(event_id") == 1


@pytest.mark.parametrize("name", ["dedupe_first", "insert_if_absent"])
def test_dedup_parses_and_scans_messages_once(spark, name):
    w = World(spark, SF)
    text = plan(queries()[name](spark, SF))
    assert text.count("from_json(StructField(event_id") == 1
    stored = text.count("Scan parquet") - plan(w.messages).count("Scan parquet")
    assert stored == (plan(w.readings).count("Scan parquet") if name == "insert_if_absent" else 0)


def test_pages_are_cut_by_top_k(spark):
    assert "TakeOrderedAndProject" in plan(queries()["incident_page"](spark, SF))
    assert "TakeOrderedAndProject" in plan(queries()["model_list"](spark, SF))


def test_a_schedule_does_not_multiply_or_shuffle_readings(spark):
    from pulsegrid.operators.schedule import apply_anomaly_schedule

    w = World(spark, SF)
    text = plan(apply_anomaly_schedule(w.readings, w.windows))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
