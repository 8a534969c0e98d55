import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from rows import BASE, anomalies, no_fired, no_members

from pulsegrid.operators import incidents as inc


def sizes(df, gap=600):
    rows = inc.group_incidents(df, gap).orderBy("service", "metric", "started_at").collect()
    return [r["n_anomalies"] for r in rows]


@pytest.mark.parametrize(
    ("minutes", "wanted"), [([0, 5, 9], [3]), ([0, 20], [1, 1]), ([0, 5, 25, 30], [2, 2]), ([], []), ([0, 9, 18, 27], [4])]
)
def test_grouping_by_gap_to_the_previous(spark, minutes, wanted):
    assert sizes(anomalies(spark, minutes)) == wanted


def test_gap_equal_to_the_window_joins(spark):
    assert sizes(anomalies(spark, [0, 600], seconds=True)) == [2]
    assert sizes(anomalies(spark, [0, 601], seconds=True)) == [1, 1]
    assert sizes(anomalies(spark, [1, 599, 1199, 1800], seconds=True)) == [3, 1]


def test_series_never_share_an_incident(spark):
    both = anomalies(spark, [0]).unionByName(anomalies(spark, [0], "auth-service", "latency_p99"))
    assert sizes(both) == [1, 1]


def test_started_at_is_the_first_member(spark):
    row = inc.group_incidents(anomalies(spark, [9, 0, 5])).first()
    assert row["started_at"] == BASE and row["last_at"] == BASE + timedelta(minutes=9)


def brute(times, gap):
    groups = []
    for t in sorted(times):
        if groups and t - groups[-1][-1] <= gap:
            groups[-1].append(t)
        else:
            groups.append([t])
    return groups


@pytest.mark.parametrize("gap", [1, 7, 60, 600])
def test_sessions_against_brute_force(spark, gap):
    rnd = random.Random(gap)
    times = sorted(rnd.sample(range(40_000), 700))
    df = anomalies(spark, times, seconds=True).repartition(4)
    wanted = brute(times, gap)
    assert sizes(df, gap) == [len(g) for g in wanted]
    members = inc.incident_members(df, gap)
    linked = members.join(df, "anomaly_id").groupBy("incident_id").agg(F.sort_array(F.collect_list("timestamp")).alias("ts"))
    got = sorted([int((t - BASE).total_seconds()) for t in r["ts"]] for r in linked.collect())
    assert got == wanted


def test_member_list_is_numbered_in_order(spark):
    a = anomalies(spark, [3, 0, 7, 60, 61])
    rows = inc.incident_member_list(a, inc.incident_members(a)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["incident_id"], {})[r["member_no"]] = r["anomaly_id"][-1]
    assert sorted([m[i] for i in sorted(m)] for m in by.values()) == [["1", "0", "2"], ["3", "4"]]
    agg = inc.incident_members_agg(a, inc.incident_members(a)).collect()
    assert sorted((r["n_members"], r["first_anomaly_id"][-1], r["last_anomaly_id"][-1]) for r in agg) == [(2, "3", "4"), (3, "1", "2")]


def cycle(spark, a, members=None, fired=None, now=BASE, **kw):
    r = inc.alert_cycle(a, members if members is not None else no_members(spark), fired if fired is not None else no_fired(spark), now, **kw)
    c = r.counts.first()
    return r, (c["created"], c["suppressed"])


def test_cycle_counts(spark):
    one = anomalies(spark, [0])
    assert cycle(spark, one)[1] == (1, 0)
    assert cycle(spark, one.limit(0))[1] == (0, 0)
    fired = spark.createDataFrame([("payment-api", "cpu_percent", BASE)], no_fired(spark).schema)
    assert cycle(spark, one, fired=fired, now=BASE + timedelta(seconds=299))[1] == (0, 1)
    assert cycle(spark, one, fired=fired, now=BASE + timedelta(seconds=300))[1] == (1, 0)
    two = one.unionByName(anomalies(spark, [0], "auth-service", "latency_p99"))
    assert cycle(spark, two)[1] == (2, 0)


def test_only_the_earliest_group_of_a_series_fires(spark):
    a = anomalies(spark, [0, 5, 60, 120])
    result, counts = cycle(spark, a)
    assert counts == (1, 2)
    assert result.members.count() == 2
    assert result.incidents.first()["started_at"] == BASE
    later, counts = cycle(spark, a, result.members, result.fired, BASE + timedelta(seconds=300))
    assert counts == (1, 1) and later.incidents.first()["started_at"] == BASE + timedelta(minutes=60)


def test_long_burst_becomes_a_chain_of_incidents(spark):
    """An anomaly every 10 s for 20 minutes, a cycle every two: an incident at 2, 8, 14 and 20 minutes."""
    a = anomalies(spark, range(0, 1200, 10), seconds=True)
    members, fired, created = no_members(spark), no_fired(spark), 0
    for minute in range(2, 21, 2):
        now = BASE + timedelta(minutes=minute)
        r = inc.alert_cycle(a.where(F.col("timestamp") <= F.lit(now)), members, fired, now)
        new, fire = r.members.collect(), r.fired.collect()
        created += r.counts.first()["created"]
        members = spark.createDataFrame(members.collect() + new, members.schema)
        fired = spark.createDataFrame(fired.collect() + fire, fired.schema)
    assert created == 4


def test_cooldown_boundary_and_brute_force(spark):
    rnd = random.Random(1)
    minutes = [0, 20, 40] + sorted(rnd.sample(range(60, 5000, 11), 150))
    opened = inc.group_incidents(anomalies(spark, minutes), 600)
    for wait in (20 * 60, 3 * 3600):
        last, wanted = None, 0
        for m in minutes:
            if last is None or (m - last) * 60 >= wait:
                last, wanted = m, wanted + 1
        assert inc.suppress_cooldown(opened, wait).count() == wanted
    assert inc.suppress_cooldown(opened, 300).count() == opened.count()


def test_ungrouped_fresh_and_linked(spark):
    a = anomalies(spark, [0, 5, 60])
    members = spark.createDataFrame([("payment-api-cpu_percent-0", "i1")], no_members(spark).schema)
    assert inc.ungrouped_anomalies(a, members).count() == 2
    now = BASE + timedelta(minutes=62)
    assert inc.fresh_ungrouped(a, members, now, "payment-api", "cpu_percent").count() == 1
    assert inc.fresh_ungrouped(a, members, now, "other", "cpu_percent").count() == 2
    linked = {r["anomaly_id"][-1]: r["incident_id"] for r in inc.link_members(a, members).collect()}
    assert linked == {"0": "i1", "1": None, "2": None}


def test_resolving_and_latest_status(spark):
    a = anomalies(spark, [0, 60])
    opened = inc.group_incidents(a).select("incident_id", "service", "metric", "status", "started_at", F.lit(None).cast("timestamp").alias("resolved_at"))
    first = opened.where(F.col("started_at") == F.lit(BASE))
    at = BASE + timedelta(hours=2)
    events = inc.resolve_incident(opened, first, at, 1)
    now = {r["started_at"]: (r["status"], r["resolved_at"]) for r in inc.current_incidents(opened, events).collect()}
    assert now == {BASE: ("resolved", at), BASE + timedelta(minutes=60): ("open", None)}
    unknown = spark.createDataFrame([("nope",)], "incident_id string")
    assert inc.resolve_incident(opened, unknown, at, 2).isEmpty()
    bad = opened.withColumn("status", F.lit("closed"))
    assert inc.status_domain_audit(bad).first()["n_invalid"] == 2


def test_cooldown_of_a_million_incidents_of_one_series(spark):
    opened = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("incident_id"), F.lit("s").alias("service"), F.lit("m").alias("metric"),
        F.timestamp_seconds(F.col("id") * 601).alias("started_at"),
    )
    assert inc.suppress_cooldown(opened, 3005).count() == 200_000
