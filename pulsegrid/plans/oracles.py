"""The same queries in plain SQL over the given tables."""

from __future__ import annotations

from pulsegrid.functions import fixed_values as V
from pulsegrid.plans.fixtures import EVENT_TYPES

ORACLES: dict[str, str] = {}

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def h60(text: str) -> str:
    return f"CAST(concat('0x', substr(md5({text}), 1, 15)) AS BIGINT)"


# Common table expressions, each with those it needs.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "me": ((), """
        SELECT CAST(event_id AS VARCHAR) AS event_id, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service,
               event_type AS metric, value, ts AS timestamp,
               '{"k":"' || json_extract_string(props, '$.k') || '"}' AS labels
        FROM events"""),
    "scored": (("me",), """
        SELECT me.*, cut - value AS score
        FROM me JOIN (SELECT service, metric, quantile_cont(value, 0.95) AS cut FROM me GROUP BY ALL) USING (service, metric)"""),
    "an": (("scored",), """
        SELECT md5(concat_ws(':', 'anomaly', event_id)) AS anomaly_id, event_id, timestamp, service, metric, value,
               score, 0.0::DOUBLE AS threshold, md5(concat_ws(':', 'model', service, metric)) AS model_id
        FROM scored WHERE score < 0"""),
    "raw_messages": (("me",), f"""
        SELECT CAST(event_id AS BIGINT) * 2 + copy AS msg_id, me.*, {h60('event_id')} % 50 AS kind
        FROM me, (VALUES (0), (1)) AS c(copy)
        WHERE copy = 0 OR {h60('event_id')} % 50 = 2"""),
    "msg": (("raw_messages",), """
        SELECT *, CASE kind WHEN 0 THEN 'bad json' WHEN 1 THEN 'missing value' WHEN 3 THEN 'bad service' WHEN 4 THEN 'bad metric' WHEN 5 THEN 'bad value' END AS reason FROM raw_messages"""),
    "opened": (("ses36000",), """
        SELECT incident_id, service, metric, min(timestamp) AS started_at, max(timestamp) AS last_at, count(*) AS n
        FROM ses36000 GROUP BY ALL"""),
    "inc": (("opened",), f"""
        SELECT incident_id, service, metric, started_at,
               CASE WHEN {h60('incident_id')} % 4 = 0 THEN 'resolved' ELSE 'open' END AS status,
               CASE WHEN {h60('incident_id')} % 4 = 0 THEN started_at + INTERVAL 1 HOUR END AS resolved_at
        FROM opened"""),
    "mem": (("ses36000",), f"""
        SELECT anomaly_id, incident_id FROM ses36000 WHERE {h60('anomaly_id')} % 5 <> 0"""),
    "feed": (("inc", "mem"), """
        SELECT inc.*, (SELECT count(*) FROM mem WHERE mem.incident_id = inc.incident_id) AS anomaly_count FROM inc"""),
    "waiting": (("an", "mem"), "SELECT * FROM an WHERE anomaly_id NOT IN (SELECT anomaly_id FROM mem)"),
    "fired": (("me",), f"""
        SELECT service, metric, {AS_OF} - to_seconds({h60("concat_ws(':', 'fired', service, metric)")} % 600) AS last_fired
        FROM (SELECT DISTINCT service, metric FROM me)
        WHERE {h60("concat_ws(':', 'fired', service, metric)")} % 3 <> 0"""),
    "heads": (("waitses", "fired"), f"""
        SELECT service, metric, count(DISTINCT incident_id) AS n_groups,
               arg_min(incident_id, timestamp) AS incident_id, min(timestamp) AS started_at,
               max(last_fired) IS NULL OR {AS_OF} >= max(last_fired) + INTERVAL 300 SECOND AS fires
        FROM waitses LEFT JOIN fired USING (service, metric) GROUP BY service, metric"""),
    "ver": (("me",), f"""
        SELECT md5(concat_ws(':', 'model', service, metric, CAST(v AS VARCHAR))) AS model_id, service, metric, v,
               {AS_OF} - to_days(CAST(7 * v AS INTEGER)) AS trained_at,
               CAST(ceil(count(*) FILTER (WHERE timestamp < {AS_OF} - to_days(CAST(7 * v AS INTEGER))) * 0.8::DOUBLE) AS BIGINT) AS n_samples
        FROM me, (VALUES (0), (1), (2)) AS x(v) GROUP BY service, metric, v"""),
    "ptr": (("ver",), f"""
        SELECT service, metric, model_id, trained_at AS event_ts, 2 - v AS seq FROM ver
        UNION ALL
        SELECT service, metric, model_id, {AS_OF}, 9 FROM ver
        WHERE v = 1 AND {h60("concat_ws(':', service, metric)")} % 4 = 0"""),
    "cur": (("ptr",), """
        SELECT service, metric, model_id, event_ts AS since FROM ptr
        QUALIFY row_number() OVER (PARTITION BY service, metric ORDER BY event_ts DESC, seq DESC) = 1"""),
    "reg": (("ver", "cur"), f"""
        SELECT ver.*, trained_at - INTERVAL 30 DAY AS window_start, trained_at AS window_end,
               model_id IN (SELECT model_id FROM cur) AS is_current,
               CASE WHEN {h60('model_id')} % 10 = 0 THEN -1.0::DOUBLE ELSE ({h60("'precision:' || model_id")} % 101) / 100.0::DOUBLE END AS eval_precision,
               CASE WHEN {h60('model_id')} % 10 = 0 THEN -1.0::DOUBLE ELSE ({h60("'recall:' || model_id")} % 101) / 100.0::DOUBLE END AS eval_recall,
               CASE WHEN {h60('model_id')} % 10 = 0 THEN -1.0::DOUBLE ELSE ({h60("'f1:' || model_id")} % 101) / 100.0::DOUBLE END AS eval_f1
        FROM ver"""),
    "win": (("me",), f"""
        SELECT i AS spec_idx, service, metric, kind AS anomaly_type,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(h % 480 + i * 20) AS start, secs AS duration_seconds,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(h % 480 + i * 20) + to_seconds(secs) AS "end",
               CASE kind WHEN 'dip' THEN 0.7 WHEN 'spike' THEN 5.0 ELSE 20.0 END::DOUBLE AS magnitude
        FROM (SELECT *, CASE WHEN i % 2 = 0 THEN (1440 + h % 4000) * 60.0 ELSE (24 + h % 48) * 3600.0 END::DOUBLE AS secs
              FROM (SELECT DISTINCT service, metric, {h60("concat_ws(':', service, metric)")} AS h FROM me),
                   (VALUES (0, 'spike'), (1, 'dip'), (2, 'level_shift'), (3, 'gradual_drift')) AS t(i, kind))"""),
    "hit": (("me", "win"), """
        SELECT me.*, win.* EXCLUDE (service, metric)
        FROM me LEFT JOIN win ON me.service = win.service AND me.metric = win.metric
             AND timestamp >= win.start AND timestamp < win."end"
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY spec_idx) = 1"""),
    "manywin": (("me",), f"""
        SELECT h % 1009 AS spec_idx, service, metric, timestamp + INTERVAL 1 HOUR AS start,
               timestamp + INTERVAL 1 HOUR + to_seconds((h % 200000)::DOUBLE) AS "end", h % 200000 AS secs,
               (['spike', 'dip', 'level_shift', 'gradual_drift'])[CAST(h % 4 AS INTEGER) + 1] AS anomaly_type, h % 7 + 0.25::DOUBLE AS magnitude
        FROM (SELECT *, {h60('event_id')} AS h FROM me) WHERE h % 2 = 0 AND h % 200000 > 0"""),
    "manyhit": (("me", "manywin"), """
        SELECT me.*, m.* EXCLUDE (service, metric)
        FROM me LEFT JOIN manywin m ON me.service = m.service AND me.metric = m.metric AND timestamp >= m.start AND timestamp < m."end"
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY spec_idx, m.start, m."end", anomaly_type, magnitude) = 1"""),
    "ranked": (("me",), """
        SELECT *, row_number() OVER (PARTITION BY service, metric ORDER BY timestamp, md5(event_id)) AS rn,
               count(*) OVER (PARTITION BY service, metric) AS n FROM me"""),
}


def _sessions(name: str, source: str, gap: int) -> None:
    CTES[name] = ((source,), f"""
        SELECT * EXCLUDE (sno), md5(concat_ws(':', 'incident', service, metric,
               CAST(min(us) OVER (PARTITION BY service, metric, sno) AS VARCHAR))) AS incident_id
        FROM (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > {gap}::BIGINT * 1000000 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY service, metric ORDER BY us, event_id) AS sno
              FROM (SELECT *, epoch_us(timestamp) AS us,
                           lag(epoch_us(timestamp)) OVER (PARTITION BY service, metric ORDER BY timestamp, event_id) AS prev
                    FROM {source}))""")


def _injected(name: str, seed: int) -> None:
    key = f"concat_ws(':', '{seed}', event_id)"
    CTES[name] = (("me",), f"""
        SELECT *, pos <= greatest(1, floor(n * 0.05::DOUBLE)) AS sampled,
               value * (5.0::DOUBLE + 5.0::DOUBLE * ({h60(f"concat_ws(':', 'factor', '{seed}', event_id)")} / 1152921504606846976.0::DOUBLE)) AS spiked
        FROM (SELECT *, row_number() OVER (PARTITION BY service, metric ORDER BY md5({key})) AS pos,
                     count(*) OVER (PARTITION BY service, metric) AS n FROM me)""")


_sessions("ses600", "an", 600)
_sessions("ses36000", "an", 36_000)
_sessions("waitses", "waiting", 36_000)
_injected("inj42", 42)
_injected("inj7", 7)


def _needs(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needs(CTES[name][0], seen)
            seen.append(name)
    return seen


def oracle(name: str, needs: str, body: str) -> None:
    parts = [f"{n} AS ({CTES[n][1]})" for n in _needs(tuple(needs.split()), [])]
    ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + body


def rollup_sql(width: str, source: str = "me", where: str = "TRUE") -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', timestamp) AS bucket, service, metric, round(avg(value), 4) AS avg_value,
               min(value) AS min_value, max(value) AS max_value, count(*) AS sample_count
               FROM {source} WHERE {where} GROUP BY ALL"""


LONG_LINEITEM = """(
    SELECT l_returnflag || l_linestatus AS service, l_shipdate AS timestamp,
           unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS metric,
           unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"""


def confusion_sql(source: str) -> str:
    return f"""SELECT service, metric, tp, fp, fn,
        CASE WHEN tp + fn = 0 THEN -1.0::DOUBLE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fp), 4) END AS precision,
        CASE WHEN tp + fn = 0 THEN -1.0::DOUBLE ELSE round(tp::DOUBLE / (tp + fn), 4) END AS recall,
        CASE WHEN tp + fn = 0 THEN -1.0::DOUBLE ELSE round(2 * tp::DOUBLE / (2 * tp + fp + fn), 4) END AS f1
        FROM (SELECT service, metric, count(*) FILTER (truth AND hit) AS tp, count(*) FILTER (NOT truth AND hit) AS fp,
                     count(*) FILTER (truth AND NOT hit) AS fn FROM ({source}) GROUP BY ALL)"""


# --- ingest -------------------------------------------------------------------------------------

oracle("metric_events", "me", "SELECT * FROM me")
oracle("parse_events", "msg", """
    SELECT msg_id, event_id, service, metric, value, timestamp, reason FROM msg WHERE reason IS NULL
    UNION ALL SELECT msg_id, NULL, NULL, NULL, NULL, NULL, reason FROM msg WHERE reason IS NOT NULL""")
oracle("validate_events", "msg", "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM msg GROUP BY ALL")
oracle("accept_request", "msg", """
    SELECT msg_id // 400 AS request, count(*) AS n_events, count(reason) AS n_bad, count(reason) = 0 AS accepted
    FROM msg GROUP BY ALL""")
oracle("dedupe_first", "msg", """
    SELECT msg_id, event_id, service, metric, value FROM msg WHERE reason IS NULL
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY msg_id) = 1""")
oracle("insert_if_absent", "msg", """
    SELECT msg_id, event_id, timestamp, service, metric, value FROM msg
    WHERE reason IS NULL AND timestamp >= TIMESTAMP '2024-01-20 00:00:00'
    QUALIFY row_number() OVER (PARTITION BY timestamp, event_id ORDER BY msg_id) = 1""")
oracle("insert_anomalies", "an", """
    SELECT anomaly_id, event_id, timestamp, 'open' AS status, round(score, 4) AS score FROM an
    WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00'""")
oracle("batch_accounting", "msg", """
    SELECT batch, count(*) AS received, count(reason) AS rejected,
           count(*) FILTER (reason IS NULL AND first_one AND timestamp >= TIMESTAMP '2024-01-10 00:00:00') AS inserted,
           count(*) FILTER (reason IS NULL AND NOT (first_one AND timestamp >= TIMESTAMP '2024-01-10 00:00:00')) AS skipped
    FROM (SELECT *, msg_id // 1000 AS batch,
                 row_number() OVER (PARTITION BY event_id ORDER BY msg_id) = 1 AS first_one FROM msg)
    GROUP BY ALL""")
oracle("completeness_audit", "me", """
    SELECT service, metric, 120::BIGINT AS expected, n AS stored, n >= 120 AS complete
    FROM (SELECT service, metric, count(*) FILTER (timestamp >= TIMESTAMP '2024-01-10 00:00:00'
                 AND timestamp < TIMESTAMP '2024-01-20 00:00:00') AS n FROM me GROUP BY ALL)""")
oracle("write_metrics_table", "me", """
    SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS n, max(value) AS top FROM me GROUP BY ALL""")
oracle("jsonl_round_trip", "me", "SELECT * FROM me")
oracle("save_and_load_tables", "opened", """
    SELECT CASE WHEN started_at < TIMESTAMP '2024-01-16 00:00:00' THEN 'r1' ELSE 'r2' END AS run_id, service, metric,
           count(*) AS n, min(started_at) AS first FROM opened GROUP BY ALL""")

# --- projections and reads ----------------------------------------------------------------------

oracle("load_series", "me", """
    SELECT timestamp, value FROM me WHERE service = 'svc-1' AND metric = 'click'
    AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-25 00:00:00'""")
oracle("discover_pairs", "me", "SELECT DISTINCT service, metric FROM me WHERE timestamp >= TIMESTAMP '2024-01-30 12:00:00'")
oracle("optional_filter", "inc", """
    SELECT service, metric, count(*) AS n, 'none' AS filter FROM inc GROUP BY ALL
    UNION ALL SELECT service, metric, count(*), status FROM inc GROUP BY ALL""")
oracle("out_of_range_readings", "me", """
    SELECT service, metric, count(*) FILTER (timestamp > TIMESTAMP '2024-01-25 06:01:00') AS n_future,
           count(*) FILTER (timestamp < TIMESTAMP '2024-01-11 06:00:00') AS n_too_old,
           count(*) FILTER (timestamp >= TIMESTAMP '2024-01-25 03:00:00' AND timestamp < TIMESTAMP '2024-01-25 06:00:00') AS n_default_window,
           count(*) AS n_total FROM me GROUP BY ALL""")
oracle("parse_iso_utc", "me", f"""
    SELECT event_id, CASE {h60('event_id')} % 6 WHEN 0 THEN timestamp WHEN 1 THEN timestamp
           WHEN 2 THEN timestamp - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('second', timestamp)
           WHEN 4 THEN date_trunc('day', timestamp)::TIMESTAMP END AS parsed FROM me""")
oracle("health_status", "inc me", """
    SELECT service, metric, n, CASE WHEN n = 0 THEN 'healthy' WHEN n <= 2 THEN 'degraded' ELSE 'critical' END AS health
    FROM (SELECT service, metric, count(*) FILTER (status = 'open') AS n FROM inc GROUP BY ALL
          UNION ALL SELECT service, 'all', count(DISTINCT metric) FROM me GROUP BY ALL)""")
oracle("score_tier", "reg", """
    SELECT model_id, eval_f1, CASE WHEN eval_f1 < 0 THEN 'not evaluated' WHEN eval_f1 >= 0.8 THEN 'good'
           WHEN eval_f1 >= 0.6 THEN 'fair' ELSE 'poor' END AS tier FROM reg""")
oracle("is_anomaly", "scored", """
    SELECT metric, t::DOUBLE AS threshold, count(*) FILTER (score < t) AS n
    FROM scored, (VALUES (-100.0), (-50.0), (0.0), (25.0)) AS x(t) GROUP BY metric, t""")
oracle("rethreshold", "an", """
    SELECT service, metric, count(*) FILTER (score < -40) AS n_kept, count(*) FILTER (score >= -40) AS n_dropped
    FROM an GROUP BY ALL""")
oracle("resolved_flag", "an mem inc", """
    SELECT anomaly_id, coalesce(status, 'open') <> 'open' AS resolved
    FROM an LEFT JOIN mem USING (anomaly_id) LEFT JOIN inc USING (incident_id)""")
oracle("status_domain_audit", "inc", f"""
    SELECT count(*) AS n_rows, count(*) FILTER (odd) AS n_invalid, count(*) FILTER (NOT odd AND status = 'open') AS n_open
    FROM (SELECT status, {h60('incident_id')} % 7 = 0 AS odd FROM inc)""")
oracle("series_points_auto_short", "me", f"""
    SELECT * EXCLUDE (service, metric) FROM ({rollup_sql('10 seconds', where='''service = 'svc-2' AND metric = 'view'
    AND timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-10 02:00:00' ''')}) ORDER BY bucket LIMIT 500""")
oracle("series_points_auto_long", "me", f"""
    SELECT * EXCLUDE (service, metric) FROM ({rollup_sql('1 minute', where='''service = 'svc-2' AND metric = 'view' ''')})
    WHERE bucket >= TIMESTAMP '2024-01-02 00:00:00' AND bucket < TIMESTAMP '2024-01-30 00:00:00' ORDER BY bucket LIMIT 500""")
oracle("metrics_for_service", "reg", "SELECT metric FROM reg WHERE is_current AND service = 'svc-3'")
oracle("relative_window", "me", """
    SELECT service, count(*) AS n, p AS preset FROM me, (VALUES ('1h', 1), ('3h', 3), ('24h', 24), ('7d', 168)) AS x(p, h)
    WHERE timestamp >= TIMESTAMP '2024-01-30 12:00:00' - to_hours(h) AND timestamp < TIMESTAMP '2024-01-30 12:00:00' GROUP BY service, p""")
oracle("ungrouped_anomalies", "waiting", "SELECT anomaly_id, service, metric, timestamp FROM waiting")
oracle("fresh_ungrouped", "waiting", """
    SELECT anomaly_id, service, metric, timestamp FROM waiting
    WHERE NOT (service = 'svc-1' AND metric = 'error' AND timestamp < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 864000 SECOND)""")

# --- joins --------------------------------------------------------------------------------------

oracle("service_overview", "me inc an", """
    SELECT service, coalesce(open_incidents, 0) AS open_incidents, last_anomaly_at,
           CASE WHEN coalesce(open_incidents, 0) = 0 THEN 'healthy' WHEN open_incidents <= 2 THEN 'degraded' ELSE 'critical' END AS health
    FROM (SELECT DISTINCT service FROM me)
    LEFT JOIN (SELECT service, count(*) AS open_incidents FROM inc WHERE status = 'open' GROUP BY service) USING (service)
    LEFT JOIN (SELECT service, max(timestamp) AS last_anomaly_at FROM an GROUP BY service) USING (service)""")
oracle("incident_feed", "feed", "SELECT * FROM feed ORDER BY started_at DESC, incident_id LIMIT 50 OFFSET 10")
oracle("attach_current_model", "me cur", """
    SELECT service, metric, model_id, count(*) AS n FROM me JOIN cur USING (service, metric) GROUP BY ALL""")
oracle("apply_anomaly_schedule", "hit", """
    SELECT event_id, spec_idx IS NOT NULL AS is_anomalous, round(CASE anomaly_type
             WHEN 'spike' THEN value * magnitude WHEN 'dip' THEN value * (1.0::DOUBLE - magnitude)
             WHEN 'level_shift' THEN value + magnitude
             WHEN 'gradual_drift' THEN value + magnitude * ((epoch_us(timestamp) - epoch_us(start)) / (duration_seconds * 1000000))
             ELSE value END, 4) AS value FROM hit""")
oracle("schedule_indexed", "manyhit", """
    SELECT event_id, spec_idx, spec_idx IS NOT NULL AS is_anomalous, round(CASE anomaly_type
             WHEN 'spike' THEN value * magnitude WHEN 'dip' THEN value * (1.0::DOUBLE - magnitude)
             WHEN 'level_shift' THEN value + magnitude
             WHEN 'gradual_drift' THEN value + magnitude * ((epoch_us(timestamp) - epoch_us(start)) / (secs::DOUBLE * 1000000))
             ELSE value END, 4) AS value FROM manyhit""")
oracle("first_matching_spec", "hit", "SELECT service, metric, spec_idx, count(*) AS n FROM hit GROUP BY ALL")
oracle("injected_count", "hit", "SELECT service, metric, count(spec_idx) AS n_injected, count(*) AS n FROM hit GROUP BY ALL")
oracle("score_against_truth", "scored hit", confusion_sql(
    "SELECT scored.service, scored.metric, score < 0 AS hit, spec_idx IS NOT NULL AS truth FROM scored JOIN hit USING (event_id)"))
oracle("annotate_buckets_exact", "me an", """
    SELECT me.event_id, max_by(an.value, an.anomaly_id) AS anomaly_value, round(max_by(score, an.anomaly_id), 4) AS anomaly_score
    FROM me LEFT JOIN an ON me.service = an.service AND me.metric = an.metric AND me.timestamp = an.timestamp GROUP BY me.event_id""")
oracle("annotate_buckets_aligned", "me an", f"""
    SELECT service, metric, bucket, sample_count, anomaly_value, anomaly_score FROM ({rollup_sql('1 hour')})
    LEFT JOIN (SELECT service, metric, time_bucket(INTERVAL '1 hour', timestamp) AS bucket,
                      arg_max(value, timestamp) AS anomaly_value, round(arg_max(score, timestamp), 4) AS anomaly_score
               FROM an GROUP BY ALL) USING (service, metric, bucket)""")
oracle("incident_of_event", "an mem inc", """
    SELECT event_id, anomaly_id, incident_id, status, started_at, round(score, 4) AS score
    FROM an JOIN mem USING (anomaly_id) JOIN inc USING (incident_id)""")
oracle("link_members", "an mem", "SELECT anomaly_id, event_id, incident_id FROM an LEFT JOIN mem USING (anomaly_id)")

# --- aggregates ---------------------------------------------------------------------------------

oracle("rollup_1min", "me", rollup_sql("1 minute"))
oracle("rollup_10s", "me", f"""
    SELECT * EXCLUDE (service, metric) FROM ({rollup_sql('10 seconds', where='''service = 'svc-0' AND metric = 'signup' ''')})
    ORDER BY bucket LIMIT 500""")
oracle("rebuild_rollup", "me", rollup_sql(
    "1 minute", where="timestamp >= TIMESTAMP '2024-01-08 00:00:00' AND timestamp < TIMESTAMP '2024-01-22 00:00:00'"))
oracle("rollup_lineitem", "", f"""
    SELECT bucket, service, metric, min_value, max_value, sample_count, total FROM (
        SELECT *, round(sum_value, 2) AS total FROM ({rollup_sql("1 minute", LONG_LINEITEM).replace(
            "round(avg(value), 4) AS avg_value", "sum(value) AS sum_value")}))""")
oracle("open_incident_counts", "inc", "SELECT service, count(*) AS open_incidents FROM inc WHERE status = 'open' GROUP BY ALL")
oracle("last_anomaly_at", "an", "SELECT service, max(timestamp) AS last_anomaly_at FROM an GROUP BY ALL")
oracle("incident_anomaly_count", "feed", "SELECT incident_id, status, anomaly_count FROM feed")
oracle("avg_f1_evaluated", "reg", """
    SELECT round(avg(eval_f1) FILTER (eval_f1 >= 0), 4) AS avg_f1, count(*) FILTER (eval_f1 >= 0) AS n_evaluated,
           coalesce(avg(eval_f1) FILTER (eval_f1 >= 0) >= 0.6, false) AS passes FROM reg""")
oracle("registry_audit", "reg", """
    SELECT count(*) AS n_total, count(*) FILTER (is_current) AS n_current,
           count(*) FILTER (is_current AND eval_f1 > 0) AS n_current_scored,
           count(*) FILTER (is_current AND eval_f1 < 0) AS n_current_not_evaluated FROM reg""")
oracle("score_range_audit", "reg", f"""
    SELECT count(*) FILTER (eval_f1 >= 0) AS n_evaluated, count(*) FILTER (eval_f1 >= 0 AND
           (eval_precision NOT BETWEEN 0 AND 1 OR recall NOT BETWEEN 0 AND 1 OR eval_f1 NOT BETWEEN 0 AND 1)) AS n_out_of_range
    FROM (SELECT *, CASE WHEN {h60('model_id')} % 9 = 0 THEN eval_recall + 1 ELSE eval_recall END AS recall FROM reg)""")
oracle("confusion_scores", "inj7", confusion_sql(
    "SELECT service, metric, sampled AS truth, CASE WHEN sampled THEN spiked ELSE value END > 120 AS hit FROM inj7"))
oracle("contamination_offset", "scored", """
    SELECT service, metric, round(quantile_cont(score, 0.05), 4) AS "offset" FROM scored GROUP BY ALL""")
oracle("incident_members_agg", "an mem", """
    SELECT incident_id, count(*) AS n_members, min(timestamp) AS started_at,
           arg_min(anomaly_id, timestamp) AS first_anomaly_id, arg_max(anomaly_id, timestamp) AS last_anomaly_id
    FROM mem JOIN an USING (anomaly_id) GROUP BY ALL""")
oracle("incident_member_list", "an mem", """
    SELECT incident_id, anomaly_id, timestamp,
           row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, anomaly_id) AS member_no
    FROM mem JOIN an USING (anomaly_id)""")
oracle("anomalies_in_window", "an", """
    SELECT service, metric, count(*) AS n_anomalies FROM an
    WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL""")

# --- ordered operators --------------------------------------------------------------------------

for _gap in (600, 36_000):
    oracle(f"group_incidents_{_gap}", f"ses{_gap}", f"""
        SELECT incident_id, service, metric, min(timestamp) AS started_at, max(timestamp) AS last_at, count(*) AS n_anomalies
        FROM ses{_gap} GROUP BY ALL""")
oracle("incident_members", "ses36000", "SELECT anomaly_id, incident_id FROM ses36000")
oracle("chrono_split", "ranked", """
    SELECT event_id, CASE WHEN rn <= ceil(n * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'train' ELSE 'holdout' END AS part FROM ranked""")
oracle("min_sample_gate", "me", """
    SELECT service, concat_ws('@', metric, strftime(timestamp, '%Y-%m-%d')) AS metric, count(*) AS n FROM me
    GROUP BY ALL HAVING count(*) >= 14""")
oracle("current_models", "cur", "SELECT * FROM cur")
oracle("rollback_model", "cur ver", """
    SELECT service, metric, CASE WHEN service = 'svc-2' AND metric = 'click' THEN
           (SELECT model_id FROM ver WHERE service = 'svc-2' AND metric = 'click' AND v = 2) ELSE model_id END AS model_id,
           CASE WHEN service = 'svc-2' AND metric = 'click' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE since END AS since FROM cur""")
oracle("sample_rows", "inj42", "SELECT event_id, sampled FROM inj42")
oracle("inject_anomalies", "inj42", """
    SELECT event_id, round(CASE WHEN sampled THEN spiked ELSE value END, 3) AS value,
           CASE WHEN sampled THEN 1 ELSE 0 END AS truth FROM inj42""")
oracle("suppress_cooldown", "opened", "SELECT 1")
ORACLES["suppress_cooldown"] = ORACLES["suppress_cooldown"].replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("SELECT 1") + """
    , replay AS (
        SELECT service, metric, min(started_at) AS started_at FROM opened GROUP BY ALL
        UNION ALL
        SELECT o.service, o.metric, o.started_at FROM replay r JOIN opened o
            ON o.service = r.service AND o.metric = r.metric AND o.started_at = (
               SELECT min(started_at) FROM opened x WHERE x.service = r.service AND x.metric = r.metric
               AND x.started_at >= r.started_at + INTERVAL 172800 SECOND))
    SELECT incident_id, service, metric, started_at FROM replay JOIN opened USING (service, metric, started_at)"""
ORACLES["stream_suppress"] = ORACLES["suppress_cooldown"]
oracle("resolve_incident", "inc", f"""
    SELECT incident_id, service, metric, started_at,
           CASE WHEN started_at >= TIMESTAMP '2024-01-25 00:00:00' THEN 'resolved' ELSE status END AS status,
           CASE WHEN started_at >= TIMESTAMP '2024-01-25 00:00:00' THEN greatest({AS_OF}, resolved_at) ELSE resolved_at END AS resolved_at FROM inc""")
oracle("alert_cycle", "heads", "SELECT incident_id, service, metric, 'open' AS status, started_at FROM heads WHERE fires")
oracle("alert_cycle_members", "heads waitses", """
    SELECT anomaly_id, incident_id FROM waitses WHERE incident_id IN (SELECT incident_id FROM heads WHERE fires)""")
oracle("alert_cycle_counts", "heads", """
    SELECT count(*) FILTER (fires) AS created, CAST(sum(n_groups) - count(*) FILTER (fires) AS BIGINT) AS suppressed FROM heads""")

# --- pages --------------------------------------------------------------------------------------

oracle("series_points", "me", f"""
    SELECT * EXCLUDE (service, metric) FROM ({rollup_sql('1 minute', where='''service = 'svc-4' AND metric = 'error' ''')})
    ORDER BY bucket LIMIT 500""")
oracle("incident_page", "inc", "SELECT * FROM inc WHERE status = 'resolved' ORDER BY started_at DESC, incident_id LIMIT 40 OFFSET 5")
oracle("model_list", "reg", """
    SELECT model_id, service, metric, trained_at, n_samples, eval_f1, is_current FROM reg
    ORDER BY trained_at DESC, model_id LIMIT 200""")
oracle("model_list_current", "reg", """
    SELECT model_id, service, metric, trained_at, window_start, window_end, n_samples FROM reg
    WHERE is_current AND service = 'svc-1' ORDER BY trained_at DESC, model_id LIMIT 200""")
_open_feed = "SELECT * EXCLUDE (resolved_at) FROM feed WHERE status = 'open'"
oracle("recent_open_incidents", "feed", f"{_open_feed} ORDER BY started_at DESC, incident_id LIMIT 10")
oracle("service_open_incidents", "feed", f"""
    SELECT * FROM ({_open_feed} ORDER BY started_at DESC, incident_id LIMIT 50) WHERE service = 'svc-1'""")
oracle("service_open_incidents_paged", "feed", f"""
    {_open_feed} AND service = 'svc-1' ORDER BY started_at DESC, incident_id LIMIT 50""")
oracle("anomaly_markers", "an", """
    SELECT timestamp, value, round(score, 4) AS score FROM an WHERE service = 'svc-3' AND metric = 'purchase'
    AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-28 00:00:00'""")

# --- scalar functions ---------------------------------------------------------------------------

oracle("time_bucket", "me", """
    SELECT event_id, time_bucket(INTERVAL '1 minute', timestamp) AS minute, time_bucket(INTERVAL '10 seconds', timestamp) AS ten FROM me""")
_profile = """(
    SELECT service, metric, part, step, CASE WHEN part = 'all' THEN mean ELSE mean / nullif(max(mean) FILTER (part = 'all') OVER s, 0) END AS factor
    FROM (SELECT service, metric, part, step, avg(value) AS mean FROM (
              SELECT service, metric, value, unnest(['all', 'hour', 'weekday']) AS part,
                     unnest([0, hour(timestamp), isodow(timestamp) - 1])::INTEGER AS step FROM me) GROUP BY ALL)
    WINDOW s AS (PARTITION BY service, metric))"""
oracle("seasonality", "me", f"SELECT service, metric, part, step, round(factor, 6) AS factor FROM {_profile}")
oracle("expected_baseline", "me", f"""
    SELECT event_id, round(a.factor * h.factor * d.factor, 4) AS baseline FROM me
    JOIN {_profile} a ON a.service = me.service AND a.metric = me.metric AND a.part = 'all'
    JOIN {_profile} h ON h.service = me.service AND h.metric = me.metric AND h.part = 'hour' AND h.step = hour(timestamp)
    JOIN {_profile} d ON d.service = me.service AND d.metric = me.metric AND d.part = 'weekday' AND d.step = isodow(timestamp) - 1""")
oracle("labels_round_trip", "", "SELECT CAST(event_id AS VARCHAR) AS event_id, json_extract_string(props, '$.k') AS k FROM events")
oracle("offset_to_window", "win", """
    SELECT spec_idx, service, metric, anomaly_type, start, "end", duration_seconds, magnitude FROM win""")
oracle("ground_truth_windows", "win", """
    SELECT service, metric, anomaly_type, start, "end", duration_seconds, magnitude FROM win""")
oracle("predict", "scored", """
    SELECT event_id, CASE WHEN score < 0 THEN -1 ELSE 1 END AS prediction, CASE WHEN score < 0 THEN 1 ELSE 0 END AS label FROM scored""")
oracle("deterministic_id", "me", "SELECT event_id, md5(concat_ws(':', 'event', service, metric, event_id)) AS id FROM me")
oracle("rank_detector", "scored", "SELECT event_id, round(score, 4) AS score FROM scored")

# --- models: what does not depend on the random splits ----------------------------------------------

_window = f"timestamp >= {AS_OF} - INTERVAL 30 DAY AND timestamp < {AS_OF}"
oracle("fit_isolation_forest", "me", f"""
    SELECT service, metric, CAST(least(25600, ceil(count(*) * (1.0::DOUBLE - 0.2::DOUBLE))) AS BIGINT) AS n_fit, true AS whole
    FROM me WHERE {_window} GROUP BY ALL HAVING count(*) >= 10""")
oracle("train_all", "me", f"""
    SELECT service, metric, md5(concat_ws(':', 'model', service, metric, '2024-01-31 00:00:00')) AS model_id,
           concat_ws('/', 'models', service, metric, md5(concat_ws(':', 'model', service, metric, '2024-01-31 00:00:00'))) AS artifact_path,
           'isolation_forest' AS algorithm, {AS_OF} AS trained_at, {AS_OF} - INTERVAL 30 DAY AS window_start, {AS_OF} AS window_end,
           CAST(n_train AS BIGINT) AS n_samples, true AS is_current, true AS evaluated,
           CAST(greatest(1, floor((n - n_train) * 0.05::DOUBLE)) AS BIGINT) AS n_injected
    FROM (SELECT service, metric, count(*) AS n, ceil(count(*) * (1.0::DOUBLE - 0.2::DOUBLE)) AS n_train
          FROM me WHERE {_window} GROUP BY ALL HAVING count(*) >= 10)""")

_models = f"(SELECT service, metric, count(*) AS n FROM me WHERE {_window} GROUP BY ALL HAVING count(*) >= 10)"
oracle("model_fit_stats", "me", f"""
    SELECT service, metric, CAST(ceil(n * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT) AS n_samples, true AS timed FROM {_models}""")
for _name in ("score_events", "score_events_sorted"):
    oracle(_name, "me", f"SELECT service, metric, count(*) AS n, 0::BIGINT AS n_wrong FROM me JOIN (SELECT service, metric FROM {_models}) USING (service, metric) GROUP BY ALL")
oracle("evaluate_holdout", "me", f"""
    SELECT service, metric, CAST(greatest(1, floor((n - ceil(n * (1.0::DOUBLE - 0.2::DOUBLE))) * 0.05::DOUBLE)) AS BIGINT) AS n_injected,
           true AS sound FROM {_models}""")
oracle("trained_quality", "me", f"SELECT count(*) AS n_evaluated, true AS useful, true AS gate_agrees FROM {_models}")
oracle("save_and_load_models", "me", f"SELECT service, metric, true AS same FROM {_models}")
for _name in ("detect", "detect_sorted", "stream_score"):
    oracle(_name, "me", f"""
        SELECT service, metric, count(*) AS n_readings, 0::BIGINT AS n_missed, 0::BIGINT AS n_extra, true AS few
        FROM me JOIN (SELECT service, metric FROM {_models}) USING (service, metric) GROUP BY ALL""")

# --- streams ------------------------------------------------------------------------------------

oracle("stream_dedup", "me", "SELECT * EXCLUDE (labels) FROM me")
oracle("stream_dedup_late", "me", "SELECT * EXCLUDE (labels) FROM me")
oracle("stream_rollup_1min", "me", rollup_sql("1 minute"))
oracle("stream_late_data", "me", rollup_sql("1 minute"))
oracle("rollup_refresh", "me", rollup_sql("1 minute"))
oracle("series_points_auto_stored", "me", f"""
    SELECT * EXCLUDE (service, metric) FROM ({rollup_sql('1 minute', where='''service = 'svc-2' AND metric = 'view' ''')})
    WHERE bucket >= TIMESTAMP '2024-01-02 00:00:00' AND bucket < TIMESTAMP '2024-01-30 00:00:00' ORDER BY bucket LIMIT 500""")
oracle("stream_rollup_fresh", "me", rollup_sql("1 minute", where="timestamp < TIMESTAMP '2024-01-20 12:00:00'"))
oracle("stream_incidents", "ses36000", """
    SELECT service, metric, min(timestamp) AS started_at, max(timestamp) AS last_at, count(*) AS n_anomalies
    FROM ses36000 GROUP BY service, metric, incident_id""")
oracle("stream_incident_merge", "ses36000", """
    SELECT service, metric, min(timestamp) AS started_at, max(timestamp) AS last_at, count(*) AS n_anomalies, count(DISTINCT anomaly_id) AS n_members
    FROM ses36000 GROUP BY service, metric, incident_id""")
oracle("stream_model_refresh", "", "SELECT h AS half, 0::BIGINT AS n_by_other_models, true AS any FROM (VALUES (0), (1)) AS x(h)")
oracle("stream_alert_cycle", "", "SELECT c AS cycle, true AS created_right, true AS waiting_right FROM (VALUES (0), (1), (2), (3)) AS x(c)")
ORACLES["alert_cycle_compacted"] = ORACLES["stream_alert_cycle"]
oracle("stream_ingest_restart", "msg", """
    SELECT unnest(['received', 'rejected', 'inserted', 'skipped', 'stored', 'ids', 'quarantined']) AS what,
           unnest([2 * n, 2 * bad, ids, 2 * (n - bad) - ids, ids, ids, 2 * bad]) AS n
    FROM (SELECT count(*) AS n, count(reason) AS bad, count(DISTINCT event_id) FILTER (reason IS NULL) AS ids FROM msg)""")
oracle("stream_queue_source", "msg", """
    SELECT unnest(['received', 'rejected', 'inserted', 'skipped', 'stored', 'ids']) AS what, unnest([n, bad, ids, n - bad - ids, ids, ids]) AS n
    FROM (SELECT count(*) AS n, count(reason) AS bad, count(DISTINCT event_id) FILTER (reason IS NULL) AS ids FROM msg)""")
oracle("ingest_torn_write", "msg", "SELECT DISTINCT event_id, service, metric, value, timestamp FROM msg WHERE reason IS NULL")
oracle("dead_letters", "msg", """
    SELECT unnest(['kept', 'ids', 'inserted', 'dead_lettered']) AS what, unnest([ids, ids, 0, ids]) AS n
    FROM (SELECT count(DISTINCT event_id) FILTER (reason IS NULL) AS ids FROM msg)""")
oracle("insert_first_arrival", "msg", "SELECT DISTINCT event_id, round(value + 1000, 4) AS value FROM msg WHERE reason IS NULL")
oracle("accepted_events", "msg", """
    SELECT msg_id // 40 AS request, msg_id, event_id, value FROM msg
    WHERE msg_id // 40 NOT IN (SELECT msg_id // 40 FROM msg WHERE reason IS NOT NULL)""")
_default = ", ".join(
    f"({n}, 'svc-{list(dict.fromkeys(r[0] for r in V.DEFAULT_SCHEDULE)).index(r[0])}', '{EVENT_TYPES[V.METRIC_TYPES.index(r[1]) % 5]}', '{r[2]}', {r[3]}::DOUBLE, {r[4] * 60 if r[4] else r[5] * 3600}::DOUBLE, {r[6]}::DOUBLE)"
    for n, r in enumerate(V.DEFAULT_SCHEDULE)
)
oracle("apply_default_schedule", "me", f"""
    SELECT service, metric, spec_idx, count(*) AS n, round(sum(CASE kind WHEN 'spike' THEN value * amount - value WHEN 'dip' THEN value * (1.0::DOUBLE - amount) - value
             WHEN 'level_shift' THEN amount WHEN 'gradual_drift' THEN amount * (epoch_us(timestamp) - begin_us) / (length * 1000000) ELSE 0 END), 3) AS moved
    FROM (SELECT me.service, me.metric, me.value, me.timestamp, c.spec_idx, c.kind, c.amount, c.length, c.begin_us
          FROM me LEFT JOIN (SELECT *, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + start * 3600000000 AS begin_us FROM (VALUES {_default}) AS d(spec_idx, service, metric, kind, start, length, amount)) c
          ON c.service = me.service AND c.metric = me.metric AND epoch_us(me.timestamp) >= c.begin_us AND epoch_us(me.timestamp) < c.begin_us + c.length * 1000000
          QUALIFY row_number() OVER (PARTITION BY me.event_id ORDER BY c.spec_idx) = 1) GROUP BY ALL""")
oracle("quantile_narrowed", "", f"SELECT service, metric, round(quantile_cont(value, 0.95), 4) AS q FROM {LONG_LINEITEM} GROUP BY ALL")
_long = LONG_LINEITEM.replace("l_shipdate AS timestamp,", "l_shipdate AS timestamp, l_orderkey || '-' || l_linenumber || '-' AS line_id,")
oracle("chrono_split_narrowed", "", f"""
    SELECT service, metric, CASE WHEN pos <= ceil(total * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'train' ELSE 'holdout' END AS part,
           count(*) AS n, min(timestamp) AS first, max(timestamp) AS last
    FROM (SELECT *, row_number() OVER (PARTITION BY service, metric ORDER BY timestamp, md5(line_id || metric)) AS pos,
                 count(*) OVER (PARTITION BY service, metric) AS total FROM {_long}) GROUP BY ALL""")
oracle("sample_rows_narrowed", "inj42", "SELECT event_id, sampled FROM inj42")
oracle("number_rows_spread", "me", """
    SELECT event_id, row_number() OVER (PARTITION BY service, metric ORDER BY timestamp, event_id) AS n FROM me""")
oracle("stream_ingest", "msg", "SELECT DISTINCT event_id, service, metric, value, timestamp FROM msg WHERE reason IS NULL")
oracle("stream_quarantine", "msg", "SELECT reason, count(*) AS n FROM msg WHERE reason IS NOT NULL GROUP BY ALL")
oracle("stream_accounting", "msg", """
    SELECT count(*) AS received, count(reason) AS rejected, count(DISTINCT event_id) FILTER (reason IS NULL) AS inserted,
           count(*) FILTER (reason IS NULL) - count(DISTINCT event_id) FILTER (reason IS NULL) AS skipped FROM msg""")
ORACLES["insert_indexed"] = ORACLES["insert_if_absent"]
ORACLES["stream_ingest_indexed"] = ORACLES["stream_ingest"]
ORACLES["score_against_truth_indexed"] = ORACLES["score_against_truth"]
oracle("quantile_from_daily", "me", "SELECT service, metric, round(quantile_cont(value, 0.95), 4) AS q FROM me GROUP BY ALL")
