"""The numbers and names below must equal the published behaviour for right results."""

# Metric names of the event model.
METRIC_TYPES = (
    "cpu_percent",
    "memory_percent",
    "request_rate",
    "latency_p50",
    "latency_p95",
    "latency_p99",
    "error_rate",
)

# Incident and anomaly statuses.
STATUSES = ("open", "resolved", "suppressed")

# Anomaly kinds of a schedule.
ANOMALY_TYPES = ("spike", "dip", "level_shift", "gradual_drift")

# Default schedule (service, metric, type, start_offset_hours, duration_minutes, duration_hours, magnitude).
DEFAULT_SCHEDULE = (
    ("payment-api", "cpu_percent", "spike", 24.0, 30.0, None, 5.0),
    ("auth-service", "error_rate", "spike", 60.0, 20.0, None, 15.0),
    ("inventory-db", "memory_percent", "gradual_drift", 36.0, None, 48.0, 20.0),
    ("notification-service", "latency_p99", "spike", 120.0, 45.0, None, 8.0),
    ("api-gateway", "request_rate", "dip", 96.0, 60.0, None, 0.7),
    ("payment-api", "latency_p95", "level_shift", 144.0, None, 12.0, 200.0),
)

# Defaults of the stages.
GROUPING_SECONDS = 600
SUPPRESSION_SECONDS = 300
TRAINING_DAYS = 30
HOLDOUT_FRACTION = 0.2
CONTAMINATION = 0.05
MIN_SAMPLES = 10
N_TREES = 100
MAX_TREE_ROWS = 256
FOREST_SEED = 42
INJECT_FRACTION = 0.05
SPIKE_LOW, SPIKE_HIGH = 5.0, 10.0
ANOMALY_THRESHOLD = 0.0
ROLLUP_ROUTE_HOURS = 2.0
MAX_POINTS = 500
MAX_MODELS = 200
FEED_LIMIT, FEED_LIMIT_MAX = 50, 500
RECENT_OPEN = 10
MAX_WINDOW_DAYS = 30
DEFAULT_WINDOW_HOURS = 3
FUTURE_SLACK_SECONDS = 60
FRESH_SECONDS = 300
ROLLUP_REFRESH = "3 hours"
MIN_AVG_F1 = 0.60

# Look-back presets in hours.
WINDOW_PRESETS = {"1h": 1, "3h": 3, "24h": 24, "7d": 168}
