"""Default thresholds and sizes. Fixed values."""

TOP_K = 12
ENDPOINT_BREAKDOWN_LIMIT = 50
DONUT_SLICES = 5

PROFILE_WINDOW_MINUTES = 1440
TIMELINE_LIMIT = 200

CERT_WARN_DAYS = 30
CERT_CRITICAL_DAYS = 7

ALERT_BLOCK_BURST_THRESHOLD = 50
ALERT_CRED_STUFFING_MIN_EVENTS = 20
ALERT_CRED_STUFFING_FAILURE_PCT = 50.0
ALERT_SHADOW_MIN_SAMPLES = 100
ALERT_CERT_EXPIRY_DAYS = 7
CONFIG_POLL_SECONDS = 600

EVENT_RETENTION_DAYS = 7
MINUTE_METRIC_RETENTION_DAYS = 30
HOUR_METRIC_RETENTION_DAYS = 90
ALERT_RETENTION_DAYS = 90
AUDIT_RETENTION_DAYS = 180
AUDIT_TAIL_ROWS = 50

ROLLUP_LOOKBACK_DAYS = 7
ROLLUP_LAG_HOURS = 1
LATE_MINUTES = 10
