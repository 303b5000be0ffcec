"""Schemas of the engine's records; all are fixed, none is inferred. Times in ``ts`` are epoch milliseconds."""

from __future__ import annotations

EVENT = "key string, value string, ts bigint"
USER_BEHAVIOR = "userId string, productId string, categoryId string, type string, ts bigint"
PRODUCT_VIEW_PER_WINDOW = "productId string, count bigint, windowStartTime timestamp, windowEndTime timestamp"
USER_VIEW_COUNT_PER_WINDOW = "username string, count bigint, windowStartTime timestamp, windowEndTime timestamp"
STATISTIC = "min bigint, max bigint, sum bigint, count bigint, avg bigint"
SENSOR_READING = "sensorId string, temperature double, ts bigint"
KEYED_SECONDS = "f0 string, f1 bigint"
CLICKS = "user string, url string, ts timestamp"
EVENTS_TABLE = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
