"""The registered queries in SQL over the same tables.

Written from the operators' definitions, not from their Spark plans: distinct
counts are plain ``count(DISTINCT ..)``, series are unions, joins are joins.
"""

from __future__ import annotations

RAW = """
raw AS (
  SELECT
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'signup' THEN 'product_click'
      WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'order_event'
      ELSE 'error' END AS event_type,
    user_id,
    'session-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
    ts AS "timestamp",
    CASE event_type WHEN 'view' THEN ' Home ' WHEN 'signup' THEN 'Product' ELSE '' END
      AS page,
    CASE WHEN event_type IN ('view', 'signup', 'click')
      THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END AS product_id,
    CASE event_type WHEN 'click' THEN 'add_to_cart' ELSE '' END AS action,
    CASE event_type WHEN 'click'
      THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END AS quantity,
    CASE event_type WHEN 'purchase' THEN ' o#' || event_id || ' ' ELSE '' END
      AS order_id,
    '' AS cart_id,
    CASE event_type WHEN 'purchase' THEN CAST(value AS DECIMAL(10, 2)) ELSE 0 END
      AS amount,
    CASE event_type WHEN 'purchase' THEN 'Completed ' ELSE '' END AS status,
    CASE event_type WHEN 'click' THEN 'cart-events' WHEN 'purchase' THEN 'order-events'
      ELSE 'page-views' END AS _topic,
    event_id AS _offset
  FROM events
)"""

ENRICHED = (
    RAW
    + """,
enriched AS (
  SELECT
    event_type, user_id, session_id, "timestamp",
    CASE WHEN event_type IN ('page_view', 'product_click') THEN 'view_service'
      WHEN event_type IN ('add_to_cart', 'remove_from_cart', 'update_quantity')
        THEN 'cart_service'
      WHEN event_type = 'order_event' THEN 'order_service'
      ELSE 'unknown' END AS service_source,
    lower(trim(page)) AS page,
    CASE WHEN product_id > 0 AND product_id < 1000000 THEN product_id ELSE 0 END
      AS product_id,
    lower(trim(action)) AS action,
    CASE WHEN quantity > 0 AND quantity < 100 THEN quantity ELSE 1 END AS quantity,
    regexp_replace(trim(order_id), '[^a-zA-Z0-9_-]', '', 'g') AS order_id,
    CASE WHEN amount > 0 AND amount < 100000 THEN amount ELSE 0 END AS amount,
    lower(trim(status)) AS status,
    _topic
  FROM raw
  WHERE user_id > 0
)"""
)


def _buckets(unit: str, where: str = "true") -> str:
    return (
        ENRICHED
        + f""",
buckets AS (
  SELECT
    date_trunc('{unit}', "timestamp") AS bucket,
    count(DISTINCT session_id) FILTER (WHERE service_source = 'view_service')
      AS viewing_sessions,
    count(DISTINCT session_id) FILTER (WHERE service_source = 'cart_service')
      AS cart_sessions,
    count(DISTINCT session_id) FILTER (WHERE service_source = 'order_service')
      AS order_sessions,
    CAST(coalesce(sum(amount) FILTER (WHERE service_source = 'order_service'), 0)
      AS DOUBLE) AS gmv
  FROM enriched
  WHERE {where}
  GROUP BY 1
)"""
    )


METRICS = """,
metrics AS (
  SELECT 'ecommerce_conversion_rate' AS metric_name,
    CAST(order_sessions AS DOUBLE) / nullif(viewing_sessions, 0) AS metric_value,
    bucket AS "timestamp", 'conversion' AS label_type
  FROM buckets WHERE viewing_sessions > 0
  UNION ALL
  SELECT 'ecommerce_cart_abandonment_rate',
    CAST(cart_sessions - order_sessions AS DOUBLE) / nullif(cart_sessions, 0),
    bucket, 'abandonment'
  FROM buckets WHERE cart_sessions > 0
  UNION ALL
  SELECT 'ecommerce_gmv', gmv, bucket, 'revenue'
  FROM buckets WHERE gmv > 0
)"""

HOURLY = _buckets("hour") + METRICS
_POINTS = 'metric_name, round(metric_value, 6) AS metric_value, "timestamp", label_type'
_TYPED_AMOUNT = "* REPLACE (CAST(amount AS DOUBLE) AS amount)"

# --- Conform: what the three message formats carry ---------------------------
_VIEWS = """
SELECT
  CASE event_type WHEN 'view' THEN 'page_view' ELSE 'product_click' END AS event_type,
  user_id,
  'session-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
  date_trunc('second', ts) AS "timestamp",
  CASE event_type WHEN 'view' THEN ' Home ' ELSE 'Product' END AS page,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
  '' AS action, CAST(0 AS BIGINT) AS quantity, '' AS order_id, '' AS cart_id,
  CAST(0 AS DOUBLE) AS amount, '' AS status, 'page-views' AS _topic,
  event_id AS _offset
FROM events WHERE event_type IN ('view', 'signup')"""

_CARTS = """
SELECT
  'add_to_cart' AS event_type, user_id, 'session-' || user_id AS session_id,
  ts AS "timestamp", '' AS page,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
  'add_to_cart' AS action,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS quantity,
  '' AS order_id, '' AS cart_id, CAST(0 AS DOUBLE) AS amount, '' AS status,
  'cart-events' AS _topic, event_id AS _offset
FROM events WHERE event_type = 'click'"""

_ORDERS = """
SELECT
  'order_event' AS event_type, user_id,
  'session-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
  date_trunc('second', ts) AS "timestamp", '' AS page,
  CAST(0 AS BIGINT) AS product_id, '' AS action, CAST(0 AS BIGINT) AS quantity,
  ' o#' || event_id || ' ' AS order_id, '' AS cart_id,
  CAST(CAST(value AS DECIMAL(10, 2)) AS DOUBLE) AS amount,
  'Completed ' AS status, 'order-events' AS _topic, event_id AS _offset
FROM events WHERE event_type = 'purchase'"""

_ALL_CONFORMED = " UNION ALL ".join((_VIEWS, _CARTS, _ORDERS))

_ENRICHED_ORDERS = """
SELECT
  'order_event' AS event_type, o_custkey AS user_id,
  'session-' || o_custkey AS session_id, CAST(o_orderdate AS TIMESTAMP) AS "timestamp",
  'order_service' AS service_source, '' AS page, CAST(0 AS BIGINT) AS product_id,
  '' AS action, CAST(1 AS BIGINT) AS quantity, 'o' || o_orderkey AS order_id,
  CASE WHEN o_totalprice > 0 AND CAST(o_totalprice AS DECIMAL(10, 2)) < 100000
    THEN CAST(CAST(o_totalprice AS DECIMAL(10, 2)) AS DOUBLE) ELSE 0 END AS amount,
  lower(o_orderstatus) AS status, 'order-events' AS _topic
FROM orders WHERE o_custkey > 0"""

_MESSAGES = (
    RAW
    + """,
messages AS (
  SELECT
    'user-' || user_id AS "key",
    CASE _topic
      WHEN 'page-views' THEN
        '{"event_type":"' || event_type || '","user_id":' || user_id
        || CASE WHEN product_id = 0 THEN '' ELSE ',"product_id":' || product_id END
        || ',"session_id":"' || session_id
        || '","timestamp":' || CAST(floor(epoch("timestamp")) AS BIGINT)
        || ',"page":"' || page || '"}'
      WHEN 'cart-events' THEN
        '{"type":"' || event_type || '","user_id":' || user_id
        || ',"product_id":' || product_id || ',"quantity":' || quantity || '}'
      ELSE
        '{"event_type":"' || event_type || '","user_id":' || user_id
        || ',"order_id":"' || order_id || '","session_id":"' || session_id
        || '","timestamp":' || CAST(floor(epoch("timestamp")) AS BIGINT)
        || ',"amount":' || CAST(CAST(amount AS DOUBLE) AS VARCHAR)
        || ',"status":"' || status || '"}'
    END AS "value",
    _topic AS topic, _offset AS "offset", "timestamp", event_type
  FROM raw
)"""
)

# --- Totals ------------------------------------------------------------------
_TOTAL_CONVERSION = """
SELECT 'conversion_rate' AS metric_name,
  round(CAST(count(DISTINCT session_id) FILTER (WHERE service_source = 'order_service')
    AS DOUBLE)
  / nullif(count(DISTINCT session_id) FILTER (WHERE service_source = 'view_service'), 0),
  6) AS metric_value
FROM enriched"""

_TOTAL_ABANDONMENT = """
SELECT 'cart_abandonment_rate' AS metric_name,
  round(CAST(count(DISTINCT session_id) FILTER (
    WHERE service_source = 'cart_service' AND service_source <> 'order_service')
    AS DOUBLE)
  / nullif(count(DISTINCT session_id) FILTER (WHERE service_source = 'cart_service'), 0),
  6) AS metric_value
FROM enriched"""

_TOTAL_GMV = """
SELECT 'gmv' AS metric_name, round(CAST(coalesce(sum(amount), 0) AS DOUBLE), 6)
  AS metric_value
FROM enriched WHERE service_source = 'order_service'"""

# --- Outliers ----------------------------------------------------------------
_JUDGED = """
  CASE WHEN history_count < 4 THEN 'insufficient'
    WHEN coalesce(stdev_value, 0) <= 0 THEN 'no variance'
    WHEN abs((metric_value - mean_value) / stdev_value) > {threshold} THEN 'anomaly'
    ELSE 'normal' END AS status,
  CASE WHEN history_count >= 4 AND stdev_value > 0
    THEN abs((metric_value - mean_value) / stdev_value) END AS z_score"""


def _latest(
    as_of: str, threshold: float = 2.0, where: str = "true", lookback: str = "24 HOURS"
) -> str:
    return f""",
recent AS (
  SELECT metric_name, metric_value, "timestamp",
    row_number() OVER (PARTITION BY metric_name ORDER BY "timestamp" DESC) AS rn
  FROM metrics
  WHERE "timestamp" >= {as_of} - INTERVAL {lookback} AND "timestamp" < {as_of}
    AND {where}
),
stats AS (
  SELECT metric_name, max("timestamp") AS "timestamp",
    max(metric_value) FILTER (WHERE rn = 1) AS metric_value,
    count(*) FILTER (WHERE rn > 1) AS history_count,
    avg(metric_value) FILTER (WHERE rn > 1) AS mean_value,
    stddev_samp(metric_value) FILTER (WHERE rn > 1) AS stdev_value
  FROM recent GROUP BY metric_name
),
judged AS (SELECT *, {_JUDGED.format(threshold=threshold)} FROM stats)"""


_DETECT_AS_OF = "TIMESTAMP '2024-01-29 03:00:00'"
_LATEST = HOURLY + _latest(_DETECT_AS_OF)



def _every_point(series: str = "metric_name") -> str:
    return f""",
stats AS (
  SELECT {series}, metric_value, "timestamp",
    count(*) OVER past AS history_count,
    avg(metric_value) OVER past AS mean_value,
    stddev_samp(metric_value) OVER past AS stdev_value
  FROM metrics
  WINDOW past AS (PARTITION BY {series} ORDER BY "timestamp"
    RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)
),
judged AS (SELECT *, {_JUDGED.format(threshold=2.0)} FROM stats)"""


_EVERY_POINT = HOURLY + _every_point()

_STATS = """"timestamp", metric_name, round(metric_value, 6) AS metric_value,
  round(z_score, 6) AS z_score, round(mean_value, 6) AS mean_value,
  round(stdev_value, 6) AS stdev_value"""
_FLAGGED = f"""SELECT {_STATS}, "timestamp" AS detected_at
FROM judged WHERE status = 'anomaly'"""
_REPORT = f"SELECT {_STATS}, history_count, status FROM judged"

# --- History: an early run that ended mid-bucket, and a later one --------------
_EARLY = "\"timestamp\" < TIMESTAMP '2024-01-20 12:30:00'"
_LATE = "\"timestamp\" >= TIMESTAMP '2024-01-18 06:00:00'"


def _run(name: str, where: str, computed_at: str) -> str:
    """One KPI run's rows as the CTE ``name``, with private bucket and metric CTEs."""
    text = _buckets("hour", where).removeprefix(ENRICHED) + METRICS
    text = text.replace("buckets", f"{name}_buckets").replace(
        "metrics AS", f"{name}_metrics AS"
    )
    return (
        text
        + f""",
{name} AS (
  SELECT *, TIMESTAMP '{computed_at}' AS computed_at FROM {name}_metrics
)"""
    )


_HISTORY = (
    ENRICHED
    + _run("early", _EARLY, "2024-01-20 12:30:00")
    + _run("late", _LATE, "2024-01-31 00:00:00")
    + """,
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY metric_name, "timestamp", label_type ORDER BY computed_at DESC) AS rn
  FROM (SELECT * FROM early UNION ALL SELECT * FROM late)
)"""
)
_HISTORY_ROWS = f"SELECT {_POINTS}, computed_at FROM ranked WHERE rn = 1"

# --- Streaming: buckets that end at or before the watermark --------------------
_LAST_CLOSED = """(SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE user_id > 0)"""
_CLOSED = f"bucket + INTERVAL 1 HOUR <= {_LAST_CLOSED}"
_CLOSED_POINT = f"\"timestamp\" + INTERVAL 1 HOUR <= {_LAST_CLOSED}"
_STREAM_AS_OF = f"""(SELECT max("timestamp") + INTERVAL 1 HOUR FROM metrics
    WHERE {_CLOSED_POINT})"""


# Decoded messages carry no row for the broken ones, so these close no bucket.
_LAST_DECODED = """(SELECT max(ts) - INTERVAL 1 HOUR FROM events
    WHERE user_id > 0 AND event_type <> 'error')"""
_DECODED_CLOSED = f"\"timestamp\" + INTERVAL 1 HOUR <= {_LAST_DECODED}"

# --- Messages of which a few hold what producers get wrong, by offset % 97 -----
_EDGE_REJECTED = """(_offset % 97 = 1
    OR (_offset % 97 IN (2, 5, 6) AND _topic <> 'cart-events')
    OR (_offset % 97 IN (3, 4) AND _topic = 'order-events'))"""
_EDGE_REASON = """CASE
    WHEN event_type = 'error' OR _offset % 97 = 1 THEN 'malformed'
    WHEN _offset % 97 IN (2, 6) AND _topic <> 'cart-events' THEN 'time out of range'
    WHEN _offset % 97 = 5 AND _topic <> 'cart-events' THEN 'time ahead of arrival'
    WHEN _offset % 97 IN (3, 4) AND _topic = 'order-events' THEN 'amount out of range'
  END"""


def _select(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


_ABANDONED = """
SELECT 'cart_abandonment_rate' AS metric_name,
  round(CAST(count(DISTINCT c.session_id) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM enriched e
    WHERE e.session_id = c.session_id AND e.service_source = 'order_service'))
    AS DOUBLE) / nullif(count(DISTINCT c.session_id), 0), 6) AS metric_value
FROM enriched c WHERE c.service_source = 'cart_service'"""


def _series(metric_name: str) -> str:
    return _select(
        HOURLY, f"SELECT {_POINTS} FROM metrics WHERE metric_name = '{metric_name}'"
    )


_STORED_ONCE = _select(
    f"conformed AS ({_ALL_CONFORMED})",
    """SELECT *, strftime("timestamp", '%Y%m') AS event_month FROM conformed""",
)

ORACLE: dict[str, str] = {
    "conform_views": _VIEWS,
    "conform_carts": _CARTS,
    "conform_orders": _ORDERS,
    "conform_union": _ALL_CONFORMED,
    "conform_records": _ALL_CONFORMED,
    "quarantine_counts": """
SELECT 'page-views' AS topic, count(*) AS rejected
FROM events WHERE event_type = 'error' HAVING count(*) > 0""",
    "raw_events": _select(RAW, f"SELECT {_TYPED_AMOUNT} FROM raw"),
    "events_by_month": """
SELECT strftime(ts, '%Y%m') AS event_month, count(*) AS event_count
FROM events GROUP BY 1""",
    "topic_counts": _select(
        RAW, "SELECT _topic, count(*) AS total_count FROM raw GROUP BY 1"
    ),
    "raw_event_table": _select(
        RAW,
        f"""SELECT {_TYPED_AMOUNT}, strftime("timestamp", '%Y%m') AS event_month
FROM raw WHERE "timestamp" >= TIMESTAMP '2024-01-21 00:00:00'""",
    ),
    "enriched_events": _select(ENRICHED, f"SELECT {_TYPED_AMOUNT} FROM enriched"),
    "enriched_orders": _ENRICHED_ORDERS,
    "event_source_counts": _select(
        ENRICHED,
        """SELECT event_type, service_source, count(*) AS event_count
FROM enriched GROUP BY 1, 2""",
    ),
    "bucket_sessions_hour": _select(_buckets("hour"), "SELECT * FROM buckets"),
    "conversion_series": _series("ecommerce_conversion_rate"),
    "abandonment_series": _series("ecommerce_cart_abandonment_rate"),
    "gmv_series": _series("ecommerce_gmv"),
    "kpi_minute": _select(
        _buckets("minute") + METRICS, f"SELECT {_POINTS} FROM metrics"
    ),
    "kpi_hour": _select(HOURLY, f"SELECT {_POINTS} FROM metrics"),
    "kpi_closed_hours": _select(
        _buckets(
            "hour",
            """"timestamp" >= TIMESTAMP '2024-01-02 10:00:00'
    AND "timestamp" < TIMESTAMP '2024-01-20 12:00:00'""",
        )
        + METRICS,
        f"SELECT {_POINTS} FROM metrics",
    ),
    "session_funnel": _select(
        ENRICHED
        + """,
sessions AS (
  SELECT session_id,
    max(CASE WHEN service_source = 'view_service' THEN 1 ELSE 0 END) AS viewed,
    max(CASE WHEN service_source = 'cart_service' THEN 1 ELSE 0 END) AS carted,
    max(CASE WHEN service_source = 'order_service' THEN 1 ELSE 0 END) AS ordered
  FROM enriched GROUP BY session_id
),
totals AS (
  SELECT count(*) AS total_sessions, CAST(sum(viewed) AS BIGINT) AS v,
    CAST(sum(carted) AS BIGINT) AS c, CAST(sum(ordered) AS BIGINT) AS o
  FROM sessions
)""",
        """SELECT total_sessions, v AS sessions_with_views, c AS sessions_with_cart,
  o AS sessions_with_orders,
  round(coalesce(CAST(c AS DOUBLE) / nullif(v, 0), 0), 6) AS view_to_cart_rate,
  round(coalesce(CAST(o AS DOUBLE) / nullif(c, 0), 0), 6) AS cart_to_order_rate,
  round(coalesce(CAST(o AS DOUBLE) / nullif(v, 0), 0), 6) AS conversion_rate
FROM totals""",
    ),
    "conversion_rate_total": _select(ENRICHED, _TOTAL_CONVERSION),
    "cart_abandonment_literal": _select(ENRICHED, _TOTAL_ABANDONMENT),
    "cart_abandonment_sessions": _select(
        ENRICHED
        + """,
carts AS (
  SELECT DISTINCT session_id FROM enriched WHERE service_source = 'cart_service'
),
abandoned AS (
  SELECT session_id FROM carts WHERE NOT EXISTS (
    SELECT 1 FROM enriched e
    WHERE e.session_id = carts.session_id AND e.service_source = 'order_service')
)""",
        """SELECT (SELECT count(*) FROM carts) AS cart_sessions,
  (SELECT count(*) FROM abandoned) AS abandoned_sessions,
  round(CAST((SELECT count(*) FROM abandoned) AS DOUBLE)
    / nullif((SELECT count(*) FROM carts), 0), 6) AS abandonment_rate""",
    ),
    "gmv_total": _select(ENRICHED, _TOTAL_GMV),
    "product_metrics": _select(
        ENRICHED
        + f""",
totals AS ({_TOTAL_CONVERSION} UNION ALL {_ABANDONED} UNION ALL
  SELECT 'cart_abandonment_literal', metric_value FROM ({_TOTAL_ABANDONMENT})
  UNION ALL {_TOTAL_GMV})""",
        """SELECT TIMESTAMP '2024-01-31 00:00:00' AS "timestamp", metric_name,
  metric_value,
  CASE metric_name WHEN 'conversion_rate' THEN 'conversion'
    WHEN 'gmv' THEN 'revenue' ELSE 'abandonment' END AS label_type,
  TIMESTAMP '2024-01-31 00:00:00' AS computed_at
FROM totals WHERE metric_value IS NOT NULL""",
    ),
    "product_metric_table": _select(
        ENRICHED
        + """,
runs AS (
  SELECT unnest([TIMESTAMP '2024-01-20 12:30:00', TIMESTAMP '2024-01-31 00:00:00'])
    AS as_of
),
totals AS (
  SELECT as_of,
    CAST(count(DISTINCT session_id) FILTER (WHERE service_source = 'view_service')
      AS DOUBLE) AS views,
    CAST(count(DISTINCT session_id) FILTER (WHERE service_source = 'cart_service')
      AS DOUBLE) AS carts,
    CAST(count(DISTINCT session_id) FILTER (WHERE service_source = 'order_service')
      AS DOUBLE) AS orders,
    CAST(coalesce(sum(amount) FILTER (WHERE service_source = 'order_service'), 0)
      AS DOUBLE) AS gmv
  FROM runs JOIN enriched ON enriched."timestamp" < as_of
  GROUP BY as_of
),
product_metrics AS (
  SELECT 'conversion_rate' AS metric_name, orders / nullif(views, 0) AS metric_value
  FROM totals
  UNION ALL
  SELECT 'cart_abandonment_literal', carts / nullif(carts, 0) FROM totals
  UNION ALL
  SELECT 'cart_abandonment_rate', (
    SELECT CAST(count(DISTINCT c.session_id) AS DOUBLE) FROM enriched c
    WHERE c.service_source = 'cart_service' AND c."timestamp" < as_of
      AND c.session_id NOT IN (SELECT e.session_id FROM enriched e
        WHERE e.service_source = 'order_service' AND e."timestamp" < as_of)
  ) / nullif(carts, 0) FROM totals
  UNION ALL
  SELECT 'gmv', gmv FROM totals
)""",
        """SELECT metric_name, count(*) AS data_points,
  round(avg(metric_value), 6) AS avg_value
FROM product_metrics WHERE metric_value IS NOT NULL GROUP BY 1""",
    ),
    "metric_summary": _select(
        HOURLY,
        """SELECT metric_name, count(*) AS data_points,
  round(avg(metric_value), 6) AS avg_value
FROM metrics GROUP BY 1""",
    ),
    "metric_span": _select(
        HOURLY,
        """SELECT metric_name, count(*) AS data_points,
  min("timestamp") AS first_point, max("timestamp") AS last_point
FROM metrics GROUP BY 1""",
    ),
    "recent_points": _select(
        HOURLY,
        """SELECT count(*) AS new_records, max("timestamp") AS latest_timestamp
FROM metrics WHERE "timestamp" > TIMESTAMP '2024-01-30 19:00:00'""",
    ),
    "latest_points": _select(
        HOURLY,
        f"""SELECT {_POINTS} FROM metrics
ORDER BY metrics."timestamp" DESC, metrics.metric_name LIMIT 10""",
    ),
    "series_range": _select(
        HOURLY,
        f"""SELECT {_POINTS} FROM metrics
WHERE metric_name = 'ecommerce_conversion_rate' AND "timestamp"
  BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""",
    ),
    "panel_series": _select(
        HOURLY,
        f"""SELECT {_POINTS} FROM metrics
WHERE "timestamp" >= TIMESTAMP '2024-01-30 12:00:00'
  AND "timestamp" < TIMESTAMP '2024-01-31 00:00:00'""",
    ),
    "history_upsert": _select(_HISTORY, _HISTORY_ROWS),
    "history_table": _select(
        _HISTORY,
        _HISTORY_ROWS.replace(
            "computed_at FROM",
            "computed_at, strftime(\"timestamp\", '%Y%m') AS event_month FROM",
        ),
    ),
    "zscore_latest": _select(
        _LATEST,
        _FLAGGED.replace(
            '"timestamp" AS detected_at', f"{_DETECT_AS_OF} AS detected_at"
        ),
    ),
    "zscore_status": _select(_LATEST, _REPORT),
    "zscore_backfill": _select(_EVERY_POINT, _FLAGGED),
    "zscore_backfill_status": _select(_EVERY_POINT, _REPORT),
    "moments_backfill": _select(_EVERY_POINT, _REPORT),
    "moments_latest": _select(
        HOURLY + _latest(_DETECT_AS_OF, lookback="14 DAYS"), _REPORT
    ),
    "new_anomalies": _select(
        _EVERY_POINT
        + f""",
flagged AS ({_FLAGGED}),
recorded AS (
  SELECT metric_name, "timestamp" FROM flagged
  WHERE "timestamp" < TIMESTAMP '2024-01-20 12:30:00'
)""",
        """SELECT * FROM flagged f WHERE NOT EXISTS (
  SELECT 1 FROM recorded r
  WHERE r.metric_name = f.metric_name AND r."timestamp" = f."timestamp")""",
    ),
    "anomaly_table": _select(
        _EVERY_POINT + f",\nflagged AS ({_FLAGGED})",
        """SELECT *, strftime("timestamp", '%Y%m') AS event_month FROM flagged""",
    ),
    "recorded_status": _select(
        _EVERY_POINT,
        """SELECT metric_name,
  CASE WHEN status = 'anomaly' AND "timestamp" < TIMESTAMP '2024-01-20 12:30:00'
    THEN 'already recorded' ELSE status END AS status,
  count(*) AS points
FROM judged GROUP BY 1, 2""",
    ),
    "import_payload": _select(
        HOURLY,
        """SELECT metric_name, "timestamp",
  '{"metric":{"__name__":"' || metric_name || '","type":"' || label_type
  || '"},"values":[' || CAST(metric_value AS VARCHAR)
  || '],"timestamps":[' || epoch_ms("timestamp") || ']}' AS payload
FROM metrics""",
    ),
    "delivery_report": _select(
        HOURLY,
        """SELECT metric_name, count(*) AS retrieved,
  count(*) FILTER (WHERE metric_value >= 0) AS delivered,
  count(*) FILTER (WHERE metric_value < 0) AS failed
FROM metrics GROUP BY 1""",
    ),
    "kafka_records": _select(
        _MESSAGES, 'SELECT topic, "key", "value" FROM messages'
    ),
    "stream_ingest": f"""
SELECT *, strftime("timestamp", '%Y%m') AS event_month FROM ({_ALL_CONFORMED})""",
    "stream_quarantine": _select(
        _MESSAGES,
        """SELECT "key", left("value", length("value") - 1) AS "value", topic, "offset",
  "timestamp"
FROM messages WHERE event_type = 'error'""",
    ),
    "stream_buckets": _select(
        _buckets("hour"), f"SELECT * FROM buckets WHERE {_CLOSED}"
    ),
    "stream_kpi_hour": _select(
        HOURLY, f"SELECT {_POINTS} FROM metrics WHERE {_CLOSED_POINT}"
    ),
    "stream_detect": _select(
        HOURLY + _latest(_STREAM_AS_OF, threshold=0.5, where=_CLOSED_POINT),
        f"""SELECT {_STATS}, {_STREAM_AS_OF} AS detected_at,
  strftime("timestamp", '%Y%m') AS event_month
FROM judged WHERE status = 'anomaly'""",
    ),
    "raw_table_two_writers": _select(
        RAW + f",\nconformed AS ({_ALL_CONFORMED})",
        f"""SELECT *, strftime("timestamp", '%Y%m') AS event_month FROM (
  SELECT {_TYPED_AMOUNT} FROM raw WHERE _offset % 3 <> 1
  UNION ALL BY NAME SELECT * FROM conformed WHERE _offset % 3 = 1)""",
    ),
    "conform_edge_messages": _select(
        f"conformed AS ({_ALL_CONFORMED})",
        f"""SELECT * FROM conformed WHERE NOT {_EDGE_REJECTED}
UNION ALL SELECT * FROM conformed WHERE _offset % 97 = 0""",
    ),
    "quarantine_reasons": _select(
        RAW,
        f"""SELECT topic, reason, CAST(sum(rows) AS BIGINT) AS rejected FROM (
  SELECT _topic AS topic, {_EDGE_REASON} AS reason,
    CASE WHEN _offset % 97 = 0 THEN 2 ELSE 1 END AS rows FROM raw)
WHERE reason IS NOT NULL GROUP BY 1, 2""",
    ),
    "read_events_files": _select(
        RAW,
        """SELECT source, _topic AS topic, count(*) AS messages,
  CAST(sum(_offset) AS BIGINT) AS offsets
FROM raw JOIN (VALUES ('views', 'page-views'), ('carts', 'cart-events'),
  ('orders', 'order-events'), ('all', NULL)) s(source, only_topic)
  ON only_topic IS NULL OR only_topic = _topic
GROUP BY 1, 2""",
    ),
    "history_compacted": _select(
        _HISTORY,
        _HISTORY_ROWS.replace(
            "computed_at FROM",
            "computed_at, strftime(\"timestamp\", '%Y%m') AS event_month FROM",
        ),
    ),
    "zscore_backfill_minute": _select(
        _buckets("minute") + METRICS + _every_point(), _FLAGGED.replace(", 6)", ", 4)")
    ),
    "anomaly_table_labels": _select(
        ENRICHED
        + _run("g0", "user_id % 2 = 0", "2024-01-31")
        + _run("g1", "user_id % 2 = 1", "2024-01-31")
        + """,
metrics AS (
  SELECT *, '0' AS label_group FROM g0 UNION ALL SELECT *, '1' FROM g1
)"""
        + _every_point("metric_name, label_group"),
        f"""SELECT {_STATS}, label_group, "timestamp" AS detected_at,
  strftime("timestamp", '%Y%m') AS event_month
FROM judged WHERE status = 'anomaly'""",
    ),
    "import_lines": _select(
        HOURLY,
        """SELECT '{"metric":{"__name__":"' || metric_name || '","type":"' || label_type
  || '"},"values":[' || CAST(metric_value AS VARCHAR)
  || '],"timestamps":[' || epoch_ms("timestamp") || ']}' AS payload
FROM metrics""",
    ),
    "stream_kpi_batches": _select(
        HOURLY, f"SELECT {_POINTS} FROM metrics WHERE {_DECODED_CLOSED}"
    ),
    "stream_detect_all": _select(
        _EVERY_POINT,
        f"""SELECT {_STATS}, "timestamp" AS detected_at,
  strftime("timestamp", '%Y%m') AS event_month
FROM judged WHERE status = 'anomaly' AND {_DECODED_CLOSED}""",
    ),
    "stream_open_buckets": _select(HOURLY, f"SELECT {_POINTS} FROM metrics"),
    "late_repair": _select(HOURLY, f"SELECT {_POINTS} FROM metrics"),
    "redelivered_messages": _STORED_ONCE,
    "redelivered_stream": _STORED_ONCE,
    "offset_gaps": _select(
        RAW
        + """,
following AS (
  SELECT _topic AS topic, _offset,
    lead(_offset) OVER (PARTITION BY _topic ORDER BY _offset) AS later FROM raw
)""",
        """SELECT topic, CAST(0 AS INTEGER) AS "partition", _offset + 1 AS gap_start,
  later - 1 AS gap_end, later - _offset - 1 AS missing
FROM following WHERE later > _offset + 1""",
    ),
    "next_offsets": _select(
        RAW,
        """SELECT _topic AS topic, CAST(0 AS INTEGER) AS "partition",
  max(_offset) + 1 AS next_offset FROM raw GROUP BY 1""",
    ),
    "session_rollup": _select(
        ENRICHED,
        " UNION ALL ".join(
            f"""SELECT {bucket} AS bucket, '{unit}' AS unit,
  count(DISTINCT session_id) FILTER (WHERE service_source = 'view_service')
    AS viewing_sessions,
  count(DISTINCT session_id) FILTER (WHERE service_source = 'cart_service')
    AS cart_sessions,
  count(DISTINCT session_id) FILTER (WHERE service_source = 'order_service')
    AS order_sessions
FROM enriched WHERE service_source <> 'unknown' GROUP BY 1"""
            for unit, bucket in (
                ("hour", "date_trunc('hour', \"timestamp\")"),
                ("day", "CAST(date_trunc('day', \"timestamp\") AS TIMESTAMP)"),
                ("all", "CAST(NULL AS TIMESTAMP)"),
            )
        ),
    ),
    "delivery_retries": _select(
        HOURLY,
        """SELECT metric_name, count(*) AS points,
  count(*) FILTER (WHERE metric_value > -1) AS delivered,
  CAST(0 AS BIGINT) AS waiting,
  count(*) FILTER (WHERE metric_value <= -1) AS parked,
  CAST(0 AS BIGINT) AS queued,
  CAST(sum(CASE WHEN metric_value < 0 THEN 3 ELSE 1 END) AS BIGINT) AS attempts
FROM metrics GROUP BY 1""",
    ),
}
ORACLE["funnel_by_session"] = ORACLE["session_funnel"]
ORACLE["panel_steps"] = _select(
    HOURLY
    + """,
grid AS (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00',
    TIMESTAMP '2024-01-31 00:00:00', INTERVAL 20 MINUTE)) AS step
)""",
    """SELECT metric_name, label_type, step AS "timestamp",
  round(arg_max(metric_value, m."timestamp"), 6) AS metric_value
FROM grid JOIN metrics m
  ON m."timestamp" <= step AND m."timestamp" > step - INTERVAL 100 MINUTE
GROUP BY 1, 2, 3""",
)
ORACLE["wire_field_profile"] = _select(
    RAW
    + """,
sent AS (SELECT *, _offset % 11 = 0 AS campaign,
  _offset % 11 <> 0 AND _offset % 13 = 0 AS debug
  FROM raw WHERE event_type <> 'error'),
fields AS (
  SELECT _topic AS topic, unnest(
    CASE _topic
      WHEN 'page-views' THEN ['event_type', 'user_id', 'session_id', 'timestamp', 'page']
        || CASE WHEN product_id <> 0 THEN ['product_id'] ELSE [] END
      WHEN 'cart-events' THEN ['type', 'user_id', 'product_id', 'quantity']
      ELSE ['event_type', 'user_id', 'order_id', 'session_id', 'timestamp', 'amount',
        'status'] END
    || CASE WHEN campaign THEN ['campaign'] ELSE [] END
    || CASE WHEN debug THEN ['debug', 'tags'] ELSE [] END) AS field
  FROM sent
)""",
    """SELECT topic, field, CASE WHEN field = 'debug' THEN 'boolean'
    WHEN field = 'tags' THEN 'array'
    WHEN field IN ('user_id', 'timestamp', 'product_id', 'quantity', 'amount')
      THEN 'number' ELSE 'string' END AS type,
  field NOT IN ('campaign', 'debug', 'tags') AS known, count(*) AS messages
FROM fields GROUP BY 1, 2, 3, 4""",
)
# Three loads and a repeated one come to the same totals as one.
ORACLE["product_totals_incremental"] = ORACLE["product_metrics"]
