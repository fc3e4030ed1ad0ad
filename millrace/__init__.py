"""Product-funnel analytics on Spark: events to KPIs to outliers."""

from millrace.functions import bounded, classify, since
from millrace.operators.conform import (
    conform_carts,
    conform_orders,
    conform_views,
    with_event_month,
)
from millrace.operators.delivery import delivery_job, enqueue, ledger_report, read_outbox
from millrace.operators.enrich import enrich
from millrace.operators.export import (
    delivery_report,
    http_sender,
    import_payload,
    publish,
    publish_events,
    to_kafka_records,
    write_import_lines,
)
from millrace.operators.history import (
    compact_history,
    current_points,
    read_history,
    stamp,
    upsert_history,
    write_history,
)
from millrace.operators.kpis import bucket_sessions, metric_series, to_metric_rows
from millrace.operators.moments import (
    backfill_by_blocks,
    block_moments,
    detect_by_moments,
    detect_from_state,
    judge_by_moments,
    merge_moments,
    read_moments,
    resumed_backfill_job,
)
from millrace.operators.offsets import (
    fresh_records,
    next_offsets,
    offset_gaps,
    offset_repeats,
    read_offsets,
    starting_offsets,
    write_offsets,
)
from millrace.operators.outliers import (
    backfill_anomalies,
    detect_anomalies,
    mark_recorded,
    new_only,
    write_anomalies,
)
from millrace.operators.reports import (
    cart_abandonment_literal,
    cart_abandonment_sessions,
    conversion_rate_total,
    event_source_counts,
    events_by_month,
    gmv_total,
    latest_points,
    metric_span,
    metric_summary,
    panel_series,
    panel_steps,
    product_metrics,
    recent_points,
    series_range,
    session_funnel,
    topic_counts,
)
from millrace.operators.rollups import (
    number_sessions,
    roll_up_bitmaps,
    roll_up_sketches,
    session_bitmaps,
    session_sketches,
)
from millrace.operators.sessions import (
    merge_sessions,
    read_session_state,
    totals_job,
    update_session_state,
)
from millrace.plans.jobs import (
    detection_job,
    kpi_job,
    kpi_metrics,
    load_job,
    product_job,
)
from millrace.plans.views import register_views
from millrace.session import configure, ensure_shared_folder, scratch_dir
from millrace.sources.tables import (
    compact_raw_events,
    read_anomalies,
    read_quarantine,
    read_raw_events,
    read_table,
    write_by_session,
    write_quarantine,
    write_raw_events,
)
from millrace.sources.wire import (
    conform_records,
    decoded_records,
    field_profile,
    parse_json,
    read_events,
    split_records,
    union_events,
)
from millrace.streaming.detect import detect_stream
from millrace.streaming.ingest import ingest_stream, quarantine_stream
from millrace.streaming.kpi import (
    bucket_sessions_stream,
    dropped_rows,
    kpi_stream,
    not_ahead,
)
from millrace.streaming.open_buckets import compact_bucket_sessions, open_bucket_stream

__all__ = [
    "backfill_anomalies",
    "backfill_by_blocks",
    "block_moments",
    "bounded",
    "bucket_sessions",
    "bucket_sessions_stream",
    "cart_abandonment_literal",
    "cart_abandonment_sessions",
    "classify",
    "compact_bucket_sessions",
    "compact_history",
    "compact_raw_events",
    "configure",
    "conform_carts",
    "conform_orders",
    "conform_records",
    "conform_views",
    "conversion_rate_total",
    "current_points",
    "decoded_records",
    "delivery_job",
    "delivery_report",
    "detect_anomalies",
    "detect_by_moments",
    "detect_from_state",
    "detect_stream",
    "detection_job",
    "dropped_rows",
    "enqueue",
    "enrich",
    "ensure_shared_folder",
    "event_source_counts",
    "events_by_month",
    "field_profile",
    "fresh_records",
    "gmv_total",
    "http_sender",
    "import_payload",
    "ingest_stream",
    "judge_by_moments",
    "kpi_job",
    "kpi_metrics",
    "kpi_stream",
    "latest_points",
    "ledger_report",
    "load_job",
    "mark_recorded",
    "merge_moments",
    "merge_sessions",
    "metric_series",
    "metric_span",
    "metric_summary",
    "new_only",
    "next_offsets",
    "not_ahead",
    "number_sessions",
    "offset_gaps",
    "offset_repeats",
    "open_bucket_stream",
    "panel_series",
    "panel_steps",
    "parse_json",
    "product_job",
    "product_metrics",
    "publish",
    "publish_events",
    "quarantine_stream",
    "read_anomalies",
    "read_events",
    "read_history",
    "read_moments",
    "read_offsets",
    "read_outbox",
    "read_quarantine",
    "read_raw_events",
    "read_session_state",
    "read_table",
    "recent_points",
    "register_views",
    "resumed_backfill_job",
    "roll_up_bitmaps",
    "roll_up_sketches",
    "scratch_dir",
    "series_range",
    "session_bitmaps",
    "session_funnel",
    "session_sketches",
    "since",
    "split_records",
    "stamp",
    "starting_offsets",
    "to_kafka_records",
    "to_metric_rows",
    "topic_counts",
    "totals_job",
    "union_events",
    "update_session_state",
    "upsert_history",
    "with_event_month",
    "write_anomalies",
    "write_by_session",
    "write_history",
    "write_import_lines",
    "write_offsets",
    "write_quarantine",
    "write_raw_events",
]
