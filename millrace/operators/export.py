"""Export: time-series import documents, delivery, and keyed event records."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schemas as S

# Takes the documents of one batch, returns one error per document, None if sent.
Sender = Callable[[Sequence[str]], Sequence[str | None]]

_NAME = "__name__"
_STATUS_SCHEMA = (
    "metric_name string, timestamp timestamp, delivered boolean, error string"
)


def import_payload(metrics: DataFrame) -> DataFrame:
    """Add ``payload``, one JSON import document per point.

    ``{"metric":{"__name__":name,...labels},"values":[v],"timestamps":[ms]}``; a
    label called ``__name__`` takes precedence over the metric name.
    """
    labels = F.coalesce(F.col("labels"), F.create_map().cast(S.LABELS))
    named = F.map_concat(F.create_map(F.lit(_NAME), F.col("metric_name")), labels)
    document = F.struct(
        F.when(F.map_contains_key(labels, _NAME), labels).otherwise(named).alias("metric"),
        F.array(F.col("metric_value").cast("double")).alias("values"),
        F.array(F.unix_millis("timestamp")).alias("timestamps"),
    )
    return metrics.withColumn("payload", F.to_json(document))


def write_import_lines(metrics: DataFrame, path: str) -> None:
    """Store the import documents as JSON lines."""
    import_payload(metrics).select(F.col("payload").alias("value")).write.mode(
        "append"
    ).text(path)


def http_sender(url: str, timeout: float = 10.0, per_request: int = 500) -> Sender:
    """A sender that posts JSON lines to an import endpoint.

    A failing request marks its documents as failed and the rest go on.
    """

    def send(documents: Sequence[str]) -> list[str | None]:
        errors: list[str | None] = []
        for start in range(0, len(documents), per_request):
            chunk = documents[start : start + per_request]
            request = urllib.request.Request(
                url,
                data="\n".join(chunk).encode(),
                headers={"Content-Type": "application/json"},
                method="POST",
            )
            error = None
            try:
                with urllib.request.urlopen(request, timeout=timeout):
                    pass
            except Exception as failure:
                error = str(failure)
            errors.extend([error] * len(chunk))
        return errors

    return send


def publish(metrics: DataFrame, sender: Sender) -> DataFrame:
    """Send every point and return its delivery status.

    Sending happens where the partitions are, when the result is evaluated;
    write the result once and read that, since evaluating it again sends again.
    A retried task repeats its points, which an import endpoint absorbs because
    they carry the same time and value.
    """

    def deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                errors = list(sender(batch["payload"].tolist()))
            except Exception as failure:
                errors = [str(failure)] * len(batch)
            status = batch[["metric_name", "timestamp"]].copy()
            status["delivered"] = [e is None for e in errors]
            status["error"] = pd.Series(errors, index=status.index, dtype=object)
            yield status

    documents = import_payload(metrics).select("metric_name", "timestamp", "payload")
    return documents.mapInPandas(deliver, _STATUS_SCHEMA)


def delivery_report(status: DataFrame) -> DataFrame:
    """Points retrieved, delivered and failed per metric."""
    return status.groupBy("metric_name").agg(
        F.count("*").alias("retrieved"),
        F.count_if("delivered").alias("delivered"),
        F.count_if(~F.col("delivered")).alias("failed"),
    )


def to_kafka_records(
    events: DataFrame, key: str = "user_id", carry: Sequence[str] = ()
) -> DataFrame:
    """Wide event rows as (topic, key, value) messages in their topic's format.

    The inverse of the conform step: keys read ``user-<id>``, and each value
    holds only the fields its topic carries.  A view's product id of 0 is left
    out.  Columns named in ``carry`` are kept beside the message.
    """
    product = F.nullif("product_id", F.lit(0)).alias("product_id")
    epoch = F.unix_seconds("timestamp").alias("timestamp")
    amount = F.col("amount").cast("double").alias("amount")
    view = F.struct("event_type", "user_id", product, "session_id", epoch, "page")
    cart = F.struct(
        F.col("event_type").alias("type"), "user_id", "product_id", "quantity"
    )
    order = F.struct(
        "event_type", "user_id", "order_id", "session_id", epoch, amount, "status"
    )
    topic = F.col("_topic")
    value = (
        F.when(topic == S.VIEW_TOPIC, F.to_json(view))
        .when(topic == S.CART_TOPIC, F.to_json(cart))
        .when(topic == S.ORDER_TOPIC, F.to_json(order))
    )
    return events.select(
        topic.alias("topic"),
        F.concat(F.lit("user-"), F.col(key).cast("string")).alias("key"),
        value.alias("value"),
        *carry,
    )


def publish_events(events: DataFrame, fmt: str = "kafka", **options: str) -> None:
    """Write wide event rows to their topics."""
    to_kafka_records(events).write.format(fmt).options(**options).mode("append").save()
