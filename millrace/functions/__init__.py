"""Column expressions and time helpers shared by the operators."""

from millrace.functions.columns import (
    bounded,
    classify,
    day_of,
    labels_key,
    month_of,
    normalise,
    safe_ratio,
    scrub,
)
from millrace.functions.time import bucket_start, instant, seconds_in, since

__all__ = [
    "bounded",
    "bucket_start",
    "classify",
    "day_of",
    "instant",
    "labels_key",
    "month_of",
    "normalise",
    "safe_ratio",
    "scrub",
    "seconds_in",
    "since",
]
