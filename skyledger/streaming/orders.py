"""Orders that a platform sends more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

# How long after an order its repetition may still come.
DELAY = "1 hour"


def first_receipts(received: DataFrame, at: str = "received_at", delay: str = DELAY) -> DataFrame:
    """Stream of orders without repetitions that come within `delay`.

    The state holds the orders of the last `delay` before the watermark only, however many came;
    what is older than the watermark is late and dropped by the stream.
    """
    return received.withWatermark(at, delay).dropDuplicatesWithinWatermark(["order_id"])
