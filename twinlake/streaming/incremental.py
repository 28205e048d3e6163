"""Compare each micro-batch of a stream with the rows of the same keys in a reference table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinlake.diff import DiffOptions, diff


def compare_stream(stream: DataFrame, reference: Callable[[], DataFrame], key: list[str], on_result: Callable, *, checkpoint: str, options: DiffOptions | None = None, **trigger) -> StreamingQuery:
    """Start a query that hands (batch id, DiffResult) to ``on_result`` for each micro-batch.

    The batch is the left side; the right side is the reference restricted to the batch's keys, so rows that
    have not arrived are not reported as missing.
    """
    options = options or DiffOptions(key=tuple(key))

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            right = reference().join(batch.select(*key).distinct(), key, "left_semi")
            result = diff(batch, right, options, declared_key=key)
            on_result(number, result)
            result.close()
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
