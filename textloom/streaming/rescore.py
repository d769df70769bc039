"""Optional streaming front: every micro-batch of conversations is summarised anew and handed to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def summarize_stream(conversations: DataFrame, summarize: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that calls sink(summarize(batch), batch number). Operators are batch ones; a batch holds whole conversations."""
    return conversations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(summarize(batch), n)).start()
