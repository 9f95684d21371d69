"""Feeds a space from a stream: every micro batch is added and the rules run again.

The language has no streaming operators of its own; this is the adaptor to Structured Streaming. A batch that is given
again after a failure adds the same atoms, which are a set, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..space import Space


def feed(stream: DataFrame, space: Space, head: str, columns: list[str], rules: str, checkpoint: str, then: Callable[[Space, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream; ``then`` is called with the space and the batch number after the rules of a batch have run."""

    def batch(df: DataFrame, number: int) -> None:
        space.add_table(df, head, columns)
        space.settle()
        space.add(rules)
        space.run()
        space.settle()
        if then is not None:
            then(space, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
