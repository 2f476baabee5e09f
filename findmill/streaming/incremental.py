"""The row-local operators on a stream of new responses or scanner documents.

They use no sort, window or join, so ``readStream`` sources work unchanged; each
micro-batch is appended to the findings table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_findings(
    stream: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Parse a stream (``parse_responses``, ``parse_documents``, ...) into Parquet files.

    The file sink's log makes each micro-batch appear once, also after a restart.
    """
    return (
        parse(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
