"""Structured Streaming sink for feature programs.

Programs are batch plans over whole tables; a stream of main rows is served micro-batch by micro-batch against the side
tables as they are then, which gives each row the features of its own time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.planner import compile_program


def serve(stream: DataFrame, config: str | dict, program: str, sides: Callable[[], dict[str, DataFrame]], target: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes the features of each micro-batch of main rows under path, one folder for each batch so that a retried batch is rewritten whole."""

    def batch(df: DataFrame, number: int) -> None:
        compile_program(config, program, {target: df, **sides()}, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
