"""Incremental ingest and live queries over growing files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkseek.sources import jsonl, tail


def line_stream(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """Complete lines of a growing file as a stream (_offset, _length, value)."""
    tail.register(spark)
    return spark.readStream.format("sparkseek_lines").option("path", path).option("split", split).load()


def _write_once(batch: DataFrame, batch_id: int, table: str) -> None:
    """A batch that is repeated after a failure replaces its own files, so no record is stored twice."""
    batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def start(spark: SparkSession, path: str, table: str, checkpoint: str, parse: bool = False, mode: str = "failfast", once: bool = True) -> StreamingQuery:
    """Begin writing new complete lines to Parquet at ``table``; the checkpoint keeps the byte offset.

    ``parse``: store the VARIANT too. A micro-batch with a malformed line fails as a whole (``failfast``) and leaves nothing behind.
    """
    stream = line_stream(spark, path)
    out = jsonl.bronze(stream, mode) if parse else stream
    writer = out.writeStream.foreachBatch(lambda b, i: _write_once(b, i, table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, parse: bool = False, mode: str = "failfast") -> None:
    """Read what was completed since the last call; nothing new changes nothing."""
    query = start(spark, path, table, checkpoint, parse, mode)
    query.awaitTermination()


def on_snapshot(spark: SparkSession, path: str, table: str, checkpoint: str, callback: Callable[[DataFrame], None], once: bool = False) -> StreamingQuery:
    """Call ``callback`` with the whole table after every batch that added records: a live query is a callback that runs it again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        _write_once(batch, batch_id, table)
        callback(spark.read.parquet(table))

    writer = line_stream(spark, path).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
