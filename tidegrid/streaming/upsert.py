"""Start streams that are worked through batch by batch, and collect what batches write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidegrid.session import work_dir

Each = Callable[[DataFrame, int], None]


def start_batches(stream: DataFrame, name: str, each: Each, mode: str = "append", offsets: str | None = None,
                  every: str | None = None) -> StreamingQuery:
    """A running query that hands each micro-batch to ``each``.

    It goes on for good with a batch ``every`` so often (such as ``120 seconds``), or without that ends with the
    available data. With a kept ``offsets`` folder it goes on where an earlier query stopped.
    """
    w = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", offsets or work_dir(stream.sparkSession, f"offsets-{name}"))
        .foreachBatch(each)
    )
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run_batches(stream: DataFrame, name: str, each: Each, mode: str = "append", offsets: str | None = None) -> None:
    """Process everything available in micro-batches, then stop."""
    q = start_batches(stream, name, each, mode, offsets)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def batch_writer(out: str) -> Each:
    """Write each batch to its own folder; a repeated batch replaces its first attempt."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write
