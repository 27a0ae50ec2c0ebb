"""Streaming.

The analytics this library re-expresses run over finished tables only: no
watermark, window, state or late data exists in them, so there is no streaming
operator here.  Every batch operator accepts a streaming DataFrame wherever
Spark allows the same plan (projections, filters, joins against static reference
tables, aggregates in complete/update mode), and ``run_on_stream`` applies a
batch operator to each micro-batch through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_on_stream(stream: DataFrame, op: Callable[[DataFrame], DataFrame], sink_path: str,
                  checkpoint: str, fmt: str = "parquet"):
    """Append ``op(batch)`` of every micro-batch to ``sink_path`` (exactly-once
    by the streaming checkpoint at ``checkpoint``, a shared folder)."""
    def each(batch: DataFrame, _epoch: int) -> None:
        op(batch).write.mode("append").format(fmt).save(sink_path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
