"""T5: intake records as a stream, valid ones to one table and rejected ones to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from grantlens.sources.records import judge_intake
from grantlens.streaming.sinks import split_sink


def stream_intake(records: DataFrame, valid_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Start the intake over all that has arrived; each micro-batch writes both sides under its own batch number, so a replay overwrites itself."""
    reason = F.col("reject_reason")
    sink = split_sink({valid_path: reason.isNull(), rejected_path: reason.isNotNull()}, drop={valid_path: ("reject_reason",)})
    return judge_intake(records).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
