"""Scoring of streams: the same projection on an unbounded frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from transcurve.operators import score
from transcurve.spec import Model


def score_stream(stream: DataFrame, model: Model, prefix: str = "p_") -> DataFrame:
    """A stream with the model's probabilities; stateless, so any output mode and trigger will do."""
    return score.with_probabilities(stream, model, prefix)


def write_scores(stream: DataFrame, model: Model, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Score a stream into Parquet, exactly once by the checkpoint; ``once`` drains what is there and ends."""
    writer = score_stream(stream, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
