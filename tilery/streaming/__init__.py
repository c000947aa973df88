"""Streams of utterances: the row-local form needs no state, so it runs in append mode as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tilery.operators.lexicon import Lexicon
from tilery.plans.pipeline import tile_local


def tile_stream(utterances: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(key, words, tokens) of a streaming DataFrame. The index is read when the stream is made."""
    if not utterances.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return tile_local(utterances, key, text, lexicon)


def write_stream(tiled: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of parquet files; the checkpoint folder must be one that all executors share."""
    return tiled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
