"""Preparation and scoring on Structured Streaming: the row-local operators, unchanged, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import prepare as P, scoring as Sc
from ..registry import Endpoint


def read_rows(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def prepare_stream(rows: DataFrame, ep: Endpoint, key: str = "raw_key", label: str = "y") -> DataFrame:
    return P.prepare(rows, ep, key, label)


def score_stream(rows: DataFrame, models, row_id: str = "row_id") -> DataFrame:
    return Sc.score_rows(rows, models, row_id)


def write_rows(df: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append-only Parquet sink that drains what is there and stops; exactly-once by its checkpoint folder."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start(path)
