"""New target records as a stream: cleaned as they come, matched in micro-batches with frozen statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinweave.functions.cleaning import clean_records
from kinweave.sources.records import SCHEMA


def read_stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """Tab-separated files of a folder as they arrive, with src."""
    return spark.readStream.schema(f"src tinyint, {SCHEMA}").option("sep", "\t").option("header", True).option("quote", "").option("maxFilesPerTrigger", files_each).csv(path)


def clean_stream(stream: DataFrame, state: dict | None = None) -> DataFrame:
    """Stateless, so late and early records are cleaned alike."""
    return clean_records(stream, state)


def match_stream(cleaned: DataFrame, match: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch through match(batch), written under its batch number: a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = cleaned.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
