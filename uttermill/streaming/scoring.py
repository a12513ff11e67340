"""Continuous scoring of arriving texts, with rejected requests kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.scoring import score_batch, validate_requests


def read_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return read_stream(spark, path, schema, files_per_trigger=files_per_trigger)
    return read_stream(spark, place.getParent().toString(), schema, place.getName(), files_per_trigger)


def score_stream(stream: DataFrame, path: str, checkpoint: str, **score) -> StreamingQuery:
    """Score every arriving text into a Parquet sink; stateless, exactly once."""
    return (
        score_batch(stream, **score)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def route_stream(stream: DataFrame, valid_path: str, rejected_path: str, checkpoint: str, **score) -> StreamingQuery:
    """Score valid requests and keep rejected ones with their reason.

    Each micro-batch overwrites its own folder, so a replayed batch adds nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_requests(batch)
        valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
        score_batch(valid, **score).write.mode("overwrite").parquet(f"{valid_path}/batch_id={batch_id}")
        checked.filter(F.col("reject_reason").isNotNull()).write.mode("overwrite").parquet(
            f"{rejected_path}/batch_id={batch_id}"
        )

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
