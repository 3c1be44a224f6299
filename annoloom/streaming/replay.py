"""Resumable batch: saved answers are parsed as their files arrive. The checkpoint remembers the files seen, so
a stopped run goes on where it was. This is beyond a plain loop over a folder, which has no such state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annoloom.functions.response import parse_responses, saved_body
from annoloom.functions.text import stem


def stream_saved_responses(spark: SparkSession, path: str) -> DataFrame:
    """(model, raw_response) of answer files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.concat(stem(F.input_file_name()), F.lit(".xml")).alias("model"), saved_body(F.col("value")).alias("raw_response"))


def replay_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived and stop. Each batch writes its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        parse_responses(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = stream_saved_responses(spark, path)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
