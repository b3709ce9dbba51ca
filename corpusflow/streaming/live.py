"""Structured Streaming forms of three state operators; an extension, as the batch operators need no stream.

`first_wins` keeps the first row of a key within a watermark; `windowed_counts` counts late data into its window;
`status_machine` folds each item's status changes, refusing steps backward.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.plans.catalog import rows_only

RANK = {"pending": 0, "in-progress": 1, "failed": 2, "done": 3}


def first_wins(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str = "1 day", *by: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def status_machine(stream: DataFrame, key: str, status: str) -> DataFrame:
    """(key, status, refused) of each key after each micro-batch."""

    def fold(k, batches, state):
        now, refused = state.get if state.exists else ("pending", 0)
        for batch in batches:
            for s in batch[status]:
                if RANK.get(s, -1) >= RANK[now]:
                    now = s
                else:
                    refused += 1
        state.update((now, refused))
        yield pd.DataFrame({"key": [k[0]], "status": [now], "refused": [refused]})

    return stream.groupBy(key).applyInPandasWithState(fold, "key long, status string, refused long", "status string, refused long", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is there, into a memory table; for tests and small results."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


@rows_only("stream_windowed_counts")
def stream_windowed_counts(spark, sf_dir):
    out = drain(windowed_counts(events(spark, sf_dir), "ts", "1 day", "1 day", "event_type"), "windowed_counts", "complete")
    return out.select(F.col("window.start").alias("day"), "event_type", "n")
