"""Written intermediates of programs that loop, and positions in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a private one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A table that grows by parts, each written once; `all` is one scan of those so far, so a loop's plans keep their shape."""

    def __init__(self, first: DataFrame, tag: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path, self.parts = f"{shared_folder(self.spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """The part as it was written."""
        df.select(*self.schema.names).write.parquet(f"{self.path}/{self.parts}")
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.parts - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{i}" for i in range(self.parts)))


def empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def with_places(df: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """df with positions from 1 in a global order: ranges are numbered one by one and moved by the sizes of those before, so that no task sees all rows."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(place, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")
