"""Table sinks and configuration: partitioned blocks, single JSON documents, thresholds with fallbacks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusflow.plans.catalog import engine_table, rows_only

#: Thresholds of triage, used where a profile names none.
DEFAULT_THRESHOLDS = {"readable_chars": 1000, "scanned_chars": 100, "image_rate": 0.9, "nonprint": 0.05, "dominant": 0.8}
SCHEMA_VERSION = "1"


def write_blocks(blocks: DataFrame, path: str) -> str:
    """Blocks as Parquet by source; the committer makes the write whole or absent."""
    blocks.write.mode("overwrite").partitionBy("source").parquet(path)
    return path


def write_json(rows: DataFrame, path: str) -> str:
    """Rows as JSON lines in a folder, whole or absent."""
    rows.write.mode("overwrite").json(path)
    return path


def load_thresholds(text: str | None) -> tuple[dict, list[str]]:
    """A profile with fallbacks; what was wrong with it is listed, a wrong version is refused."""
    if not text:
        return dict(DEFAULT_THRESHOLDS), ["no profile"]
    try:
        given = json.loads(text)
    except ValueError as e:
        return dict(DEFAULT_THRESHOLDS), [f"not readable: {e}"]
    if str(given.pop("schema_version", SCHEMA_VERSION)) != SCHEMA_VERSION:
        return dict(DEFAULT_THRESHOLDS), ["schema version differs"]
    unknown = sorted(set(given) - set(DEFAULT_THRESHOLDS))
    return DEFAULT_THRESHOLDS | {k: v for k, v in given.items() if k in DEFAULT_THRESHOLDS}, [f"unknown: {k}" for k in unknown]


def _folder(spark: SparkSession) -> str:
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{home.rstrip('/')}/sink-{uuid.uuid4().hex}"


@rows_only("snk_sdm")
def snk_sdm(spark, sf_dir):
    blocks = engine_table(spark, sf_dir, "blocks")
    return spark.read.schema(blocks.schema).parquet(write_blocks(blocks, _folder(spark)))


@rows_only("snk_atomic_json")
def snk_atomic_json(spark, sf_dir):
    notes = engine_table(spark, sf_dir, "notes")
    return spark.read.schema(notes.schema).json(write_json(notes, _folder(spark)))


@rows_only("src_profile_yaml")
def src_profile_yaml(spark, sf_dir):
    found, _ = load_thresholds(None)
    return spark.createDataFrame(sorted((k, float(v)) for k, v in found.items()), "name string, value double")
