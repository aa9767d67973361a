"""File sources and sinks: tables by extension, CSV with a schema, model stats and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.staging import scratch_path


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its extension: CSV (with header), JSON or Parquet (the default)."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """A metrics table as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def write_stats(stats: DataFrame, path: str | None = None) -> str:
    """The one row of a model's normalisation (mean, std, feature_names, card_dim, ...) as JSON."""
    return write_report(stats, path or scratch_path(stats.sparkSession, "stats"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("mean array<double>, std array<double>, n array<long>, feature_names array<string>, card_dim int").json(path)
