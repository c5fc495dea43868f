"""The tables of the training-data queries and their fixed settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settings(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """rag_config as a dict; the table is fixed at a handful of rows, and more than 1,000 are refused."""
    rows = table(spark, sf_dir, "rag_config").select("setting", "setting_value").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("rag_config holds more than 1,000 settings")
    return {r.setting: r.setting_value for r in rows}
