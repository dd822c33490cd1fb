"""Readers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with props.k as k; ts is an instant, as watermarks need."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("long"), "cents": F.round(F.col("value") * 100).cast("long")})


def select_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a layout (name -> type); those that ``df`` lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
