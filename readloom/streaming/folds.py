"""Streaming forms: sites that arrive in files are folded into running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema, files: int = 64) -> DataFrame:
    """Parquet files as they arrive, `files` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_frequency(sites: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """keys, n, k, freq so far; the state is a row for each key, not for each site."""
    return sites.groupBy(*keys).agg(F.count(bit).alias("n"), F.sum(bit).alias("k"), F.avg(bit).alias("freq"))


def windowed_frequency(sites: DataFrame, keys: list[str], bit: str, time: str, width: str, late: str) -> DataFrame:
    """As above by windows of time, which close when the watermark passes them."""
    of = sites.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(bit).alias("n"), F.sum(bit).alias("k"))
    return of.select(F.col("window.start").alias("start"), *keys, "n", "k")
