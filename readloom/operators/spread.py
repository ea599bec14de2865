"""How many tasks share a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for each partition.
SHARE = 4 << 20


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by its keys to so many partitions that a task's share does not grow with the input. The number is given, so
    that small shuffles of rows that grow later, as texts do, are not joined. Inputs that Spark cannot size, as rows of the
    driver, have the shuffles' number."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    least = df.sparkSession.sparkContext.defaultParallelism
    if any(n >= 1 << 50 for n in sizes):
        least = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, -(-sum(n for n in sizes if n < 1 << 50) // SHARE)), *by)
