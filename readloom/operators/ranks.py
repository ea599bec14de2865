"""Selections by rank, and statistics over ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_with_ties(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Rows whose value is among the group's n largest rows; ties of the last stay."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("rank") <= n).drop("rank")


def top_exact(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n).drop("rank")


def matched(df: DataFrame, strata: list[str], library: str, order: list[str]) -> DataFrame:
    """From each library and stratum as many rows as the smallest library has there, the first in a fixed order."""
    sizes = df.groupBy(*strata, library).agg(F.count(F.lit(1)).alias("c")).groupBy(*strata).agg(F.min("c").alias("least"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*strata, library).orderBy(*order))).join(sizes, strata).where("rank <= least").drop("rank", "least")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """q: the smallest p * m / rank from here on; per value first, so ties are one row."""
    per = df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    per = per.withColumn("rank", F.sum("c").over(w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))).withColumn("m", F.sum("c").over(w))
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(w.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(per.withColumn("q", q).select(*by, p, "q"), [*by, p])


def mean_rank(by: list[str], value: str) -> Column:
    """Ranks from 1, ties get their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*by, value)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", mean_rank(by, x)).withColumn("ry", mean_rank(by, y))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve and the Mann-Whitney U, from mean ranks."""
    ranked = df.withColumn("r", mean_rank(by, score))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("r"))).alias("s"), F.sum(label).alias("n1"), F.count(F.lit(1)).alias("n"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return sums.where("n1 > 0 AND n1 < n").select(*by, u.alias("u"), (u / (F.col("n1") * (F.col("n") - F.col("n1")))).alias("auc"))
