"""Rates, histograms, depth, tests and orders over sites and calls."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned_value(x: Column, low: float, width: float) -> Column:
    """The lower edge of a value's bin."""
    return F.lit(low) + F.floor((x - low) / width) * width


def equal_weight_histogram(df: DataFrame, unit: str, bin_: Column) -> DataFrame:
    """bin, share: the mean over all units of each one's share in the bin; a bin that a unit lacks counts as 0."""
    counts = df.groupBy(unit, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy(unit)))
    units = df.agg(F.count_distinct(unit).alias("units"))  # one row
    return shares.groupBy("bin").agg(F.sum("s").alias("s")).join(F.broadcast(units)).select("bin", (F.col("s") / F.col("units")).alias("share"))


def against_reference(rates: DataFrame, unit: str, library: str, rate: str, reference: str, floor: float = 1e-3) -> DataFrame:
    """unit, library, log2fc of each library's rate against the reference library's."""
    ref = rates.where(F.col(library) == reference).select(unit, F.col(rate).alias("_ref"))
    return rates.where(F.col(library) != reference).join(ref, unit).select(unit, library, F.log2((F.col(rate) + floor) / (F.col("_ref") + floor)).alias("log2fc"))


def convolved(df: DataFrame, unit: str, pos: str, value: str, reach: int) -> DataFrame:
    """unit, pos, total: the sum of values within reach on a dense axis, where absent positions count as 0."""
    w = Window.partitionBy(unit).orderBy(pos).rangeBetween(-reach, reach)
    return df.select(unit, pos, F.sum(value).over(w).alias("total"))


def facilitation(df: DataFrame, unit: str, rank: str, protected: str) -> DataFrame:
    """distance, pairs, both, after_unprotected: of ordered pairs of a unit's windows, by their distance in rank: how often the
    second is protected where the first is, and where it is not."""
    a = df.select(unit, F.col(rank).alias("i"), F.col(protected).alias("x"))
    b = df.select(unit, F.col(rank).alias("j"), F.col(protected).alias("y"))
    both = a.join(b, unit).where("j > i")
    return both.groupBy((F.col("j") - F.col("i")).alias("distance")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("both"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("after_unprotected")
    )


def packed(intervals: DataFrame, group: str) -> DataFrame:
    """group, key, start, end, row: each interval in the first row that is free at its start, by start and then key.
    Greedy and in order, so it runs group by group; a group is one locus."""

    def place(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["start", "key"], kind="stable")
        busy: list[tuple[int, int]] = []  # end, row
        free: list[int] = []
        rows, made = [], 0
        for start, end in zip(t["start"], t["end"], strict=True):
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                row = heapq.heappop(free)
            else:
                row, made = made, made + 1
            rows.append(row)
            heapq.heappush(busy, (end, row))
        return t.assign(row=rows)

    kind = intervals.schema[group].dataType.simpleString()
    return intervals.select(group, "key", "start", "end").groupBy(group).applyInPandas(place, f"{group} {kind}, key bigint, start bigint, end bigint, row int")


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table, from sums of logarithms: tables no likelier than the observed one."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(a: int, b: int, c: int, d: int) -> float:
            choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
            rows, column, n = a + b, a + c, a + b + c + d
            of = {x: choose(rows, x) + choose(n - rows, column - x) - choose(n, column) for x in range(max(0, column - (n - rows)), min(rows, column) + 1)}
            return min(1.0, sum(math.exp(v) for v in of.values() if v <= of[a] + 1e-7))

        return pd.Series([one(*map(int, x)) for x in zip(a, b, c, d, strict=True)])

    return p(a, b, c, d)


def wilcoxon(df: DataFrame, group: str, difference: str) -> DataFrame:
    """group, n, w, p: the signed-rank statistic (the smaller sum) and its two-sided p by the normal approximation with
    ties; zero differences are left out. Ranks come from counts per distinct size, so no group is one task's list."""
    x = df.where(F.col(difference) != 0).select(group, F.abs(difference).alias("m"), (F.col(difference) > 0).alias("up"))
    sizes = x.groupBy(group, "m").agg(F.count(F.lit(1)).alias("t"), F.count_if("up").alias("ups"))
    before = F.sum("t").over(Window.partitionBy(group).orderBy("m")) - F.col("t")
    ranked = sizes.withColumn("rank", before + (F.col("t") + 1) / 2)
    out = ranked.groupBy(group).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("ups")).alias("plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    total = F.col("n") * (F.col("n") + 1) / 2
    w = F.least("plus", total - F.col("plus"))
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    return out.select(group, "n", w.alias("w"), ((w - total / 2) / sd).alias("z"))


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tpr, fpr of each distinct score, from counts."""
    c = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = c.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))  # one row
    w = Window.orderBy(F.desc("threshold"))
    return c.join(F.broadcast(total)).select("threshold", (F.sum("p").over(w) / F.col("positives")).alias("tpr"), (F.sum("n").over(w) / F.col("negatives")).alias("fpr"))


def shuffled(df: DataFrame, text: str, rounds: int, seed: int) -> DataFrame:
    """df with round and `shuffled`: the characters of a string in random order, rounds times; the order comes from hashes."""
    out = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    order = F.array_sort(F.transform(F.split(text, ""), lambda c, i: F.struct(F.xxhash64(F.lit(seed), "round", F.col(text), i).alias("h"), c.alias("c"))))
    return out.withColumn("shuffled", F.array_join(F.transform(order, lambda x: x["c"]), ""))
