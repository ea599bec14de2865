"""Chains of sites along a read: first-order windows, exact tails and a two-state hidden Markov segmentation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import spread


def markov_window(sites: DataFrame, read: str, pos: str, bit: str, start: float, stay: tuple[float, float], half: int) -> DataFrame:
    """sites with logp: natural log likelihood of the bits of the closed window around each, as a first-order chain.
    P(1) = start at the window's first site; stay[b] is P(b | b)."""
    row, w = Window.partitionBy(read).orderBy(pos), Window.partitionBy(read).orderBy(pos).rangeBetween(-half, half)
    b, was = F.col(bit), F.lag(bit).over(row)
    same = F.when(b == 1, F.lit(stay[1])).otherwise(F.lit(stay[0]))
    step = F.when(was.isNull(), 0.0).when(was == b, F.log(same)).otherwise(F.log(1 - F.when(was == 1, F.lit(stay[1])).otherwise(F.lit(stay[0]))))
    first = F.log(F.when(b == 1, F.lit(start)).otherwise(F.lit(1 - start)))
    s = sites.withColumn("_step", step).withColumn("_first", first)
    return s.withColumn("logp", F.sum("_step").over(w) - F.first("_step").over(w) + F.first("_first").over(w)).drop("_step", "_first")


def starts_window(sites: DataFrame, read: str, pos: str, logp: Column, width: int, least: int) -> DataFrame:
    """read, start, n, total: sum of logp over the sites in [start, start + width), for every start with `least` sites,
    which are one or more."""
    s = sites.select(read, F.col(pos).alias("p"), logp.alias("v")).where(F.col("p").isNotNull() & F.col("v").isNotNull())
    w = Window.partitionBy(read).orderBy("p")
    # the starts whose first site this is lie after the site before; no other row has them
    near = F.collect_list(F.struct("p", "v")).over(w.rangeBetween(0, width - 1))
    s = spread(s, read).select(read, "p", near.alias("near"), F.greatest(F.col("p") - (width - 1), F.lag("p").over(w) + 1).alias("first"))
    s = s.where((F.col("first") <= F.col("p")) & (F.size("near") >= least)).select(read, "near", F.explode(F.sequence("first", "p")).alias("start"))
    s = s.select(read, "start", F.filter("near", lambda x: x["p"] < F.col("start") + width).alias("in")).where(F.size("in") >= least)
    return s.select(read, "start", F.size("in").cast("bigint").alias("n"), F.aggregate("in", F.lit(0.0), lambda a, x: a + x["v"]).alias("total"))


def poisson_binomial_tail(ps: Column, k: Column) -> Column:
    """P(X <= k), X the number of successes of independent trials with the probabilities in the array ps."""
    zero = F.array(F.lit(0.0))
    grown = lambda acc, p: F.zip_with(F.concat(F.transform(acc, lambda x: x * (1 - p)), zero), F.concat(zero, F.transform(acc, lambda x: x * p)), lambda x, y: x + y)
    pmf = F.aggregate(ps, F.array(F.lit(1.0)), grown)
    return F.aggregate(F.slice(pmf, F.lit(1), k.cast("int") + 1), F.lit(0.0), lambda a, x: a + x)


def posterior(bits: np.ndarray, gaps: np.ndarray, p: tuple[float, float], leave: tuple[float, float]) -> np.ndarray:
    """P(state 1 | bits) at each site, by scaled forward and backward passes. p[s] is P(bit = 1 | state s), leave[s] the
    chance to leave s per position; gaps[i] positions lie between sites i - 1 and i, and the matrix is raised to them."""
    n, total = len(bits), leave[0] + leave[1]
    still = np.array([leave[1], leave[0]]) / total
    emit = np.where(bits[:, None] == 1, np.array(p), 1 - np.array(p))
    decay = (1 - total) ** gaps
    ahead, behind = np.empty((n, 2)), np.ones((n, 2))
    move = lambda i: still[None, :] + decay[i] * (np.eye(2) - still[None, :])
    for i in range(n):
        x = (still if i == 0 else ahead[i - 1] @ move(i)) * emit[i]
        ahead[i] = x / x.sum()
    for i in range(n - 2, -1, -1):
        x = move(i + 1) @ (emit[i + 1] * behind[i + 1])
        behind[i] = x / x.sum()
    both = ahead * behind
    return both[:, 1] / both.sum(axis=1)


def segmented(sites: DataFrame, read: str, pos: str, bit: str, p: tuple[float, float], leave: tuple[float, float]) -> DataFrame:
    """read, pos, bit, pb: the posterior of the protected state at each site; a read is one group, as it is one molecule."""
    kinds = dict(sites.dtypes)

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(pos)
        gaps = np.diff(df[pos].to_numpy(), prepend=df[pos].iloc[0]).astype(float)
        return df.assign(pb=posterior(df[bit].to_numpy(), gaps, p, leave))

    return sites.select(read, pos, bit).where(F.col(bit).isNotNull()).groupBy(read).applyInPandas(one, f"`{read}` {kinds[read]}, `{pos}` {kinds[pos]}, `{bit}` {kinds[bit]}, pb double")


def fisher_combined(ps: Column) -> Column:
    """Survival of chi-squared with twice as many degrees of freedom as p-values at -2 sum(ln p), in closed form."""
    half = F.aggregate(ps, F.lit(0.0), lambda a, p: a - F.log(F.greatest(p, F.lit(1e-300))))
    term = lambda i: F.exp(i * F.log(half) - half - F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda a, j: a + F.log(j.cast("double"))))
    return F.when(half <= 0, 1.0).otherwise(F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ps) - 1), term), F.lit(0.0), lambda a, x: a + x))
