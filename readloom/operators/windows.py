"""Windows and runs along the sites of a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(sites: DataFrame, read: str, pos: str, keep: Column) -> DataFrame:
    """read, lo, hi, n_sites of the maximal runs of sites that fulfil `keep`."""
    w = Window.partitionBy(read).orderBy(pos)
    marked = sites.withColumn("on", F.coalesce(keep, F.lit(False))).withColumn("was", F.lag("on", 1, False).over(w))
    island = F.sum((F.col("on") & ~F.col("was")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", island).where("on").groupBy(read, "run").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count(F.lit(1)).alias("n_sites")).drop("run")


def run_gaps(found: DataFrame, read: str) -> DataFrame:
    """read, gap: positions between the end of a run and the start of the next."""
    w = Window.partitionBy(read).orderBy("lo")
    return found.select(read, (F.col("lo") - F.lag("hi").over(w) - 1).alias("gap")).where("gap IS NOT NULL")


def eligibility(reads: DataFrame, found: DataFrame, read: str) -> DataFrame:
    """kind, n: reads with no run, one, or several."""
    per = reads.select(read).distinct().join(found.groupBy(read).agg(F.count(F.lit(1)).alias("c")), read, "left")
    kind = F.when(F.coalesce("c", F.lit(0)) == 0, "none").when(F.col("c") == 1, "one").otherwise("several")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def shadows(sites: DataFrame, read: str, pos: str, bit: str, least_span: int, least_sites: int) -> DataFrame:
    """Runs of unedited sites that are long enough."""
    return runs(sites, read, pos, F.col(bit) == 0).where((F.col("hi") - F.col("lo") + 1 >= least_span) & (F.col("n_sites") >= least_sites))


def around(read: str, pos: str, half: int) -> Window:
    return Window.partitionBy(read).orderBy(pos).rangeBetween(-half, half)


def log_odds(sites: DataFrame, read: str, pos: str, bit: str, pa: float, pb: float, half: int) -> DataFrame:
    """sites with the sum of log(P(bit | B) / P(bit | A)) over the closed window around each."""
    one = F.when(F.col(bit) == 1, F.log(F.lit(pb / pa))).otherwise(F.log(F.lit((1 - pb) / (1 - pa))))
    return sites.withColumn("score", F.sum(one).over(around(read, pos, half)))


def binomial_tail(sites: DataFrame, read: str, pos: str, bit: str, p: float, half: int) -> DataFrame:
    """sites with n and k of the window [pos - half, pos + half) and P(X <= k) for X ~ Bin(n, p), by the recursion of
    its terms."""
    w = Window.partitionBy(read).orderBy(pos).rangeBetween(-half, half - 1)
    out = sites.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.sum(bit).over(w))
    first = F.pow(F.lit(1 - p), F.col("n"))
    start = F.struct(first.alias("term"), first.alias("total"))
    step = lambda a, i: F.struct((a["term"] * (F.col("n") - i + 1) / i * (p / (1 - p))).alias("term"), (a["total"] + a["term"] * (F.col("n") - i + 1) / i * (p / (1 - p))).alias("total"))
    terms = F.when(F.col("k") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("k").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("tail", F.aggregate(terms, start, step, lambda a: F.least(F.lit(1.0), a["total"])))


def calls(sites: DataFrame, read: str, pos: str, keep: Column, half: int) -> DataFrame:
    """Unions of fixed-width calls around the sites that fulfil `keep`."""
    from .intervals import merged

    return merged(sites.where(keep).select(read, (F.col(pos) - half).alias("start"), (F.col(pos) + half + 1).alias("end")), [read])


def rolling_mean(sites: DataFrame, read: str, pos: str, value: str, half: int) -> DataFrame:
    """Centred mean over neighbouring sites, as many as there are."""
    return sites.withColumn("mean", F.avg(F.col(value).cast("double")).over(Window.partitionBy(read).orderBy(pos).rowsBetween(-half, half)))


def autocorrelation(sites: DataFrame, read: str, pos: str, value: str, lags: range) -> DataFrame:
    """read, lag, n, r: Pearson correlation of a read's values with those `lag` sites on; all lags in one pass over
    windows, nothing is joined."""
    w = Window.partitionBy(read).orderBy(pos)
    ahead = sites.select(read, F.col(value).cast("double").alias("x"), F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(F.col(value).cast("double"), k).over(w).alias("y")) for k in lags]).alias("ys"))
    pairs = ahead.select(read, "x", F.inline("ys")).where("y IS NOT NULL")
    return pairs.groupBy(read, "lag").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, share of rows up to it; counted per value first, so a common value is one row."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return per.withColumn("share", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))


def fill_nearest(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """Nulls of value get the nearest known one; of two equally near the earlier one."""
    w = Window.partitionBy(*by).orderBy(pos)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(pos))
    out = df.withColumn("_b", F.last(value, True).over(up)).withColumn("_bp", F.last(at, True).over(up)).withColumn("_a", F.first(value, True).over(down)).withColumn("_ap", F.first(at, True).over(down))
    near = F.when(F.col("_bp").isNotNull() & (F.col("_ap").isNull() | (F.col(pos) - F.col("_bp") <= F.col("_ap") - F.col(pos))), F.col("_b")).otherwise(F.col("_a"))
    return out.withColumn("filled", F.coalesce(F.col(value), near)).drop("_b", "_bp", "_a", "_ap")
