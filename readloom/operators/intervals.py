"""Joins and arithmetic of half-open intervals, and nearest anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(df: DataFrame, start: str, end: str, width: int, name: str = "bin") -> DataFrame:
    """A row for each bin that [start, end) touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlaps(left: DataFrame, right: DataFrame, on: list[str], width: int = 64) -> DataFrame:
    """left (start, end) with each right (r_start, r_end) that overlaps it, and by how much. An equi-join on bins: a pair
    is kept in the bin where its overlap begins, so none comes twice."""
    both = binned(left, "start", "end", width).join(binned(right, "r_start", "r_end", width), [*on, "bin"])
    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    return both.where((lo < hi) & (F.floor(lo / width) == F.col("bin"))).withColumn("overlap", hi - lo).drop("bin")


def holding(points: DataFrame, spans: DataFrame, pos: str, how: str = "inner", width: int = 256) -> DataFrame:
    """points with each of spans (start, end) that holds their pos; with how="left" those that none holds, too. An
    equi-join on the point's bin: a span is a row for each bin that it touches, not for each position."""
    here = points.withColumn("_bin", F.floor(F.col(pos) / width))
    return here.join(binned(spans, "start", "end", width, "_r_bin"), (F.col("_bin") == F.col("_r_bin")) & (F.col("start") <= F.col(pos)) & (F.col(pos) < F.col("end")), how).drop("_bin", "_r_bin")


def clipped(df: DataFrame, width: int) -> DataFrame:
    """The parts of each interval in bins of positions, with _bin; an empty interval has none."""
    edge = F.col("_bin") * width
    cut = binned(df.where("start < end"), "start", "end", width, "_bin")
    return cut.withColumns({"start": F.greatest("start", edge), "end": F.least("end", edge + width)})


def depths(df: DataFrame, by: list[str], of: dict[str, Column], width: int = 4096) -> DataFrame:
    """by, start, end and for each of `of` how many intervals for which it holds cover the stretch, which is cut where any
    interval begins or ends and at bins. Ends are sorted and summed: no row is made for a position."""
    cut = clipped(df, width).select(*by, "_bin", "start", "end", *[c.cast("int").alias(f"_n{i}") for i, c in enumerate(of.values())])
    n = [F.col(f"_n{i}") for i in range(len(of))]
    step = lambda at, sign: F.struct(F.col(at).alias("at"), *[(c * sign).alias(f"n{i}") for i, c in enumerate(n)])
    ends = cut.select(*by, "_bin", F.explode(F.array(step("start", 1), step("end", -1))).alias("s")).select(*by, "_bin", "s.*")
    # one row a place, so that each has its whole change
    ends = ends.groupBy(*by, "_bin", "at").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(of))])
    w = Window.partitionBy(*by, "_bin").orderBy("at")
    out = ends.select(*by, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *[F.sum(f"n{i}").over(w).alias(name) for i, name in enumerate(of)])
    return out.where("end IS NOT NULL")


def once_covered(df: DataFrame, by: list[str], carry: list[str], width: int = 4096) -> DataFrame:
    """by, start, end, carry: the stretches that exactly one interval covers, with what that interval carries, cut at bins
    so that a long sequence is many groups. Of intervals that have begun where one is left, it is the one that ends last."""
    cut = clipped(df, width).select(*by, "_bin", *carry, "start", "end")
    it = F.struct("end", *carry)
    steps = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("more"), it.alias("it")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("more"), F.lit(None).cast(cut.select(it).schema[0].dataType).alias("it")))
    ends = cut.select(*by, "_bin", F.explode(steps).alias("s")).select(*by, "_bin", "s.at", "s.more", "s.it")
    w = Window.partitionBy(*by, "_bin").orderBy("at")
    found = ends.select(*by, "at", F.lead("at").over(w).alias("next"), F.sum("more").over(w).alias("n"), F.max("it").over(w).alias("it"))
    return found.where("n = 1 AND at < next").select(*by, F.col("at").alias("start"), F.col("next").alias("end"), *[F.col(f"it.{c}").alias(c) for c in carry])


def best_overlap(left: DataFrame, right: DataFrame, key: str, on: list[str], r_key: str, width: int = 64) -> DataFrame:
    """key, r_key, overlap: the interval with the most overlap; of equal ones the smallest r_key."""
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), r_key)
    return overlaps(left, right, on, width).withColumn("rank", F.row_number().over(w)).where("rank = 1").select(key, r_key, "overlap")


def touching(left: DataFrame, right: DataFrame, key: str, on: list[str], width: int = 64) -> DataFrame:
    """The rows of left that overlap any interval of right."""
    return left.join(overlaps(left, right, on, width).select(key).distinct(), key, "left_semi")


def merged(df: DataFrame, by: list[str]) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    new = df.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.when(F.col("start") <= F.col("before"), 0).otherwise(1))
    return new.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(df: DataFrame, by: list[str]) -> DataFrame:
    """What lies between merged intervals: introns between exons."""
    w = Window.partitionBy(*by).orderBy("start")
    return merged(df, by).select(*by, F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where("end IS NOT NULL")


def neighbour_caps(df: DataFrame, by: list[str], key: str, flank: int) -> DataFrame:
    """key, left, right: how far an interval may extend before its neighbours, at most `flank`."""
    w = Window.partitionBy(*by).orderBy("start", "end", key)
    cap = lambda x: F.greatest(F.lit(0), F.least(F.lit(flank), F.coalesce(x, F.lit(flank))))
    return df.select(key, cap(F.col("start") - F.lag("end").over(w)).alias("left"), cap(F.lead("start").over(w) - F.col("end")).alias("right"))


def antisense_covered(df: DataFrame, key: str, share: float = 0.5, width: int = 64) -> DataFrame:
    """key of intervals that one on the other strand, at least as long, covers by the share or more of their length."""
    other = df.select(F.col(key).alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("strand").alias("r_strand"), F.lit(0).alias("one"))
    both = overlaps(df.withColumn("one", F.lit(0)), other, ["one"], width).where("strand <> r_strand")
    mine, its = F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start")
    return both.where((mine <= its) & (F.col("overlap") >= share * mine)).select(key).distinct()


def nearest(points: DataFrame, anchors: DataFrame, by: list[str], pos: str, anchor: str) -> DataFrame:
    """points with the nearest anchor of their group and the signed distance; of two equally near the later one. Both
    tables are sorted together once: no pair of rows is made that is not a result."""
    both = points.withColumn("a", F.lit(None).cast("bigint")).unionByName(anchors.select(*by, F.col(anchor).alias(pos), F.col(anchor).cast("bigint").alias("a")).distinct(), allowMissingColumns=True)
    order = [pos, F.col("a").isNull()]
    before = F.last("a", True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("a", True).over(Window.partitionBy(*by).orderBy(pos, F.col("a").isNotNull()).rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("before", before).withColumn("after", after).where("a IS NULL").drop("a")
    pick = F.when(F.col("before").isNull() | (F.col("after") - F.col(pos) <= F.col(pos) - F.col("before")), F.col("after")).otherwise(F.col("before"))
    return out.withColumn("anchor", F.coalesce(pick, F.col("before"))).withColumn("distance", F.col(pos) - F.col("anchor")).where("anchor IS NOT NULL").drop("before", "after")
