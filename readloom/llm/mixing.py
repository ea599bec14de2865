"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a keyed hash and laid end to end as one stream of words, which is cut into
blocks of equal length. Slots 0, 1, 2, ... are mapped through the cumulative shares of the sources by golden-ratio
points; a source's slots are ranked, and rank r takes block r mod (number of blocks): a stream that is used up
starts again, up to three times.

Defined results: size counts the words of a text (null: 0); a document without words is never taken; sources sort
by code point, the null source last; repeated rows are documents of their own; no documents, no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words in a block, at most, and blocks that even a small source has, where it has the words.
BLOCK, LEAST_BLOCKS = 512, 512
GOLDEN = 0.6180339887498949
#: Slots whose ranks one task works out together, and documents in a shuffle bucket.
CHUNK, BUCKET = 1 << 16, 1 << 14


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_size", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("bigint"))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = MAX_REPEATS) -> list[tuple[str | None, int, float]]:
    """Source, size and target; sizes are (source, words). The total is shared by weight; what goes beyond most
    times a source's size is reshared by weight until none is above."""
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    total = float(sum(n for _, n in sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        share = left / sum(weight[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if share * weight[i] > most * sizes[i][1]]
        for i in over:
            target[i] = most * float(sizes[i][1])
            left -= target[i]
        if not over:
            for i in open_:
                target[i] = share * weight[i]
        open_ -= set(over)
        if not over:
            break
    return [(s, n, t) for (s, n), t in zip(sizes, target, strict=True)]


def plan(sizes: DataFrame, weights=WEIGHTS, block: int = BLOCK) -> list[dict]:
    """A row per source: the catalog of sources, not of documents, is what reaches the driver."""
    rows = [(r["source"], r["n"] or 0) for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    out, at = [], 0.0
    for i, (source, n, target) in enumerate(targets(rows, weights)):
        words = max(1, min(block, n // LEAST_BLOCKS))
        blocks = -(-n // words)
        slots = min(target / words if n else 0.0, float(MAX_REPEATS * blocks))
        out.append({"k": i, "source": source, "source_size": n, "target": target, "block": words, "blocks": blocks, "lo": at, "hi": at + slots})
        at += slots
    return out


def schedule(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """slot, k (the source), rank, block_no: what the mix takes, in order."""
    total = sources[-1]["hi"] if sources else 0.0
    n = round(total)
    live = [s for s in sources if s["hi"] > s["lo"]]
    if not n or not live:
        return spark.createDataFrame([], "slot bigint, k int, rank bigint, block_no bigint")
    bounds = spark.createDataFrame([(s["k"], s["lo"] / total, s["hi"] / total, s["blocks"]) for s in live], "k int, lo double, hi double, blocks bigint")
    point = F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)")
    # a hash index over 1024 cells finds the source of a point without comparing it with every source
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * 1024).cast("int"), F.least(F.lit(1023), F.floor(F.col("hi") * 1024)).cast("int"))))
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * 1024).cast("int"))
    last = live[-1]["k"]
    slots = slots.join(F.broadcast(cells), "cell").where((F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | (F.col("k") == last)))
    slots = slots.withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    # ranks in two steps: inside chunks of slots, and over the counts of chunks before
    before = slots.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = before.withColumn("base", F.sum("c").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("chunk", "k").orderBy("slot")) - 1
    ranked = slots.withColumn("r", within).join(before.drop("c"), ["k", "chunk"]).withColumn("rank", F.col("r") + F.coalesce("base", F.lit(0)))
    ranked = ranked.where(F.col("rank") < MAX_REPEATS * F.col("blocks"))
    return ranked.select("slot", "k", F.col("rank").cast("bigint").alias("rank"), (F.col("rank") % F.col("blocks")).alias("block_no"))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where each document lies in its source's stream (k, lo, hi in words, with sizes and target), how often the
    schedule takes each block (k, block_no, uses), and the schedule itself. Texts are read once and never shuffled."""
    order = ["h", "doc_id", "size", "x", "row"]
    base = sized(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", F.col("_size").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.xxhash64("text").alias("x"), F.monotonically_increasing_id().alias("row")
    )
    base = Scratch(spark, "mixing").keep(base, "sizes")
    sources = plan(base, weights, block)
    known = spark.createDataFrame([(s["k"], s["source"], s["source_size"], s["target"], s["block"]) for s in sources], "k int, _source string, source_size bigint, target double, block bigint")
    n_buckets = max(1, base.count() // BUCKET)
    base = base.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("b", F.pmod(F.col("h"), F.lit(n_buckets)))
    # the offset of a document: the sums of the buckets before its own, and a running sum inside it
    sums = base.groupBy("k", "b").agg(F.sum("size").alias("n"))
    sums = sums.select("k", "b", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = F.sum("size").over(Window.partitionBy("k", "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = base.withColumn("run", run).join(sums, ["k", "b"]).withColumn("hi", F.col("before") + F.col("run")).withColumn("lo", F.col("hi") - F.col("size"))
    slots = schedule(spark, sources)
    return placed, slots.groupBy("k", "block_no").agg(F.count(F.lit(1)).alias("uses")), slots


def taken(placed: DataFrame, uses: DataFrame) -> DataFrame:
    """A row per document with the words that the mix takes of it, repeats counted."""
    keys = ["k", "lo", "row", "doc_id", "size", "source_size", "target"]
    some = placed.where("size > 0").withColumn("block_no", F.explode(F.expr("sequence(lo div block, (hi - 1) div block)")))
    part = F.least(F.col("hi"), (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("lo"), F.col("block_no") * F.col("block"))
    some = some.withColumn("part", part).join(uses, ["k", "block_no"], "left").groupBy(*keys).agg(F.sum(F.col("part") * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def mixed(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The contract's columns."""
    return taken(*mix(spark, docs, weights, block)[:2])
