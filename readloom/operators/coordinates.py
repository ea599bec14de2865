"""Maps between genomic and transcript positions. All positions are 0-based; intervals are half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(segments: DataFrame) -> DataFrame:
    """segments (gene, strand, start, end) with the transcript position of each segment's first base in transcript
    order, which is descending on the minus strand."""
    order = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    w = Window.partitionBy("gene").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))


def tx_map(segments: DataFrame) -> DataFrame:
    """gene, gpos, tx_pos for every base of every segment."""
    s = offsets(segments).where("end > start").select("*", F.explode(F.sequence(F.lit(0), (F.col("end") - F.col("start") - 1).cast("int"))).alias("i"))
    gpos = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("i")).otherwise(F.col("start") + F.col("i"))
    return s.select("gene", gpos.alias("gpos"), (F.col("offset") + F.col("i")).alias("tx_pos"))


def junctions(segments: DataFrame) -> DataFrame:
    """gene, junction: half-integers between the last base of a segment and the first of the next."""
    return offsets(segments).where("offset > 0").select("gene", (F.col("offset") - F.lit(0.5)).alias("junction"))


def codon_sites(seqs: DataFrame, key: str, seq: str, codons: list[str]) -> DataFrame:
    """key, pos, codon, rank of the in-frame codons wanted; ranks count in transcript order from 1 for each codon."""
    s = seqs.where(F.length(seq) >= 3).select(key, seq, F.explode(F.expr(f"sequence(0, length({seq}) - 3, 3)")).alias("pos"))
    s = s.select(key, "pos", F.substring(F.col(seq), F.col("pos") + 1, F.lit(3)).alias("codon")).where(F.col("codon").isin(codons))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(key, "codon").orderBy("pos")))


def reference_span(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers: its M, D and N operations."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def five_prime(pos: Column, strand: Column, cigar: Column) -> Column:
    """The position of a read's 5' end: past the reference span on the minus strand."""
    return F.when(strand == "-", pos + reference_span(cigar)).otherwise(pos)
