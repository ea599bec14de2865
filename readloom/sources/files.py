"""Text formats as DataFrames: annotation (GTF), sequences (FASTA, FASTQ), alignments (SAM) and library manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = ["gene_id", "gene_name", "gene_biotype", "transcript_id", "transcript_biotype", "exon_number", "protein_id"]


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with 0-based half-open start and end; an attribute that is absent is null."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(part) >= 9))
    found = lambda a: F.regexp_extract("attributes", rf'(?:^|;)\s*{a} "?([^";]*)"?', 1)
    cols = [part[i].alias(n) for i, n in enumerate(["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"])]
    out = rows.select(*cols).withColumn("start", F.col("start").cast("bigint") - 1).withColumn("end", F.col("end").cast("bigint"))
    return out.select("*", *[F.nullif(found(a), F.lit("")).alias(a) for a in ATTRIBUTES]).drop("attributes")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (the header's first word), description, seq; a record is split off at its header, whole files are not read."""
    rec = F.split("value", "\n", 2)
    rows = spark.read.option("lineSep", "\n>").text(path).where("length(trim(value)) > 0")
    head = F.regexp_replace(rec[0], r"^>|\r$", "")
    return rows.select(F.split(head, r"\s+")[0].alias("name"), head.alias("description"), F.regexp_replace(F.coalesce(F.try_element_at(rec, F.lit(2)), F.lit("")), r"\s", "").alias("seq"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of records of four lines. A record may begin at any line of a split, so files are read whole, one
    to a task: shard them as sequencers do."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(@[^\n]*\n[^\n]*\n\+[^\n]*\n[^\n]*)(?:\n|$)"), F.lit(1))).alias("r"))
    line = F.split("r", "\r?\n")
    return rows.select(F.substring_index(F.expr("substring(split(r, '\n')[0], 2)"), " ", 1).alias("name"), line[1].alias("seq"), line[3].alias("qual"))


def mean_quality(qual):
    """Mean phred score of a quality string, offset 33."""
    return F.aggregate(F.split(qual, ""), F.lit(0.0), lambda a, c: a + F.ascii(c) - 33) / F.length(qual)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven mandatory columns, pos 0-based, and tags as a map from tag to its text."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(part) >= 11))
    names = ["read_id", "flag", "chrom", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    tags = F.map_from_entries(F.transform(F.slice(part, F.lit(12), F.size(part)), lambda t: F.struct(F.substring(t, 1, 2), F.regexp_replace(t, r"^..:.:", ""))))
    out = rows.select(*[part[i].alias(n) for i, n in enumerate(names)], tags.alias("tags"))
    whole = {n: F.col(n).cast("bigint") for n in ("flag", "mapq", "pnext", "tlen")}
    return out.withColumns({**whole, "pos": F.col("pos").cast("bigint") - 1})


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """library (name-rep) and path from lines of name, replicate and path; blank and # lines are skipped."""
    part = F.split(F.trim("value"), r"\s+", 3)
    rows = spark.read.text(path).where((F.size(part) == 3) & ~F.trim("value").startswith("#"))
    return rows.select(F.concat_ws("-", part[0], part[1]).alias("library"), part[2].alias("path"))


def write_chunks(df: DataFrame, path: str, rows: int = 50_000, by: list[str] | None = None) -> None:
    """zstd Parquet of at most `rows` rows a file, under a folder for each value of `by`."""
    out = df.write.option("compression", "zstd").option("maxRecordsPerFile", rows)
    (out.partitionBy(*by) if by else out).parquet(path)
