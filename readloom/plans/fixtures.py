"""The driver's tables seen as reads, sites and intervals; the same views in DataFrame terms and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """library, read, pos, code: a read is a supplier, a position a part; R is an edit, A none, N no site."""
    code = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("library"), F.col("l_suppkey").alias("read"), F.col("l_partkey").alias("pos"), code.alias("code"))
    return spread(rows, "read", "pos").groupBy("library", "read", "pos").agg(F.max("code").alias("code"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, pos, bit, one row per read and position, both libraries together."""
    return line(spark, sf_dir).groupBy("read", "pos").agg(F.max("code").alias("bit")).where("bit < 2")


def library_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line(spark, sf_dir).where("code < 2").withColumnRenamed("code", "bit")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, pos, kind, value, bit: a read is a user, a position an event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("read"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), "value", (F.col("value") >= 35).cast("int").alias("bit"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, start, end, strand: intervals from parts."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select(k.alias("key"), (k * 7).alias("start"), (k * 7 + n).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.strings import bases as of

    return table(spark, sf_dir, "documents").select("doc_id", of(F.col("text")).alias("seq"))


SQL = {
    "line": "line AS (SELECT l_linestatus AS library, l_suppkey AS read, l_partkey AS pos, max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 2 END) AS code FROM lineitem GROUP BY ALL)",
    "sites": "sites AS (SELECT read, pos, max(code) AS bit FROM line GROUP BY ALL HAVING max(code) < 2)",
    "lib": "lib AS (SELECT library, read, pos, code AS bit FROM line WHERE code < 2)",
    "ev": "ev AS (SELECT user_id AS read, event_id AS pos, event_type AS kind, value, CASE WHEN value >= 35 THEN 1 WHEN value IS NOT NULL THEN 0 END AS bit FROM events)",
    "genes": "genes AS (SELECT p_partkey AS key, p_partkey * 7 AS start, p_partkey * 7 + p_size AS \"end\", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)",
    "seqs": "seqs AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
