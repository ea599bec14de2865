"""Queries of coordinate maps, chains, barcodes and normalised means, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import chains, coordinates, sites
from . import fixtures as fx
from .queries import ORACLE_SQL, QUERIES, query, r6

_SEG = """WITH seg AS (SELECT p_partkey % 40 AS gene, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey * 100 AS start, p_partkey * 100 + p_size AS "end" FROM part),
    o AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY gene ORDER BY CASE strand WHEN '-' THEN -start ELSE start END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM seg)"""


def _segments(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    return fx.table(spark, sf_dir, "part").select((k % 40).alias("gene"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (k * 100).alias("start"), (k * 100 + F.col("p_size")).alias("end"))


@query(_SEG + """, e AS (SELECT *, unnest(range(0, "end" - start)) AS i FROM o)
    SELECT gene, CASE strand WHEN '-' THEN "end" - 1 - i ELSE start + i END AS gpos, (off + i)::BIGINT AS tx_pos FROM e""")
def tx_position_map(spark, sf_dir):
    return coordinates.tx_map(_segments(spark, sf_dir)).select("gene", "gpos", F.col("tx_pos").cast("bigint").alias("tx_pos"))


@query(_SEG + " SELECT gene, off - 0.5::DOUBLE AS junction FROM o WHERE off > 0")
def splice_junctions(spark, sf_dir):
    return coordinates.junctions(_segments(spark, sf_dir)).select("gene", F.col("junction").cast("double").alias("junction"))


@query(fx.with_("seqs") + """, c AS (SELECT doc_id, unnest(range(0, length(seq) - 2, 3)) AS pos, seq FROM seqs), d AS (SELECT doc_id, pos, substr(seq, pos + 1, 3) AS codon FROM c)
    SELECT doc_id, pos, codon, row_number() OVER (PARTITION BY doc_id, codon ORDER BY pos) AS rank FROM d WHERE codon IN ('CAC', 'CAT')""")
def codon_sites_ranked(spark, sf_dir):
    s = fx.bases(spark, sf_dir).groupBy("doc_id").agg(F.max("seq").alias("seq"))
    return coordinates.codon_sites(s, "doc_id", "seq", ["CAC", "CAT"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "codon", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey * 10 + CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT + l_linenumber + 7 ELSE 0 END AS pos5 FROM lineitem""")
def five_prime_ends(spark, sf_dir):
    li, n = fx.table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("bigint").cast("string")
    cigar = F.concat(F.lit("5S"), n, F.lit("M3I"), F.col("l_linenumber").cast("string"), F.lit("D7N"))
    strand = F.when(F.col("l_linestatus") == "F", "-").otherwise("+")
    return li.select("l_orderkey", "l_linenumber", coordinates.five_prime(F.col("l_partkey").cast("bigint") * 10, strand, cigar).alias("pos5"))


_STEP = fx.with_("line", "sites") + """, s AS (SELECT *, lag(bit) OVER r AS was FROM sites WINDOW r AS (PARTITION BY read ORDER BY pos)),
    t AS (SELECT *, CASE WHEN was IS NULL THEN 0 WHEN was = 0 AND bit = 0 THEN ln(0.9) WHEN was = 0 THEN ln(0.1) WHEN bit = 1 THEN ln(0.7) ELSE ln(0.3) END AS step, CASE bit WHEN 1 THEN ln(0.2) ELSE ln(0.8) END AS first FROM s)"""


@query(_STEP + """ SELECT read, pos, round(sum(step) OVER w - first_value(step) OVER w + first_value(first) OVER w, 6) AS logp FROM t
    WINDOW w AS (PARTITION BY read ORDER BY pos RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)""")
def markov_window(spark, sf_dir):
    s = fx.sites(spark, sf_dir)
    return chains.markov_window(s, "read", "pos", "bit", 0.2, (0.9, 0.7), 30).select("read", "pos", r6("logp"))


@query(fx.with_("line", "sites") + """, e AS (SELECT read, unnest(range(pos - 19, pos + 1)) AS start, CASE bit WHEN 1 THEN log10(0.3) ELSE log10(0.7) END AS v FROM sites)
    SELECT read, start, count(*) AS n, round(sum(v), 6) AS total FROM e GROUP BY ALL HAVING count(*) >= 2""")
def sliding_joint_probability(spark, sf_dir):
    v = F.when(F.col("bit") == 1, F.log10(F.lit(0.3))).otherwise(F.log10(F.lit(0.7)))
    s = fx.sites(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))
    return chains.starts_window(s, "read", "pos", v, 20, 2).select("read", "start", "n", r6("total"))


@query(fx.with_("ev") + " SELECT kind, pos % 50 AS centre, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM ev GROUP BY ALL")
def meta_quantiles(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    e = fx.events(spark, sf_dir).groupBy("kind", (F.col("pos") % 50).alias("centre")).agg(q.alias("q"))
    return e.select("kind", "centre", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(["q05", "q50", "q95"])])


@query()
def poisson_binomial_window(spark, sf_dir):
    """P(X <= edits) in the window around each site, X from the positions' own frequencies; SQL has no such fold."""
    s = fx.sites(spark, sf_dir)
    s = s.join(s.groupBy("pos").agg(F.avg("bit").alias("p")), "pos")
    w = Window.partitionBy("read").orderBy("pos").rangeBetween(-30, 29)
    s = s.select("read", "pos", F.collect_list("p").over(w).alias("ps"), F.sum("bit").over(w).alias("k"))
    return s.select("read", "pos", F.size("ps").cast("bigint").alias("n"), "k", F.round(chains.poisson_binomial_tail(F.col("ps"), F.col("k")), 6).alias("tail"))


@query()
def hmm_segments(spark, sf_dir):
    """Posterior of the protected state along each read; a recursion over sites, which SQL windows can't express."""
    return chains.segmented(fx.sites(spark, sf_dir), "read", "pos", "bit", (0.4, 0.05), (0.01, 0.02)).select("read", "pos", "bit", r6("pb"))


@query(fx.with_("line", "lib") + """, u AS (SELECT library, pos % 7 AS motif, read, avg(bit) AS f FROM lib GROUP BY ALL), b AS (SELECT pos % 7 AS motif, avg(bit) AS m FROM lib GROUP BY ALL)
    SELECT library, motif, round(avg((f + 1e-3) / (m + 1e-3)), 6) AS ratio, round(stddev_samp((f + 1e-3) / (m + 1e-3)) / sqrt(count(*)), 6) AS sem, count(*) AS units FROM u JOIN b USING (motif) GROUP BY ALL""")
def motif_normalised_ratio(spark, sf_dir):
    s = fx.library_sites(spark, sf_dir).withColumn("motif", F.col("pos") % 7)
    u = s.groupBy("library", "motif", "read").agg(F.avg("bit").alias("f")).join(s.groupBy("motif").agg(F.avg("bit").alias("m")), "motif")
    u = u.withColumn("x", (F.col("f") + 1e-3) / (F.col("m") + 1e-3))
    return sites.two_stage(u, "read", ["library", "motif"], "x").select("library", "motif", F.round("mean", 6).alias("ratio"), r6("sem"), "units")


@query(fx.with_("seqs") + """, k AS (SELECT item_id, left(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 12) AS code FROM benchmark), d AS (SELECT doc_id, left(seq, 12) AS bar FROM seqs WHERE length(seq) >= 12),
    j AS (SELECT doc_id, item_id, levenshtein(bar, code) AS dist FROM d, k WHERE length(code) = 12),
    r AS (SELECT *, row_number() OVER o AS place, lead(dist) OVER o AS next FROM j WINDOW o AS (PARTITION BY doc_id ORDER BY dist, item_id))
    SELECT doc_id, CASE WHEN next - dist > 1 THEN item_id END AS item_id, dist, next - dist AS margin FROM r WHERE place = 1""")
def levenshtein_demux(spark, sf_dir):
    """The nearest barcode if it is nearer than the second by more than one; the barcodes are a library's fixed set."""
    text = fx.table(spark, sf_dir, "benchmark").select("item_id", F.substring(strings.bases(F.col("text")), 1, 12).alias("code")).where("length(code) = 12")
    codes = text.agg(F.sort_array(F.collect_list(F.struct("item_id", "code"))).alias("codes")).withColumn("one", F.lit(1))
    d = fx.bases(spark, sf_dir).where("length(seq) >= 12").select("doc_id", F.substring("seq", 1, 12).alias("bar"), F.lit(1).alias("one")).join(F.broadcast(codes), "one")
    d = d.select("doc_id", F.array_sort(F.transform("codes", lambda c: F.struct(F.levenshtein(F.col("bar"), c["code"]).cast("bigint").alias("dist"), c["item_id"].alias("item_id")))).alias("b"))
    dist, margin = F.col("b")[0]["dist"], F.try_element_at("b", F.lit(2))["dist"] - F.col("b")[0]["dist"]
    return d.where(F.size("b") > 0).select("doc_id", F.when(margin > 1, F.col("b")[0]["item_id"]).alias("item_id"), dist.alias("dist"), margin.alias("margin"))


@query(fx.with_("line") + """, u AS (SELECT library, read, pos FROM line WHERE code = 2), r AS (SELECT *, pos - lag(pos) OVER (PARTITION BY library, read ORDER BY pos) AS gap FROM u)
    SELECT library, read, max(gap) AS widest, coalesce(bool_or(gap > 100), false) AS unexplained FROM r GROUP BY ALL""")
def unexplained_gaps(spark, sf_dir):
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("library", "read").orderBy("pos"))
    u = fx.line(spark, sf_dir).where("code = 2").withColumn("gap", gap)
    return u.groupBy("library", "read").agg(F.max("gap").alias("widest"), F.coalesce(F.bool_or(F.col("gap") > 100), F.lit(False)).alias("unexplained"))


@query(fx.with_("line", "lib") + """, f AS (SELECT pos, avg(bit) AS f, count(*) AS n FROM lib GROUP BY pos), d AS (SELECT read, pos, bit FROM lib QUALIFY row_number() OVER (PARTITION BY read, pos ORDER BY library) = 1)
    SELECT d.read, count(*) FILTER (bit = 0) AS protected, round(sum(CASE WHEN bit = 0 THEN 1 / greatest(f, 0.01) ELSE 0 END), 6) AS weighted FROM d JOIN f USING (pos) GROUP BY ALL""")
def weighted_protection(spark, sf_dir):
    s = fx.library_sites(spark, sf_dir)
    f = s.groupBy("pos").agg(F.avg("bit").alias("f"))
    first = s.groupBy("read", "pos").agg(F.min_by("bit", "library").alias("bit")).join(f, "pos")
    score = F.when(F.col("bit") == 0, 1 / F.greatest("f", F.lit(0.01))).otherwise(0.0)
    return first.groupBy("read").agg(F.count_if(F.col("bit") == 0).alias("protected"), F.round(F.sum(score), 6).alias("weighted"))


__all__ = ["ORACLE_SQL", "QUERIES"]
