"""Queries of rates, histograms, depth, joins, orders and tests over reads and calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import intervals, profiles, ranks
from . import fixtures as fx
from .core import ORACLE_SQL, QUERIES
from .queries import query, r6

count = lambda: F.count(F.lit(1))


def genes_of(spark, sf_dir):
    """library, read, gene, pos, bit: a gene is 50 positions."""
    return fx.library_sites(spark, sf_dir).withColumn("gene", F.floor(F.col("pos") / 50))


LIB = fx.with_("line", "lib") + ", lg AS (SELECT *, pos // 50 AS gene FROM lib)"


@query("SELECT p_partkey, p_type, p_size FROM part WHERE NOT coalesce(contains(upper(p_type), 'STEEL'), false)")
def name_exclusion(spark, sf_dir):
    """Rows without a word in their name; a null name stays."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return p.where(~F.coalesce(F.upper("p_type").contains("STEEL"), F.lit(False)))


@query("WITH t AS (SELECT p_partkey, p_brand || 'Rep' || p_size || 'Rep' || (p_partkey % 3) AS token FROM part) SELECT p_partkey, regexp_extract(token, '^(.*)(Rep.*)$', 1) AS name, regexp_extract(token, '^(.*)(Rep.*)$', 2) AS rep FROM t")
def manifest_tokens(spark, sf_dir):
    """Library tokens, cut at the last Rep."""
    t = fx.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("Rep"), "p_size", F.lit("Rep"), (F.col("p_partkey") % 3).cast("string")).alias("token"))
    return t.select("p_partkey", F.regexp_extract("token", "^(.*)(Rep.*)$", 1).alias("name"), F.regexp_extract("token", "^(.*)(Rep.*)$", 2).alias("rep"))


@query("SELECT user_id AS read, event_id AS pos, round(value, 6) AS score FROM events WHERE value IS NOT NULL")
def call_lists(spark, sf_dir):
    """Parallel list columns of a read, put together and taken apart again."""
    e = fx.events(spark, sf_dir).where("value IS NOT NULL").groupBy("read").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("x"))
    lists = e.select("read", F.col("x.pos").alias("shadow_gpos"), F.col("x.value").alias("shadow_P_B"))
    flat = lists.select("read", F.explode(F.arrays_zip("shadow_gpos", "shadow_P_B")).alias("z"))
    return flat.select("read", F.col("z.shadow_gpos").alias("pos"), F.round("z.shadow_P_B", 6).alias("score"))


@query("SELECT DISTINCT user_id AS read FROM events WHERE value IS NOT NULL")
def called_reads(spark, sf_dir):
    return fx.events(spark, sf_dir).where("value IS NOT NULL").select("read").distinct()


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey AND l_linenumber = 1")
def assign_left(spark, sf_dir):
    """Left join on two keys."""
    o = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), "o_custkey")
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, ["l_orderkey", "l_linenumber"], "left")


@query("SELECT DISTINCT p_brand AS name, p_type AS id FROM part")
def names_dictionary(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("id")).distinct()


@query("SELECT l_partkey AS key FROM lineitem UNION SELECT p_partkey FROM part")
def union_keys(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).unionByName(fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))).distinct()


@query(LIB + " SELECT library, gene, round(sum(bit) / count(*), 6) AS site_rate, count(*) AS n, count(*) FILTER (pos % 50 < 10) AS n_utr5, count(*) FILTER (pos % 50 >= 10 AND pos % 50 < 40) AS n_cds, sum(bit) FILTER (pos % 50 >= 10 AND pos % 50 < 40)::BIGINT AS cds_edits FROM lg GROUP BY ALL")
def gene_rates(spark, sf_dir):
    cds = (F.col("pos") % 50 >= 10) & (F.col("pos") % 50 < 40)
    return genes_of(spark, sf_dir).groupBy("library", "gene").agg(
        F.round(F.sum("bit") / count(), 6).alias("site_rate"), count().alias("n"), F.count_if(F.col("pos") % 50 < 10).alias("n_utr5"), F.count_if(cds).alias("n_cds"), F.sum(F.when(cds, F.col("bit"))).cast("bigint").alias("cds_edits")
    )


@query(LIB + ", r AS (SELECT library, gene, avg(bit) AS rate FROM lg GROUP BY ALL) SELECT a.gene, a.library, round(log2((a.rate + 0.001) / (b.rate + 0.001)), 6) AS log2fc FROM r a JOIN r b ON a.gene = b.gene AND b.library = 'F' WHERE a.library <> 'F'")
def log2fc_reference(spark, sf_dir):
    rates = genes_of(spark, sf_dir).groupBy("library", "gene").agg(F.avg("bit").alias("rate"))
    return profiles.against_reference(rates, "gene", "library", "rate", "F").select("gene", "library", r6("log2fc"))


@query("WITH c AS (SELECT l_suppkey AS gene, floor(l_quantity / 5) * 5 AS bin, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT bin, n / sum(n) OVER (PARTITION BY gene) AS s FROM c) SELECT bin::DOUBLE AS bin, round(sum(s) / (SELECT count(DISTINCT l_suppkey) FROM lineitem), 6) AS share FROM s GROUP BY bin")
def equal_weight_histogram(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), "l_quantity")
    out = profiles.equal_weight_histogram(li, "gene", profiles.binned_value(F.col("l_quantity"), 0.0, 5.0))
    return out.select(F.col("bin").cast("double").alias("bin"), r6("share"))


@query(fx.with_("ev") + ", r AS (SELECT read, max(pos) - min(pos) AS len, count(*) FILTER (bit = 1) AS n FROM ev GROUP BY read) SELECT len // 1000 AS bin, n, count(*) AS reads FROM r GROUP BY ALL")
def calls_by_length(spark, sf_dir):
    r = fx.events(spark, sf_dir).groupBy("read").agg((F.max("pos") - F.min("pos")).alias("len"), F.count_if(F.col("bit") == 1).alias("n"))
    return r.groupBy(F.floor(F.col("len") / 1000).alias("bin"), "n").agg(count().alias("reads"))


@query(fx.with_("genes") + " SELECT pos, count(*) AS depth FROM (SELECT unnest(range(start, \"end\")) AS pos FROM genes) WHERE pos % 10 < 7 GROUP BY pos")
def run_depth(spark, sf_dir):
    """Depth of runs, clipped to exons (the first seven of ten positions)."""
    d = intervals.depths(fx.genes(spark, sf_dir), [], {"depth": F.lit(True)}).where("depth > 0")
    return d.select(F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "depth").where("pos % 10 < 7")


@query(LIB + ", d AS (SELECT library = 'F' AS shadow, gene, count(*) AS n, sum(bit)::BIGINT AS e FROM lg GROUP BY ALL) SELECT gene, max(n) FILTER (shadow) AS n_shadow, max(e) FILTER (shadow) AS e_shadow, max(n) FILTER (NOT shadow) AS n_back, max(e) FILTER (NOT shadow) AS e_back FROM d GROUP BY gene HAVING min(n) >= 3 AND count(*) = 2")
def background_2x2(spark, sf_dir):
    """Shadow and background tables of genes with enough observations in both."""
    s = F.col("library") == "F"
    of = genes_of(spark, sf_dir).groupBy("gene").agg(F.count_if(s).alias("n_shadow"), F.count_if(s & (F.col("bit") == 1)).alias("e_shadow"), F.count_if(~s).alias("n_back"), F.count_if(~s & (F.col("bit") == 1)).alias("e_back"))
    return of.where("n_shadow >= 3 AND n_back >= 3")


@query()
def background_fisher(spark, sf_dir):
    """Two-sided exact p of each gene's table."""
    t = background_2x2(spark, sf_dir)
    p = profiles.fisher_exact(F.col("e_shadow"), F.col("n_shadow") - F.col("e_shadow"), F.col("e_back"), F.col("n_back") - F.col("e_back"))
    return t.select("gene", p.alias("p"))


@query(LIB + """, r AS (SELECT library, gene, read, avg(bit) AS m FROM lg GROUP BY ALL), x AS (SELECT a.gene, round(a.m - b.m, 9) AS d FROM r a JOIN r b ON a.gene = b.gene AND a.read = b.read AND a.library = 'F' AND b.library = 'O'),
    k AS (SELECT gene, abs(d) AS m, d > 0 AS up, rank() OVER (PARTITION BY gene ORDER BY abs(d)) AS lo, count(*) OVER (PARTITION BY gene, abs(d)) AS t FROM x WHERE d <> 0),
    s AS (SELECT gene, count(*) AS n, coalesce(sum(lo + (t - 1) / 2.0) FILTER (up), 0) AS plus, sum(t * t - 1) AS ties FROM k GROUP BY gene)
    SELECT gene, n, least(plus, n * (n + 1) / 2 - plus)::DOUBLE AS w, round((least(plus, n * (n + 1) / 2 - plus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48.0), 6) AS z FROM s""")
def wilcoxon(spark, sf_dir):
    """Signed ranks of the reads' differences between libraries, by gene."""
    r = genes_of(spark, sf_dir).groupBy("library", "gene", "read").agg(F.avg("bit").alias("m"))
    x = r.where("library = 'F'").join(r.where("library = 'O'").select("gene", "read", F.col("m").alias("other")), ["gene", "read"])
    out = profiles.wilcoxon(x.withColumn("d", F.round(F.col("m") - F.col("other"), 9)), "gene", "d")
    return out.select("gene", "n", F.col("w").cast("double").alias("w"), r6("z"))


@query(LIB + ", s AS (SELECT library, gene, count(*) AS n, avg(bit) AS m FROM lg GROUP BY ALL), c AS (SELECT unnest([1, 3, 5, 10]) AS cutoff), j AS (SELECT cutoff, a.m AS x, b.m AS y FROM s a JOIN s b ON a.gene = b.gene AND a.library = 'F' AND b.library = 'O', c WHERE a.n >= cutoff AND b.n >= cutoff), k AS (SELECT cutoff, rank() OVER (PARTITION BY cutoff ORDER BY x) + (count(*) OVER (PARTITION BY cutoff, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY cutoff ORDER BY y) + (count(*) OVER (PARTITION BY cutoff, y) - 1) / 2.0 AS ry FROM j) SELECT cutoff, count(*) AS genes, round(corr(rx, ry), 5) AS rho FROM k GROUP BY cutoff HAVING count(*) > 2")
def cutoff_sweep(spark, sf_dir):
    """Rank correlation of two libraries' genes, for a sweep of least counts."""
    s = genes_of(spark, sf_dir).groupBy("library", "gene").agg(count().alias("n"), F.avg("bit").alias("m"))
    both = s.where("library = 'F'").select("gene", F.col("n").alias("nx"), F.col("m").alias("x")).join(s.where("library = 'O'").select("gene", F.col("n").alias("ny"), F.col("m").alias("y")), "gene")
    j = both.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in (1, 3, 5, 10)]))).where("nx >= cutoff AND ny >= cutoff")
    rank = lambda c: F.rank().over(Window.partitionBy("cutoff").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("cutoff", c)) - 1) / 2
    k = j.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    return k.groupBy("cutoff").agg(count().alias("genes"), F.round(F.corr("rx", "ry"), 5).alias("rho")).where("genes > 2")


@query(LIB + ", b AS (SELECT read, gene, max(bit) FILTER (pos % 2 = 0) AS a, max(bit) FILTER (pos % 2 = 1) AS b FROM lg GROUP BY ALL) SELECT gene, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 1 AND b = 1) AS n11 FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY gene")
def joint_classes(spark, sf_dir):
    """Joint classes of two sites of a read."""
    of = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("bit")))
    b = genes_of(spark, sf_dir).groupBy("read", "gene").agg(of(0).alias("a"), of(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    n = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y)).alias(f"n{x}{y}")
    return b.groupBy("gene").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))


@query(fx.with_("line", "sites") + ", a AS (SELECT read, min(pos) FILTER (bit = 1) AS anchor FROM sites GROUP BY read) SELECT pos - anchor AS off, sum(bit)::BIGINT AS edits, count(*) AS n, round(sum(bit) / count(*), 6) AS ratio FROM sites JOIN a USING (read) WHERE abs(pos - anchor) <= 30 GROUP BY ALL")
def anchored_matrix(spark, sf_dir):
    """Edits by offset from a read's first edit; the anchor comes from a window, nothing is joined."""
    s = fx.sites(spark, sf_dir).withColumn("anchor", F.min(F.when(F.col("bit") == 1, F.col("pos"))).over(Window.partitionBy("read"))).where("abs(pos - anchor) <= 30")
    return s.groupBy((F.col("pos") - F.col("anchor")).alias("off")).agg(F.sum("bit").cast("bigint").alias("edits"), count().alias("n"), F.round(F.sum("bit") / count(), 6).alias("ratio"))


@query(LIB + ", w AS (SELECT read, gene, row_number() OVER (PARTITION BY read ORDER BY gene) AS rank, max(bit) = 0 AS protected FROM lg WHERE pos % 50 < 5 GROUP BY read, gene) SELECT b.rank - a.rank AS distance, count(*) AS pairs, count(*) FILTER (a.protected AND b.protected) AS both, count(*) FILTER (NOT a.protected AND b.protected) AS after_unprotected FROM w a JOIN w b ON a.read = b.read AND b.rank > a.rank GROUP BY ALL")
def facilitation_pairs(spark, sf_dir):
    w = genes_of(spark, sf_dir).where("pos % 50 < 5").groupBy("read", "gene").agg((1 - F.max("bit")).alias("protected"))
    w = w.withColumn("rank", F.row_number().over(Window.partitionBy("read").orderBy("gene")).cast("bigint"))
    return profiles.facilitation(w, "read", "rank", "protected")


@query(LIB + " SELECT gene, pos, round(avg(bit), 6) AS mean FROM lg GROUP BY ALL")
def column_means(spark, sf_dir):
    return genes_of(spark, sf_dir).groupBy("gene", "pos").agg(F.round(F.avg("bit"), 6).alias("mean"))


@query("SELECT event_type AS barcode, user_id % 5 AS contig, count(*) AS n, count(DISTINCT event_id) AS reads FROM events GROUP BY ALL")
def barcode_counts(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("barcode"), (F.col("user_id") % 5).alias("contig")).agg(count().alias("n"), F.count_distinct("event_id").alias("reads"))


@query("WITH o AS (SELECT l_partkey AS a, l_partkey + l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT DISTINCT p_partkey AS a, p_partkey + 1 + p_size % 4 AS b FROM part) SELECT a, b, n FROM o JOIN k USING (a, b)")
def validated_junctions(spark, sf_dir):
    """Observed junctions that the annotation has."""
    li = fx.table(spark, sf_dir, "lineitem")
    o = li.groupBy(F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_linenumber")).alias("b")).agg(count().alias("n"))
    k = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1 + F.col("p_size") % 4).alias("b")).distinct()
    return o.join(k, ["a", "b"])


@query("SELECT l_suppkey AS read, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS med, round(sum(pow(10, -l_quantity / 10)) / count(*), 6) AS error, round(sum(pow(10, -l_quantity)), 6) AS score FROM lineitem GROUP BY ALL")
def quality_stats(spark, sf_dir):
    """Mean and median quality, error rate, and the score with its own power."""
    q = F.col("l_quantity")
    return fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("read")).agg(
        F.round(F.avg(q), 6).alias("mean"), F.round(F.median(q), 6).alias("med"), F.round(F.sum(F.pow(F.lit(10.0), -q / 10)) / count(), 6).alias("error"), F.round(F.sum(F.pow(F.lit(10.0), -q)), 6).alias("score")
    )


@query(LIB + ", v AS (SELECT library, pos % 50 AS region, pos // 50 % 8 AS lag, read % 2 AS half, CASE WHEN count(*) > 2 THEN corr(bit, read) END AS r FROM lg GROUP BY ALL) SELECT library, region, lag, count(*) AS n, count(*) FILTER (r IS NOT NULL AND NOT isnan(r)) AS n_valid, round(coalesce(sum(r) FILTER (NOT isnan(r)), 0), 5) AS total, round(coalesce(sum(r * r) FILTER (NOT isnan(r)), 0), 5) AS squares FROM v GROUP BY ALL")
def correlation_fold(spark, sf_dir):
    """Running folds of correlations: counts, valid ones, sum and sum of squares, as partial and final aggregates."""
    g = genes_of(spark, sf_dir)
    v = g.groupBy("library", (F.col("pos") % 50).alias("region"), (F.col("gene") % 8).alias("lag"), (F.col("read") % 2).alias("half")).agg(F.when(count() > 2, F.try_divide(F.covar_pop("bit", "read"), F.stddev_pop("bit") * F.stddev_pop("read"))).alias("r"))
    r = F.col("r")
    return v.groupBy("library", "region", "lag").agg(count().alias("n"), F.count(r).alias("n_valid"), F.round(F.coalesce(F.sum(r), F.lit(0.0)), 5).alias("total"), F.round(F.coalesce(F.sum(r * r), F.lit(0.0)), 5).alias("squares"))


@query(fx.with_("line", "sites") + " SELECT read, pos, sum(bit) OVER (PARTITION BY read ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)::BIGINT AS total FROM sites")
def convolution(spark, sf_dir):
    return profiles.convolved(fx.sites(spark, sf_dir), "read", "pos", "bit", 10).withColumn("total", F.col("total").cast("bigint"))


@query(fx.with_("line", "sites") + """, m AS (SELECT pos % 20 AS x, avg(bit) AS m FROM sites GROUP BY ALL), c AS (SELECT x, m - (SELECT avg(m) FROM m) AS d FROM m),
    a AS (SELECT b.x - c.x AS lag, sum(b.d * c.d) AS s FROM c JOIN c b ON b.x >= c.x GROUP BY ALL) SELECT lag, round(s / (SELECT s FROM a WHERE lag = 0), 6) AS r FROM a""")
def profile_autocorrelation(spark, sf_dir):
    """Autocorrelation of the mean profile over 20 places, as full correlation over its value at lag 0."""
    m = fx.sites(spark, sf_dir).groupBy((F.col("pos") % 20).alias("x")).agg(F.avg("bit").alias("m"))
    rows = m.agg(F.sort_array(F.collect_list(F.struct("x", "m"))).alias("p"), F.avg("m").alias("mu"))  # 20 places
    c = rows.select(F.inline("p"), "mu").select("x", (F.col("m") - F.col("mu")).alias("d"))
    a = c.join(F.broadcast(c.toDF("y", "e"))).where("y >= x").groupBy((F.col("y") - F.col("x")).alias("lag")).agg(F.sum(F.col("d") * F.col("e")).alias("s"))
    zero = a.where("lag = 0").select(F.col("s").alias("zero"))
    return a.join(F.broadcast(zero)).select("lag", F.round(F.col("s") / F.col("zero"), 6).alias("r"))


@query()
def interval_rows(spark, sf_dir):
    """Greedy rows of intervals that do not overlap, by strand and hundred keys."""
    g = fx.genes(spark, sf_dir).withColumn("grp", F.concat("strand", F.floor(F.col("key") / 100).cast("string")))
    return profiles.packed(g, "grp")


@query()
def shuffle_null(spark, sf_dir):
    """Three shuffles of each sequence, for permutation nulls."""
    return profiles.shuffled(fx.bases(spark, sf_dir), "seq", 3, 7).select("doc_id", "round", "shuffled")


@query("WITH c AS (SELECT l_suppkey AS read, l_partkey AS pos, l_quantity AS len FROM lineitem) SELECT read, pos, len FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY len DESC, pos) AS k FROM c) WHERE k <= 30 QUALIFY rank() OVER (PARTITION BY read ORDER BY len DESC) <= 10")
def topn_heap(spark, sf_dir):
    """The thirty longest in order, and of those all that are as long as the tenth."""
    c = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("read"), F.col("l_partkey").alias("pos"), F.col("l_quantity").alias("len"))
    k = c.withColumn("k", F.row_number().over(Window.partitionBy("read").orderBy(F.desc("len"), "pos"))).where("k <= 30")
    return k.withColumn("r", F.rank().over(Window.partitionBy("read").orderBy(F.desc("len")))).where("r <= 10").select("read", "pos", "len")


@query(LIB + " SELECT library, read, gene, round(avg(bit), 6) AS freq FROM lg GROUP BY ALL HAVING avg(bit) >= 0.8")
def rare_reads(spark, sf_dir):
    return genes_of(spark, sf_dir).groupBy("library", "read", "gene").agg(F.avg("bit").alias("f")).where("f >= 0.8").select("library", "read", "gene", F.round("f", 6).alias("freq"))


@query(LIB + ", t AS (SELECT gene FROM lg GROUP BY gene ORDER BY count(DISTINCT read) DESC, gene LIMIT 10) SELECT gene, read, count(*) AS n FROM lg SEMI JOIN t USING (gene) GROUP BY ALL")
def top_transcripts(spark, sf_dir):
    """Reads of the ten transcripts that most reads have; ten keys are broadcast."""
    g = genes_of(spark, sf_dir)
    top = g.groupBy("gene").agg(F.count_distinct("read").alias("c")).orderBy(F.desc("c"), "gene").limit(10).select("gene")
    return g.join(F.broadcast(top), "gene", "left_semi").groupBy("gene", "read").agg(count().alias("n"))


@query(LIB + " SELECT gene, count(DISTINCT read) AS reads, sum(bit)::BIGINT AS edits FROM lg GROUP BY gene ORDER BY reads DESC, edits DESC, gene LIMIT 20")
def ranked_genes(spark, sf_dir):
    g = genes_of(spark, sf_dir).groupBy("gene").agg(F.count_distinct("read").alias("reads"), F.sum("bit").cast("bigint").alias("edits"))
    return g.orderBy(F.desc("reads"), F.desc("edits"), "gene").limit(20)


@query(fx.with_("seqs") + ", u AS (SELECT doc_id, string_agg(CASE WHEN i % 5 = 0 THEN 'A' ELSE substr(seq, i + 1, 1) END, '' ORDER BY i) AS restored FROM (SELECT doc_id, seq, unnest(range(0, length(seq))) AS i FROM seqs) GROUP BY doc_id) SELECT doc_id, restored FROM u")
def unmutate(spark, sf_dir):
    """Bases at known positions turned back into A."""
    return fx.bases(spark, sf_dir).where("length(seq) > 0").select("doc_id", F.array_join(F.transform(F.split("seq", ""), lambda c, i: F.when(i % 5 == 0, "A").otherwise(c)), "").alias("restored"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H:%M:%S') AS stamp FROM orders")
def timestamps(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd_HH:mm:ss").alias("stamp"))


@query("WITH c AS (SELECT p_size AS threshold, count(*) FILTER (p_partkey % 3 = 0) AS p, count(*) FILTER (p_partkey % 3 <> 0) AS n FROM part GROUP BY ALL) SELECT threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC)")
def roc_points(spark, sf_dir):
    """Points of the curve from counts per distinct score, so the ordered window runs over scores, not rows."""
    p = fx.table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 3 == 0).cast("int").alias("y"))
    return profiles.roc(p, "p_size", "y").select("threshold", r6("tpr"), r6("fpr"))


@query("WITH c AS (SELECT p_size AS t, count(*) FILTER (p_partkey % 3 = 0) AS p, count(*) FILTER (p_partkey % 3 <> 0) AS n FROM part GROUP BY ALL), r AS (SELECT t, sum(p) OVER w / sum(p) OVER () - sum(n) OVER w / sum(n) OVER () AS j FROM c WINDOW w AS (ORDER BY t DESC)) SELECT t AS threshold, round(j, 6) AS youden FROM r ORDER BY round(j, 9) DESC, t LIMIT 1")
def youden_cutoff(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 3 == 0).cast("int").alias("y"))
    j = profiles.roc(p, "p_size", "y").select("threshold", F.round(F.col("tpr") - F.col("fpr"), 9).alias("j"))
    best = j.agg(F.max(F.struct("j", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.round("b.j", 6).alias("youden"))


@query(fx.with_("line", "sites") + ", w AS (SELECT read, pos // 100 AS win, count(*) AS n, count(*) FILTER (bit = 0) AS k FROM sites GROUP BY ALL) SELECT read, arg_min(win, (pow(0.5, n) * pow(1.5, k), win)) AS best, count(*) AS windows FROM w WHERE n >= 3 GROUP BY read")
def best_window(spark, sf_dir):
    """Of a read's windows the one with the smallest score, ties to the first."""
    w = fx.sites(spark, sf_dir).groupBy("read", F.floor(F.col("pos") / 100).alias("win")).agg(count().alias("n"), F.count_if(F.col("bit") == 0).alias("k")).where("n >= 3")
    s = F.pow(F.lit(0.5), "n") * F.pow(F.lit(1.5), "k")
    return w.groupBy("read").agg(F.min(F.struct(s.alias("s"), "win")).alias("m"), count().alias("windows")).select("read", F.col("m.win").alias("best"), "windows")


@query("SELECT l_orderkey::INT AS k, l_quantity::FLOAT::DOUBLE AS q, l_linenumber::SMALLINT::INT AS n FROM lineitem")
def downcast(spark, sf_dir):
    """Numbers narrowed by one schema for all files, then read back."""
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("int").alias("k"), F.col("l_quantity").cast("float").cast("double").alias("q"), F.col("l_linenumber").cast("smallint").cast("int").alias("n"))


@query(LIB + ", m AS (SELECT library, gene, avg(bit) AS m, count(*) AS n FROM lg GROUP BY ALL) SELECT gene, round(a.m, 6) AS m_1, round(b.m, 6) AS m_2, a.n AS n_1, b.n AS n_2 FROM (SELECT * FROM m WHERE library = 'F') a JOIN (SELECT * FROM m WHERE library = 'O') b USING (gene)")
def gene_summary_join(spark, sf_dir):
    m = genes_of(spark, sf_dir).groupBy("library", "gene").agg(F.round(F.avg("bit"), 6).alias("m"), count().alias("n"))
    side = lambda lib, k: m.where(F.col("library") == lib).select("gene", F.col("m").alias(f"m_{k}"), F.col("n").alias(f"n_{k}"))
    return side("F", 1).join(side("O", 2), "gene")


@query(fx.with_("line", "sites", "genes") + ", r AS (SELECT read, min(pos) AS lo, max(pos) AS hi FROM sites GROUP BY read) SELECT read, count(*) AS inside FROM sites JOIN r USING (read) WHERE pos BETWEEN lo + 10 AND hi - 10 GROUP BY read")
def site_in_span(spark, sf_dir):
    """Sites inside their own read's span, by windows over the read."""
    w = Window.partitionBy("read")
    s = fx.sites(spark, sf_dir).withColumn("lo", F.min("pos").over(w)).withColumn("hi", F.max("pos").over(w)).where("pos BETWEEN lo + 10 AND hi - 10")
    return s.groupBy("read").agg(count().alias("inside"))


@query(fx.with_("seqs") + ", m AS (SELECT substr(seq, i + 1, 3) AS motif, count(*) AS n FROM (SELECT seq, unnest(range(0, length(seq) - 2)) AS i FROM seqs WHERE length(seq) > 2) GROUP BY ALL) SELECT motif, n FROM m")
def site_motifs(spark, sf_dir):
    """Three-base motifs at every place."""
    s = fx.bases(spark, sf_dir).where("length(seq) > 2").select("seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 2)).alias("i"))
    return s.groupBy(F.substring("seq", F.col("i"), F.lit(3)).alias("motif")).agg(count().alias("n"))


__all__ = ["ORACLE_SQL", "QUERIES", "ranks", "strings"]
