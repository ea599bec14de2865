"""Queries that compare libraries, select reads and assign points, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sites
from . import fixtures as fx
from .queries import ORACLE_SQL, QUERIES, query, r6


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def first_occurrence(spark, sf_dir):
    """One row for each key, the earliest; an aggregate, so it is combined before the shuffle."""
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    return li.select("l_partkey", "l_suppkey", "m.l_orderkey", "m.l_linenumber")


@query(fx.with_("line", "lib") + """, n AS (SELECT library, read, count(*) AS n FROM lib GROUP BY ALL HAVING count(*) >= 5)
    SELECT read, min(n) AS least, max(n) AS most FROM n GROUP BY read HAVING count(*) = 2""")
def common_genes(spark, sf_dir):
    """Units that reach a minimum in every library."""
    n = fx.library_sites(spark, sf_dir).groupBy("library", "read").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return n.groupBy("read").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("c")).where("c = 2").drop("c")


@query("""WITH r AS (SELECT l_suppkey AS gene, sum(l_extendedprice::DOUBLE) AS rpf FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), a AS (SELECT l_suppkey AS gene, sum(l_extendedprice::DOUBLE) AS rna FROM lineitem GROUP BY ALL)
    SELECT gene, s_nationkey AS nation, round(rpf / rna, 6) AS te, CASE WHEN rpf / rna >= 0.25 THEN 'high' ELSE 'low' END AS class FROM r JOIN a USING (gene) JOIN supplier ON s_suppkey = gene WHERE rna > 0""")
def efficiency_ratio(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    both = li.groupBy(F.col("l_suppkey").alias("gene")).agg(F.sum(F.when(F.col("l_returnflag") == "R", price)).alias("rpf"), F.sum(price).alias("rna")).where("rna > 0 AND rpf IS NOT NULL")
    te = F.col("rpf") / F.col("rna")
    named = both.join(fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene"), F.col("s_nationkey").alias("nation")), "gene")
    return named.select("gene", "nation", F.round(te, 6).alias("te"), F.when(te >= 0.25, "high").otherwise("low").alias("class"))


@query(fx.with_("line", "sites") + """, c AS (SELECT read, pos, bit, unnest([pos - 2, pos - 1, pos, pos + 1, pos + 2]) AS near FROM sites)
    SELECT a.read, a.pos, count(*) AS hits, sum(c.bit)::BIGINT AS edits FROM sites a JOIN c ON a.read = c.read AND a.pos = c.near AND a.pos <> c.pos GROUP BY ALL""")
def tolerance_lookup(spark, sf_dir):
    """Other sites of the read within two positions, by a range window: nothing is joined."""
    w = Window.partitionBy("read").orderBy("pos").rangeBetween(-2, 2)
    s = fx.sites(spark, sf_dir).withColumn("hits", F.count(F.lit(1)).over(w) - 1).withColumn("edits", F.sum("bit").over(w) - F.col("bit"))
    return s.where("hits > 0").select("read", "pos", "hits", F.col("edits").cast("bigint").alias("edits"))


@query(fx.with_("line", "sites") + """, l AS (SELECT read, max(pos) - min(pos) AS span FROM sites GROUP BY read), q AS (SELECT quantile_cont(span, [0.25, 0.5, 0.75]) AS q FROM l),
    c AS (SELECT read, 1 + (span > q[1])::INT + (span > q[2])::INT + (span > q[3])::INT AS quartile FROM l, q),
    m AS (SELECT quartile, pos % 10 AS rel, read, avg(bit) AS m FROM sites JOIN c USING (read) GROUP BY ALL)
    SELECT quartile, rel, round(avg(m), 6) AS mean, count(*) AS units FROM m GROUP BY ALL""")
def meta_by_length_quartile(spark, sf_dir):
    s = fx.sites(spark, sf_dir)
    spans = s.groupBy("read").agg((F.max("pos") - F.min("pos")).alias("span"))
    cuts = spans.agg(F.percentile("span", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))  # one row
    of = spans.join(F.broadcast(cuts)).select("read", (1 + sum((F.col("span") > F.col("q")[i]).cast("int") for i in range(3))).alias("quartile"))
    rel = s.join(of, "read").withColumn("rel", F.col("pos") % 10)
    return sites.two_stage(rel, "read", ["quartile", "rel"], "bit").select("quartile", "rel", r6("mean"), "units")


@query(fx.with_("line", "lib") + """, m AS (SELECT library, read, avg(bit) AS m FROM lib GROUP BY ALL), o AS (SELECT read, m AS obs FROM m WHERE library = 'F'), n AS (SELECT m AS rnd FROM m WHERE library = 'O'),
    z AS (SELECT avg(rnd) AS mu, stddev_pop(rnd) AS sd, count(*) AS r FROM n)
    SELECT read, round((obs - mu) / sd, 6) AS z, round(((SELECT count(*) FROM n WHERE rnd < obs) + 1) / (r + 2), 6) AS p FROM o, z""")
def null_z_and_p(spark, sf_dir):
    """z against a null sample and Laplace-smoothed empirical p. The null is counted per value and ranked with the
    observed values in one ordered pass over distinct values."""
    m = fx.library_sites(spark, sf_dir).groupBy("library", "read").agg(F.avg("bit").alias("m"))
    null = F.col("library") == "O"
    z = m.where(null).agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"), F.count(F.lit(1)).alias("r"))
    below = m.groupBy("m").agg(F.count_if(null).alias("c")).withColumn("below", F.sum("c").over(Window.orderBy("m")) - F.col("c"))
    rows = m.where(F.col("library") == "F").join(below, "m").join(F.broadcast(z))
    return rows.select("read", F.round((F.col("m") - F.col("mu")) / F.col("sd"), 6).alias("z"), F.round((F.col("below") + 1) / (F.col("r") + 2), 6).alias("p"))


@query(fx.with_("seqs") + """, p AS (SELECT doc_id, seq, lag(seq) OVER (ORDER BY doc_id) AS other FROM (SELECT doc_id, max(left(seq, 30)) AS seq FROM seqs GROUP BY doc_id)),
    s AS (SELECT doc_id, substr(other, i, 1) AS r, substr(seq, i, 1) AS q FROM p, range(1, 31) t(i) WHERE other IS NOT NULL AND i <= least(length(seq), length(other)))
    SELECT doc_id, count(*) FILTER (r = 'A') AS n_a, count(*) FILTER (r = 'A' AND q = 'G') AS n_edit, count(*) FILTER (r <> q) AS n_mismatch FROM s GROUP BY doc_id""")
def mismatch_counts(spark, sf_dir):
    """Edits and mismatches of the first 30 bases of each sequence against the one before it, place by place in array
    functions; mismatch_counts_whole counts whole ones."""
    d = fx.bases(spark, sf_dir).groupBy("doc_id").agg(F.max(F.substring("seq", 1, 30)).alias("seq"))
    d = d.withColumn("other", F.lag("seq").over(Window.orderBy("doc_id"))).where("length(seq) > 0 AND length(other) > 0")
    n = F.least(F.length("seq"), F.length("other"))
    cut = lambda c: F.slice(F.split(c, ""), F.lit(1), n)
    d = d.select("doc_id", F.arrays_zip(cut("other").alias("r"), cut("seq").alias("q")).alias("z"))
    count = lambda f: F.size(F.filter("z", f)).cast("bigint")
    return d.select("doc_id", count(lambda x: x["r"] == "A").alias("n_a"), count(lambda x: (x["r"] == "A") & (x["q"] == "G")).alias("n_edit"), count(lambda x: x["r"] != x["q"]).alias("n_mismatch"))


@query()
def mismatch_counts_whole(spark, sf_dir):
    """Edits and mismatches of each whole sequence against the one before it; repeated ids are rows of their own."""
    d = fx.bases(spark, sf_dir).withColumn("other", F.lag("seq").over(Window.orderBy("doc_id", "seq"))).where("length(seq) > 0 AND length(other) > 0")
    n = F.least(F.length("seq"), F.length("other"))
    cut = lambda c: F.slice(F.split(c, ""), F.lit(1), n)
    d = d.select("doc_id", F.arrays_zip(cut("other").alias("r"), cut("seq").alias("q")).alias("z"))
    count = lambda f: F.size(F.filter("z", f)).cast("bigint")
    return d.select("doc_id", count(lambda x: x["r"] == "A").alias("n_a"), count(lambda x: (x["r"] == "A") & (x["q"] == "G")).alias("n_edit"), count(lambda x: x["r"] != x["q"]).alias("n_mismatch"))


@query()
def co_occurrence_whole(spark, sf_dir):
    """The tally of every pair of sites of a read; co_occurrence's is of those up to 8 apart."""
    return sites.pair_tally_whole(fx.sites(spark, sf_dir), "read", "pos", "bit")


@query()
def odds_ratio_whole(spark, sf_dir):
    return co_occurrence_whole(spark, sf_dir).select("i", "j", F.round(sites.odds_ratio(), 6).alias("odds"))


@query()
def mutual_information_whole(spark, sf_dir):
    return co_occurrence_whole(spark, sf_dir).select("i", "j", F.abs(F.round(sites.mutual_information(), 6)).alias("mi"))


@query(fx.with_("line", "lib") + """, c AS (SELECT library, pos % 5 AS pos, sum(bit) AS e, count(*) - sum(bit) AS u FROM lib GROUP BY ALL), f AS (SELECT * FROM c WHERE library = 'F'), o AS (SELECT * FROM c WHERE library = 'O')
    SELECT f.pos, round(log2(((f.e + 0.5) / (f.u + 0.5)) / ((o.e + 0.5) / (o.u + 0.5))), 6) AS log2_odds FROM f JOIN o USING (pos)""")
def log2_odds_ratio(spark, sf_dir):
    c = fx.library_sites(spark, sf_dir).groupBy((F.col("pos") % 5).alias("pos"), "library").agg(F.sum("bit").alias("e"), F.count_if(F.col("bit") == 0).alias("u"))
    odds = lambda x: F.max(F.when(F.col("library") == x, (F.col("e") + 0.5) / (F.col("u") + 0.5)))
    return c.groupBy("pos").agg(odds("F").alias("f"), odds("O").alias("o")).where("f IS NOT NULL AND o IS NOT NULL").select("pos", F.round(F.log2(F.col("f") / F.col("o")), 6).alias("log2_odds"))


@query()
def principal_components(spark, sf_dir):
    """Scores of centred vectors on the leading components; the covariance is aggregated, only it comes to one place.
    Signs are fixed by the component's largest entry being positive."""
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    table = fx.table(spark, sf_dir, "embeddings")
    key = table.columns[0]
    vector = next(n for n, t in table.dtypes if t.startswith("array"))
    v = table.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    v = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=3, inputCol="c", outputCol="y").fit(v)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    y = vector_to_array("y")
    return model.transform(v).select(key, *[F.round(y[i] * float(signs[i]), 5).alias(f"pc{i + 1}") for i in range(3)])


__all__ = ["ORACLE_SQL", "QUERIES"]
