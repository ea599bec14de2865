"""Queries of gene models, record formats and matrices, with their SQL. Parts are seen as lines of an annotation: a part is
an exon of its brand's transcripts, and every second one has a coding interval too."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reads
from ..sources import annotation
from . import fixtures as fx
from .core import AL, a_sites, encoded
from .profiles import ORACLE_SQL, QUERIES
from .queries import query, r6

FEATURES = """ft AS (SELECT 'c' || (p_partkey % 3) AS chrom, p_brand AS gene, p_brand || '.' || (p_partkey % 2) AS transcript, f AS feature, CASE WHEN length(p_type) % 2 = 0 THEN '+' ELSE '-' END AS strand0,
        p_partkey * 30 + CASE WHEN f = 'CDS' THEN 5 ELSE 0 END AS start, p_partkey * 30 + 20 + p_size AS "end", p_partkey * 2 + (f = 'CDS')::INT AS line_no
        FROM part, (SELECT unnest(['exon', 'CDS']) AS f) WHERE f = 'exon' OR p_partkey % 2 = 0),
    fe AS (SELECT * EXCLUDE (strand0), min(strand0) OVER (PARTITION BY transcript) AS strand FROM ft)"""


def features(spark, sf_dir):
    k = F.col("p_partkey")
    p = fx.table(spark, sf_dir, "part").withColumn("feature", F.explode(F.when(k % 2 == 0, F.array(F.lit("exon"), F.lit("CDS"))).otherwise(F.array(F.lit("exon")))))
    cds = (F.col("feature") == "CDS").cast("int")
    out = p.select(
        F.concat(F.lit("c"), (k % 3).cast("string")).alias("chrom"), F.col("p_brand").alias("gene"), F.concat_ws(".", "p_brand", (k % 2).cast("string")).alias("transcript"), "feature",
        (k * 30 + 5 * cds).alias("start"), (k * 30 + 20 + F.col("p_size")).alias("end"), (k * 2 + cds).alias("line_no"), F.when(F.length("p_type") % 2 == 0, "+").otherwise("-").alias("strand0"),
    )
    return out.withColumn("strand", F.min("strand0").over(Window.partitionBy("transcript"))).drop("strand0")


MODEL = FEATURES + ", pin AS (SELECT gene, arg_min(transcript, line_no) AS transcript FROM fe GROUP BY gene), mo AS (SELECT fe.* FROM fe JOIN pin USING (gene, transcript))"
CODING = FEATURES + """, pb AS (SELECT DISTINCT strand, chrom, transcript, gene, unnest(range(start, "end")) AS pos FROM fe WHERE feature = 'CDS'),
    pt AS (SELECT strand, chrom, transcript, gene, pos, row_number() OVER (PARTITION BY transcript ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END) - 1 AS rel_start, count(*) OVER (PARTITION BY transcript) AS n FROM pb)"""


@query(f"WITH {MODEL}" + """ SELECT gene, transcript, count(*) FILTER (feature = 'exon') AS exons, count(*) FILTER (feature = 'CDS') AS coding, min(start) AS first, max("end") AS last FROM mo GROUP BY ALL""")
def gene_model(spark, sf_dir):
    m = annotation.gene_model(features(spark, sf_dir))
    return m.groupBy("gene", "transcript").agg(F.count_if(F.col("feature") == "exon").alias("exons"), F.count_if(F.col("feature") == "CDS").alias("coding"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(f"WITH {MODEL}" + """, x AS (SELECT DISTINCT gene, unnest(range(start, "end")) AS pos FROM mo WHERE feature = 'exon'), c AS (SELECT DISTINCT gene, unnest(range(start, "end")) AS pos FROM mo WHERE feature = 'CDS')
    SELECT gene, count(*) AS bases FROM x ANTI JOIN c USING (gene, pos) GROUP BY gene""")
def untranslated_bases(spark, sf_dir):
    return annotation.untranslated(annotation.gene_model(features(spark, sf_dir))).groupBy("gene").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query(f"WITH {FEATURES} SELECT chrom, count(*) AS n, min(start) AS first, max(\"end\") AS last FROM fe WHERE feature = 'CDS' GROUP BY chrom")
def coding_intervals(spark, sf_dir):
    return features(spark, sf_dir).where("feature = 'CDS'").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


@query("SELECT p_partkey * 30 AS start, p_partkey * 30 + 20 + p_size AS \"end\", coalesce(CASE WHEN p_size % 3 = 0 THEN p_type END, p_brand) AS biotype FROM part")
def biotype_intervals(spark, sf_dir):
    """The transcript's biotype, or else the gene's."""
    k = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select((k * 30).alias("start"), (k * 30 + 20 + F.col("p_size")).alias("end"), F.coalesce(F.when(F.col("p_size") % 3 == 0, F.col("p_type")), "p_brand").alias("biotype"))


@query(f"WITH {CODING} SELECT strand, chrom, pos, transcript, rel_start, rel_start - n + 1 AS rel_stop FROM pt")
def position_dictionary(spark, sf_dir):
    return annotation.position_table(features(spark, sf_dir))


@query(f"WITH {FEATURES}" + """ SELECT chrom, gene, count(*) AS positions FROM (SELECT chrom, pos, min(gene) AS gene FROM (SELECT chrom, gene, unnest(range(start, "end")) AS pos FROM fe) GROUP BY chrom, pos HAVING count(DISTINCT gene) = 1) GROUP BY ALL""")
def unambiguous_positions(spark, sf_dir):
    return annotation.unambiguous(features(spark, sf_dir)).groupBy("chrom", "gene").agg(F.sum(F.col("end") - F.col("start")).alias("positions"))


@query(f"WITH {CODING} SELECT chrom, pos, gene, strand, transcript, rel_start, rel_start - n + 1 AS rel_stop FROM pt")
def annotation_round_trip(spark, sf_dir):
    """Positions written as lines and parsed again."""
    f = features(spark, sf_dir)
    owner = f.select("transcript", "gene").distinct()
    return annotation.annotation_rows(annotation.annotation_line(annotation.position_table(f).join(owner, "transcript")))


@query("SELECT c_custkey AS record, c_name AS sam, c_mktsegment AS features, 'g' || c_nationkey AS gene_type, '01' AS edits, CAST(c_custkey * 2 AS VARCHAR) AS coords FROM customer")
def sham_records(spark, sf_dir):
    """Records of five lines, put together by line number."""
    five = F.array("c_name", "c_mktsegment", F.concat(F.lit("g"), F.col("c_nationkey").cast("string")), F.lit("01"), (F.col("c_custkey") * 2).cast("string"))
    lines = fx.table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(five).alias("i", "value")).select("value", (F.col("c_custkey") * 5 + F.col("i")).alias("n"))
    return annotation.records(lines, annotation.SHAM)


@query("SELECT c_custkey AS record, c_name AS read_id, c_mktsegment AS features FROM customer")
def longjam_records(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array("c_name", "c_mktsegment")).alias("i", "value")).select("value", (F.col("c_custkey") * 2 + F.col("i")).alias("n"))
    return annotation.records(lines, annotation.LONGJAM)


@query("SELECT s_suppkey AS gene, s_suppkey * 100 + k * 40 - CASE WHEN k = 0 THEN 10 ELSE 0 END AS start, s_suppkey * 100 + k * 40 + 20 + CASE WHEN k = 2 THEN 10 ELSE 0 END AS \"end\" FROM supplier, (SELECT unnest([0, 1, 2]) AS k)")
def padded_segments(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    s = s.select("gene", (F.col("gene") * 100 + F.col("k") * 40).alias("start"), (F.col("gene") * 100 + F.col("k") * 40 + 20).alias("end"))
    return annotation.padded(s, 10).select("gene", "start", "end")


@query(f"WITH {FEATURES} SELECT gene, sum(\"end\" - start) FILTER (feature = 'CDS')::BIGINT AS coding, sum(\"end\" - start) FILTER (feature = 'exon')::BIGINT AS exonic FROM fe GROUP BY gene")
def region_lengths(spark, sf_dir):
    n = lambda f: F.sum(F.when(F.col("feature") == f, F.col("end") - F.col("start"))).cast("bigint")
    return features(spark, sf_dir).groupBy("gene").agg(n("CDS").alias("coding"), n("exon").alias("exonic"))


@query("SELECT c_custkey AS read_id, c_name || chr(9) || c_nationkey || chr(9) || 'cI:Z:' || c_mktsegment || chr(9) || 'cS:Z:' || c_custkey AS line FROM customer")
def tagged_export(spark, sf_dir):
    """Lines with renamed tags."""
    tags = F.create_map(F.lit("xS"), F.col("c_custkey").cast("string"), F.lit("xI"), F.col("c_mktsegment"))
    renamed = F.transform_keys(tags, lambda k, v: F.concat(F.lit("c"), F.substring(k, 2, 1)))
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("read_id"), annotation.sam_line(["c_name", "c_nationkey"], renamed).alias("line"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END NOT IN ('1-URGENT', '2-HIGH'), true)")
def subset_without(spark, sf_dir):
    """Rows whose label is not listed; rows without a label stay."""
    label = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    return fx.table(spark, sf_dir, "orders").where(F.coalesce(~label.isin("1-URGENT", "2-HIGH"), F.lit(True))).select("o_orderkey", "o_orderpriority")


@query(f"WITH {AL} SELECT doc_id, pos - doc_id * 50 AS rel, bit FROM site WHERE pos - doc_id * 50 <= 695")
def bounded_sites(spark, sf_dir):
    s = a_sites(spark, sf_dir).withColumn("rel", F.col("pos") - F.col("doc_id") * 50)
    return s.where("rel <= 695").select("doc_id", "rel", "bit")


@query(f"WITH {AL} SELECT doc_id, string_agg(CASE WHEN q = ' ' THEN '.' ELSE q END, '' ORDER BY ord) AS region FROM cd WHERE pos >= doc_id * 50 + 10 AND pos < doc_id * 50 + 40 GROUP BY doc_id")
def region_sequences(spark, sf_dir):
    """A read's bases over 30 reference positions, insertions left out and deletions as dots, in sense orientation."""
    e = encoded(spark, sf_dir)
    p = reads.positions(e, ["doc_id"], base="read_sense").where("pos >= doc_id * 50 + 10 AND pos < doc_id * 50 + 40")
    parts = p.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.translate("base", " ", ".").alias("b")))).alias("x"))
    return parts.select("doc_id", F.array_join("x.b", "").alias("region"))


@query(fx.with_("line", "sites") + ", m AS (SELECT pos, avg(bit) AS m FROM sites GROUP BY pos), g AS (SELECT read, pos FROM (SELECT DISTINCT read FROM sites), m), v AS (SELECT g.read, g.pos, coalesce(bit, m.m) AS v FROM g JOIN m USING (pos) LEFT JOIN sites s ON s.read = g.read AND s.pos = g.pos) SELECT read, count(*) AS columns, round(sum(v), 5) AS total FROM v GROUP BY read")
def imputed_matrix(spark, sf_dir):
    """Read rows over all positions, absent ones with the position's mean, without a dense table: a row's sum is the sum of
    its own bits and of the means of the positions that it lacks."""
    s = fx.sites(spark, sf_dir)
    m = s.groupBy("pos").agg(F.avg("bit").alias("m"))
    total = m.agg(F.sum("m").alias("all"), F.count(F.lit(1)).alias("columns"))  # one row
    own = s.join(m, "pos").groupBy("read").agg(F.sum(F.col("bit") - F.col("m")).alias("more"))
    return own.join(F.broadcast(total)).select("read", "columns", F.round(F.col("all") + F.col("more"), 5).alias("total"))


@query(fx.with_("line", "sites") + " SELECT pos, read, round(avg(bit) OVER (PARTITION BY pos ORDER BY read ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM sites")
def smoothed_matrix(spark, sf_dir):
    """Bits of a position averaged over neighbouring reads."""
    w = Window.partitionBy("pos").orderBy("read").rowsBetween(-2, 2)
    return fx.sites(spark, sf_dir).select("pos", "read", F.round(F.avg("bit").over(w), 6).alias("smooth"))


@query(fx.with_("seqs") + """, c AS (SELECT doc_id, 'RYNNWSKMBD' AS p, substr(seq, 1, 10) AS q FROM seqs WHERE length(seq) >= 10), x AS (SELECT doc_id, substr(p, i, 1) AS p, substr(q, i, 1) AS q FROM c, range(1, 11) t(i)),
    m AS (SELECT * FROM (VALUES ('R', 'AG'), ('Y', 'CT'), ('N', 'ACGT'), ('W', 'AT'), ('S', 'CG'), ('K', 'GT'), ('M', 'AC'), ('B', 'CGT'), ('D', 'AGT')) v(p, ok))
    SELECT doc_id, count(*) FILTER (NOT contains(ok, q))::INT AS n_mismatch, count(*) FILTER (NOT contains(ok, q)) = 0 AS perfect FROM x JOIN m USING (p) GROUP BY doc_id""")
def region_compare(spark, sf_dir):
    """A region of ten bases against a pattern in the nucleotide code."""
    d = fx.bases(spark, sf_dir).where("length(seq) >= 10").select("doc_id", annotation.compared(F.lit("RYNNWSKMBD"), F.substring("seq", 1, 10)).alias("c"))
    return d.select("doc_id", "c.n_mismatch", "c.perfect")


@query("SELECT l_orderkey, l_linenumber, repeat('M', l_linenumber) || repeat('D', 2) || repeat('S', CAST(l_quantity AS INT) % 5) AS expanded FROM lineitem")
def cigar_expansion(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    cigar = F.concat(F.col("l_linenumber").cast("string"), F.lit("M2D3=4H"), (F.col("l_quantity").cast("int") % 5).cast("string"), F.lit("S"))
    return li.select("l_orderkey", "l_linenumber", annotation.expanded(cigar).alias("expanded"))


@query("WITH s AS (SELECT o_custkey AS k, max(o_orderpriority) AS barcode FROM orders GROUP BY ALL) SELECT c_custkey AS read_id, coalesce(barcode, 'unclassified') AS barcode FROM customer LEFT JOIN s ON k = c_custkey AND c_custkey % 5 <> 0")
def barcode_lookup(spark, sf_dir):
    """Two columns of a summary joined to reads; reads without an entry are unclassified."""
    s = fx.table(spark, sf_dir, "orders").where("o_custkey % 5 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("barcode"))
    return fx.table(spark, sf_dir, "customer").select("c_custkey").join(s, "c_custkey", "left").select(F.col("c_custkey").alias("read_id"), F.coalesce("barcode", F.lit("unclassified")).alias("barcode"))


@query(fx.with_("ev") + " SELECT read, pos, round(value, 6) AS score FROM ev WHERE value <= 5")
def significant_windows(spark, sf_dir):
    return fx.events(spark, sf_dir).where("value <= 5").select("read", "pos", F.round("value", 6).alias("score"))


@query(fx.with_("line", "sites") + ", w AS (SELECT read, pos // 50 AS win, count(*) AS n, sum(1 - bit) AS k FROM sites GROUP BY ALL) SELECT read, count(*) FILTER (n >= 2) AS windows, count(*) FILTER (n >= 2 AND k = n) AS unedited FROM w GROUP BY read")
def accepted_windows(spark, sf_dir):
    """Windows that pass thresholds of length and edits."""
    w = fx.sites(spark, sf_dir).groupBy("read", F.floor(F.col("pos") / 50).alias("win")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("bit")).alias("k"))
    return w.groupBy("read").agg(F.count_if(F.col("n") >= 2).alias("windows"), F.count_if((F.col("n") >= 2) & (F.col("k") == F.col("n"))).alias("unedited"))


__all__ = ["ORACLE_SQL", "QUERIES", "r6"]
