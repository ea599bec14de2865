"""Queries from alignments to sites, and from sites to regions and assignments, with their SQL.

The driver's documents are seen as alignments: their bases are the reference, and fixed replacements in them make edits
and gaps. A minus-strand read has an odd id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, reads
from . import fixtures as fx
from .more import ORACLE_SQL, QUERIES
from .queries import query, r6


def alignments(spark, sf_dir):
    seq = F.col("seq")
    made = F.replace(F.replace(F.replace(seq, F.lit("GAT"), F.lit("GGT")), F.lit("TTC"), F.lit("T C")), F.lit("ATA"), F.lit("ACA"))
    b = fx.bases(spark, sf_dir).where("length(seq) > 0")
    return b.select(
        "doc_id", (F.col("doc_id") % 2 == 1).alias("is_reverse"), (F.col("doc_id") * 50).alias("read_start"),
        F.replace(seq, F.lit("CAT"), F.lit("C T")).alias("ref_aligned"), made.alias("read_aligned"),
    )


def encoded(spark, sf_dir):
    return reads.encoded(alignments(spark, sf_dir))


def a_sites(spark, sf_dir):
    """doc_id, pos, bit."""
    return reads.a_sites(encoded(spark, sf_dir), ["doc_id"])


#: al: alignments in sense orientation; co: a row per column; site: the A sites.
AL = fx.SQL["seqs"] + """, g AS (SELECT doc_id, doc_id % 2 = 1 AS rev, doc_id * 50 AS start, replace(seq, 'CAT', 'C T') AS ref,
        replace(replace(replace(seq, 'GAT', 'GGT'), 'TTC', 'T C'), 'ATA', 'ACA') AS q FROM seqs WHERE length(seq) > 0),
    co AS (SELECT doc_id, rev, i, start, substr(ref, i, 1) AS gr, substr(q, i, 1) AS gq, length(ref) AS n FROM (SELECT *, unnest(range(1, length(ref) + 1)) AS i FROM g)),
    cs AS (SELECT doc_id, CASE WHEN rev THEN n + 1 - i ELSE i END AS ord,
            CASE WHEN gr <> ' ' THEN start + count(*) FILTER (gr <> ' ') OVER (PARTITION BY doc_id ORDER BY i) - 1 END AS pos,
            CASE WHEN rev THEN translate(gr, 'ACGTN', 'TGCAN') ELSE gr END AS ref, CASE WHEN rev THEN translate(gq, 'ACGTN', 'TGCAN') ELSE gq END AS q FROM co),
    cd AS (SELECT *, CASE WHEN ref = ' ' OR q = ' ' THEN '2' WHEN ref = 'A' AND q = 'G' THEN '1' ELSE '0' END AS code FROM cs),
    site AS (SELECT doc_id, pos, code::INT AS bit FROM cd WHERE pos IS NOT NULL AND ref = 'A' AND code <> '2')"""


@query(f"WITH {AL}" + """
    SELECT doc_id, string_agg(code, '' ORDER BY ord) AS edit_string, count(*) FILTER (ref = 'A' AND code <> '2') AS n_a_positions, count(*) FILTER (code = '1') AS n_edits,
           round(coalesce(count(*) FILTER (code = '1') / nullif(count(*) FILTER (ref = 'A' AND code <> '2'), 0), 0), 6) AS global_edit_freq FROM cd GROUP BY doc_id""")
def encode_alignment(spark, sf_dir):
    return encoded(spark, sf_dir).select("doc_id", "edit_string", "n_a_positions", "n_edits", r6("global_edit_freq"))


@query(f"WITH {AL} SELECT doc_id, pos, bit FROM site")
def explode_sites(spark, sf_dir):
    return a_sites(spark, sf_dir)


#: Transcripts of 200 bases every 160: neighbours overlap by 40.
TX = "tx AS (SELECT s_suppkey AS gene, unnest(range(s_suppkey * 160, s_suppkey * 160 + 200)) AS pos, s_suppkey * 160 AS start FROM supplier)"


def transcripts(spark, sf_dir):
    k = F.col("s_suppkey")
    return fx.table(spark, sf_dir, "supplier").select(k.alias("gene"), (k * 160).alias("start"), (k * 160 + 200).alias("end"))


def on_transcripts(spark, sf_dir, how="inner"):
    """doc_id, pos, bit, gene, start, end: a row per site and transcript that has it."""
    return intervals.holding(a_sites(spark, sf_dir), transcripts(spark, sf_dir), "pos", how)


@query(f"WITH {AL}, {TX}" + """, u AS (SELECT pos, min(gene) AS gene, min(start) AS start FROM tx GROUP BY pos HAVING count(*) = 1)
    SELECT doc_id, gene, pos - start AS rel, bit FROM site JOIN u USING (pos)""")
def unique_sites(spark, sf_dir):
    """Sites at positions that one transcript has alone."""
    alone = intervals.once_covered(transcripts(spark, sf_dir).withColumn("first", F.col("start")), [], ["gene", "first"])
    s = intervals.holding(a_sites(spark, sf_dir), alone, "pos")
    return s.select("doc_id", "gene", (F.col("pos") - F.col("first")).alias("rel"), "bit")


@query(f"WITH {AL}, {TX}" + """, r AS (SELECT gene, CASE WHEN pos - start < 50 THEN 'UTR5' WHEN pos - start < 150 THEN 'CDS' ELSE 'UTR3' END AS region, bit FROM site JOIN tx USING (pos))
    SELECT gene, region, count(*) AS n, sum(bit)::BIGINT AS edits FROM r GROUP BY ALL""")
def region_tallies(spark, sf_dir):
    """Sites and edits per transcript and region; the first coding base is the 51st."""
    s = on_transcripts(spark, sf_dir)
    of = reads.region(F.col("pos") - F.col("start") - 50, F.lit(100))
    return s.groupBy("gene", of.alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("bit").cast("bigint").alias("edits"))


@query(f"WITH {AL}, {TX}, t AS (SELECT doc_id, gene, min(pos - start) AS lo, max(pos - start) AS hi FROM site JOIN tx USING (pos) GROUP BY ALL) SELECT doc_id, gene FROM t WHERE lo <= 25 AND hi >= 175")
def spans_whole(spark, sf_dir):
    """Reads that touch both ends of a transcript's coding part."""
    s = on_transcripts(spark, sf_dir).withColumn("rel", F.col("pos") - F.col("start"))
    return s.groupBy("doc_id", "gene").agg(F.bool_or(F.col("rel") <= 25).alias("a"), F.bool_or(F.col("rel") >= 175).alias("b")).where("a AND b").select("doc_id", "gene")


@query(f"WITH {AL}" + """, r AS (SELECT *, count(*) FILTER (code = '2') OVER (PARTITION BY doc_id ORDER BY ord) AS gaps FROM cd),
    m AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, gaps) AS run FROM r WHERE code <> '2')
    SELECT doc_id, count(*) AS columns, max(run) AS longest FROM m WHERE run >= 20 GROUP BY doc_id""")
def matched_runs(spark, sf_dir):
    return reads.matched_runs(encoded(spark, sf_dir), "doc_id", 20)


@query(f"WITH {AL}, {TX}" + """, t AS (SELECT doc_id, gene, sum(bit) AS edits, count(*) AS n FROM site JOIN tx USING (pos) GROUP BY ALL)
    SELECT doc_id, gene, n FROM t WHERE edits = 0""")
def shadowed_region(spark, sf_dir):
    """Reads over a region that show no edit in it."""
    s = on_transcripts(spark, sf_dir)
    return s.groupBy("doc_id", "gene").agg(F.bool_or(F.col("bit") == 1).alias("edited"), F.count(F.lit(1)).alias("n")).where("NOT edited").select("doc_id", "gene", "n")


@query(f"WITH {AL} SELECT pos, count(*) - sum(bit)::BIGINT AS \"A\", sum(bit)::BIGINT AS \"G\", count(*) AS coverage, round(sum(bit) / count(*), 6) AS ag_edit_frac FROM site GROUP BY pos HAVING count(*) >= 3")
def site_pileup(spark, sf_dir):
    return reads.pileup(a_sites(spark, sf_dir), ["pos"], 3).select("pos", "A", "G", "coverage", r6("ag_edit_frac"))


@query(f"WITH {AL} SELECT doc_id, round(sum(bit) / count(*), 6) AS efficiency FROM site GROUP BY doc_id")
def read_efficiency(spark, sf_dir):
    return a_sites(spark, sf_dir).groupBy("doc_id").agg(F.round(F.sum("bit") / F.count("bit"), 6).alias("efficiency"))


@query(f"WITH {AL} SELECT pos, round(avg(bit), 6) AS rate, count(*) AS n FROM site GROUP BY pos HAVING count(*) >= 2")
def raw_track(spark, sf_dir):
    return a_sites(spark, sf_dir).groupBy("pos").agg(F.round(F.avg("bit"), 6).alias("rate"), F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(f"WITH {AL} SELECT pos FROM site WHERE doc_id = 7 AND bit = 1")
def inspect_read(spark, sf_dir):
    """Edited positions of one read; the filter reaches the scan."""
    of = reads.encoded(alignments(spark, sf_dir).where("doc_id = 7"))
    return reads.a_sites(of, ["doc_id"]).where("bit = 1").select("pos")


@query(f"WITH {AL}" + """, anchor AS (SELECT s_suppkey * 160 + 50 AS anchor FROM supplier)
    SELECT anchor, doc_id, pos - anchor AS rel, bit FROM site JOIN anchor ON pos BETWEEN anchor - 15 AND anchor + 15""")
def anchored_long(spark, sf_dir):
    """A row per anchor, read and relative position; an equi-join on bins of positions, not a range join."""
    a = fx.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 160 + 50).alias("anchor"))
    a = a.select("anchor", (F.col("anchor") - 15).alias("start"), (F.col("anchor") + 16).alias("end"))
    return intervals.holding(a_sites(spark, sf_dir), a, "pos").select("anchor", "doc_id", (F.col("pos") - F.col("anchor")).alias("rel"), "bit")


@query(f"WITH {AL}, anchor AS (SELECT s_suppkey * 160 + 50 AS anchor FROM supplier), l AS (SELECT pos - anchor AS rel, anchor, avg(bit) AS m, count(*) AS n FROM site JOIN anchor ON pos BETWEEN anchor - 15 AND anchor + 15 GROUP BY ALL) SELECT rel, round(avg(m), 6) AS mean, count(*) AS anchors FROM l WHERE n >= 2 GROUP BY rel")
def meta_anchor(spark, sf_dir):
    """Mean per transcript and relative position with enough reads, then over transcripts with equal weight."""
    one = anchored_long(spark, sf_dir).groupBy("rel", "anchor").agg(F.avg("bit").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return one.groupBy("rel").agg(F.round(F.avg("m"), 6).alias("mean"), F.count(F.lit(1)).alias("anchors"))


@query(f"WITH {AL}, s AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi, avg(bit) AS f FROM site GROUP BY doc_id), genes AS (SELECT s_suppkey AS gene, s_suppkey * 160 AS a, s_suppkey * 160 + 200 AS b FROM supplier) SELECT doc_id, gene, lo <= a AND hi >= b AS spanning FROM s JOIN genes ON lo < b AND hi > a WHERE f >= 0.1")
def gene_read_filter(spark, sf_dir):
    """Reads that overlap a gene and have the least edit frequency; whether they span it."""
    s = a_sites(spark, sf_dir).groupBy("doc_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.avg("bit").alias("f")).where("f >= 0.1")
    k = F.col("s_suppkey")
    g = fx.table(spark, sf_dir, "supplier").select(k.alias("gene"), (k * 160).alias("a"), (k * 160 + 200).alias("b"))
    step = 1000  # both sides meet in the bins that they touch; a pair counts in the first bin that both have
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))).alias("bin")
    both = s.select("*", bins("lo", "hi")).join(g.select("*", bins("a", "b")), "bin").where("lo < b AND hi > a")
    both = both.where(F.col("bin") == F.greatest(F.floor(F.col("lo") / step), F.floor(F.col("a") / step)))
    return both.select("doc_id", "gene", ((F.col("lo") <= F.col("a")) & (F.col("hi") >= F.col("b"))).alias("spanning"))


@query(f"WITH {AL}, {TX}, a AS (SELECT doc_id, count(DISTINCT gene) AS genes, string_agg(DISTINCT gene::VARCHAR, ',' ORDER BY gene::VARCHAR) AS names FROM site JOIN tx USING (pos) GROUP BY doc_id) SELECT doc_id, coalesce(genes, 0) AS genes, coalesce(names, 'intergenic') AS names FROM (SELECT DISTINCT doc_id FROM site) LEFT JOIN a USING (doc_id)")
def all_overlaps(spark, sf_dir):
    """Every transcript of a read, or intergenic."""
    a = on_transcripts(spark, sf_dir, "left").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("gene").cast("string"))).alias("g"))
    return a.select("doc_id", F.size("g").cast("bigint").alias("genes"), F.when(F.size("g") > 0, F.array_join("g", ",")).otherwise("intergenic").alias("names"))


@query(f"WITH {AL}, {TX}, t AS (SELECT doc_id, pos, gene FROM site JOIN tx USING (pos)), own AS (SELECT doc_id, pos AS p, gene FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC, gene) = 1), e AS (SELECT doc_id, own.gene AS own, min(t.pos) AS first FROM own JOIN t USING (doc_id) WHERE t.gene = own.gene GROUP BY ALL) SELECT doc_id, own, count(DISTINCT gene) AS upstream FROM e JOIN t USING (doc_id) WHERE gene <> own AND pos < first GROUP BY ALL")
def extended_reads(spark, sf_dir):
    """Reads whose own transcript, that of the 3'-most site, has others strictly upstream."""
    t = on_transcripts(spark, sf_dir).groupBy("doc_id", "gene").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    own = F.min(F.struct(-F.col("hi"), "gene", "lo")).over(Window.partitionBy("doc_id"))
    t = t.withColumn("own", own).where("gene <> own.gene AND lo < own.lo")
    return t.groupBy("doc_id", F.col("own.gene").alias("own")).agg(F.count(F.lit(1)).alias("upstream"))


@query(f"WITH {AL}" + """, b AS (SELECT doc_id, pos, bit, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) * 4 AS x FROM site),
    r AS (SELECT *, count(*) FILTER (bit = 1) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM site)
    SELECT doc_id, max(n) AS longest, count(*) AS stretches FROM (SELECT doc_id, run, count(*) AS n FROM r WHERE bit = 0 GROUP BY ALL) GROUP BY doc_id""")
def unedited_stretch(spark, sf_dir):
    """Stretches of unedited sites between edits."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    r = a_sites(spark, sf_dir).withColumn("run", F.count_if(F.col("bit") == 1).over(w)).where("bit = 0")
    return r.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("stretches"))


@query(f"WITH {AL}, t AS (SELECT doc_id, pos // 100 AS win, sum(bit)::BIGINT AS edits, count(*) AS n FROM site GROUP BY ALL), f AS (SELECT *, max(n) OVER (PARTITION BY win) AS most FROM t) SELECT win, doc_id, edits, round(cume_dist() OVER (PARTITION BY win ORDER BY edits), 6) AS share FROM f WHERE n = most")
def window_cumulative(spark, sf_dir):
    """Edits of a window's fully covered reads, cumulated."""
    t = a_sites(spark, sf_dir).groupBy(F.floor(F.col("pos") / 100).alias("win"), "doc_id").agg(F.sum("bit").cast("bigint").alias("edits"), F.count(F.lit(1)).alias("n"))
    t = t.withColumn("most", F.max("n").over(Window.partitionBy("win"))).where("n = most")
    return t.select("win", "doc_id", "edits", F.round(F.cume_dist().over(Window.partitionBy("win").orderBy("edits")), 6).alias("share"))


@query(f"WITH {AL} SELECT doc_id, max(bit) = 0 AS unedited, min(pos) // 100 AS win FROM site GROUP BY doc_id")
def window_absence(spark, sf_dir):
    return a_sites(spark, sf_dir).groupBy("doc_id").agg((F.max("bit") == 0).alias("unedited"), F.floor(F.min("pos") / 100).alias("win"))


@query(f"WITH {AL}, {TX}, d AS (SELECT gene, pos - start AS rel, count(*) AS n FROM site JOIN tx USING (pos) GROUP BY ALL), f AS (SELECT rel, n / sum(n) OVER (PARTITION BY gene) AS share FROM d) SELECT rel, round(sum(share), 6) AS total, count(*) AS genes, round(sum(share) / count(*), 6) AS mean FROM f GROUP BY rel")
def metagene(spark, sf_dir):
    """Shares of each gene's depth by relative position, summed over genes; places without depth do not count."""
    d = on_transcripts(spark, sf_dir).groupBy("gene", (F.col("pos") - F.col("start")).alias("rel")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("gene"))
    return d.withColumn("share", share).groupBy("rel").agg(F.round(F.sum("share"), 6).alias("total"), F.count(F.lit(1)).alias("genes"), F.round(F.avg("share"), 6).alias("mean"))


@query(f"WITH {AL}, {TX}, t AS (SELECT gene, pos, bit FROM site JOIN tx USING (pos)), c AS (SELECT s_suppkey AS gene, s_suppkey * 160 + 100 AS centre FROM supplier WHERE s_suppkey % 3 = 0), p AS (SELECT gene, pos - centre AS rel, count(*) AS n FROM t JOIN c USING (gene) GROUP BY ALL) SELECT rel, count(*) AS calls, sum(n)::BIGINT AS depth, round(avg(n), 6) AS per_gene FROM p WHERE abs(rel) <= 50 GROUP BY rel")
def call_metagene(spark, sf_dir):
    """Depth around calls: summed, and the mean of genes."""
    t = on_transcripts(spark, sf_dir)
    c = fx.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("gene"), (F.col("s_suppkey") * 160 + 100).alias("centre"))
    p = t.join(c, "gene").groupBy("gene", (F.col("pos") - F.col("centre")).alias("rel")).agg(F.count(F.lit(1)).alias("n")).where("abs(rel) <= 50")
    return p.groupBy("rel").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("depth"), F.round(F.avg("n"), 6).alias("per_gene"))


@query(f"WITH {AL}, {TX}" + """, d AS (SELECT gene, length(seq) AS len, doc_id, doc_id * 50 + length(seq) - (s_suppkey * 160 + 150) AS rel FROM seqs, (SELECT s_suppkey, s_suppkey AS gene FROM supplier) WHERE length(seq) > 0 AND abs(doc_id * 50 + length(seq) - (s_suppkey * 160 + 150)) <= 30)
    SELECT rel, ((rel % 3) + 3) % 3 AS phase, count(*) AS n FROM d GROUP BY ALL""")
def stop_phase(spark, sf_dir):
    """Read ends relative to stops, with their phase; the stops that an end can be near are computed, not searched."""
    d = fx.bases(spark, sf_dir).where("length(seq) > 0").select((F.col("doc_id") * 50 + F.length("seq")).alias("end"))
    k = lambda off: F.floor((F.col("end") - 150 + off) / 160)
    near = d.select("end", F.explode(F.sequence(k(-30), k(30) + 1)).alias("gene")).withColumn("rel", F.col("end") - (F.col("gene") * 160 + 150)).where("abs(rel) <= 30")
    near = near.join(fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene")), "gene", "left_semi")
    return near.groupBy("rel", F.pmod("rel", F.lit(3)).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS nation, CAST(least(3, floor((c_acctbal + 1000) / 11000 * 4)) AS INT) AS bin, count(*) AS n, round(max(-log10(greatest(c_acctbal / 100000, 0.000001))), 6) AS confidence FROM customer GROUP BY ALL")
def confidence_bins(spark, sf_dir):
    """Quartile bins of a score's range, and a log-scaled confidence with a floor."""
    bin_ = F.least(F.lit(3), F.floor((F.col("c_acctbal") + 1000) / 11000 * 4)).cast("int")
    conf = -F.log10(F.greatest(F.col("c_acctbal") / 100000, F.lit(0.000001)))
    return fx.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(conf), 6).alias("confidence"))


@query(f"WITH {AL}, h AS (SELECT doc_id % 7 AS chrom, min(pos) AS lo, max(pos) AS hi FROM site WHERE doc_id % 97 = 5 GROUP BY ALL) SELECT DISTINCT doc_id FROM site WHERE doc_id NOT IN (SELECT doc_id FROM site JOIN h ON doc_id % 7 = chrom WHERE pos BETWEEN lo - 2000 AND hi + 2000)")
def hull_exclusion(spark, sf_dir):
    """Reads with no site near the hull of their chromosome's excluded features; one hull a chromosome."""
    s = a_sites(spark, sf_dir).withColumn("chrom", F.col("doc_id") % 7)
    h = s.where("doc_id % 97 = 5").groupBy("chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    near = (F.col("pos") >= F.col("lo") - 2000) & (F.col("pos") <= F.col("hi") + 2000)
    return s.join(h, "chrom", "left").groupBy("doc_id").agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("near")).where("NOT near").select("doc_id")


__all__ = ["ORACLE_SQL", "QUERIES", "intervals"]
