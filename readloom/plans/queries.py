"""A query per operator over the driver's tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import intervals, ranks, sites, windows
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def r6(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


@query(fx.with_("line", "lib") + """, m AS (SELECT library, pos, read, avg(bit) AS m FROM lib GROUP BY ALL)
    SELECT library, pos, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, count(m) AS units FROM m GROUP BY ALL""")
def two_stage_mean_sem(spark, sf_dir):
    return sites.two_stage(fx.library_sites(spark, sf_dir), "read", ["library", "pos"], "bit").select("library", "pos", r6("mean"), r6("sem"), "units")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def scan_project_filter(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").where("o_totalprice > 100000 AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(fx.with_("seqs") + """, s AS (SELECT doc_id, unnest(range(0, length(seq))) AS pos, seq FROM seqs)
    SELECT substr(seq, pos + 1, 1) AS base, pos % 3 AS frame, count(*) AS n FROM s GROUP BY ALL""")
def site_explode(spark, sf_dir):
    s = sites.explode_string(fx.bases(spark, sf_dir), "doc_id", "seq")
    return s.groupBy("base", (F.col("pos") % 3).cast("bigint").alias("frame")).agg(F.count(F.lit(1)).alias("n"))


@query(fx.with_("seqs") + " SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs")
def revcomp(spark, sf_dir):
    return fx.bases(spark, sf_dir).select("doc_id", strings.reverse_complement(F.col("seq")).alias("rc"))


@query(fx.with_("seqs") + " SELECT doc_id, translate(seq, 'A', 'G') AS three, translate(seq, 'AC', 'GT') AS two FROM seqs")
def alphabet_mutate(spark, sf_dir):
    s = F.col("seq")
    return fx.bases(spark, sf_dir).select("doc_id", strings.substituted(s, "A", "G").alias("three"), strings.substituted(s, "AC", "GT").alias("two"))


@query(fx.with_("seqs") + """, t AS (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM seqs), c AS (SELECT substr(seq, i, 3) AS context FROM t WHERE substr(seq, i + 1, 1) = 'A'),
    e AS (SELECT x || 'A' || y AS context FROM (SELECT unnest(['A','C','G','T']) AS x), (SELECT unnest(['A','C','G','T']) AS y))
    SELECT e.context, count(c.context) AS n FROM e LEFT JOIN c USING (context) GROUP BY ALL""")
def context_rate_zero_filled(spark, sf_dir):
    return sites.contexts(sites.explode_string(fx.bases(spark, sf_dir), "doc_id", "seq"), "doc_id", "pos", "base", "A")


@query(fx.with_("seqs") + """, t AS (SELECT seq, unnest(range(2, length(seq) + 1)) AS i FROM seqs), c AS (SELECT substr(seq, i, 1) AS ref, substr(seq, i - 1, 1) AS alt FROM t),
    e AS (SELECT ref, alt FROM (SELECT unnest(['A','C','G','T']) AS ref), (SELECT unnest(['A','C','G','T']) AS alt) WHERE ref <> alt)
    SELECT e.ref, e.alt, count(c.ref) AS n FROM e LEFT JOIN c ON e.ref = c.ref AND e.alt = c.alt GROUP BY ALL""")
def substitution_profile(spark, sf_dir):
    s = sites.explode_string(fx.bases(spark, sf_dir), "doc_id", "seq")
    return sites.substitutions(s.withColumn("alt", F.lag("base").over(Window.partitionBy("doc_id").orderBy("pos"))), "base", "alt")


@query(fx.with_("line", "lib") + " SELECT library, pos, count(*) AS n, round(greatest(1e-6, least(1 - 1e-6, avg(bit))), 6) AS freq FROM lib GROUP BY ALL")
def edit_freq_clamped(spark, sf_dir):
    return sites.frequency(fx.library_sites(spark, sf_dir), ["library", "pos"]).select("library", "pos", "n", r6("freq"))


@query(fx.with_("line", "lib") + " SELECT library, pos, count(*) AS n, round((sum(bit) + 1) / (count(*) + 2), 6) AS freq FROM lib GROUP BY ALL")
def edit_freq_laplace(spark, sf_dir):
    return sites.smoothed_frequency(fx.library_sites(spark, sf_dir), ["library", "pos"]).select("library", "pos", "n", r6("freq"))


@query(fx.with_("line", "lib") + """, m AS (SELECT pos, avg(bit) FILTER (library = 'F') AS a, avg(bit) FILTER (library = 'O') AS b FROM lib GROUP BY pos)
    SELECT pos, round(a, 6) AS a, round(b, 6) AS b, round(log2((a + 1e-3) / (b + 1e-3)), 6) AS log2fc FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def log2fc_libraries(spark, sf_dir):
    return sites.compared(fx.library_sites(spark, sf_dir), "library", "F", "O", ["pos"], "bit").select("pos", r6("a"), r6("b"), r6("log2fc"))


@query(fx.with_("line", "lib") + " SELECT read, round(avg(bit) FILTER (library = 'F'), 6) AS f, round(avg(bit) FILTER (library = 'O'), 6) AS o FROM lib GROUP BY read")
def pivot_strata(spark, sf_dir):
    return fx.library_sites(spark, sf_dir).groupBy("read").pivot("library", ["F", "O"]).agg(F.avg("bit")).select("read", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"))


@query(fx.with_("line", "lib") + " SELECT library, bit, count(*) AS n FROM lib GROUP BY GROUPING SETS ((library, bit), (library), ())")
def grouping_sets_summary(spark, sf_dir):
    return fx.library_sites(spark, sf_dir).groupingSets([["library", "bit"], ["library"], []], "library", "bit").agg(F.count(F.lit(1)).alias("n"))


@query(fx.with_("ev") + """ SELECT kind, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd,
    round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95,
    round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0 END), 6) AS frac_zero FROM ev GROUP BY kind""")
def dist_summary(spark, sf_dir):
    q = lambda p, n: F.round(F.percentile("value", F.lit(p)), 6).alias(n)
    return fx.events(spark, sf_dir).groupBy("kind").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), q(0.5, "median"), F.round(F.stddev_samp("value"), 6).alias("sd"), q(0.05, "p5"), q(0.25, "p25"), q(0.75, "p75"), q(0.95, "p95"),
        F.round(F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)), 6).alias("frac_zero"),
    )


@query(fx.with_("line") + """, g AS (SELECT library, read, count(*) AS hits FROM line GROUP BY ALL), t AS (SELECT *, sum(hits) OVER (PARTITION BY library) AS total FROM g)
    SELECT library, read, hits, round(hits * 1e6 / total, 6) AS rpm, round(hits / total, 6) AS frac, CASE WHEN hits * 1e6 / total >= 10000 THEN 'high' WHEN hits * 1e6 / total >= 1000 THEN 'mid' ELSE 'low' END AS grp FROM t WHERE hits >= 5""")
def rpm_fraction_bins(spark, sf_dir):
    g = fx.line(spark, sf_dir).groupBy("library", "read").agg(F.count(F.lit(1)).alias("hits"))
    total = g.groupBy("library").agg(F.sum("hits").alias("total"))
    rpm = F.col("hits") * 1e6 / F.col("total")
    return g.join(F.broadcast(total), "library").where("hits >= 5").select("library", "read", "hits", F.round(rpm, 6).alias("rpm"), F.round(F.col("hits") / F.col("total"), 6).alias("frac"), F.when(rpm >= 10000, "high").when(rpm >= 1000, "mid").otherwise("low").alias("grp"))


def _reads(spark, sf_dir):
    o = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(o.alias("read"), (o % 14000).alias("start"), (o % 14000 + 40).alias("end"), F.lit(0).alias("one"))


def _genes(spark, sf_dir):
    return fx.genes(spark, sf_dir).select(F.col("key").alias("gene"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.lit(0).alias("one"))


_READS = 'reads AS (SELECT o_orderkey AS read, o_orderkey % 14000 AS start, o_orderkey % 14000 + 40 AS "end" FROM orders)'


@query(fx.with_("genes") + f""", {_READS}, o AS (SELECT read, key AS gene, least(r."end", g."end") - greatest(r.start, g.start) AS overlap FROM reads r JOIN genes g ON r.start < g."end" AND g.start < r."end")
    SELECT read, gene, overlap FROM o QUALIFY row_number() OVER (PARTITION BY read ORDER BY overlap DESC, gene) = 1""")
def max_overlap_assign(spark, sf_dir):
    return intervals.best_overlap(_reads(spark, sf_dir), _genes(spark, sf_dir), "read", ["one"], "gene")


@query(fx.with_("genes") + f', {_READS} SELECT read FROM reads r WHERE EXISTS (SELECT 1 FROM genes g WHERE r.start < g."end" AND g.start < r."end")')
def range_semi_join(spark, sf_dir):
    return intervals.touching(_reads(spark, sf_dir), _genes(spark, sf_dir), "read", ["one"]).select("read")


@query(fx.with_("genes") + f', {_READS} SELECT read, count(*) AS spanned FROM reads r JOIN genes g ON r.start <= g.start AND g."end" <= r."end" GROUP BY read')
def span_vs_overlap(spark, sf_dir):
    return intervals.overlaps(_reads(spark, sf_dir), _genes(spark, sf_dir), ["one"]).where("start <= r_start AND r_end <= end").groupBy("read").agg(F.count(F.lit(1)).alias("spanned"))


@query(fx.with_("genes") + """ SELECT DISTINCT a.key FROM genes a JOIN genes b ON a.strand <> b.strand AND a.start < b."end" AND b.start < a."end"
    WHERE a."end" - a.start <= b."end" - b.start AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.5 * (a."end" - a.start)""")
def antisense_exclusion(spark, sf_dir):
    return intervals.antisense_covered(fx.genes(spark, sf_dir), "key")


@query(fx.with_("genes") + """, o AS (SELECT *, max("end") OVER (PARTITION BY strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM genes),
    i AS (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT strand, min(start) AS start, max("end") AS "end" FROM i GROUP BY strand, island""")
def merge_intervals(spark, sf_dir):
    return intervals.merged(fx.genes(spark, sf_dir), ["strand"])


@query(fx.with_("genes") + """, o AS (SELECT *, max("end") OVER (PARTITION BY strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM genes)
    SELECT strand, before AS start, start AS "end" FROM o WHERE start > before""")
def introns(spark, sf_dir):
    return intervals.gaps(fx.genes(spark, sf_dir), ["strand"])


@query(fx.with_("genes") + """ SELECT key, greatest(0, least(100, coalesce(start - lag("end") OVER w, 100))) AS "left", greatest(0, least(100, coalesce(lead(start) OVER w - "end", 100))) AS "right"
    FROM genes WINDOW w AS (PARTITION BY strand ORDER BY start, "end", key)""")
def neighbor_gap_caps(spark, sf_dir):
    return intervals.neighbour_caps(fx.genes(spark, sf_dir), ["strand"], "key", 100)


@query(fx.with_("ev") + """, a AS (SELECT read, pos AS anchor FROM ev WHERE kind = 'error'), p AS (SELECT read, pos FROM ev WHERE kind <> 'error'),
    j AS (SELECT p.read, p.pos, a.anchor FROM p JOIN a USING (read))
    SELECT read, pos, anchor, pos - anchor AS distance FROM j QUALIFY row_number() OVER (PARTITION BY read, pos ORDER BY abs(pos - anchor), anchor DESC) = 1""")
def asof_nearest(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    return intervals.nearest(e.where("kind <> 'error'").select("read", "pos"), e.where("kind = 'error'").select("read", F.col("pos").alias("anchor")), ["read"], "pos", "anchor")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").join(fx.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def anti_join(spark, sf_dir):
    """Customers without an urgent finished order; both sides have rows."""
    urgent = fx.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return fx.table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(fx.with_("line") + """, a AS (SELECT read, count(*) AS q FROM line WHERE library = 'F' AND code = 1 GROUP BY read), b AS (SELECT read, count(*) AS q FROM line WHERE library = 'O' AND code = 1 GROUP BY read)
    SELECT read, CASE WHEN b.q IS NULL OR a.q >= b.q THEN 'F' ELSE 'O' END AS path, greatest(coalesce(a.q, 0), coalesce(b.q, 0)) AS q FROM a FULL JOIN b USING (read)""")
def full_outer_best(spark, sf_dir):
    q = lambda x, n: fx.line(spark, sf_dir).where((F.col("library") == x) & (F.col("code") == 1)).groupBy("read").agg(F.count(F.lit(1)).alias(n))
    both = q("F", "a").join(q("O", "b"), "read", "full")
    return both.select("read", F.when(F.col("b").isNull() | (F.col("a") >= F.col("b")), "F").otherwise("O").alias("path"), F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("q"))


@query(fx.with_("line", "sites") + """ SELECT read, pos, count(*) OVER w AS n, CAST(sum(bit) OVER w AS BIGINT) AS k, round(sum(CASE WHEN bit = 1 THEN ln(0.05 / 0.5) ELSE ln(0.95 / 0.5) END) OVER (PARTITION BY read ORDER BY pos RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING), 6) AS score
    FROM sites WINDOW w AS (PARTITION BY read ORDER BY pos RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)""")
def log_odds_window(spark, sf_dir):
    w = windows.around("read", "pos", 30)
    s = windows.log_odds(fx.sites(spark, sf_dir), "read", "pos", "bit", 0.5, 0.05, 30)
    return s.select("read", "pos", F.count(F.lit(1)).over(w).alias("n"), F.sum("bit").over(w).cast("bigint").alias("k"), r6("score"))


@query(fx.with_("line", "sites") + """, w AS (SELECT read, pos, count(*) OVER w AS n, CAST(sum(bit) OVER w AS BIGINT) AS k FROM sites WINDOW w AS (PARTITION BY read ORDER BY pos RANGE BETWEEN 25 PRECEDING AND 24 FOLLOWING))
    SELECT read, pos, n, k, round(least(1.0, list_sum([(gamma(n + 1) / (gamma(i + 1) * gamma(n - i + 1))) * pow(0.5, i) * pow(0.5, n - i) for i in range(0, k + 1)])), 6) AS tail FROM w""")
def binom_lower_window(spark, sf_dir):
    return windows.binomial_tail(fx.sites(spark, sf_dir), "read", "pos", "bit", 0.5, 25).select("read", "pos", "n", big("k"), r6("tail"))


_RUNS = """, m AS (SELECT *, bit = 1 AS hit, coalesce(lag(bit = 1) OVER (PARTITION BY read ORDER BY pos), false) AS was FROM ev),
    i AS (SELECT *, sum(CASE WHEN hit AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY read ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m),
    r AS (SELECT read, min(pos) AS lo, max(pos) AS hi, count(*) AS n_sites FROM i WHERE hit GROUP BY read, run)"""


@query(fx.with_("ev") + _RUNS + " SELECT * FROM r")
def runs(spark, sf_dir):
    return windows.runs(fx.events(spark, sf_dir), "read", "pos", F.col("bit") == 1)


@query(fx.with_("ev") + _RUNS + ", g AS (SELECT read, lo - lag(hi) OVER (PARTITION BY read ORDER BY lo) - 1 AS gap FROM r) SELECT * FROM g WHERE gap IS NOT NULL")
def run_gaps(spark, sf_dir):
    return windows.run_gaps(runs(spark, sf_dir), "read")


@query(fx.with_("ev") + _RUNS + ", c AS (SELECT read, (SELECT count(*) FROM r WHERE r.read = e.read) AS c FROM (SELECT DISTINCT read FROM ev) e) SELECT CASE c WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS kind, count(*) AS n FROM c GROUP BY ALL")
def gap_eligibility(spark, sf_dir):
    return windows.eligibility(fx.events(spark, sf_dir), runs(spark, sf_dir), "read")


@query(fx.with_("line", "sites") + """, m AS (SELECT *, coalesce(lag(bit = 0) OVER (PARTITION BY read ORDER BY pos), false) AS was FROM sites),
    i AS (SELECT *, sum(CASE WHEN bit = 0 AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY read ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT read, min(pos) AS lo, max(pos) AS hi, count(*) AS n_sites FROM i WHERE bit = 0 GROUP BY read, run HAVING max(pos) - min(pos) + 1 >= 10 AND count(*) >= 3""")
def edit_shadows(spark, sf_dir):
    return windows.shadows(fx.sites(spark, sf_dir), "read", "pos", "bit", 10, 3)


@query(fx.with_("ev") + """, c AS (SELECT read, pos - 14 AS start, pos + 15 AS "end" FROM ev WHERE value >= 90),
    o AS (SELECT *, max("end") OVER (PARTITION BY read ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
    i AS (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY read ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT read, min(start) AS start, max("end") AS "end" FROM i GROUP BY read, island""")
def center_calls_union(spark, sf_dir):
    return windows.calls(fx.events(spark, sf_dir), "read", "pos", F.col("value") >= 90, 14)


@query(fx.with_("line") + """, m AS (SELECT read, pos, CASE WHEN max(code) < 2 THEN max(code) END AS bit FROM line GROUP BY ALL), k AS (SELECT read, pos AS kp, bit AS kb FROM m WHERE bit IS NOT NULL),
    j AS (SELECT m.read, m.pos, kb FROM m LEFT JOIN k ON m.read = k.read QUALIFY row_number() OVER (PARTITION BY m.read, m.pos ORDER BY abs(m.pos - kp), kp) = 1)
    SELECT read, pos, kb AS filled FROM j""")
def gap_fill(spark, sf_dir):
    m = fx.line(spark, sf_dir).groupBy("read", "pos").agg(F.max("code").alias("c")).withColumn("bit", F.when(F.col("c") < 2, F.col("c")))
    return windows.fill_nearest(m, ["read"], "pos", "bit").select("read", "pos", "filled")


_LAGS = " UNION ALL ".join(f"SELECT read, {k} AS lag, bit AS x, lead(bit, {k}) OVER (PARTITION BY read ORDER BY pos) AS y FROM sites" for k in range(1, 6))


@query(fx.with_("line", "sites") + f", p AS ({_LAGS}) SELECT read, lag, count(*) AS n, round(corr(x, y), 6) AS r FROM p WHERE y IS NOT NULL GROUP BY ALL")
def autocorr(spark, sf_dir):
    return windows.autocorrelation(fx.sites(spark, sf_dir), "read", "pos", "bit", range(1, 6)).select("read", "lag", "n", F.round(F.when(~F.isnan("r"), F.col("r")), 6).alias("r"))


@query(fx.with_("ev") + " SELECT read, pos, round(avg(value) OVER (PARTITION BY read ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM ev")
def rolling_mean_pos(spark, sf_dir):
    return windows.rolling_mean(fx.events(spark, sf_dir), "read", "pos", "value", 2).select("read", "pos", r6("mean"))


@query(fx.with_("ev") + """, p AS (SELECT kind, value, count(*) AS n FROM ev WHERE value IS NOT NULL GROUP BY ALL)
    SELECT kind, value, n, round(sum(n) OVER (PARTITION BY kind ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY kind), 6) AS share FROM p""")
def ecdf(spark, sf_dir):
    return windows.ecdf(fx.events(spark, sf_dir), ["kind"], "value").select("kind", "value", "n", r6("share"))


@query(fx.with_("line", "sites") + ", d AS (SELECT pos - lag(pos) OVER (PARTITION BY read ORDER BY pos) AS distance FROM sites WHERE bit = 1) SELECT distance, count(*) AS n FROM d WHERE distance IS NOT NULL GROUP BY ALL")
def inter_edit_distance(spark, sf_dir):
    return sites.distances(fx.sites(spark, sf_dir), "read", "pos", F.col("bit") == 1)


_TALLY = """, t AS (SELECT a.pos AS i, b.pos AS j, count(*) FILTER (a.bit = 0 AND b.bit = 0) AS n00, count(*) FILTER (a.bit = 0 AND b.bit = 1) AS n01, count(*) FILTER (a.bit = 1 AND b.bit = 0) AS n10, count(*) FILTER (a.bit = 1 AND b.bit = 1) AS n11
    FROM sites a JOIN sites b ON a.read = b.read AND b.pos > a.pos AND b.pos - a.pos <= 8 GROUP BY ALL)"""


def _tally(spark, sf_dir):
    return sites.pair_tally(fx.sites(spark, sf_dir), "read", "pos", "bit", 8)


@query(fx.with_("line", "sites") + _TALLY + " SELECT * FROM t")
def co_occurrence(spark, sf_dir):
    return _tally(spark, sf_dir)


@query(fx.with_("line", "sites") + _TALLY + " SELECT i, j, round((n00 + 0.5) * (n11 + 0.5) / ((n01 + 0.5) * (n10 + 0.5)), 6) AS odds FROM t")
def odds_ratio(spark, sf_dir):
    return _tally(spark, sf_dir).select("i", "j", F.round(sites.odds_ratio(), 6).alias("odds"))


def _term(x: int, y: int) -> str:
    return f"CASE WHEN n{x}{y} > 0 THEN n{x}{y} / n * log2(n{x}{y} * n / ((n{x}0 + n{x}1) * (n0{y} + n1{y}))) ELSE 0 END"


@query(fx.with_("line", "sites") + _TALLY + f" SELECT i, j, abs(round({' + '.join(_term(x, y) for x in (0, 1) for y in (0, 1))}, 6)) AS mi FROM (SELECT *, n00 + n01 + n10 + n11 AS n FROM t)")
def mutual_information(spark, sf_dir):
    return _tally(spark, sf_dir).select("i", "j", F.abs(F.round(sites.mutual_information(), 6)).alias("mi"))


@query(fx.with_("ev") + " SELECT pos, round((value - avg(value) OVER (PARTITION BY kind)) / nullif(stddev_pop(value) OVER (PARTITION BY kind), 0), 6) AS z FROM ev")
def zscore_in_motif(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    m = e.groupBy("kind").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(F.broadcast(m), "kind").select("pos", F.round((F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0)), 6).alias("z"))


@query(fx.with_("line") + ", n AS (SELECT library, read, count(*) AS n FROM line GROUP BY ALL) SELECT * FROM n QUALIFY rank() OVER (PARTITION BY library ORDER BY n DESC) <= 10")
def topn_rank_ties(spark, sf_dir):
    return ranks.top_with_ties(fx.line(spark, sf_dir).groupBy("library", "read").agg(F.count(F.lit(1)).alias("n")), ["library"], "n", 10)


@query(fx.with_("ev") + " SELECT kind, read, pos FROM ev QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value DESC, pos) <= 7")
def topn_exact(spark, sf_dir):
    return ranks.top_exact(fx.events(spark, sf_dir), ["kind"], [F.desc("value"), F.col("pos")], 7).select("kind", "read", "pos")


@query(fx.with_("ev") + """, c AS (SELECT kind, read % 3 AS lib, count(*) AS c FROM ev GROUP BY ALL), l AS (SELECT kind, min(c) AS least FROM c GROUP BY kind)
    SELECT e.kind, e.read, e.pos FROM (SELECT *, row_number() OVER (PARTITION BY kind, read % 3 ORDER BY read, pos) AS rank FROM ev) e JOIN l USING (kind) WHERE rank <= least""")
def matched_downsample(spark, sf_dir):
    return ranks.matched(fx.events(spark, sf_dir).withColumn("lib", F.col("read") % 3), ["kind"], "lib", ["read", "pos"]).select("kind", "read", "pos")


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def union_all(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).unionByName(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def intersect(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def set_except(spark, sf_dir):
    dear = fx.table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("k"))
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).exceptAll(dear).distinct()


@query(fx.with_("ev") + """, p AS (SELECT kind, pos, (floor(value) + 1) / 1000 AS p FROM ev WHERE value IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY p) + count(*) OVER (PARTITION BY kind, p) - 1 AS rk, count(*) OVER (PARTITION BY kind) AS m FROM p)
    SELECT kind, pos, round(least(1.0, min(p * m / rk) OVER (PARTITION BY kind ORDER BY p DESC)), 6) AS q FROM k""")
def bh_fdr(spark, sf_dir):
    p = fx.events(spark, sf_dir).where("value IS NOT NULL").select("kind", "pos", ((F.floor("value") + 1) / 1000).alias("p"))
    return ranks.benjamini_hochberg(p, "p", ["kind"]).select("kind", "pos", r6("q"))


_RANKED = """, a AS (SELECT kind, value, bit, length(CAST(read AS VARCHAR)) * 1000 + read % 97 AS y FROM ev WHERE value IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY kind ORDER BY value) + (count(*) OVER (PARTITION BY kind, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY kind ORDER BY y) + (count(*) OVER (PARTITION BY kind, y) - 1) / 2.0 AS ry FROM a)"""


def _with_y(spark, sf_dir):
    return fx.events(spark, sf_dir).where("value IS NOT NULL").withColumn("y", F.length(F.col("read").cast("string")) * 1000 + F.col("read") % 97)


@query(fx.with_("ev") + _RANKED + " SELECT kind, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY kind")
def spearman(spark, sf_dir):
    return ranks.spearman(_with_y(spark, sf_dir), ["kind"], "value", "y").select("kind", "n", r6("rho"))


@query(fx.with_("ev") + _RANKED + ", s AS (SELECT kind, sum(ry) FILTER (bit = 1) AS s, sum(bit) AS n1, count(*) AS n FROM k GROUP BY kind) SELECT kind, round(s - n1 * (n1 + 1) / 2.0, 6) AS u, round((s - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)), 6) AS auc FROM s WHERE n1 > 0 AND n1 < n")
def auc_rank(spark, sf_dir):
    return ranks.auc(_with_y(spark, sf_dir), ["kind"], "y", "bit").select("kind", r6("u"), r6("auc"))


@query(fx.with_("ev") + " SELECT kind, round(regr_slope(value, pos), 6) AS slope, round(regr_intercept(value, pos), 6) AS intercept, round(regr_r2(value, pos), 6) AS r2 FROM ev GROUP BY kind")
def regr(spark, sf_dir):
    e = fx.events(spark, sf_dir).groupBy("kind")
    return e.agg(F.round(F.regr_slope("value", "pos"), 6).alias("slope"), F.round(F.regr_intercept("value", "pos"), 6).alias("intercept"), F.round(F.regr_r2("value", "pos"), 6).alias("r2"))


@query(fx.with_("line", "lib") + """, t AS (SELECT pos, (sum(bit) FILTER (library = 'F') + 1) / (count(*) FILTER (library = 'F') + 2) AS pa, (sum(bit) FILTER (library = 'O') + 1) / (count(*) FILTER (library = 'O') + 2) AS pb FROM lib GROUP BY pos HAVING count(*) FILTER (library = 'F') > 0 AND count(*) FILTER (library = 'O') > 0)
    SELECT pos, round(pa, 6) AS pa, round(pb, 6) AS pb, round(ln(pb / pa), 6) AS w1, round(ln((1 - pb) / (1 - pa)), 6) AS w0 FROM t""")
def nb_train(spark, sf_dir):
    p = lambda x, n: ((F.sum(F.when(F.col("library") == x, F.col("bit"))) + 1) / (F.count(F.when(F.col("library") == x, 1)) + 2)).alias(n)
    t = fx.library_sites(spark, sf_dir).groupBy("pos").agg(p("F", "pa"), p("O", "pb")).where("pa IS NOT NULL AND pb IS NOT NULL")
    return t.select("pos", r6("pa"), r6("pb"), F.round(F.log(F.col("pb") / F.col("pa")), 6).alias("w1"), F.round(F.log((1 - F.col("pb")) / (1 - F.col("pa"))), 6).alias("w0"))


@query(fx.with_("seqs") + """, k AS (SELECT item_id, left(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 12) AS code FROM benchmark), d AS (SELECT doc_id, left(seq, 12) AS bar FROM seqs WHERE length(seq) >= 12),
    j AS (SELECT doc_id, item_id, hamming(bar, code) AS dist FROM d, k WHERE length(code) = 12)
    SELECT doc_id, item_id, dist FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dist, item_id) = 1""")
def hamming_demux(spark, sf_dir):
    # the barcodes are a library's fixed set, carried with each row as one array: no pair of rows is made
    text = fx.table(spark, sf_dir, "benchmark").select("item_id", F.substring(strings.bases(F.col("text")), 1, 12).alias("code")).where("length(code) = 12")
    codes = text.agg(F.sort_array(F.collect_list(F.struct("item_id", "code"))).alias("codes"))
    d = fx.bases(spark, sf_dir).where("length(seq) >= 12").select("doc_id", F.substring("seq", 1, 12).alias("bar"), F.lit(1).alias("one")).join(F.broadcast(codes.withColumn("one", F.lit(1))), "one")
    best = F.array_min(F.transform("codes", lambda c: F.struct(strings.hamming(F.col("bar"), c["code"]).alias("dist"), c["item_id"].alias("item_id"))))
    return d.select("doc_id", best.alias("b")).select("doc_id", "b.item_id", F.col("b.dist").cast("bigint").alias("dist"))
