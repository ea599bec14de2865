"""Queries of the second module against their SQL, chains against brute force, sources and streams on small files."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.operators import chains, coordinates
from readloom.plans import more
from readloom.sources import files
from readloom.streaming import folds

from test_reference import DATA, duck, norm  # noqa: F401

NAMES = ["tx_position_map", "splice_junctions", "codon_sites_ranked", "five_prime_ends", "markov_window", "sliding_joint_probability", "meta_quantiles", "motif_normalised_ratio", "levenshtein_demux", "unexplained_gaps", "weighted_protection"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = more.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(more.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols and got
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_poisson_binomial(spark):
    ps = [0.1, 0.5, 0.7, 0.25]
    df = spark.createDataFrame([(ps, k) for k in range(5)], "ps array<double>, k int")
    got = [r[0] for r in df.select(chains.poisson_binomial_tail(F.col("ps"), F.col("k"))).collect()]
    want = [sum(math.prod(p if x else 1 - p for p, x in zip(ps, xs, strict=True)) for xs in itertools.product([0, 1], repeat=4) if sum(xs) <= k) for k in range(5)]
    assert np.allclose(got, want)


def test_posterior_equals_sum_over_paths():
    bits, gaps, p, leave = np.array([1, 0, 0, 1, 0]), np.array([0.0, 2, 1, 5, 3]), (0.4, 0.05), (0.1, 0.2)
    step = np.array([[1 - leave[0], leave[0]], [leave[1], 1 - leave[1]]])
    start = np.array([leave[1], leave[0]]) / sum(leave)
    mass = np.zeros((5, 2))
    for path in itertools.product([0, 1], repeat=5):
        w = start[path[0]]
        for i, s in enumerate(path):
            w *= (p[s] if bits[i] else 1 - p[s]) * (np.linalg.matrix_power(step, int(gaps[i]))[path[i - 1], s] if i else 1)
        for i, s in enumerate(path):
            mass[i, s] += w
    assert np.allclose(chains.posterior(bits, gaps, p, leave), mass[:, 1] / mass.sum(axis=1))


def test_fisher(spark):
    got = spark.createDataFrame([([0.1, 0.2],), ([1.0],)], "ps array<double>").select(chains.fisher_combined(F.col("ps"))).collect()
    h = -math.log(0.02)
    assert math.isclose(got[0][0], math.exp(-h) * (1 + h)) and got[1][0] == 1.0


def test_minus_strand_map(spark):
    seg = spark.createDataFrame([("g", "-", 10, 12), ("g", "-", 20, 23)], "gene string, strand string, start bigint, end bigint")
    assert [(r["gpos"], r["tx_pos"]) for r in coordinates.tx_map(seg).orderBy("tx_pos").collect()] == [(22, 0), (21, 1), (20, 2), (11, 3), (10, 4)]
    assert [float(r["junction"]) for r in coordinates.junctions(seg).collect()] == [2.5]


def test_sources(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    g = files.gtf(spark, put("a.gtf", '#!x\nI\tsrc\tCDS\t11\t20\t.\t+\t0\tgene_id "g1"; transcript_id "t1";\n')).first()
    assert (g["start"], g["end"], g["gene_id"], g["transcript_id"], g["gene_name"]) == (10, 20, "g1", "t1", None)
    f = files.fasta(spark, put("a.fa", ">a one\nAC\nGT\n>b\nTT\n")).orderBy("name").collect()
    assert [(r["name"], r["seq"]) for r in f] == [("a", "ACGT"), ("b", "TT")]
    q = files.fastq(spark, put("a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\n!!\n")).select("name", "seq", files.mean_quality(F.col("qual")).alias("q")).orderBy("name").collect()
    assert [tuple(r) for r in q] == [("r1", "ACGT", 40.0), ("r2", "AC", 0.0)]
    s = files.sam(spark, put("a.sam", "@HD\n" + "\t".join(["r", "0", "I", "5", "60", "3M", "*", "0", "0", "ACG", "III", "NM:i:2", "ch:Z:a:b"]) + "\n")).first()
    assert s["pos"] == 4 and s["tags"] == {"NM": "2", "ch": "a:b"}
    assert [tuple(r) for r in files.manifest(spark, put("m.txt", "# c\nwt 1 /x y\n\n")).collect()] == [("wt-1", "/x y")]
    files.write_chunks(spark.range(10).coalesce(1), str(tmp_path / "out"), rows=4)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(i % 3, i % 2) for i in range(50)]
    sites = spark.createDataFrame(rows, "pos int, bit int")
    sites.repartition(5).write.parquet(str(tmp_path / "in"))
    out = folds.running_frequency(folds.arriving(spark, str(tmp_path / "in"), sites.schema, 2), ["pos"], "bit")
    out.writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start().awaitTermination()
    want = folds.running_frequency(sites, ["pos"], "bit")
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, want.collect()))


def test_segments_and_tails_run_on_whole_tables(spark):
    """The queries without SQL: a row a site, probabilities within bounds, segments equal to the pass they call."""
    n = more.fx.sites(spark, DATA).count()
    tails = more.QUERIES["poisson_binomial_window"](spark, DATA).toPandas()
    assert len(tails) == n and tails["tail"].between(0, 1.000001).all()
    found = more.QUERIES["hmm_segments"](spark, DATA).toPandas()
    assert len(found) == n
    one = found[found["read"] == found["read"].iloc[0]].sort_values("pos")
    want = chains.posterior(one["bit"].to_numpy(), np.diff(one["pos"], prepend=one["pos"].iloc[0]).astype(float), (0.4, 0.05), (0.01, 0.02))
    assert np.allclose(one["pb"], want, atol=1e-6)
