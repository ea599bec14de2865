"""Steps whose work and memory must grow no faster than their input."""

import random
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from readloom.operators import chains, intervals, reads, sites, spread
from readloom.plans import core, fixtures
from readloom.sources import annotation

from test_reference import DATA


def alignment(r, n):
    ref = "".join(r.choice("ACGT ") for _ in range(n))
    return ref, "".join(r.choice((x, "G", " ")) if x != " " else r.choice("ACGT") for x in ref)


def sites_of(ref, read, reverse, start):
    """pos, ord, bit of a read's A sites, column by column."""
    flip, at, out, n = str.maketrans("ACGT", "TGCA"), start - 1, [], len(ref)
    for i, (x, y) in enumerate(zip(ref, read, strict=True)):
        at += x != " "
        if reverse:
            x, y = x.translate(flip), y.translate(flip)
        if x == "A" and y != " ":
            out.append((at, n - i if reverse else i + 1, int(y == "G")))
    return out


def test_sites_of_long_and_repeated_reads(spark):
    """A read of 300000 columns is walked once; where reads share a key, the last column at a position wins."""
    r = random.Random(4)
    rows = [(k, k % 2 == 1, 10 * k, *alignment(r, n)) for k, n in enumerate((300_000, 200_000, 50, 1, 7))]
    rows += [(5, False, 3, *alignment(r, 40)), (5, True, 9, *alignment(r, 60)), (6, None, None, "AA", "AG")]
    want = {}
    for k, reverse, start, ref, read in rows[:-1]:
        for pos, place, bit in sites_of(ref, read, reverse, start):
            want[k, pos] = max(want.get((k, pos), (0, 0)), (place, bit))
    schema = "read_id int, is_reverse boolean, read_start int, ref_aligned string, read_aligned string"
    began = time.monotonic()
    got = reads.a_sites(reads.encoded(spark.createDataFrame(rows, schema)), ["read_id"]).collect()
    assert time.monotonic() - began < 60
    assert Counter((g["read_id"], g["pos"], g["bit"]) for g in got) == Counter([(k, p, b) for (k, p), (_, b) in want.items()] + [(6, None, 1)])


def test_positions_have_the_characters_of_further_strings(spark):
    row = spark.createDataFrame([("r", True, 20, "CT TATG", "CTGTACG")], "k string, is_reverse boolean, read_start bigint, ref_aligned string, read_aligned string")
    got = sorted(map(tuple, reads.positions(reads.encoded(row), ["k"], base="read_sense").collect()))
    assert got == [("r", o, p, x, c, y) for o, p, x, c, y in [(1, 25, "C", "0", "C"), (2, 24, "A", "1", "G"), (3, 23, "T", "0", "T"), (4, 22, "A", "0", "A"), (6, 21, "A", "0", "A"), (7, 20, "G", "0", "G")]]


def spans(r, n, top):
    return [(i, s, s + r.randrange(1, 30)) for i, s in enumerate(r.randrange(top) for _ in range(n))]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_points_meet_spans_by_bins(spark, how):
    r = random.Random(how)
    rows, points = spans(r, 60, 300), [(i, r.randrange(-5, 400)) for i in range(200)]
    found = intervals.holding(spark.createDataFrame(points, "id int, pos bigint"), spark.createDataFrame(rows, "k int, start bigint, end bigint"), "pos", how, width=16)
    want = [(i, k) for i, p in points for k, s, e in rows if s <= p < e]
    want += [(i, None) for i, p in points if how == "left" and not any(s <= p < e for _, s, e in rows)]
    assert Counter((g["id"], g["k"]) for g in found.collect()) == Counter(want)


def test_stretches_that_one_interval_covers(spark):
    r = random.Random(1)
    rows = [(c, f"g{i}", s, e) for c in "xy" for i, s, e in spans(r, 25, 300)] + [("z", "same", 5, 9)] * 2
    found = intervals.once_covered(spark.createDataFrame(rows, "chrom string, gene string, start bigint, end bigint"), ["chrom"], ["gene"], width=16).collect()
    on = {}
    for c, g, s, e in rows:
        for p in range(s, e):
            on.setdefault((c, p), []).append(g)
    assert Counter((f["chrom"], p, f["gene"]) for f in found for p in range(f["start"], f["end"])) == Counter((c, p, g[0]) for (c, p), g in on.items() if len(g) == 1)


def test_transcripts_go_out_as_intervals(spark):
    """What is sent to every task is a row or two a transcript, not one for each of its positions."""
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert core.transcripts(spark, DATA).count() == n
    plan = core.on_transcripts(spark, DATA)
    assert plan.where(F.col("gene").isNotNull()).count() == plan.count() > 0


@pytest.mark.parametrize("most", [7, 10**6])
def test_pairs_of_whole_reads_are_not_shuffled(spark, most):
    """Short and long reads over several blocks, negative positions, bits that are null and positions that come twice."""
    r = random.Random(most)
    rows = [(k, r.randrange(-40, 60), r.choice((0, 1, 1, None))) for k in range(6) for _ in range(3 * k)] + [(9, 5, 1), (None, 1, 1), (None, 2, 0), (8, None, 1)]
    df = spark.createDataFrame(rows, "read int, pos int, bit int")
    want = {}
    for k, i, x in rows:
        for m, j, y in rows:
            if k is not None and k == m and None not in (i, j) and j > i:
                n = want.setdefault((i, j), [0] * 4)
                if None not in (x, y):
                    n[2 * x + y] += 1
    out = sites.pair_tally_whole(df, "read", "pos", "bit", block=16, most=most)
    got = out.collect()
    assert {(g["i"], g["j"]): list(g[2:]) for g in got} == want and len(got) == len(want) and out.dtypes[0] == ("i", "int")
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow tallies")[0]


def on(rows):
    """The names that each position of (group, start, end, name) has."""
    out = {}
    for g, s, e, name in rows:
        for p in range(s, e):
            out.setdefault((g, p), []).append(name)
    return out


def test_depths_are_summed_ends(spark):
    r = random.Random(2)
    rows = [(g, s, e, i % 3 == 0) for g in "xy" for i, s, e in spans(r, 40, 200)] + [("x", 50, 50, True)]
    df = spark.createDataFrame(rows, "g string, start bigint, end bigint, odd boolean")
    found = intervals.depths(df, ["g"], {"n": F.lit(True), "odd": F.col("odd")}, width=16).where("n > 0").collect()
    assert Counter((f["g"], p, f["n"], f["odd"]) for f in found for p in range(f["start"], f["end"])) == Counter((*k, len(v), sum(v)) for k, v in on(rows).items())


def test_stretches_of_genes(spark):
    """Positions of one gene only, whichever of its transcripts, and exons without coding bases, as stretches."""
    r = random.Random(3)
    rows = [(c, f"g{i % 4}", ("exon", "CDS", "other")[i % 3], s * 60, e * 60) for c in "xy" for i, s, e in spans(r, 30, 200)] + [("x", "g1", "exon", 7, 7)]
    df = spark.createDataFrame(rows, "chrom string, gene string, feature string, start bigint, end bigint")
    alone = {k: v[0] for k, v in on((c, s, e, g) for c, g, _, s, e in rows).items() if len(set(v)) == 1}
    got = annotation.unambiguous(df).collect()
    assert Counter((f["chrom"], p, f["gene"]) for f in got for p in range(f["start"], f["end"])) == Counter((*k, v) for k, v in alone.items())
    assert len(got) < len(alone) / 20
    bare = [k for k, v in on((g, s, e, f) for _, g, f, s, e in rows).items() if "exon" in v and "CDS" not in v]
    got = annotation.untranslated(df).collect()
    assert Counter((f["gene"], p) for f in got for p in range(f["start"], f["end"])) == Counter(bare) and len(got) < len(bare) / 20


@pytest.mark.parametrize("least", [1, 2, 4])
def test_windows_by_their_start(spark, least):
    """Each start once, with repeated positions, gaps wider than a window and values that are null."""
    r = random.Random(least)
    rows = [(k, r.randrange(60) * (5 if k else 1), r.choice((0.5, 1.25, None))) for k in range(3) for _ in range(25)] + [(None, 1, 1.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "read int, pos bigint, v double")
    found = chains.starts_window(df, "read", "pos", F.col("v"), 7, least)
    want = {}
    for k, p, v in rows:
        for s in range(p - 6, p + 1) if v is not None else ():
            want.setdefault((k, s), []).append(v)
    assert Counter(map(tuple, found.select("read", "start", "n", "total").collect())) == Counter((*k, len(v), sum(v)) for k, v in want.items() if len(v) >= least)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_runs_within_edit_strings(spark):
    rows = [(1, "0120"), (2, "00" * 100_000 + "2" + "1" * 20 + "2" + "0" * 19), (3, "0" * 21), (3, "1" * 30 + "2"), (4, ""), (5, None)]
    got = reads.matched_runs(spark.createDataFrame(rows, "k int, edit_string string"), "k", 20).collect()
    assert sorted(map(tuple, got)) == [(2, 200_020, 200_000), (3, 51, 30)]


def test_tasks_grow_with_the_input(spark, monkeypatch):
    """A larger table is dealt to more tasks before it is grouped, so that none holds more."""
    monkeypatch.setattr(spread, "SHARE", 10_000)
    n = -(-Path(f"{DATA}/lineitem.parquet").stat().st_size // 10_000)
    plan = fixtures.line(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert n > 8 and any("RepartitionByExpression" in line and line.rstrip().endswith(f", {n}") for line in plan.splitlines())
