"""Reference queries against their SQL on the smallest tables, and operators on hand fixtures."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from readloom.operators import intervals, ranks, windows
from readloom.operators import profiles, reads
from readloom.plans import annotation as queries
from readloom.sources import annotation

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "-"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if v else "0"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_runs_on_hand_fixture(spark):
    rows = [("r", p, x) for p, x in zip([100, 103, 106, 120, 130], [0.9, 0.8, 0.2, 0.7, 0.95], strict=True)]
    found = windows.runs(spark.createDataFrame(rows, "read string, pos int, p double"), "read", "pos", F.col("p") >= 0.7)
    assert sorted((r["lo"], r["hi"], r["n_sites"]) for r in found.collect()) == [(100, 103, 2), (120, 130, 2)]
    assert [r["gap"] for r in windows.run_gaps(found, "read").collect()] == [16]


def test_alignments_on_hand_fixture(spark):
    """Two mirrored reads: the same edit string and the same sites in sense orientation."""
    rows = [("r1", False, 10, "CATA AG", "CGTACAG"), ("r2", True, 20, "CT TATG", "CTGTACG")]
    df = spark.createDataFrame(rows, "read_id string, is_reverse boolean, read_start int, ref_aligned string, read_aligned string")
    got = {r["read_id"]: r for r in reads.encoded(df).collect()}
    assert all(r["edit_string"] == "0100200" and r["n_a_positions"] == 3 and abs(r["global_edit_freq"] - 1 / 3) < 1e-12 for r in got.values())
    sites = sorted((r["read_id"], r["pos"], r["bit"]) for r in reads.a_sites(reads.encoded(df), ["read_id"]).collect())
    assert sites == [("r1", 11, 1), ("r1", 13, 0), ("r1", 14, 0), ("r2", 21, 0), ("r2", 22, 0), ("r2", 24, 1)]


def test_fisher_and_packing_against_brute_force(spark):
    import itertools
    from math import comb

    tables = [t for t in itertools.product((0, 1, 3, 6), repeat=4) if sum(t)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    for r in df.select("*", profiles.fisher_exact(*map(F.col, "abcd")).alias("p")).collect():
        a, b, c, d = r[:4]
        of = {x: comb(a + b, x) * comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        assert math.isclose(r["p"], sum(v for v in of.values() if v <= of[a]) / comb(a + b + c + d, a + c), rel_tol=1e-9)
    spans = [(i, (i * 37) % 50, (i * 37) % 50 + 5 + i % 7) for i in range(60)]
    got = profiles.packed(spark.createDataFrame([("g", *x) for x in spans], "grp string, key bigint, start bigint, end bigint"), "grp").collect()
    rows = {}
    for r in got:
        rows.setdefault(r["row"], []).append((r["start"], r["end"]))
    assert len(got) == 60 and all(a[1] <= b[0] for x in rows.values() for a, b in itertools.pairwise(sorted(x)))
    assert len(rows) == max(sum(s <= t < e for _, s, e in spans) for t in range(70))


def test_record_files(spark, tmp_path):
    """Five-line records from a file of several splits, in order, and alignments whose run lengths have odd operations."""
    lines = [f"{f}{i}" for i in range(400) for f in annotation.SHAM]
    (tmp_path / "x.sham").write_text("\n".join(lines) + "\n")
    numbered = annotation.numbered_lines(spark, str(tmp_path / "x.sham"))
    assert [r["value"] for r in numbered.orderBy("n").collect()] == lines
    got = annotation.records(numbered, annotation.SHAM).orderBy("record").collect()
    assert len(got) == 400 and got[7]["edits"] == "edits7" and got[399]["coords"] == "coords399"
    df = spark.createDataFrame([("3M1I2D4H1X",), ("",), ("2=1S",)], "c string")
    assert [r[0] for r in df.select(annotation.expanded(F.col("c"))).collect()] == ["MMMIDDX", "", "S"]
    both = spark.createDataFrame([("RN A", "GTCA"), ("AC", "A "), ("R", "C")], "p string, q string").select(annotation.compared(F.col("p"), F.col("q")).alias("c"))
    assert [tuple(r["c"]) for r in both.collect()] == [(1, 0, 0, False), (0, 1, 0, False), (0, 0, 1, False)]


def test_position_table_has_a_total_order(spark):
    """A transcript that has the same positions on several sequences: by position in transcript order, then by name."""
    for strand in "+-":
        rows = [("CDS", strand, f"c{i}", "t", 5, 8) for i in (7, 2, 9, 0, 4, 1)]
        df = spark.createDataFrame(rows, "feature string, strand string, chrom string, transcript string, start bigint, end bigint")
        want = [(p, f"c{i}") for p in ((5, 6, 7) if strand == "+" else (7, 6, 5)) for i in (0, 1, 2, 4, 7, 9)]
        for parts in (1, 3):
            got = annotation.position_table(df.repartition(parts, "chrom")).orderBy("rel_start").collect()
            assert [(r["pos"], r["chrom"]) for r in got] == want and [r["rel_start"] for r in got] == list(range(18)) and [r["rel_stop"] for r in got] == list(range(-17, 1))


@pytest.mark.parametrize("name", ["position_dictionary", "annotation_round_trip"])
def test_tied_positions_equal_sql_with_the_tie_broken(spark, name):
    """sf0.01 has positions that a transcript has on two sequences. The SQL leaves their order open and so differs from
    itself; with sequences in order of name it is one result, which the query has."""
    sql = queries.ORACLE_SQL[name].replace("ELSE pos END)", "ELSE pos END, chrom)")
    assert sql != queries.ORACLE_SQL[name]
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.01/part.parquet'")
    res = con.execute(sql)
    names = sorted(d[0] for d in res.description)
    at = [[d[0] for d in res.description].index(c) for c in names]
    want = sorted(tuple(r[i] for i in at) for r in res.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()) == want


def test_shuffles_keep_their_letters(spark):
    got = profiles.shuffled(spark.createDataFrame([("ACGTTTGACA",)], "s string"), "s", 20, 1).collect()
    assert all(sorted(r["shuffled"]) == sorted(r["s"]) for r in got) and len({r["shuffled"] for r in got}) > 15


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, start bigint, end bigint")
    assert intervals.merged(none, ["k"]).count() == 0
    assert ranks.top_with_ties(none, ["k"], "start", 3).count() == 0
