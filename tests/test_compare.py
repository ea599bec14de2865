"""Queries of the third module against their SQL; principal components against numpy."""

import numpy as np
import pytest

from readloom.plans import compare
from test_reference import DATA, duck, norm  # noqa: F401

NAMES = ["first_occurrence", "common_genes", "efficiency_ratio", "tolerance_lookup", "meta_by_length_quartile", "null_z_and_p", "mismatch_counts", "log2_odds_ratio"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = compare.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(compare.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols and got
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_principal_components(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vector = next(n for n, t in table.dtypes if t.startswith("array"))
    x = np.array([r[vector] for r in table.collect() if r[vector] is not None], float)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:3] ** 2
    got = compare.principal_components(spark, DATA).toPandas()[["pc1", "pc2", "pc3"]].to_numpy()
    assert np.allclose((got**2).sum(axis=0), want, rtol=1e-3)


def test_whole_sequences_and_rows(spark, monkeypatch):
    """Places past the first 30 count, and a repeated id is a row of its own."""
    rows = [(1, "A" * 50), (2, "A" * 40 + "G" * 10), (2, "C" * 35), (3, "")]
    monkeypatch.setattr(compare.fx, "bases", lambda *a: spark.createDataFrame(rows, "doc_id bigint, seq string"))
    got = [tuple(r) for r in compare.QUERIES["mismatch_counts_whole"](spark, "").collect()]
    assert sorted(got) == [(2, 35, 0, 35), (2, 50, 10, 10)]


def test_pairs_of_whole_reads(spark, monkeypatch):
    import itertools
    from collections import Counter

    rows = [(r, 7 * k, (k * r + k // 3) % 2) for r in range(4) for k in range(20)]
    monkeypatch.setattr(compare.fx, "sites", lambda *a: spark.createDataFrame(rows, "read bigint, pos bigint, bit int"))
    want: Counter = Counter()
    for r in range(4):
        for (_, i, x), (_, j, y) in itertools.combinations([s for s in rows if s[0] == r], 2):
            want[i, j, x, y] += 1
    got = compare.QUERIES["co_occurrence_whole"](spark, "").collect()
    assert {(g["i"], g["j"], x, y): g[f"n{x}{y}"] for g in got for x in (0, 1) for y in (0, 1) if g[f"n{x}{y}"]} == dict(want)
    assert all(len(compare.QUERIES[q](spark, "").collect()) == 190 for q in ("odds_ratio_whole", "mutual_information_whole"))
