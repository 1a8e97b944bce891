"""Centroid clustering against plain Python, on clustered, equal and odd vectors."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import centroid_clusters as cc


def plain(rows, dims, k, rounds, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*[v for (_, v), a in zip(kept, of) if a == j])] if j in of else w for j, w in enumerate(c)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, a in last if a == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, a, d, inertia[a], sum(inertia.values()), digest[a]) for i, d, a in last), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("columns", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(columns, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * columns, indexing="ij"), axis=-1).reshape(-1, columns)
    key = cc.hilbert_key(cells, bits)
    order = np.argsort(key)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest():
    rng = np.random.default_rng(1)
    for _ in range(300):
        centroids = rng.integers(-9, 9, (12, 4))
        low = rng.integers(-9, 9, 4)
        high = low + rng.integers(0, 3, 4)
        inside = rng.integers(low, high + 1, (50, 4))
        at, distance = cc.nearest(inside, centroids)
        among = cc.candidates(low, high, centroids)
        again, same = cc.nearest(inside, centroids[among])
        assert (among[again] == at).all() and (distance == same).all()


def test_clustered_vectors_leave_few_candidates():
    rng = np.random.default_rng(2)
    middles = rng.integers(-3000, 3000, (40, 16))
    vectors = np.concatenate([m + rng.integers(-40, 40, (300, 16)) for m in middles])
    order = np.argsort(cc.Curve(middles).key(vectors), kind="stable")
    left = []
    for a in range(0, len(order), 64):
        block = vectors[order[a : a + 64]]
        left.append(len(cc.candidates(block.min(axis=0), block.max(axis=0), middles)))
    assert np.mean(left) < 4


def test_large_components_are_exact():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-cc.LIMIT + 1, cc.LIMIT, (50, 64)), rng.integers(-cc.LIMIT + 1, cc.LIMIT, (7, 64))
    at, distance = cc.nearest(v, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for x in v]
    assert [(int(d), int(a)) for d, a in zip(distance, at)] == want


def test_clusters_equal_plain_python(spark):
    rng = np.random.default_rng(4)
    near = [rng.normal(m, 0.2, 3).tolist() for m in range(5) for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(near)] + [(1000 + i, near[0]) for i in range(300)]  # a third are copies
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [1.0, None, 2.0]), (2004, [1.0, float("nan"), 2.0]), (2005, [float("inf"), 1.0, 2.0]), (5, near[7]), (None, near[9]), (None, near[9])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    clashing = df.withColumns({c: F.lit("own") for c in ("id", "x", "v", "h", "key", "row", "cell", "cells", "cluster", "distance")})
    for k, rounds in ((7, 5), (1, 1), (4, 0)):
        want = plain(rows, 3, k, rounds)
        assert rows_of(cc.cluster(df, dims=3, k=k, rounds=rounds)) == want
    assert rows_of(cc.cluster(clashing, dims=3, k=4, rounds=0)) == want


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [-3.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert rows_of(cc.cluster(df, dims=2)) == plain(rows, 2, 40, 5)
    assert cc.cluster(df.limit(0), dims=2).collect() == []
    assert cc.cluster(df, dims=3).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    got = cc.query(spark, sf)
    assert rows_of(got) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({cc.QUERY_SQL})").fetchall(), key=str)
