"""Centroid clustering over zone maps: vectors in the order of a Hilbert curve, in blocks with the least and greatest
of each component. A block's box tells which centroids can be nearest to any vector in it; only those are compared, exactly.

A round reads the blocks once, sums in each task, and brings one number for each centroid and component to the driver.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Vectors of a block.
BLOCK = 256
#: Axes of the curve, and bits of each: 64 in all make the key.
AXES, BITS = 8, 8
#: Components are below this in size, so that each squared distance of up to 128 components fits in a long.
LIMIT = 1 << 27
#: Centroids nearest to the middle of a box that others must beat somewhere in it.
RIVALS = 4
_WHOLE = pa.decimal128(38, 0)


def hilbert_key(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of whole numbers below 2^bits along the Hilbert curve; columns times bits are 64 at most.

    Bit by bit from the top, the part of space that a row lies in is turned and mirrored so that the curve runs through
    it as it runs through the whole (Skilling, 2004); the key takes one bit of each column in turn.
    """
    x = places.astype(np.uint64)
    columns = x.shape[1]
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i in range(columns):
            up = (x[:, i] >> np.uint64(level) & np.uint64(1)).astype(bool)
            swap = np.where(up, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, i] ^= swap
            x[:, 0] ^= np.where(up, low, swap)
    x[:, 1:] = np.bitwise_xor.accumulate(x, axis=1)[:, 1:]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> np.uint64(level) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(columns):
            key = key << np.uint64(1) | (x[:, i] >> np.uint64(level) & np.uint64(1))
    return key


class Curve:
    """Which way the curve runs: along the axes in which the starting centroids lie farthest apart."""

    def __init__(self, centroids: np.ndarray):
        self.middle = centroids.mean(axis=0)
        self.axes = np.linalg.svd(centroids - self.middle, full_matrices=False)[2][:AXES].T
        spread = np.abs((centroids - self.middle) @ self.axes).max(axis=0, initial=1)
        self.step = 4 * np.maximum(spread, 1) / (1 << BITS)

    def key(self, vectors: np.ndarray) -> np.ndarray:
        at = np.floor((vectors - self.middle) @ self.axes / self.step) + (1 << BITS - 1)
        key = hilbert_key(np.clip(at, 0, (1 << BITS) - 1))
        return (key ^ np.uint64(1 << 63)).view(np.int64)  # signed order equals unsigned order


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest, or as near as the nearest, to a vector in the box; rising.

    One whose least distance to the box is above another's greatest can't; nor can one that another beats all over the
    box: how much nearer the other is rises or falls evenly with each component, so it is least in a corner.
    """
    gap = np.maximum(0, np.maximum(low - centroids, centroids - high))
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    alive = (gap * gap).sum(axis=1) <= (far * far).sum(axis=1).min()
    size = (centroids * centroids).sum(axis=1)
    middle = (low + high) // 2
    for i in np.argsort(((centroids - middle) ** 2).sum(axis=1), kind="stable")[:RIVALS]:
        side = centroids[i] - centroids
        alive &= size[i] - size - 2 * np.where(side > 0, low * side, high * side).sum(axis=1) >= 0
    return np.flatnonzero(alive)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector, the smaller number of equals; whole numbers."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * vectors.shape[1] * most * most < 1 << 53:  # all sums below are whole numbers that doubles hold
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        distance = ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        distance = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = distance.argmin(axis=1)
    return at, distance[np.arange(len(at)), at]


class Assign:
    """Clusters and distances of a block's vectors, for use inside tasks."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    def __call__(self, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, numbers of their centroids, squared distances."""
        cells, low, high = (np.frombuffer(block[name], np.int32).astype(np.int64) for name in ("cells", "low", "high"))
        vectors = cells.reshape(-1, self.centroids.shape[1])
        among = candidates(low, high, self.centroids)
        at, distance = nearest(vectors, self.centroids[among])
        return vectors, among[at], distance


def kept(df: DataFrame, name: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, v): vectors of dims components, none of them null, NaN or infinite, as floor(scale * component)."""
    finite = lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))
    rows = df.select(F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.filter((F.size("x") == dims) & F.forall("x", finite)).select("id", F.transform("x", lambda a: F.floor(scale * a)).alias("v"))


def _starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the least hashes of seed and id, in that order; equal ids by their vectors, null ids last."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return np.array([row["v"] for row in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], np.int64)


def zone_maps(vectors: DataFrame, dims: int, curve: Curve) -> DataFrame:
    """(ids, cells, low, high) of each block: vectors are dealt by ranges of the curve's key and cut behind each BLOCK.

    Equal vectors have one key; the number of the row in its task parts them, so that any number of copies is dealt evenly.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def key(batches):
        row = 0
        for batch in batches:
            cells = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            if len(cells) and max(int(cells.max()), -int(cells.min())) >= LIMIT:
                raise ValueError(f"a component times the scale is {LIMIT} or more: squared distances would not fit in a long")
            raw, step = cells.astype(np.int32).tobytes(), 4 * dims
            cut = pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), cut, pa.array(curve.key(cells)), pa.array(np.arange(row, row + len(cells)))], ["id", "cell", "key", "row"])
            row += len(cells)

    def packed(table: pa.Table, rows: int) -> pa.RecordBatch:
        ids, cells = table.column("id"), table.column("cell").to_pylist()
        out: dict[str, list] = {"ids": [], "cells": [], "low": [], "high": []}
        for a in range(0, rows, BLOCK):
            b = min(rows, a + BLOCK)
            box = np.frombuffer(b"".join(cells[a:b]), np.int32).reshape(-1, dims)
            for name, value in (("ids", ids.slice(a, b - a).to_pylist()), ("cells", box.tobytes()), ("low", box.min(axis=0).tobytes()), ("high", box.max(axis=0).tobytes())):
                out[name].append(value)
        return pa.RecordBatch.from_arrays([pa.array(out["ids"], pa.list_(ids.type)), *(pa.array(out[n], pa.binary()) for n in ("cells", "low", "high"))], list(out))

    def pack(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(x.num_rows for x in rest) >= BLOCK:
                table = pa.Table.from_batches(rest)
                whole = table.num_rows // BLOCK * BLOCK
                yield packed(table, whole)
                rest = table.slice(whole).to_batches()
        if any(x.num_rows for x in rest):
            table = pa.Table.from_batches(rest)
            yield packed(table, table.num_rows)

    keyed = vectors.mapInArrow(key, f"id {kind}, cell binary, key bigint, row bigint")
    dealt = keyed.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("id", "cell")
    return dealt.mapInArrow(pack, f"ids array<{kind}>, cells binary, low binary, high binary")


#: Places of the sums that aren't a component's: vectors of the cluster, and their distances.
COUNT, INERTIA = -1, -2


def totals(blocks: DataFrame, centroids: np.ndarray) -> dict[int, dict[int, int]]:
    """For each cluster with vectors: the sum of each component, and under COUNT and INERTIA of vectors and distances.

    Tasks give one row for each cluster and place, which are summed by Spark; (k * (components + 2)) rows reach the driver.
    """
    assign, k, dims = Assign(centroids), *centroids.shape

    def run(batches):
        sums, count, inertia = np.zeros((k, dims), object), np.zeros(k, object), np.zeros(k, object)
        for batch in batches:
            for block in batch.to_pylist():
                vectors, at, distance = assign(block)
                for c in np.unique(at).tolist():
                    of = at == c
                    sums[c] += vectors[of].sum(axis=0)
                    count[c] += int(of.sum())
                    inertia[c] += (int((distance[of] >> 32).sum()) << 32) + int((distance[of] & 0xFFFFFFFF).sum())
        rows = [(c, place, Decimal(int(x))) for c in range(k) if count[c] for place, x in [(COUNT, count[c]), (INERTIA, inertia[c]), *enumerate(sums[c])]]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), _WHOLE))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "total"])

    rows = blocks.select("cells", "low", "high").mapInArrow(run, "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    found: dict[int, dict[int, int]] = {}
    for row in rows.collect():
        found.setdefault(row["cluster"], {})[row["place"]] = int(row["total"])
    return found


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that can be clustered.

    Those have dims components, none null, NaN or infinite; other rows, and null vectors, give no row. Components become
    floor(scale * component). Centroids start as the k vectors (all, if fewer) of the least sha256 of seed:id; each round
    assigns every vector to its nearest, the smaller number of equals, and moves each centroid that has vectors to their
    floored mean. Repeated rows and ids count each time; a null id can be clustered, but starts a cluster only when others
    are too few. No vectors give no rows. Other columns are not read. A component of 2^27 or more after scaling fails the
    job, as squared distances would not fit in a long. Blocks are a table in the shared folder.
    """
    spark = df.sparkSession
    vectors = kept(df, id, vector, dims, scale)
    name = vectors.schema["id"].dataType.simpleString()
    schema = f"`{id}` {name}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = _starts(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks = materialise(zone_maps(vectors, dims, Curve(centroids)))
    for _ in range(rounds):
        found = totals(blocks, centroids)
        centroids = np.array([[found[c][i] // found[c][COUNT] for i in range(dims)] if c in found else old for c, old in enumerate(centroids.tolist())], np.int64)
    inertia = {c: x[INERTIA] for c, x in totals(blocks, centroids).items()}
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    assign, every = Assign(centroids), sum(inertia.values())

    def run(batches):
        for batch in batches:
            for i, block in enumerate(batch.select(["cells", "low", "high"]).to_pylist()):
                _, at, distance = assign(block)
                at = at.tolist()
                columns = [batch.column("ids")[i].values, pa.array(at, pa.int32()), pa.array(distance), pa.array([inertia[c] for c in at], pa.int64()), pa.array([every] * len(at), pa.int64()), pa.array([digest[c] for c in at])]
                yield pa.RecordBatch.from_arrays(columns, [id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(dims: int = 64, k: int = 40, rounds: int = 5) -> str:
    """The same in DuckDB: rounds are unrolled, distances are joins on the component's place."""
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        "n AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_id, * FROM v)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        square = "list_sum(list_transform(range(1, {0}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(dims + 1)
        parts.append(f"a{r} AS (SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, cluster := cluster)) AS s FROM (SELECT row_id, vec_id, v, cluster, CAST({square} AS BIGINT) AS d FROM n, c{r}) GROUP BY row_id)")
        if r < rounds:
            floor = "CAST(CASE WHEN s % n < 0 THEN (s - s % n) // n - 1 ELSE s // n END AS BIGINT)"
            parts.append(f"m{r} AS (SELECT cluster, list({floor} ORDER BY i) AS c FROM (SELECT s.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY cluster)")
            parts.append(f"c{r + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))")
    return (
        f"WITH {', '.join(f'{name} AS MATERIALIZED {body}' for name, body in (p.split(' AS ', 1) for p in parts))} "
        "SELECT vec_id, s.cluster AS cluster, s.d AS distance, CAST(sum(s.d) OVER (PARTITION BY s.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(s.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 "
        f"FROM a{rounds} JOIN c{rounds} ON s.cluster = c{rounds}.cluster"
    )


QUERY_SQL = _sql()
