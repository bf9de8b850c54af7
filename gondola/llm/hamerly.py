"""Centroid clustering: k-means over integer vectors with Hamerly's bounds.

Every vector carries its cluster, an upper bound of its distance to that centroid and a lower bound of its distance to the
nearest other one. When centroids move, the upper bound grows by its own centroid's drift and the lower one falls by the
largest drift of the others. While the upper bound is under the lower one, or under half the way to the nearest other
centroid, the nearest centroid cannot have changed. Otherwise the upper bound is made exact, and if that does not settle it
the vector is ambiguous: all its distances are computed, exactly, in whole numbers.

The vectors are written once, in buckets of a row number; a round writes the bounds only, in the same buckets, so that
each round joins them without a shuffle. What moves the centroids is added up by task (sums of the vectors that changed their
cluster, added to the sums of the round before) and then by Spark; k rows reach the driver.

Defined results:
- vectors that are null, have other than DIMS components, or a null or non-finite one are left out;
- a component beyond 64 bits after scaling counts as the largest or smallest 64-bit number; distances and inertias
  beyond 64 bits are the largest 64-bit number; comparisons are exact at any size;
- null vec_id hashes as the empty text and is kept; rows that repeat a vec_id are vectors of their own, and of equal hashes
  the one whose packed bytes are smaller is the earlier centroid;
- fewer kept vectors than k: as many centroids as vectors; equal centroids: the smaller number gets the vectors;
- none kept: no rows; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import deleted, parts, saved, shared_dir

DIMS = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Components up to this size take the fast way: sums of their squared differences fit 64 bits for up to 2048 components.
SMALL = (1 << 25) - 1
MOST = (1 << 63) - 1
#: Bytes of vectors in a bucket; more than MOST_BUCKETS are not made.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 20_000
#: Bounds are doubles: one is under another only by more than their rounding.
SLACK = 1e-9

STATE = "row long, vec_id long, cluster int, upper double, lower double, distance decimal(38,0), moved array<decimal(38,0)>"
_STATE = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.decimal128(38, 0)), ("moved", pa.list_(pa.decimal128(38, 0)))])


def packed(values: np.ndarray) -> pa.Array:
    """Vectors of whole numbers as bytes: 4 for each component where all of a vector's are small, else 8."""
    n, dims = values.shape
    small = ((values <= SMALL) & (values >= -SMALL)).all(axis=1)
    if small.all():
        return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 4 * dims).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values.astype(np.int32)))])
    return pa.array([v.astype(np.int32 if s else np.int64).tobytes() for v, s in zip(values, small)], pa.binary())


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32 if len(data) == 4 * dims else np.int64)


def to_integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(row, vec_id, x) of the vectors that are kept; row numbers differ, x is packed."""
    e = F.col("embedding")
    whole = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            x = np.floor(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * float(scale))
            exact = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            exact[x >= 2.0**63] = MOST
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), packed(exact)], names=["row", "vec_id", "x"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(whole).select("row", "vec_id", F.col("embedding").alias("x")).mapInArrow(run, "row long, vec_id long, x binary")


class Centroids:
    """Whole-number centroids, with what Hamerly's test needs of them."""

    def __init__(self, places: list[tuple[int, ...]], before: list[tuple[int, ...]] | None = None):
        self.places = places
        self.small = all(abs(x) <= SMALL for c in places for x in c)
        self.array = np.array(places, dtype=np.int64) if self.small else None
        apart = [[_root(_squared(a, b)) for b in places] for a in places]
        self.half = np.array([min((d for j, d in enumerate(row) if j != i), default=math.inf) for i, row in enumerate(apart)]) / 2 * (1 - SLACK)
        drift = np.array([_root(_squared(a, b)) for a, b in zip(places, before or places)]) * (1 + SLACK)
        self.drift = drift
        self.others = np.array([max((d for j, d in enumerate(drift) if j != i), default=0.0) for i in range(len(places))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of each row to each centroid."""
        if self.small and x.dtype == np.int64:
            out = np.empty((len(x), len(self.places)), dtype=np.int64)
            for j, c in enumerate(self.array):
                d = x - c
                out[:, j] = np.einsum("ij,ij->i", d, d)
            return out
        return np.array([[_squared(v, c) for c in self.places] for v in x.tolist()], dtype=object).reshape(len(x), len(self.places))

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        if self.small and x.dtype == np.int64:
            d = x - self.array[cluster]
            return np.einsum("ij,ij->i", d, d)
        return np.array([_squared(v, self.places[c]) for v, c in zip(x.tolist(), cluster)] + [0], dtype=object)[:-1]


def _squared(a, b) -> int:
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b))


def _root(x: int) -> float:
    return math.sqrt(x)


def _roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def assigned(x: np.ndarray, at: Centroids, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound of each row, and which rows were scanned in full."""
    n = len(x)
    if cluster is None:
        cluster, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros(n)
    else:
        cluster, upper, lower = cluster.copy(), upper + at.drift[cluster], np.maximum(lower - at.others[cluster], 0.0)
    safe = np.maximum(lower, at.half[cluster])
    open_ = np.flatnonzero(upper * (1 + SLACK) >= safe)
    if len(open_) and np.isfinite(upper[open_]).all():
        upper[open_] = _roots(at.own(x[open_], cluster[open_])) * (1 + SLACK)
        open_ = open_[upper[open_] * (1 + SLACK) >= safe[open_]]
    if len(open_):
        d = at.distances(x[open_])
        best = np.argmin(d, axis=1)  # the first of equals
        rows = np.arange(len(open_))
        cluster[open_], upper[open_] = best, _roots(d[rows, best]) * (1 + SLACK)
        if d.shape[1] > 1:
            rest = d.astype(object) if d.dtype == object else d.copy()
            rest[rows, best] = MOST * MOST * 4096 if d.dtype == object else MOST
            lower[open_] = _roots(rest.min(axis=1)) * (1 - SLACK)
        else:
            lower[open_] = np.inf
    return cluster, upper, lower, open_


def groups(data: list[bytes], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors: those of small components together as 64-bit numbers, the rest as Python's."""
    small = np.array([len(d) == 4 * dims for d in data], dtype=bool)
    at = np.flatnonzero(small)
    if len(at):
        yield at, np.frombuffer(b"".join(data[i] for i in at), dtype=np.int32).reshape(-1, dims).astype(np.int64)
    at = np.flatnonzero(~small)
    if len(at):
        yield at, np.array([unpacked(data[i], dims).tolist() for i in at], dtype=object).reshape(-1, dims)


def step(at: Centroids, dims: int, first: bool, last: bool):
    """One assignment of all vectors of a task: their bounds, then what the task adds to each cluster (row is null there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(at.places)
        gain = [[0] * (dims + 1) for _ in range(k)]  # count, then sums of components, as Python's whole numbers
        reach = [0] * k
        seen = False
        for batch in parts(batches, 4096):
            seen, n = True, batch.num_rows
            cluster, upper, lower, exact = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n), np.zeros(n, dtype=object)
            was = None if first else batch.column("cluster").to_numpy().astype(np.int64)
            bounds = (None, None) if first else (batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            for rows, x in groups(batch.column("x").to_pylist(), dims):
                old = None if first else was[rows]
                cluster[rows], upper[rows], lower[rows], _ = assigned(x, at, old, *(None if b is None else b[rows] for b in bounds))
                new = cluster[rows]
                if last:
                    exact[rows] = own = np.array([min(int(d), MOST) for d in at.own(x, new)], dtype=object)
                    for c in range(k):
                        reach[c] += sum(own[new == c])
                for c in range(k) if not last else ():
                    came, went = (new == c) & (True if first else old != c), np.zeros(len(new), dtype=bool) if first else (old == c) & (new != c)
                    if came.any() or went.any():
                        moved = [int(v) for v in x[came].sum(axis=0)], [int(v) for v in x[went].sum(axis=0)]
                        gain[c] = [g + d for g, d in zip(gain[c], [int(came.sum()) - int(went.sum()), *(a - b for a, b in zip(*moved))])]
            distance = pa.array(exact.tolist() if last else [None] * n, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), distance, pa.nulls(n, _STATE.field("moved").type)], schema=_STATE)
        if seen:
            none = lambda kind: pa.nulls(k, kind)
            totals = pa.array(reach if last else [None] * k, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), pa.array(range(k), pa.int32()), none(pa.float64()), none(pa.float64()), totals, pa.array(gain, _STATE.field("moved").type)], schema=_STATE)

    return run


@contextmanager
def buckets_of_rows(spark: SparkSession, buckets: int):
    """Gives write(df, name), which returns df as a table in so many buckets of `row`, and drop(keep), which deletes all tables but the first and the last keep - 1. All go at the end."""
    names: list[str] = []

    def path(name: str) -> str:
        return f"{shared_dir(spark)}/{name}"

    def write(df: DataFrame, name: str) -> DataFrame:
        names.append(f"{name}_{uuid.uuid4().hex}")
        df.write.bucketBy(buckets, "row").saveAsTable(names[-1], format="parquet", path=path(names[-1]))
        return spark.table(names[-1])

    def drop(keep: int) -> None:
        while len(names) > keep:
            name = names.pop(min(keep, 1))
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            deleted(spark, path(name))

    try:
        yield write, drop
    finally:
        drop(0)


def gains(state: DataFrame, dims: int) -> dict[int, list[int]]:
    """Count and component sums that a round adds to each cluster: k rows of each task, added up by Spark."""
    added = [F.sum(F.get("moved", F.lit(i))).alias(f"s{i}") for i in range(dims + 1)]
    return {r[0]: [int(x) for x in r[1:]] for r in state.where("row is null").groupBy("cluster").agg(*added).collect()}  # k rows


def start(vectors: DataFrame, k: int, dims: int, seed: int) -> list[tuple[int, ...]]:
    """The first centroids: k vectors in order of the hash of seed and id, then of their bytes."""
    marked = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("mark"), "x")
    first = [r["mark"] for r in marked.select("mark").orderBy("mark").limit(k).collect()]
    if not first:
        return []
    found = marked.where(F.col("mark") <= first[-1]).groupBy("mark", "x").agg(F.count("*").alias("n")).orderBy("mark", "x").limit(k).collect()
    return [tuple(unpacked(bytes(r["x"]), dims).tolist()) for r in found for _ in range(min(r["n"], k))][:k]


def sha256_of(place: tuple[int, ...]) -> str:
    return hashlib.sha256(",".join(map(str, place)).encode()).hexdigest()


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """OUT of each kept vector of embeddings (vec_id, embedding). Rounds end early once no centroid moves."""
    spark = embeddings.sparkSession
    size = embeddings.count() * dims * 4
    n = min(MOST_BUCKETS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES)))
    with buckets_of_rows(spark, n) as (write, drop):
        vectors = write(to_integers(embeddings, dims, scale).repartition(n, "row"), "vectors")
        places, before, state = start(vectors, k, dims, seed), None, None
        if not places:
            return spark.createDataFrame([], OUT)
        total = {c: [0] * (dims + 1) for c in range(len(places))}

        def moved(last: bool) -> DataFrame:
            rows = vectors
            if state is not None:
                rows = vectors.join(state.where("row is not null").select("row", "cluster", "upper", "lower").hint("shuffle_hash"), "row")
            return rows.mapInArrow(step(Centroids(places, before), dims, state is None, last), STATE)

        for _ in range(rounds):
            if before == places:
                break
            state = write(moved(last=False), "bounds")
            drop(2)  # the bounds of the round before
            for c, gain in gains(state, dims).items():
                total[c] = [a + b for a, b in zip(total[c], gain)]
            before, places = places, [tuple(s // t[0] for s in t[1:]) if t[0] else place for place, t in zip(places, total.values())]
        final = saved(moved(last=True).select("row", "vec_id", "cluster", "distance"), "clusters", keep=True)
    reach = {r["cluster"]: int(r["d"]) for r in final.where("row is null").groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    every = min(sum(reach.values()), MOST)
    about = spark.createDataFrame([(c, min(reach[c], MOST), every, sha256_of(p)) for c, p in enumerate(places)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = final.where("row is not null").select("vec_id", "cluster", F.col("distance").cast("long").alias("distance"))
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same as plain k-means, a step of SQL for each round."""
    apart = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(d=dims)
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, x, d, num FROM (SELECT v.vec_id, v.x, c.num, {apart}::HUGEINT AS d FROM v, c{r} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, num) = 1)"
    move = lambda r: f"""c{r + 1} AS MATERIALIZED (SELECT num, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT num, list(CASE WHEN s >= 0 THEN s // t ELSE -((t - 1 - s) // t) END ORDER BY i) AS x
      FROM (SELECT num, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS t FROM (SELECT num, unnest(x) AS y, unnest(range(1, {dims} + 1)) AS i FROM a{r}) GROUP BY num, i) GROUP BY num) n USING (num))"""  # noqa: E731
    steps = [s for r in range(rounds) for s in (near(r), move(r))]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS num, x FROM v QUALIFY num < {k}),
{", ".join(steps)}, {near(rounds)}
SELECT vec_id, num::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY num))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string((SELECT c.x FROM c{rounds} c WHERE c.num = a{rounds}.num), ',')) AS centroid_sha256 FROM a{rounds}
"""


ORACLE_SQL = oracle_sql()
