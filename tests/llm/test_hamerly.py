import hashlib
import math
import random

import numpy as np

from gondola.llm import hamerly

BIG = (1 << 63) - 1


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 0.5) for i, e in rows], "vec_id long, embedding array<float>, label int, cluster int, distance double")


def plain(rows, k, rounds, dims):
    vectors = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            vectors.append((i, tuple(max(-BIG - 1, min(BIG, math.floor(1024 * float(np.float32(x))))) for x in e)))
    mark = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted(vectors, key=lambda r: mark(r[0]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [min(range(len(at)), key=lambda c: (far(v, at[c]), c)) for _, v in vectors]
    for _ in range(rounds):
        own = nearest()
        for c in range(len(at)):
            mine = [v for (_, v), o in zip(vectors, own) if o == c]
            if mine:
                at[c] = tuple(sum(x) // len(mine) for x in zip(*mine))
    own = nearest()
    d = [min(BIG, far(v, at[c])) for (_, v), c in zip(vectors, own)]
    inertia = [min(BIG, sum(x for x, o in zip(d, own) if o == c)) for c in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, x, inertia[c], min(BIG, sum(d)), digest[c]) for (i, _), c, x in zip(vectors, own, d)), key=repr)


def found(spark, rows, k=4, rounds=6, dims=3):
    return sorted((tuple(r) for r in hamerly.cluster(frame(spark, rows), k=k, rounds=rounds, dims=dims).collect()), key=repr)


def test_equals_plain_kmeans(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(rng.choice([0, 3, -2]), 1) for _ in range(3)]) for i in range(600)]
    for rounds in (0, 1, 7, 40):
        assert found(spark, rows, k=6, rounds=rounds) == plain(rows, 6, rounds, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, []), (None, [1.0, 1.0, 1.0]), (8, [0.5, 0.25, -0.0001]), (9, [1.0, 1.0, 1.0]), (10, [5.0, 0.0, 0.0])]
    assert found(spark, rows) == plain(rows, 4, 6, 3) and len(found(spark, rows)) == 5


def test_ties_and_repeated_rows(spark):
    rows = [(i % 7, [float(i % 3), 0.0, 0.0]) for i in range(90)] + [(100, [0.5, 0.0, 0.0])] * 30
    got = found(spark, [*rows, *[(i, [1.0, 1.0, 1.0]) for i in range(200, 204)]])
    assert len(got) == 124
    one = [(i, [2.0, 2.0, 2.0]) for i in range(20)]  # all centroids equal
    assert found(spark, one) == plain(one, 4, 6, 3) and {r[1] for r in found(spark, one)} == {0}


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e5, -1e5, 3e30, 1.0, 1e9]) * rng.random() for _ in range(3)]) for i in range(60)]
    assert found(spark, rows) == plain(rows, 4, 6, 3)


def test_fewer_than_k_and_none(spark):
    rows = [(1, [0.0, 1.0, 2.0]), (2, [9.0, 1.0, 2.0])]
    assert found(spark, rows) == plain(rows, 4, 6, 3)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 40, (500, 8)) for c in (0, 900, -900)]).round().astype(np.int64)
    places, before, state, scanned = [tuple(int(v) for v in x[i]) for i in (0, 600, 1200)], None, None, []
    for _ in range(5):
        at = hamerly.Centroids(places, before)
        cluster, upper, lower, rows = hamerly.assigned(x, at, *(state or (None, None, None)))
        d = at.distances(x)
        assert (cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(x)), cluster])
        d[np.arange(len(x)), cluster] = 1 << 60
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1))).all()
        state, before = (cluster, upper, lower), places
        places = [tuple(int(v) for v in x[cluster == c].sum(axis=0) // (cluster == c).sum()) for c in range(3)]
        scanned.append(len(rows))
    assert scanned[0] == len(x) and scanned[-1] < len(x) // 10


def test_rounds_join_without_a_shuffle(spark, small):
    with hamerly.buckets_of_rows(spark, 4) as (write, _):
        vectors = write(hamerly.to_integers(spark.read.parquet(f"{small}/embeddings.parquet"), 64, 1024).repartition(4, "row"), "vectors")
        at = hamerly.Centroids(hamerly.start(vectors, 8, 64, 3))
        state = write(vectors.mapInArrow(hamerly.step(at, 64, True, False), hamerly.STATE), "bounds")
        plan = vectors.join(state.select("row", "cluster").hint("shuffle_hash"), "row")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
