import math

import numpy as np

from wireloom.llm.common import table
from wireloom.llm.nearest import nearest, op5_nearest
from wireloom.llm.quantiser import Quantiser
from pyspark.sql import functions as F


def brute(vectors, queries, k=5):
    """query -> [(score, id)] over dict id -> vector."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        s = x @ np.array(vectors[q], float) / (n * np.linalg.norm(vectors[q]))
        got = sorted((-round(v, 12), i) for v, i in zip(s.tolist(), ids) if i != q)[:k]
        out[q] = [(i, -v) for v, i in got]
    return out


def recall(got, want):
    hit = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in near}) for q, near in want.items())
    return hit / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    for sf in ("sf0.001", "sf0.1"):
        d = f"/root/testdata/{sf}"
        vectors = {r.vec_id: r.embedding for r in table(spark, d, "embeddings").collect()}
        got = op5_nearest(spark, d).collect()
        want = brute(vectors, [i for i in vectors if i % 50 == 0])
        assert recall(got, want) >= 0.95
        assert len(got) == sum(map(len, want.values()))
        for r in got:
            a, b = np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float)
            assert math.isclose(r.score, a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs_tol=1e-12)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, "a"), (1, v, "a"), (2, [2.0, 4.0, 6.0], None), (3, [0.0, 0.0, 0.0], "z"), (4, None, ""), (5, [], ""), (6, [1.0, None, 2.0], ""), (7, [float("nan"), 1.0, 1.0], ""),
            (8, [float("inf"), 1.0, 1.0], ""), (9, [1.0, 2.0], ""), (None, v, ""), (1, v, "b"), (50, [1.0, 0.0, 0.0], ""), (51, [-1.0, -2.0, -3.0], ""), (100, [0.0, -0.0, 0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [x for x in got if x[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 51)]
    assert {x[0] for x in got} == {0, 50}
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_a_hot_vector_hides_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    vectors = {i: base.tolist() for i in range(1000)} | {i: (base + rng.normal(size=16)).tolist() for i in range(1000, 3000)}
    got = nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 500 == 0).collect()
    want = brute(vectors, [i for i in vectors if i % 500 == 0])
    assert recall(got, want) >= 0.95
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 500] == [0, 1, 2, 3, 4]


def test_near_copies_hide_nothing(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    base /= np.linalg.norm(base)
    for noise in (0.02, 0.003):
        others = rng.normal(size=(4000, 32))
        copies = base + rng.normal(size=(2000, 32)) * noise / 32**0.5
        vectors = {i: x.tolist() for i, x in enumerate(np.concatenate((others, copies)))}
        df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
        got = nearest(df, F.col("vec_id") % 100 == 0, rerank=40, sample=1000).collect()
        want = brute(vectors, [i for i in vectors if i % 100 == 0])
        inside = {q: near for q, near in want.items() if q >= 4000}
        assert recall(got, inside) == 1 and recall(got, want) >= 0.9


def test_beam_beats_greedy_codes():
    x = np.random.default_rng(0).normal(size=(600, 12)).astype(np.float32)
    q = Quantiser.fit(x, 4, 16)
    errors = []
    for beam in (1, 8):
        q.beam = beam
        codes, norms = q.encode(x)
        y = q.decode(codes)
        assert np.allclose(np.linalg.norm(y, axis=1), norms, rtol=1e-4) and np.allclose(q.scores(x[0], codes, norms), y @ x[0] / norms, atol=1e-3)
        errors.append(float(((x - y) ** 2).sum()))
    assert errors[1] < errors[0]


def test_cells_keep_the_neighbours(spark, monkeypatch):
    from wireloom.llm import nearest as nn

    rng = np.random.default_rng(4)
    tiles = []
    order = nn.cell_order
    monkeypatch.setattr(nn, "CHUNK", 400)
    monkeypatch.setattr(nn, "cell_order", lambda q, centres, probes: tiles.append((len(centres), probes)) or order(q, centres, probes))
    middles = rng.normal(size=(60, 24)) * 2
    spread = np.concatenate((middles[rng.integers(60, size=8000)] + rng.normal(size=(8000, 24)), rng.normal(size=(2000, 24))))
    vectors = {i: x.tolist() for i, x in enumerate(spread)}
    got = nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, rerank=80, sample=4000).collect()
    want = brute(vectors, [i for i in vectors if i % 50 == 0])
    assert recall(got, want) >= 0.9
    assert tiles[0] == (25, 25) and tiles[1][1] < 25  # all cells for the sample of queries, fewer for all


def test_each_length_is_a_space(spark):
    rng = np.random.default_rng(5)
    short, long = {i: rng.normal(size=3).tolist() for i in range(0, 60)}, {i: rng.normal(size=5).tolist() for i in range(60, 100)}
    df = spark.createDataFrame(list((short | long).items()), "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    want = brute(short, [0, 20, 40]) | brute(long, [60, 80])
    assert got == {q: {k + 1: i for k, (i, _) in enumerate(near)} for q, near in want.items()}
