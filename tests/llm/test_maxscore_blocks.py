"""Top-k over several blocks where the threshold is zero or negative."""

import numpy as np
from pyspark.sql import functions as F

from routeloom.llm import maxscore


def check(x, q, ids, k=20):
    blocks = [maxscore._Block(ids[a : a + 2048], x[a : a + 2048]) for a in range(0, len(x), 2048)]
    _, got, scores = maxscore._search(blocks, np.array([-1]), q[None, :], np.array([-(1 << 62)]), k)
    full = x @ q
    want = np.lexsort((ids, -full))[:k]
    assert (got == ids[want]).all() and (scores == full[want]).all()


def test_rows_that_are_met_nowhere():
    rng = np.random.default_rng(6)
    ids = np.arange(6000)[::-1].copy()  # the smaller ids, which win ties, are in later blocks
    dense = rng.integers(-40, 40, (6000, 8))
    check(dense, np.zeros(8, np.int64), ids)
    sparse = np.where(rng.random((6000, 8)) < 0.2, -rng.integers(1, 50, (6000, 8)), 0)
    sparse[:2048] -= 1  # every row of the first block scores below zero
    for q in (rng.integers(1, 9, 8), np.eye(8, dtype=np.int64)[0]):
        check(sparse, q, ids)
        check(sparse[:, :1] * np.ones((1, 8), np.int64) - 1, q, ids)


def test_zero_query(spark):
    n = 5000
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.when(F.col("id") == 4999, F.array(F.lit(0.001), F.lit(0.0))).otherwise(F.array(F.lit(0.5), F.lit(-0.5))).alias("embedding"))
    got = maxscore.top_k(df.orderBy(F.desc("vec_id")), F.col("vec_id") == 4999).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0) for i in range(20)]


def test_many_queries_at_once():
    """Blocks of similar rows, thresholds from seeds, dense and sparse terms, doubles and integers: the same as by sorting all."""
    rng = np.random.default_rng(8)
    for scale in (1, 10**6):
        x = np.where(rng.random((5000, 24)) < np.where(np.arange(24) < 8, 0.9, 0.1), rng.integers(-30, 60, (5000, 24)), 0) * scale
        ids, q = rng.permutation(5000), x[:300]
        kind = maxscore._numbers(q, x)
        assert (kind is np.int64) == (scale > 1)
        theta = maxscore._first_thresholds(ids[1000:2000], x[1000:2000], ids[:300], q, 20)
        blocks = [maxscore._Block(ids[a : a + 1024], x[a : a + 1024].astype(kind)) for a in range(0, 5000, 1024)]
        at, got, scores = maxscore._search(blocks, ids[:300], q.astype(kind), theta.astype(kind), 20)
        for i in range(300):
            full = x @ q[i]
            order = np.lexsort((ids, -full))
            want = order[ids[order] != ids[i]][:20]
            assert (got[at == i] == ids[want]).all() and (scores[at == i] == full[want]).all() and theta[i] <= full[want][-1]


def test_pruning_leaves_out_rows(monkeypatch):
    """With a good threshold few rows are probed."""
    rng = np.random.default_rng(9)
    x = np.zeros((20000, 40), np.int64)
    for a in range(0, 20000, 1000):  # rows of a block have four terms in common
        x[a : a + 1000, rng.choice(40, 4, replace=False)] = rng.integers(1, 60, (1000, 4))
    blocks = [maxscore._Block(np.arange(a, a + 1000), x[a : a + 1000]) for a in range(0, 20000, 1000)]
    theta = np.sort(x @ x[5])[-20:][:1]
    probed = sum(len(maxscore._competitive(b, np.array([-1]), x[5:6], theta)[0]) for b in blocks)
    assert 20 <= probed < 60


def test_repeated_ids_and_few_rows(spark):
    rows = [(i % 40, [float(i % 40 % 7), float(i % 40 % 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = maxscore.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=10, query_rows=1).collect()
    stored = [(i, [64 * int(a) for a in v]) for i, v in rows]
    for q in (0, 20):
        own = next(v for i, v in stored if i == q)
        want = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in stored if i != q)[:20]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(-s, i) for s, i in want]
