import duckdb
import numpy as np

from sondage.llm import topk as T


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "t", 1) for i, v in rows], "vec_id bigint, embedding array<double>, dim int, ids string, rank int")


def plain_sum(v, w):
    total = 0.0
    for x, y in zip(v, w):
        total += x * y
    return round(total, T.DECIMALS) if abs(total) < 1e6 else total


def brute(rows, queries, k):
    out = set()
    for i, v in queries:
        scores = sorted((-plain_sum(v, w), j) for j, w in rows if j != i and len(w) == len(v))
        out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)}
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(70)] + [(100 + i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(30)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(8)]
    # A third of all rows are copies of one vector.
    rows += [(300 + i, rows[5][1]) for i in range(50)]
    df = frame(spark, rows)
    for k, step in ((1, 1), (5, 7), (12, 3)):
        queries = [r for r in rows if r[0] % step == 0]
        assert {tuple(r) for r in T.top_k(df, df.where(f"vec_id % {step} = 0"), k).collect()} == brute(rows, queries, k)


def test_large_values_do_not_lose_the_best(spark):
    rows = [(1, [1e20, 1e20, 1.0, 1.0]), (2, [1e20, -1e20, 5.0, 5.0]), (3, [0.0, 0.0, 2.5, 0.0]), (4, [0.0, 0.0, 2.4, 0.0]), (5, [1e99, -1e99, 1e99, 3.0]), (6, [-1e-300, 1e-200, 0.0, 0.0])]
    df = frame(spark, rows)
    got = {tuple(r) for r in T.top_k(df, df, 3).collect()}
    assert got == brute(rows, rows, 3) and (1, 2, 2, 10.0) in got


def test_rounding_never_exceeds_the_slack():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 700):
        a, b = rng.normal(size=(20, dim)) * 10.0 ** rng.integers(-3, 9, (20, dim)), rng.normal(size=(30, dim))
        at, column = (x.reshape(-1) for x in np.indices((20, 30)))
        exact = T._exact(a, b, at, column).reshape(20, 30)
        assert (np.abs(a @ b.T - exact) <= T.slack(a, b)[:, None]).all()


def test_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, T.query(spark, sf).collect()))
    assert got == sorted(c.execute(T.SQL).fetchall()) and len(got) == 5 * T.K


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [9.0, 9.0]), (4, [1.0]), (5, None), (None, [1.0, 1.0]), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1e200, 1.0])]
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in T.top_k(df, df, 2).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert T.top_k(df.limit(0), df).count() == 0 and T.top_k(df, df.limit(0)).count() == 0
