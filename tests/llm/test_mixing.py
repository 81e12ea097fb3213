import random

from hypothesis import given
from hypothesis import strategies as st
from plain import best_subset

from sondage.llm import mixing as M


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_small_budgets_are_fitted_as_well_as_can_be(counts, budget):
    taken = M.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in taken.items())
    assert sum(n * k for n, k in taken.items()) == best_subset(counts, counts.values(), budget)


def test_large_budgets_are_met_to_the_token():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(5, 4000), 900)}
    whole = sum(n * c for n, c in counts.items())
    for part in (0.1, 0.5, 0.93):
        taken = M.fit(counts, int(whole * part))
        assert sum(n * k for n, k in taken.items()) == int(whole * part) and all(k <= counts[n] for n, k in taken.items())
    assert M.fit(counts, whole + 5) == dict(sorted(counts.items())) and M.fit({}, 10) == {} and M.fit({50: 3}, 49) == {}


def test_budgets_that_only_some_subsets_meet():
    # Sums that the share taken of every length can only be brought to by giving documents back.
    total = lambda taken: sum(n * k for n, k in taken.items())
    assert total(M.fit({7: 10, 50000: 1, 49999: 1}, 99999)) == 99999
    assert total(M.fit({60000: 1, 45000: 1, 10: 1000}, 105000)) == 105000
    assert total(M.fit({1000: 70, 2500: 40, 3500: 1}, 101_499)) == 101_000
    rng = random.Random(2)
    for trial in range(40):
        counts = {rng.randint(1, 400) * rng.choice([1, 1, 30]): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        budget = rng.randint(0, sum(n * c for n, c in counts.items()))
        taken = M.fit(counts, budget, window=rng.choice([4, 64, 1024]))
        assert total(taken) == best_subset(counts, counts.values(), budget) and all(0 < k <= counts[n] for n, k in taken.items()), (trial, counts, budget)


def test_popular_lengths_are_drawn_without_ranking_them_whole(spark):
    rows = [(k, "w " * (50 if k % 3 else 40), "hot") for k in range(900)] + [(k, "w " * 50, "cold") for k in range(1000, 1020)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sorted(M.chosen(df, {"hot": 1, "cold": 1}, 3330).collect())
    assert want == sorted(M.chosen(df, {"hot": 1, "cold": 1}, 3330, ranked=7).collect()) == sorted(M.chosen(df, {"hot": 1, "cold": 1}, 3330, ranked=1).collect())
    assert sum(r["n_tokens"] for r in want if r["source"] == "hot") == 1660


def test_budgets():
    assert M.budgets({"a": 100, "b": 100}, {"a": 3, "b": 1}) == {"a": 100, "b": 33}
    assert M.budgets({"a": 100, "b": 100}, {"a": 3, "b": 1}, 80) == {"a": 60, "b": 20}
    assert M.budgets({"a": 400, "b": 100}) == {"a": 200, "b": 100} and M.budgets({}) == {} and M.budgets({"a": 0}) == {}
    assert M.budgets({"a": 10}, {"x": 1.0}) == {}


def test_stray_sources_do_not_set_the_scale(spark):
    even = {f"s{k}": 1_000_000 for k in range(10)}
    assert M.budgets({"a": 10_000_000, "x": 5}) == {"a": 10_000_000, "x": 5}
    assert M.budgets({"a": 4_000_000, "b": 1_000_000, "x": 5, "y": 700}) == {"a": 2_000_000, "b": 1_000_000, "x": 5, "y": 700}
    assert M.budgets(even | {"x": 5}) == even | {"x": 5} and M.budgets({f"s{k}": 400 for k in range(500)}) == {f"s{k}": 400 for k in range(500)}
    assert M.budgets({"a": 100, "x": 1}, {"a": 1, "x": 1}) == {"a": 1, "x": 1}
    rows = [(k, "w " * 50, "hot") for k in range(400)] + [(1000, "five words of stray text", None)]
    assert M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).count() == 401


def test_table(docs):
    rows = M.chosen(docs).collect()
    tokens = {}
    for r in docs.collect():
        tokens.setdefault(r["source"], {})[r["doc_id"]] = len(r["text"].split())
    goal = M.budgets({s: sum(x.values()) for s, x in tokens.items()})
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(tokens[r["source"]][r["doc_id"]] == r["n_tokens"] for r in rows)
    for s, x in tokens.items():
        got = sum(r["n_tokens"] for r in rows if r["source"] == s)
        assert got == best_subset(sorted(x.values()), [1] * len(x), goal[s])
    assert sorted(M.chosen(docs).collect()) == sorted(rows)
    assert {r["doc_id"] for r in M.mix(docs).collect()} == {r["doc_id"] for r in rows} and M.mix(docs).columns == docs.columns


def test_odd_rows(odd, empty):
    rows = {(r["doc_id"], r["source"]): r["n_tokens"] for r in M.chosen(odd, {None: 1.0}).collect()}
    assert (1, None) in rows and rows[1, None] == 22 and rows[6, None] == 20_000
    assert {i for i, _ in rows} == {1, 5, 6, 7, 8, 10, 11}
    assert M.mix(odd).columns == odd.columns and M.mix(odd).where("doc_id = 1").count() == 2
    assert M.chosen(empty).count() == 0 and M.mix(empty).count() == 0 and M.chosen(odd, {"other": 1.0}).count() == 0
