import random

import numpy as np
import pytest
from plain import maximal_repeats

from sondage.llm import repeats as R


def found(spark, rows, least):
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id bigint, text string, pos int, anchors string")
    rows = R.repeats(df, least)
    tree = [r.asDict() for r in rows.collect()]
    assert len({(r["array_id"], r["rank"]) for r in tree}) == len(tree)
    got = R.occurrences(rows).collect()
    assert len({(r["group_id"], r["doc_id"], r["start_word"]) for r in got}) == len(got)
    # Every place is in the tree once, with the end of its longest passage.
    longest = {}
    for r in got:
        place = r["doc_id"], r["start_word"]
        longest[place] = max(longest.get(place, 0), r["end_word"])
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in tree) == sorted((*k, v) for k, v in longest.items())
    return {tuple(r)[1:] for r in got}


@pytest.mark.parametrize("trial", range(4))
def test_equals_brute_force(spark, trial):
    rng = random.Random(trial)
    vocabulary = "abcd" if trial % 2 else "mnopqrs"
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 14))) for _ in range(4)]
    docs = [(i, " ".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(vocabulary) for _ in range(rng.randint(0, 6)))) for i in range(12)]
    docs += [(50, "a " * 30), (51, docs[3][1]), (52, "")]
    least = (3, 5, 8, 4)[trial]
    assert found(spark, docs, least) == maximal_repeats(docs, least)


def test_suffix_array():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, 200)
    text[[60, 130, 199]] = [100, 101, 102]
    wanted = np.array([i for i in range(200) if i % 3])
    order, common = R.suffix_order(text, wanted)
    suffixes = [text[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes) and sorted(order.tolist()) == wanted.tolist()
    for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_all_occurrences_of_a_passage(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(60))
    own = lambda: " ".join(f"u{rng.random()}".replace(".", "") for _ in range(40))
    docs = [(i, f"{own()} {passage} {own()}") for i in range(30)]
    assert found(spark, docs, 50) == {(60, 30, i, 40, 100) for i in range(30)}


def test_rows_do_not_outnumber_words(spark):
    # Nested repeats: each copy ends one word later, so that the occurrences are quadratic in the words.
    passage = [f"p{k}" for k in range(300)]
    docs = [(i, " ".join(passage[: 100 + i]) + f" own{i}") for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = R.repeats(df, 50)
    assert rows.count() == 150 and R.occurrences(rows).count() == sum(range(2, 151))


def test_texts_of_one_id_are_told_apart(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [(1, f"{passage} one"), (1, f"{passage} two and more"), (1, f"{passage} one"), (2, "short")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [tuple(r)[1:] for r in R.occurrences(R.repeats(df, 10)).collect()]
    assert got == [(20, 2, 1, 0, 20)] * 2


def test_odd_rows(spark, odd, empty):
    rows = {tuple(r)[1:] for r in R.occurrences(R.repeats(odd.where("doc_id != 6"), 5)).collect()}
    assert (11, 2, 1, 0, 11) in rows and (11, 2, 10, 0, 11) in rows
    # One text that repeats itself: a group for each length, all told by one row for each place.
    loop = R.repeats(odd.where("doc_id = 6"), 5).collect()
    assert {r["n_words"] for r in loop if r["n_words"]} == set(range(5, 20_000)) and len(loop) == 20_000 - 4
    assert all(r["last_rank"] - r["first_rank"] == 20_000 - r["n_words"] for r in loop if r["n_words"])
    assert R.repeats(empty, 5).count() == 0 and R.repeats(odd.where("doc_id = 1"), 5).count() == 0
