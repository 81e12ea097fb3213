import random

import duckdb
from plain import words

from sondage.llm import licenses as L


def spans(spark, texts, **options):
    rows = [(k, t, 1, 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id int, template int")
    return sorted((r["doc_id"], r["license"], r["start_word"], r["end_word"], r["coverage"]) for r in L.licenses(df, **options).collect())


def plain_spans(text, templates, k=L.GRAM_WORDS, least=L.MIN_COVERAGE, drift=L.DRIFT):
    """By definition: compare every position with every other, diagonal by diagonal."""
    w, out = words(text), set()
    for name, form in templates:
        t, votes = words(form), {}
        for p in range(len(w) - k + 1):
            for q in range(len(t) - k + 1):
                if w[p : p + k] == t[q : q + k]:
                    votes.setdefault(p - q, []).append(q)
        clusters = []
        for d in sorted(votes):
            if not clusters or d - clusters[-1][-1] > drift:
                clusters.append([])
            clusters[-1].append(d)
        for cluster in clusters:
            parts, low = [], None
            for first, d in sorted((min(votes[d]) + d, d) for d in cluster):
                if low is None or min(votes[d]) <= low:
                    parts.append([])
                parts[-1].append(d)
                low = min(votes[d])
            for part in parts:
                hit = {q + j for d in part for q in votes[d] for j in range(k)}
                if len(hit) >= least * len(t):
                    out.add((min(q + d for d in part for q in votes[d]), max(q + d for d in part for q in votes[d]) + k, name, len(hit), len(t)))
    better = lambda x, s: (x[1] - x[0], x[3] / x[4], x[3]) > (s[1] - s[0], s[3] / s[4], s[3]) or (x[1] - x[0], x[3] / x[4], x[3]) == (s[1] - s[0], s[3] / s[4], s[3]) and x[2] < s[2]
    return {(name, a, b, round(n / size, 6)) for a, b, name, n, size in out if not any(x[0] <= a and b <= x[1] and better(x, (a, b, name, n, size)) for x in out)}


def test_notices(spark):
    got = spans(spark, ["Intro. Licensed under the Apache License, Version 2.0. End", "released UNDER the mit license", "no license", "All rights reserved.", "Licensed under CC BY-NC 4.0 and CC BY 4.0"])
    assert got == [(0, "Apache-2.0", 1, 9, 1.0), (1, "MIT", 0, 5, 1.0), (3, "proprietary", 0, 3, 1.0), (4, "CC-BY-NC-4.0", 0, 7, 1.0)]


def test_drifting_diagonals_are_merged(spark):
    long = next(t for n, f, t in L.TEMPLATES if n == "GPL-3.0" and f == "header")
    w = words(long)
    changed = w[:10] + ["inserted", "words"] + w[10:18] + w[19:]
    got = spans(spark, ["x y " + " ".join(changed) + " z"])
    assert len(got) == 1 and got[0][:4] == (0, "GPL-3.0", 2, 2 + len(changed)) and got[0][4] > 0.75
    assert spans(spark, [" ".join(w[:12])]) == []


def test_equals_brute_force_on_fuzzed_texts(spark):
    rng = random.Random(4)
    forms = [t for _, _, t in L.TEMPLATES]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = words(rng.choice(forms))
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [f"own{rng.randrange(9)}" for _ in range(rng.randint(0, 3))]
                w = w or ["lost"]
            parts.append(" ".join(w[: rng.choice([len(w), len(w), 9])]))
            parts.append(" ".join(rng.choice(["the", "software", "license", "under"]) for _ in range(rng.randint(0, 6))))
        texts.append(". ".join(parts))
    texts += ["All rights reserved. " * 4, "Released under the MIT License. " * 3]
    own = [(n, t) for n, _, t in L.TEMPLATES]
    want = {(i, *s) for i, t in enumerate(texts) for s in plain_spans(t, own)}
    got = spans(spark, texts)
    assert set(got) == want and len(got) == len(want) and len(want) > 60


def test_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, L.query(spark, sf).collect()))
    assert got == sorted(c.execute(L.SQL).fetchall()) and got


def test_verification_counts_words():
    t = "a b c d e f".split()
    assert L.covering("x a b c d e f".split(), t, [1], 3) == 6 and L.covering("x a b c d e f".split(), t, [0], 3) == 0
    assert L.covering("a b x d e f".split(), t, [0], 3) == 3 and L.covering("a b c".split(), t, [-5, 0, 9], 3) == 3


def test_texts_of_one_id_make_no_span_together(spark):
    # Neither text holds a license; the two together vote for every diagonal of one.
    form = words(next(t for n, f, t in L.TEMPLATES if n == "Apache-2.0" and f == "notice"))
    half = [" ".join(form[:4] + ["x"] * 4), " ".join(["y"] * 4 + form[4:])]
    whole = " ".join(form)
    df = spark.createDataFrame([(1, half[0]), (1, half[1]), (2, whole), (2, "w " + whole)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["start_word"]) for r in L.licenses(df).collect()) == [(2, 0), (2, 1)]


def test_repeated_and_odd_rows(spark, odd, empty):
    assert L.licenses(odd).count() == 0 and L.licenses(empty).count() == 0
    twice = "Released under the MIT License. " * 3
    assert [s[2] for s in spans(spark, [twice])] == [0, 5, 10]
    df = spark.createDataFrame([(1, twice), (1, twice), (None, twice)], "doc_id bigint, text string")
    assert L.licenses(df).count() == 3
    none = spark.createDataFrame([], "template_id bigint, license string, text string")
    assert L.licenses(df, none).count() == 0
    long = "word " * 200_000 + "Licensed under the MIT License."
    assert spans(spark, [long]) == [(0, "MIT", 200_000, 200_005, 1.0)]
