"""The pipeline's rows against its stages by definition."""

import numpy as np
import pyarrow as pa
from plain import best_subset, cross_parse, words
from plain import components as plain_components

import corpus_pipeline
from sondage.llm import catalogue, decontaminate, langid, mixing, pii, simhash


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "personal_data", "source_mix"]
    assert [f"op{n}" for n in range(1, 11)] == [q.split("_")[0] for q in catalogue.QUERIES] and set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_rows_equal_brute_force(spark, sf, docs):
    rows = [r.asDict() for r in docs.collect()]
    samples = langid.labelled_samples(docs)
    kept = []
    for r in rows:
        text = langid.normalise(pa.array([r["text"]]))[0].tobytes()
        cost = {x: (cross_parse(text, s, langid.SEGMENT), np.log2(len(s))) for x, s in samples.items()}
        if text:
            best = min(sorted(cost), key=lambda x: cost[x][0] * cost[x][1])
            n, bits = cost[best]
            if (n - 1) * bits <= langid.MAX_ENTROPY * len(text):
                kept.append(r | {"lang": best})
    code, count = simhash._features(pa.array([r["text"] for r in kept]))
    some = np.flatnonzero(count)
    sigs = simhash._signatures(code, count[some]).view(np.uint64).reshape(-1, 4)
    ids = [kept[i]["doc_id"] for i in some]
    roots = plain_components((ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(simhash._distance(sigs[:i], sigs[i]) <= simhash.RADIUS))
    kept = [r for r in kept if roots.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    n = decontaminate.MIN_WORDS
    leaked = {tuple(w[i : i + n]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [words(r["text"])] for i in range(len(w) - n + 1)}
    kept = [r for r in kept for w in [words(r["text"])] if not any(tuple(w[i : i + n]) in leaked for i in range(len(w) - n + 1))]
    kept = [r | {"text": t, "n_chars": len(t)} for r in kept for t in [pii.redacted(r["text"])]]
    got = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    by = {r["doc_id"]: r for r in kept}
    assert all(by[r["doc_id"]] == r for r in got) and len({r["doc_id"] for r in got}) == len(got)
    tokens = {}
    for r in kept:
        tokens.setdefault(r["source"], []).append(len(r["text"].split()))
    goal = mixing.budgets({s: sum(x) for s, x in tokens.items()})
    for s, x in tokens.items():
        assert sum(len(r["text"].split()) for r in got if r["source"] == s) == best_subset(sorted(x), [1] * len(x), goal[s])


def test_every_stage_takes_odd_and_empty_tables(spark, sf, odd, empty):
    # The columns that a stage needs, and others that clash with its own.
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, empty):
            out = stage(spark, df, sf)
            assert out.columns == df.columns, name
            assert out.count() <= df.count(), name
