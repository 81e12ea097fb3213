import itertools

import numpy as np
import pyarrow as pa

from sondage.llm import quality as Q


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    count = np.array([3, 0, 1, 4])
    energy, moves = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, pairs, log = Q.marginals(energy, moves, count)
    want, expected, total, at = np.zeros((8, 2)), np.zeros((2, 2)), 0.0, 0
    for n in count:
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = np.exp(sum(energy[at + t, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        total += np.log(z)
        for y, x in weights.items():
            for t in range(n):
                want[at + t, y[t]] += x / z
            for a, b in zip(y, y[1:]):
                expected[a, b] += x / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs.sum(axis=0), expected) and np.isclose(log.sum(), total)


def test_lines_and_neighbours():
    f, length, count = Q.line_features(pa.array(["AB! cd\n\nx x x", None, "", "a\n", "\n"]))
    at = {n: k for k, n in enumerate(Q.FEATURES)}
    assert count.tolist() == [3, 0, 0, 1, 1] and length.tolist() == [6, 0, 5, 1, 0]
    assert f[0, at["upper"]] == 0.5 and f[0, at["upper after"]] == 0 and f[2, at["repeated words"]] == 2 / 3 and f[1, at["repeated words after"]] == 2 / 3
    assert f[:, at["first"]].tolist() == [1, 0, 0, 1, 1] and f[:, at["last"]].tolist() == [0, 0, 1, 1, 1] and f[1, at["empty"]] == 1
    g, _, _ = Q.line_features(pa.array(["same\nsame\nother"]))
    assert g[:, at["as before"]].tolist() == [0, 1, 0] and g[:, at["as after"]].tolist() == [1, 0, 0]


def labelled(folder="/root/testdata/sf0.01"):
    import pyarrow.parquet as pq

    docs, labels = (pq.read_table(f"{folder}/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    both = docs.merge(labels, on="doc_id")
    return both.iloc[::2], both.iloc[1::2]


def line_marginals(texts, field):
    features, length, count = Q.line_features(pa.array(texts))
    score = features @ field[0]
    return Q.marginals(np.stack([0 * score, score], axis=1), field[1], count, False)[0][:, 1], length, np.repeat(np.arange(len(count)), count)


def test_held_out_accuracy_and_planted_lines():
    train, test = labelled()
    field = Q.trained(train.text.tolist(), (train.quality == 1).tolist())
    p, length, owner = line_marginals(test.text.tolist(), field)
    mean = np.bincount(owner, weights=length * p) / np.bincount(owner, weights=length)
    good = test.quality.to_numpy() == 1
    assert ((mean >= Q.MIN_QUALITY) == good).mean() >= 0.98 and (mean[good] >= Q.MIN_QUALITY).mean() >= 0.99
    # A bad line in a held-out good document is found, and the lines about it stay good.
    bad = ["BUY NOW!! CHEAP!! CLICK HERE!! NOW!!", "the the the the the the the the the the the the", "In&&& of%%% the*** and$$$ ere### thand*** or%%% re&&&"]
    texts, at = [], []
    for k, t in enumerate(test.text[good]):
        lines = Q._lines(t)
        if len(lines) > 3:
            place = 1 + k % (len(lines) - 1)
            texts.append("\n".join([*lines[:place], bad[k % 3], *lines[place:]]))
            at.append(place)
    p, _, owner = line_marginals(texts, field)
    first = np.searchsorted(owner, np.arange(len(texts)))
    planted = np.zeros(len(p), bool)
    planted[first + at] = True
    assert len(texts) > 60 and (p[planted] < 0.5).mean() >= 0.95 and (p[~planted] >= 0.5).mean() >= 0.95


def test_all_is_known_of_a_hidden_text_is_that_a_line_is_bad():
    # One feature that tells good lines, and bad texts of which just one line lacks it; the last texts show where labels change.
    texts = [[1, 1, 1]] * 6 + [[1, 0, 1], [0, 1, 1], [1, 1, 0]] * 2 + [[1, 0, 0, 1], [0, 1, 0]]
    count = np.array([len(t) for t in texts])
    features = np.array([[x, 1] for t in texts for x in t], float)
    good, hidden = np.array([True] * 6 + [False] * 8), np.array([False] * 6 + [True] * 6 + [False] * 2)
    label = np.where(np.repeat(np.arange(14) >= 12, count), features[:, 0], np.repeat(good, count))
    weights, moves = Q.fit(features, count, label, hidden)
    score = features @ weights
    p = Q.marginals(np.stack([0 * score, score], axis=1), moves, count, False)[0][:, 1]
    assert ((p >= 0.5) == (features[:, 0] == 1)).all()


def test_quality_equals_enumeration(spark):
    field = (np.random.default_rng(1).normal(size=len(Q.FEATURES)), np.array([[0.3, -0.5], [-0.4, 0.8]]))
    texts = ["a b c\nTHE THE THE!!\n\nplain words of a line", "one line", "x\ny\nx\nx", "ÀÉ 12 34\n$$$"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["quality"] for r in Q.scored(rows, field).collect()}
    for i, t in enumerate(texts):
        features, length, _ = Q.line_features(pa.array([t]))
        score, total, mean = features @ field[0], 0.0, 0.0
        for y in itertools.product((0, 1), repeat=len(score)):
            w = np.exp(score @ y + sum(field[1][a, b] for a, b in zip(y, y[1:])))
            total += w
            mean += w * (length @ y) / length.sum()
        assert got[i] == round(mean / total, 6)


def test_table_and_odd_rows(spark, sf, docs, odd, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = Q.fitted(docs, labels)
    found = Q.scored(docs, field).collect()
    assert len(found) == docs.count() and all(0 <= r["quality"] <= 1 for r in found)
    rows = Q.scored(odd, field).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[2]["quality"] is None and by[3]["quality"] is None and by[9]["quality"] is None and not by[9]["good"] and by[9]["n_lines"] == 3
    assert by[6]["quality"] < 0.5 and by[1]["n_lines"] == 1 and Q.scored(empty, field).count() == 0
    nothing = Q.fitted(empty, labels.limit(0))
    assert Q.scored(docs, nothing).count() == docs.count()
