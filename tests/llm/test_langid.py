import pyarrow as pa
from plain import cross_parse
from pyspark.sql import functions as F

from sondage.llm import langid as L


def normal(text):
    data, _ = L.normalise(pa.array([text]))
    return data.tobytes()


def test_normalise():
    assert normal("  Hello, World 42!\nÄb ") == "hello world äb ".encode() and normal(None) == b"" and normal("12 3") == b""
    data, offsets = L.normalise(pa.array(["a.", ".b", "", None, "c d"]))
    assert data.tobytes() == b"a bc d" and offsets.tolist() == [0, 2, 3, 3, 3, 6]


def test_automaton_accepts_just_the_substrings():
    text = b"abracadabra"
    moves = L.suffix_automaton(text)

    def accepts(s):
        state = 0
        for c in s:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            assert accepts(text[a:b])
    assert not accepts(b"aa") and not accepts(b"abrad") and len(moves) <= 2 * len(text)


def test_phrases_equal_a_plain_parse(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 7)
    samples = {"x": b"the cat sat on the mat", "y": "der größe hund".encode()}
    parser = L.Parser(samples)
    texts = ["the cat", "größe", "qqq the", "", None, "a hund sat on der mat zz " * 3, "t"]
    data, offsets = L.normalise(pa.array(texts))
    got = parser.phrases(data, offsets)
    for r, t in enumerate(texts):
        assert got[r].tolist() == [cross_parse(normal(t), samples[x], 7) for x in parser.languages]


def test_accuracy(docs):
    samples = L.labelled_samples(docs)
    assert set(samples) == {"de", "en", "es", "fr"} and all(len(x) <= L.TRAIN_BYTES for x in samples.values())
    found = L.identified(docs, samples)
    assert found.count() == docs.count()
    right = found.join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id").where("language = label").count()
    assert right >= 0.97 * docs.count()


def test_languages_of_short_texts_have_samples(spark):
    short = ["der Hund sieht die Katze", "42", "", None, "die Katze liegt auf der Matte", "ein großer Hund"]
    long = "the cat sat on the mat and looked at the dog with a word " * 5
    rows = [(k, t, "de") for k, t in enumerate(short)] + [(10, long, "en"), (11, "a short one", "en"), (12, "7 " * 300, "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    samples = L.labelled_samples(docs)
    assert set(samples) == {"de", "en"}
    assert len(samples["de"]) == sum(len(normal(short[k])) for k in (0, 4, 5)) and all(normal(short[k]) in samples["de"] for k in (0, 4, 5))
    assert samples["en"] == normal(long) + normal("a short one")
    assert L.labelled_samples(docs, train_docs=1)["en"] == normal(long) and L.labelled_samples(docs, train_bytes=250)["en"] == normal(long)[:250]
    assert {r["doc_id"]: r["lang"] for r in L.in_known_language(docs, samples).collect()} == {0: "de", 4: "de", 5: "de", 10: "en", 11: "en"}


def test_odd_rows(odd, empty):
    samples = {"en": normal("the cat sat on the mat and looked at the dog with a word ") * 3, "de": normal("der hund sieht die katze auf der matte") * 3}
    rows = L.identified(odd, samples).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["language"] == "en" and by[6]["language"] == "en" and by[7]["language"] == "und" and by[10]["language"] == "en"
    for i in (2, 3, 4, 5, 9):
        assert (by[i]["language"], by[i]["entropy"], by[i]["n_bytes"]) == ("und", None, 0)
    assert L.identified(empty, samples).count() == 0
    assert {r["language"] for r in L.identified(odd, {}).collect()} == {"und"}
    kept = L.in_known_language(odd, samples)
    assert kept.columns == odd.columns and {1, 6, 10} <= {r["doc_id"] for r in kept.collect()} and {r["lang"] for r in kept.collect()} <= {"en", "de"}
    assert not {2, 3, 4, 5, 7, 9} & {r["doc_id"] for r in kept.collect()}
    assert L.in_known_language(odd, {}).count() == 0 and L.labelled_samples(empty) == {}


def test_ties_go_to_the_first_name(odd):
    same = normal("the cat sat on the mat")
    assert {r["language"] for r in L.identified(odd.where("doc_id = 1"), {"b": same, "a": same}).collect()} == {"a"}
