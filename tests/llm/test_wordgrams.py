import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from plain import words

from sondage.llm import wordgrams as W

TEXTS = st.lists(st.text(alphabet="aBé1 .\n日", max_size=25) | st.none(), max_size=8)


@given(TEXTS, st.integers(1, 4), st.integers(1, 5))
def test_words_grams_and_anchors(texts, k, w):
    out = W.words_of(pa.array(texts, pa.string()))
    got = [[bytes(out.data[out.start[i] : out.end[i]]).decode() for i in range(out.first[r], out.first[r + 1])] for r in range(len(texts))]
    assert got == [words(t) for t in texts]
    flat = sum(got, [])
    assert len(set(zip(flat, out.code.tolist()))) == len(set(flat)) == len(set(out.code.tolist()))
    grams, valid = W.gram_codes(out, k)
    spelled = {}
    for i in np.flatnonzero(valid):
        assert spelled.setdefault(int(grams[i]), tuple(flat[i : i + k])) == tuple(flat[i : i + k])
    assert valid.sum() == sum(max(0, len(g) - k + 1) for g in got)
    start, anchor = W.window_minima(grams, valid, out.doc, w)
    chosen = set(W.winnow(grams, valid, out.doc, w).tolist())
    doc, seen = out.doc, {}
    assert len(start) == sum(max(0, len(g) - k - w + 2) for g in got)
    for p, m in zip(start.tolist(), anchor.tolist()):
        assert p <= m < p + w and doc[p] == doc[m] and m in chosen
        # The choice depends on the window's words alone.
        key = tuple(flat[p : p + w + k - 1])
        assert seen.setdefault(key, m - p) == m - p


def test_slices_and_sliding():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "c"])], names=["t"])
    parts = list(W.slices(batch, "t", 10))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) > 1
    assert W.sliding(np.array([3, 1, 2, 5]), 3, np.minimum).tolist() == [1, 1]
