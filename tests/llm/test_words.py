import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import words as plain_words
from transitlake.llm import words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\t\n  \x0b\x1cAZ", max_size=40)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_spans_and_hashes_follow_the_words(texts):
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = words.spans(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]], strict=True)]
           for i in range(len(texts))]
    want = [plain_words(t) for t in texts]
    assert got == want
    flat = [w for t in want for w in t]
    h = words.hash_spans(data, starts, ends)
    assert len(set(flat)) == len({int(x) for x in h})
    assert len({(w, int(x)) for w, x in zip(flat, h, strict=True)}) == len(set(flat))


def test_sliced_and_null_columns():
    col = pa.array(["aa", None, "b c", "d"]).slice(1, 2)
    data, offsets = words.text_bytes(col)
    assert data.tobytes() == b"b c" and offsets.tolist() == [0, 0, 3]


def test_long_words_cross_the_span():
    text = "x" * (words._SPAN + 100) + " y " + "x" * (words._SPAN + 100) + " " + "x" * (words._SPAN + 99)
    data, offsets = words.text_bytes(pa.array([text]))
    starts, ends, _ = words.spans(data, offsets)
    a, b, c, d = words.hash_spans(data, starts, ends)
    assert a == c and len({int(a), int(b), int(d)}) == 3


def test_grams_short_and_long_agree_on_equality():
    h = np.array([1, 2, 3] * 40, np.uint64)
    for n in (4, 8, 9, 50):
        g = words.grams(h, n)
        assert len(g) == 120 - n + 1 and len(set(g.tolist())) == 3
