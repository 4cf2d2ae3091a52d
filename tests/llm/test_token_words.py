"""The word encoder gives the library's ids, and refuses files that its cuts do not fit."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from transitlake.llm import planes
from transitlake.llm.catalog import tokenizer

PATH = tokenizer("byte_bpe_50k.json")
_LIB = Tokenizer.from_file(PATH)


def _check(enc, texts):
    got = enc.encode(pa.array(texts, pa.string()))
    want = [_LIB.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in got] == want


@pytest.fixture(scope="module")
def small():
    return planes.WordEncoder(PATH, words=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab'é日 😀\n\t.,1-<|>  ﬁ", max_size=40)), max_size=8))
def test_ids_are_the_librarys(texts):
    _check(planes.encoder(PATH), texts)


def test_words_pushed_out_come_back(small):
    rng = np.random.default_rng(1)
    pool = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(200)]
    for _ in range(12):
        _check(small, [" ".join(rng.choice(pool, 30)) for _ in range(3)] + [None, "", " ", "one", "it's we'll <|endoftext|> x"])
    assert len(small.young) < 200


def test_batches_that_are_slices(small):
    texts = pa.array(["skip me", "a b c", None, "d  e", "f g"]).slice(1)
    got = small.encode(texts)
    assert [g.tolist() for g in got] == [_LIB.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert small.encode(pa.array([], pa.string())) == []


@pytest.mark.parametrize("change", [
    lambda d: d["pre_tokenizer"].update(add_prefix_space=True),
    lambda d: d["pre_tokenizer"].update(use_regex=False),
    lambda d: d.update(pre_tokenizer={"type": "Whitespace"}),
    lambda d: d.update(normalizer={"type": "Lowercase"}),
    lambda d: d["added_tokens"].append({"id": 50257, "content": "two words", "single_word": False, "lstrip": False,
                                        "rstrip": False, "normalized": False, "special": True}),
    lambda d: d["added_tokens"].append({"id": 50257, "content": "EOS", "single_word": False, "lstrip": False,
                                        "rstrip": False, "normalized": False, "special": True}),
    lambda d: d["added_tokens"].append({"id": 50257, "content": "[X]", "single_word": False, "lstrip": True,
                                        "rstrip": False, "normalized": False, "special": True}),
])
def test_other_files_are_refused(tmp_path, change):
    with open(PATH) as f:
        rules = json.load(f)
    change(rules)
    (tmp_path / "other.json").write_text(json.dumps(rules))
    with pytest.raises(ValueError):
        planes.WordEncoder(str(tmp_path / "other.json"))


def test_uncut_pre_tokens_are_kept_once():
    from transitlake.llm.bpe import worker
    path = tokenizer("word_bpe_49k.json")
    bpe = worker(path)
    text = "kiver zebrax kiver <|x Stra\u00dfe42 \u6c34 <|x|> zebrax"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False)
    assert np.frombuffer(bpe.encode(text.encode()), "<u4").tolist() == want.ids
    uncut = [w for w in ("kiver", "zebrax") if len(bpe.cut(w)) == 1]
    assert uncut and all((w, True) not in bpe.fragments for w in uncut)
