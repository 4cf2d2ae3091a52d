"""Small documents with every oddity the operators promise to handle."""

import random

import pytest

from transitlake.llm.common import prepare

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # Names that the operators use for their own columns.
          "size long, key string, rank int, label string, score double, v long, gram long, stratum string")


def sentence(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(n))


def odd_rows():
    rnd = random.Random(7)
    base = sentence(rnd, 200)
    passage = sentence(rnd, 70)
    words = base.split(" ")
    near = words[:]
    near[100] = "changed"
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"),          # copies, a repeated row
        (3, " ".join(near), "en", "b"),                                            # a near copy
        (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n", "de", None),        # nothing to read
        (None, base, "en", "a"), (None, None, None, None),                         # null ids
        (7, sentence(rnd, 60) + " " + passage, "de", "c"),
        (8, passage + "\n" + sentence(rnd, 90), "de", "c"),                        # a shared passage
        (9, "one", "fr", None), (10, "one", "fr", None), (11, "One two", "fr", "a"),
        (12, "日本語 テキスト 😀 é", None, "b"), (13, "12345 $$$ ###", "en", "b"),
        (14, sentence(rnd, 30_000), "en", "a"),                                    # very long
        (15, "word " * 5_000, "en", "a"),                                          # one gram many times
        (16, "x" * 200_000, "es", "b"),                                            # one word, very long
        (17, "<|endoftext|> a<|startoftext|>b", "es", "b"),
    ]
    texts += [(100 + i, sentence(rnd, rnd.randint(1, 120), "ijklmnop" if i % 2 else "abcdefgh"),
               "de" if i % 2 else "en", "abc"[i % 3]) for i in range(60)]
    return [(i, t, l, s, None if t is None else len(t), 1, "k", 1, "x", 0.5, 9, 8, "y") for i, t, l, s in texts]


@pytest.fixture(scope="session")
def session(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd(session):
    return session.createDataFrame(odd_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(session):
    return session.createDataFrame([], SCHEMA)
