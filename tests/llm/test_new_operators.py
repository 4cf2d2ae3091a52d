"""Decontamination, centroid clustering and fill-in-the-middle against plain restatements."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from transitlake.llm import centroids, decontaminate, infill, words
from transitlake.llm.fmindex import FmIndex, suffix_order

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Fill-in-the-middle

def test_rank_index_is_exact_where_scripts_change(monkeypatch):
    monkeypatch.setattr(infill, "SPAN", 5000)
    rnd = random.Random(3)
    texts = ["", "é" * 7, "x" * 30_000, "日本語" * 9_000, "a😀" * 5_000,
             "".join(rnd.choice("aé日😀") for _ in range(20_000)), "", "z" * 9_000 + "日" * 9_000 + "é"]
    data, at = words.text_bytes(pa.array(texts))
    index = infill.RankIndex(data, at)
    want = np.cumsum([0, *(len(c.encode()) for t in texts for c in t)])
    assert index.total == len(want) - 1
    assert (index.offsets(np.arange(len(want))) == want).all()
    assert (np.diff(index.at) == [len(t) for t in texts]).all()
    assert np.abs(index.error).max() <= infill.ERROR and index.error.dtype == np.int8
    assert len(index.start) < len(want) / 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé日😀", max_size=60), max_size=8), st.integers(1, 40))
def test_rank_index_of_any_texts(texts, span):
    old, infill.SPAN = infill.SPAN, span
    try:
        data, at = words.text_bytes(pa.array(texts, pa.string()))
        index = infill.RankIndex(data, at)
    finally:
        infill.SPAN = old
    want = np.cumsum([0, *(len(c.encode()) for t in texts for c in t)])
    assert (index.offsets(np.arange(len(want))) == want).all()
    assert (np.diff(index.at) == [len(t) for t in texts]).all()


def _infill(doc_id, text):
    t = text or ""
    n, s = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return (doc_id, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


def test_infill(session, odd, nothing):
    more = [(1000 + i, t) for i, t in enumerate(
        ["a <P> b", "<S>", "x<M", "<", "<P", "S>", "M>x<", "<<S", "é", "a\n<p>", "日本" * 4000] + ["ab <S x M> <" * 3] * 40)]
    rows = odd.select("doc_id", "text").unionByName(session.createDataFrame(more, "doc_id long, text string"))
    got = infill.restore(infill.transform(rows), text_col="again").collect()
    want = [_infill(r.doc_id, r.text) for r in rows.collect()]
    assert sorted((r[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    texts = {r.doc_id: r.text for r in rows.collect() if r.doc_id is not None}
    assert all(r.again == (texts[r.doc_id] or "") for r in got if r.doc_id is not None)
    kept = infill.transform(odd, keep=["text", "lang", "size"])
    assert kept.columns == ["doc_id", "text", "lang", "size", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert kept.count() == odd.count() and infill.restore(infill.transform(nothing)).count() == 0


def test_infill_with_other_marks_and_shares(session):
    rows = session.createDataFrame([(i, f"word {i} <P> more") for i in range(50)], "doc_id long, text string")
    marks = ("[a]", "[b]", "[c]")
    got = infill.restore(infill.transform(rows, plain_percent=0, spm_percent=100, marks=marks), marks=marks).collect()
    assert {r.form for r in got} == {"spm"} and all(r.text == f"word {r.doc_id} <P> more" for r in got)


# Centroid clustering

def _cluster(vectors, k, rounds, scale=64):
    """(cluster, distance) by position, and the final centroids, in Python integers."""
    q = [[math.floor(x * scale) if abs(x) < 2 ** 52 else int(x) * scale for x in v] for _, v in vectors]
    by = sorted(range(len(q)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"1:{vectors[i][0]}".encode()).hexdigest(),
                                              vectors[i][1]))
    c = [q[i] for i in by[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in q]

    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            own = [v for v, (_, i) in zip(q, of) if i == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(j, d) for d, j in assign()], c


def test_centroids(session):
    rnd = random.Random(11)
    good = [(i, [float(np.float32(rnd.gauss(i % 5, 0.3))) for _ in range(4)]) for i in range(300)]
    good += [(7, good[7][1]), (8, [0.0, -0.0, -1e-9, 1 / 64]), (None, [1.0, 2.0, 3.0, 4.0])]
    bad = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]),
           (904, [1.0, float("nan"), 2.0, 3.0]), (905, [1.0, float("inf"), 2.0, 3.0]), (906, [1.0] * 5)]
    rows = session.createDataFrame([(i, v, 1, 2, 0.5) for i, v in good + bad],
                                   "vec_id long, embedding array<double>, cluster int, d int, distance double").repartition(4)
    found, centres = centroids.cluster(rows, dim=4, k=6, rounds=3)
    want, c = _cluster(good, 6, 3)
    assert centres == c
    got = centroids.with_inertia(found, centres).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got if r.vec_id is not None) == sorted(
        (i, j, d) for (i, _), (j, d) in zip(good, want) if i is not None)
    assert len(got) == len(good) and {r.inertia for r in got} == {sum(d for _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_centroids_of_huge_few_and_no_vectors(session):
    schema = "vec_id long, embedding array<double>"
    big = [(1, [1e300, -1e300]), (2, [3e8, 5.5]), (3, [0.25, -0.25]), (4, [0.25, -0.25]), (5, [1e18, 1.0])]
    found, centres = centroids.cluster(session.createDataFrame(big, schema).repartition(3), dim=2, k=3, rounds=2)
    want, c = _cluster(big, 3, 2)
    assert centres == c
    assert sorted(tuple(r) for r in found.collect()) == sorted(
        (i, j, min(d, centroids.LARGEST)) for (i, _), (j, d) in zip(big, want))
    assert centroids.with_inertia(found, centres).count() == 5
    few, centres = centroids.cluster(session.createDataFrame(big[:2], schema), dim=2, k=16)
    assert len(centres) == 2 and {r.distance for r in few.collect()} == {0}
    none, centres = centroids.cluster(session.createDataFrame([], schema), dim=2)
    assert centres == [] and centroids.with_inertia(none, centres).collect() == []


def test_ties_go_to_the_smaller_cluster_and_an_emptied_one_stays(session):
    q = np.array([[0], [1], [2], [5]], np.int64)
    number, distance = centroids.nearest(q, [[0], [2], [2], [9]])
    assert number.tolist() == [0, 0, 1, 1] and distance.tolist() == [0, 1, 0, 9]
    rows = session.createDataFrame([(i, [1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    found, centres = centroids.cluster(rows, dim=1, k=4)
    assert centres == [[64]] * 4 and {r.cluster for r in found.collect()} == {0}


# Benchmark decontamination

@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6),
       st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=6), min_size=1, max_size=8))
def test_fm_index(chunks, patterns):
    symbols, to_end, from_start = [], [], []
    for c in chunks:
        symbols += [*c, 0]
        to_end += range(len(c), -1, -1)
        from_start += range(len(c) + 1)
    s, e, b = (np.array(x, np.int64) for x in (symbols, to_end, from_start))
    order = suffix_order(s, e)
    ends = [next(j for j in range(i, len(symbols)) if not symbols[j]) for i in range(len(symbols))]
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: (symbols[i:ends[i]], ends[i]))
    patterns = [p for p in patterns if max(p) <= max(symbols)]
    rows = np.zeros((len(patterns), 6), np.int64)
    for i, p in enumerate(patterns):
        rows[i, :len(p)] = p
    index = FmIndex(s, e, b)
    which, low, high = index.search(rows, np.array([len(p) for p in patterns], np.int64))
    found = {int(w): sorted(index.locate(np.arange(lo, hi)).tolist()) for w, lo, hi in zip(which, low, high)}
    for i, p in enumerate(patterns):
        want = [j for j in range(len(symbols)) if symbols[j:j + len(p)] == p]
        assert found.get(i, []) == want


def _tokens(text):
    return [(m.start(), m.end(), m.group()) for m in
            re.finditer("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))]


def _leaks(texts, items, size=10):
    """(n_words, spans in words, items) of each text by comparing each window."""
    wins = {}
    for item, text in items:
        w = [t for _, _, t in _tokens(text)]
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for text in texts:
        w, hit, who = [t for _, _, t in _tokens(text)], set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wins:
                    hit.update(range(i, i + k))
                    who |= wins[tuple(w[i:i + k])]
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i + 1 for i in sorted(hit) if i + 1 not in hit]
        out.append((len(w), list(zip(starts, ends)), sorted(str(x) for x in who if x is not None)))
    return out


def _benchmark():
    rnd = random.Random(5)
    items = [(i, sentence(rnd, rnd.randint(8, 60))) for i in range(20)]
    same = sentence(rnd, 12)
    return items + [(30, same), (31, same), (9, same + " tail"), (32, "tiny phrase"), (33, "Ünï Côdé 日本"), (34, ""),
                    (35, " .,; "), (36, None), (None, sentence(rnd, 15)), (37, "again " * 30), (38, "word " * 12)]


def _training(items):
    rnd = random.Random(6)
    texts = [None, "", "--- ...", "a TINY, phrase here", "tiny phraseology", "tiny", "ünï CôDé... 日本!", "x" * 50_000,
             "again " * 40_000 + "x", "word " * 300, " ".join(sentence(rnd, 5) for _ in range(4000))]
    for item, text in items:
        w = (text or "").split(" ")
        texts += [text, text, sentence(rnd, 30) + " " + " , ".join(w[2:-1]).upper() + " " + sentence(rnd, 20),
                  " ".join(w[:9]), " ".join(w[:11]) + "; " + " ".join(w[3:])]
    # A passage that many documents share, and one text that holds everything several times.
    texts += [sentence(rnd, rnd.randint(0, 300)) + " " + items[30 % len(items)][1] for _ in range(300)]
    texts.append("\n".join((t or "") + " gap " + sentence(rnd, 3) for _ in range(3) for _, t in items))
    return texts


@pytest.mark.parametrize("limits", [{}, {"SHARD": 300, "CHUNK": 5, "LOCATE": 7, "PIECE": 2000}])
def test_leaks(session, monkeypatch, limits):
    items = [r if r[1] is None or r[0] != 38 else r for r in _benchmark()]
    texts = _training([r for r in items if r[1]])
    for name, value in limits.items():
        monkeypatch.setattr(decontaminate, name, value)
    phrases = decontaminate.Phrases(_pairs(session, items).toArrow())
    head, names = ["doc_id"], ["doc_id", "n_words", "spans", "items"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(texts, pa.string()),
         pa.array([[]] * len(texts), pa.list_(decontaminate._SPAN_TYPE)), pa.array([[]] * len(texts), pa.list_(pa.string()))],
        ["doc_id", "_text", "spans", "items"])
    got = decontaminate._search(batch, phrases, head, names).to_pylist()
    for r, text, (n, spans, who) in zip(got, texts, _leaks(texts, items), strict=True):
        assert (r["n_words"], [(s["first"], s["last"]) for s in r["spans"]], r["items"]) == (n, spans, who)
        at, raw = _tokens(text), (text or "").encode()
        for s in r["spans"]:
            assert raw[s["begin"]:s["end"]].decode() == text[at[s["first"]][0]:at[s["last"] - 1][1]]


def _pairs(session, items):
    return decontaminate.windows(session.createDataFrame(items, "item_id long, text string"))


def test_leaks_of_frames_in_one_pass_and_in_several(session, odd, nothing):
    items = _benchmark()
    texts = _training([r for r in items if r[1]])[:120]
    bench = session.createDataFrame([(*r, "x") for r in items], "item_id long, text string, n_words string")
    docs = session.createDataFrame([(i // 2 if i % 7 else None, t, i, 0) for i, t in enumerate(texts)],
                                   "doc_id long, text string, row long, spans int").repartition(3)
    one = decontaminate.find(docs, bench, keep=["row"])
    assert one.columns == ["doc_id", "row", "n_words", "spans", "items"]
    got = {r.row: (r.n_words, [(s.first, s.last) for s in r.spans], r["items"]) for r in one.collect()}
    assert got == dict(enumerate(_leaks(texts, items)))
    several = decontaminate.find(docs, bench, keep=["row"], max_windows=40)
    assert sorted(several.collect(), key=repr) == sorted(one.collect(), key=repr)
    # No window of the benchmark is left once the spans are cut out, but for those that the cut itself joins.
    cut = decontaminate.without(decontaminate.find(docs.withColumn("text", F.concat("text", F.lit(" end"))), bench,
                                                   keep=["row", "text"]))
    for r in cut.collect():
        if texts[r.row] is not None:
            raw, at = (texts[r.row] + " end").encode(), 0
            parts = []
            for s in r.spans:
                parts.append(raw[at:s.begin])
                at = s.end
            assert r.text.encode() == b"".join([*parts, raw[at:]])
    assert decontaminate.find(nothing, bench).count() == 0
    clean = decontaminate.find(odd, session.createDataFrame([], "item_id long, text string")).collect()
    assert len(clean) == odd.count() and all(r.spans == [] and r["items"] == [] for r in clean)
    assert {r.n_words for r in clean if r.doc_id == 15} == {5000}
