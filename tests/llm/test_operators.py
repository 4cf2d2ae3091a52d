"""Every operator over odd rows, an empty table, and against a plain restatement."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from transitlake.llm import (bpe, langid, minhash, mixing, planes, quality_model, quality_rules, suffixes, vectors,
                             warc)
from transitlake.llm.catalog import tokenizer
from transitlake.llm.common import scratch


def texts_of(df):
    """Distinct ids (not null) and their texts."""
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect() if r.doc_id is not None}


# Language id

def test_language_id(odd):
    model = langid.learn(odd)
    got = langid.predict(odd, model, keep=["text", "lang"]).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        if letters:
            assert r.lang_pred in model.languages
    sure = [r for r in got if r.lang in ("en", "de") and r.doc_id and r.doc_id >= 100]
    assert all(r.lang_pred == r.lang for r in sure)


def test_language_id_without_labels(odd, nothing):
    model = langid.learn(nothing)
    assert {r.lang_pred for r in langid.predict(odd, model).collect()} == {"und"}
    assert langid.predict(nothing, langid.learn(odd)).count() == 0


def test_filter_has_every_learned_trigram_and_its_rate_holds():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 2**62, 200_000, dtype=np.uint64)
    lang = rng.integers(0, 70, len(key))
    f = langid.LanguageFilter.build([f"l{i:02}" for i in range(70)], 0, lang, key)
    mask = f.masks(key)
    assert all((mask[l // 64, lang == l] >> np.uint64(l % 64) & np.uint64(1)).all() for l in range(70))
    other = f.masks(rng.integers(0, 2**62, 100_000, dtype=np.uint64))
    seen = (other[0] & np.uint64(1)).mean()
    assert abs(seen - f.false_rate[0]) < 1e-3


# Token planes

@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_planes_round_trip(session, odd, kind):
    from tokenizers import Tokenizer
    path = scratch(session, "planes")
    planes.write(odd, path, tokenizer("byte_bpe_50k.json"), kind=kind)
    got = planes.read(session, path).join(planes.digest(planes.read(session, path)), ["doc_id", "start"]).collect()
    got += [r for r in planes.read(session, path).collect() if r.doc_id is None]
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = sorted(((r.doc_id if r.doc_id is not None else -1), tok.encode(r.text or "", add_special_tokens=False).ids)
                  for r in odd.select("doc_id", "text").collect())
    have = sorted(((r.doc_id if r.doc_id is not None else -1), list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))[:-1])
                  for r in got)
    assert have == want
    full = sorted(planes.digest(planes.read(session, path)).collect(), key=lambda r: r.start)
    at = 0
    for r in full:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in full]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    by = {r.doc_id: r for r in full}
    raw = struct.pack("<2I", *tok.encode("one", add_special_tokens=False).ids, 0)
    assert by[9].ids_crc32 == zlib.crc32(raw)


def test_token_planes_empty(session, nothing):
    path = scratch(session, "planes")
    planes.write(nothing, path, tokenizer("byte_bpe_50k.json"))
    assert planes.read(session, path).count() == 0


def test_planes_of_any_length():
    rng = np.random.default_rng(1)
    for kind in ("byte", "bit"):
        for n in (0, 1, 7, planes.BLOCK_IDS, planes.BLOCK_IDS + 5):
            ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
            sizes, body = planes.pack(ids, kind, 1)
            assert (planes.unpack(n, sizes, body) == ids).all()


# BPE

def test_bpe_equals_the_library(odd, nothing):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    rows = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    text = texts_of(rows)
    got = bpe.encode(rows, tokenizer("word_bpe_49k.json")).collect()
    assert len(got) == len(text)
    for r in got:
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        spoken = tok.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded == spoken and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert bpe.encode(nothing, tokenizer("word_bpe_49k.json")).count() == 0


def _with_added(folder, content: str) -> str:
    import json
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": len(spec["model"]["vocab"]) + len(spec["added_tokens"]), "content": content, "single_word": False,
                                 "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = f"{folder}/tokenizer.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    return path


def test_bpe_finds_any_added_token(tmp_path):
    from tokenizers import Tokenizer
    path = _with_added(tmp_path, "[MASK]")
    tok, mine = Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path)
    tok.no_truncation()
    tok.no_padding()
    for text in ("ab[MASK]cd [MASK]", "[MASK][MASK]x", "[mask] [MASK", "no token here"):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", mine.encode(text.encode()))) == ids


def test_bpe_refuses_added_tokens_with_white_space(tmp_path):
    with pytest.raises(ValueError, match="white space"):
        bpe.ForcedBoundaryBPE(_with_added(tmp_path, "a b"))


def test_forced_boundaries_are_outside_all_tokens():
    b = bpe.ForcedBoundaryBPE(tokenizer("word_bpe_49k.json"))
    pieces = b.cut("qxzjvqöä")
    assert "".join(pieces) == "qxzjvqöä" and len(pieces) > 1
    for token in list(b.vocab)[:5000]:
        body = token.removesuffix(b.end)
        if token.endswith(b.end) and len(body) > 1:
            assert b.cut(body) == [body]


def test_memo_is_bounded():
    from transitlake.llm.cache import Memo
    m = Memo(lambda k: k + 1, 10)
    assert [m[i % 37] for i in range(500)] == [i % 37 + 1 for i in range(500)]
    assert len(m) <= 10 and len(m.old) <= 10


# WARC

def test_warc_round_trip_revisits_and_pushdown(session):
    warc.register(session)
    big, small = "<p>" + "é" * 600, "<p>tiny"
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, small), (4, "http://c/\r\nX: y", small),
            (5, "http://d/", None), (6, "http://e/", ""), (None, "http://f/", "x" * 2000), (7, "http://g/", big),
            (8, "http://h/", "\r\n\r\n" * 400), (9, "http://i/", "z" * 3_000_000)]
    pages = session.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = scratch(session, "warc")
    warc.page_records(pages, f"{path}-k").repartition(3).write.format("warc").mode("append").save(path)
    read = session.read.format("warc").load(path)
    got = {r.page_id: r for r in warc.page_digest(read).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == big and i != 7
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
    heads = session.read.format("warc").option("payload", "false").load(path)
    assert "payload" not in heads.columns
    assert heads.filter("warc_type = 'revisit'").count() == 2
    assert heads.filter("target_uri LIKE 'http://d%' AND warc_type IN ('response', 'x')").count() == 1
    assert heads.filter("target_uri IS NULL").count() == 1


def test_warc_skips_without_inflating_and_ignores_unlisted_files(session, tmp_path):
    body = [warc.record("response", f"urn:x:{i}", "http://a/", b"y" * 5000) for i in range(3)]
    members = [warc.member(b) for b in body]
    broken = bytearray(members[1])
    broken[-40:-8] = b"\0" * 32   # its payload cannot be inflated any more
    (tmp_path / "a.warc.gz").write_bytes(members[0] + bytes(broken) + members[2])
    f = warc._File(str(tmp_path / "a.warc.gz"))
    kept = list(warc._gzip_records(f, lambda h: h["record_id"] != "urn:x:1"))
    assert [h["record_id"] for h, _ in kept] == ["urn:x:0", "urn:x:2"]
    (tmp_path / "b.warc").write_bytes(b"".join(body))
    assert len(list(warc._plain_records(warc._File(str(tmp_path / "b.warc")), lambda h: True))) == 3
    import gzip
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(b) for b in body))
    kept = list(warc._gzip_records(warc._File(str(tmp_path / "c.warc.gz")), lambda h: h["record_id"] == "urn:x:2"))
    assert len(kept) == 1 and kept[0][1].endswith(b"y" * 5000)


def test_warc_empty(session):
    warc.register(session)
    path = scratch(session, "warc")
    pages = session.createDataFrame([], "page_id long, url string, html string")
    warc.page_records(pages, f"{path}-k").write.format("warc").mode("append").save(path)
    assert session.read.format("warc").load(path).count() == 0


def test_warc_appends_add_and_overwrite_replaces(session):
    warc.register(session)
    path = scratch(session, "warc")

    def write(ids, mode):
        pages = session.createDataFrame([(i, f"http://{i}/", f"<p>{i}") for i in ids], "page_id long, url string, html string")
        rows = warc.page_records(pages, f"{scratch(session, 'warc')}-k")
        rows.repartition(2).write.format("warc").mode(mode).save(path)
        return {r.page_id for r in warc.page_digest(session.read.format("warc").load(path)).collect()}

    assert write([1, 2], "append") == {1, 2}
    assert write([3], "append") == {1, 2, 3}
    assert write([], "append") == {1, 2, 3}
    assert write([4, 5], "overwrite") == {4, 5}


def test_warc_append_keeps_archives_made_elsewhere(session, tmp_path):
    warc.register(session)
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record("response", "urn:x:1", "http://a/", b"y")))
    pages = session.createDataFrame([(2, "http://b/", "z")], "page_id long, url string, html string")
    warc.page_records(pages, f"{scratch(session, 'warc')}-k").write.format("warc").mode("append").save(str(tmp_path))
    assert session.read.format("warc").load(str(tmp_path)).filter("warc_type = 'response'").count() == 2


# Quality model

def test_quality_model_learns_and_scores_oddities(session, odd, nothing):
    good = [(1000 + i, f"alpha beta gamma {'delta ' if i % 2 else 'eta '}and so on {i}", 1) for i in range(80)]
    junk = [(2000 + i, "BUY!! NOW!! " * (5 + i % 7), 0) for i in range(80)]
    docs = session.createDataFrame(good + junk, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality").unionByName(
        session.createDataFrame([(None, 1), (1000, None), (99999, 1)], "doc_id long, quality int"))
    w = quality_model.fit(docs, labels.filter("doc_id % 3 <> 0 OR doc_id IS NULL"))
    got = quality_model.score(docs, w, keep=["quality"]).collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in got)
    again = quality_model.fit(docs.repartition(7), labels.filter("doc_id % 3 <> 0 OR doc_id IS NULL"))
    assert (w == again).all()
    odd_scores = quality_model.score(odd, w).collect()
    assert len(odd_scores) == odd.count() and all(0 <= r.score <= 1 for r in odd_scores)
    empty = [r.score for r in odd_scores if r.doc_id in (4, 5, 6)]
    assert len(set(empty)) == 1
    assert quality_model.score(nothing, w).count() == 0


def test_quality_model_without_labels(session, odd, nothing):
    w = quality_model.fit(odd, session.createDataFrame([], "doc_id long, quality int"))
    assert not w.any()
    assert {r.score for r in quality_model.score(odd, w).collect()} == {0.5}


# MinHash

@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_equal_brute_force(odd, size):
    text = texts_of(odd)
    sets, want = brute.near_groups(text, size)
    got = minhash.groups(odd, size=size).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_groups_of_an_empty_table(nothing):
    assert minhash.groups(nothing).count() == 0


@pytest.mark.parametrize("chunk", [256, 7])
def test_large_group_of_near_copies(session, monkeypatch, chunk):
    """Near copies of which many do not link: no pair lost, however homes are dealt."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    import random
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = base[:]
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(120)] = f"z{rnd.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    docs = session.createDataFrame(rows, "doc_id long, text string")
    _, want = brute.near_groups(dict(rows), 5)
    got = {r.doc_id: r.component_id for r in minhash.groups(docs).collect()}
    assert got == want


# Quality rules

def test_rule_counts_and_verdicts(session, odd, nothing):
    labels = session.createDataFrame([(100 + i, 1) for i in range(60)] + [(13, 0), (None, 1), (14, None)],
                                     "doc_id long, quality int")
    got = quality_rules.judge(odd, labels).collect()
    assert len(got) == odd.count()
    text = texts_of(odd)
    for r in got:
        if r.doc_id is None:
            continue
        want = brute.base_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules.judge(nothing, labels).count() == 0


def test_rule_counts_on_lines():
    import pyarrow as pa

    from transitlake.llm import words
    texts = ["a b\nc\na b\n\n \na b", "", None, "\n\n", "x\nx\n", "x \nx", "q w e r t y u i " * 4, "a b\n" * 30]
    got = quality_rules.counts(*words.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality_rules._COUNTS) == brute.base_counts(t), t


def test_certified_cutoffs_keep_their_promise(session):
    """In a stratum with enough labels junk goes; in one with few nothing is certified."""
    rows, labels = [], []
    for i in range(1500):
        junk = i % 5 == 0
        word = "ab### " if junk else ("abcd " if i % 400 else "ab# ")
        rows.append((i, word * 30 + f"tail{i}", "en" if i >= 60 else "xx"))
        labels.append((i, 0 if junk else 1))
    docs = session.createDataFrame(
        [(i, " ".join(f"{w}{j}" for j, w in enumerate(t.split())), l) for i, t, l in rows],
        "doc_id long, text string, lang string")
    marks = session.createDataFrame(labels, "doc_id long, quality int")
    measured = quality_rules.measure(docs, "doc_id", "text", "lang")
    cuts = {(r.stratum, r.rule): r.cutoff for r in quality_rules.cutoffs(measured, marks).collect()}
    assert ("en", "symbols") in cuts and not any(s == "xx" for s, _ in cuts)
    got = {r.doc_id: r for r in quality_rules.judge(docs, marks).collect()}
    good = [i for i, q in labels if q and i >= 60]
    assert sum(not got[i].kept for i in good) <= quality_rules.ALPHA * len(good)
    assert not any(got[i].kept for i, q in labels if not q and i >= 60)


def test_binomial_tail_is_exact():
    from math import comb
    for n, p in ((10, 0.3), (50, 0.01)):
        for x in range(n + 1):
            want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
            assert abs(quality_rules.binomial_tail(x, n, p) - want) < 1e-9


# Vectors

def vector_rows():
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        centre = rng.standard_normal((6, 24))
        for i in range(120):
            v = centre[i % 6] + rng.standard_normal(24) * (0.08 if i % 3 else 0.9)
            rows.append((n, v.tolist(), label))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, [2 * x for x in rows[0][1]], 0), (n + 1, [2 * x for x in rows[0][1]], 0),
             (n + 2, None, 0), (n + 3, [], 0), (n + 4, [0.0] * 24, 0), (n + 5, [float("nan")] + [1.0] * 23, 0),
             (n + 6, [None] + [1.0] * 23, 0), (n + 7, [float("inf")] * 24, 1), (n + 8, [1.0, 2.0], 1),
             (n + 9, [1.0, 2.0], 1), (None, rows[0][1], 0), (n + 10, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("chunk", [1024, 7])
def test_vector_links_equal_brute_force(session, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rows = vector_rows()
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("s", F.lit(1))
    got = vectors.groups(df, cosine=0.93).collect()
    assert len(got) == len(rows)
    fine = []
    for k, (i, v, l) in enumerate(rows):
        ok = i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fine.append((k, i, np.array(v, float) / np.linalg.norm(v), l) if ok else None)
    links, count = [], [0] * len(rows)
    for a in filter(None, fine):
        for b in filter(None, fine):
            if a[0] < b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] >= 0.93:
                links.append((a[1], b[1]))
                count[a[0]] += 1
                count[b[0]] += 1
    comp = brute.least_of_component({r[0] for r in rows if r[0] is not None}, links)
    want = sorted((i if i is not None else -1, count[k], comp.get(i, -1), comp.get(i) == i)
                  for k, (i, _, _) in enumerate(rows))
    have = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links,
                   r.component_id if r.component_id is not None else -1, r.kept) for r in got)
    assert [h for h in have if h[0] >= 0] == [w for w in want if w[0] >= 0]
    assert [h for h in have if h[0] < 0] == [(-1, 0, -1, True)]


def test_vectors_empty(session):
    df = session.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.groups(df).count() == 0


# Mixing

def test_mix_serves_targets_and_repeats_bounded(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.times <= 3 and (r.size > 0 or r.times == 0)
        t = by.setdefault((r.target, r.source_size), [0])
        t[0] += r.size * r.times
    assert sum(t[0] for t in by.values()) <= total
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(odd.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.times)
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str) and key(got[0])


def test_targets_fill_up_to_their_caps(session):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 0, None: 400}
    df = session.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r for r in mixing.source_targets(df).collect()}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    open_, left, target = set(sizes), float(sum(sizes.values())), {}
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: share * weight[s] for s in open_}
    for s in sizes:
        assert got[s].weight == weight[s] and abs(got[s].target - target[s]) < 1e-6


def test_mix_spreads_rows_without_ids(session):
    # Half the rows have no id and come from one source; their texts differ.
    df = session.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS doc_id",
                                        "concat('word ', id) AS text", "'web' AS source")
    key = df.select(F.substring(mixing.shuffle_key(F.col("doc_id"), F.col("text")), 1, 1).alias("k"))
    sizes = [r["count"] for r in key.groupBy("k").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * 4000 / 16
    assert mixing.mix(df).agg(F.count("*"), F.sum(F.col("size") * F.col("times"))).first() == (4000, 8000)


def test_mix_comes_near_targets(session):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3] if i % 5 else "a") for i in range(3000)]
    df = session.createDataFrame(rows, "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix(df).collect():
        t = by.setdefault(r.target, 0)
        by[r.target] = t + r.size * r.times
    assert all(abs(taken - target) <= 20 for target, taken in by.items())


# Suffixes

def test_repeated_spans_equal_brute_force(odd, nothing):
    text = texts_of(odd)
    got = {(r.doc_id, r.start_word, r.end_word, r.removed) for r in suffixes.repeats(odd).collect()}
    assert got == brute.repeated_spans(text)
    assert suffixes.repeats(nothing).count() == 0


def test_removed_spans_leave_the_texts(session, odd):
    spans = suffixes.repeats(odd)
    left = suffixes.without(odd, spans)
    assert left.columns == odd.columns
    got = {r.doc_id: r.text for r in left.collect() if r.doc_id is not None}
    text = texts_of(odd)
    assert 1 in got and 2 not in got            # a copy loses all its words
    assert got[7] == text[7] and got[4] is None and got[5] == ""
    passage = brute.words(text[7])[60:]
    assert brute.words(got[8]) == brute.words(text[8])[len(passage):]
    assert left.filter("doc_id IS NULL").count() == 2
    assert not [s for s in brute.repeated_spans(got) if s[3]]


def test_minimisers_meet_in_every_shared_passage():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**62, 50, dtype=np.uint64)
    span = suffixes.MIN_WORDS - suffixes.GRAM + 1
    from transitlake.llm.words import grams
    for _ in range(50):
        kept = []
        for _ in range(2):
            h = np.concatenate([rng.integers(0, 2**62, rng.integers(0, 90), dtype=np.uint64), shared,
                                rng.integers(0, 2**62, rng.integers(0, 90), dtype=np.uint64)])
            g = grams(h, suffixes.GRAM)
            kept.append(set(g[suffixes.minimisers(g, np.zeros(len(g), int), span)].tolist()))
        assert kept[0] & kept[1] & set(grams(shared, suffixes.GRAM).tolist())
