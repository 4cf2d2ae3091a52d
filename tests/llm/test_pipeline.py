"""Registration, the pipeline's stages, and the SQL oracles."""

import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.oracle_check import check, duck
from transitlake.llm import mixing


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_oracles_agree(spark):
    con = duck(SF_SMALL)
    for key in ("op3_warc_pages", "op9_source_mix"):
        r = check(spark, SF_SMALL, key, entry.queries()[key], entry.oracle_sql()[key], con)
        assert r["ok"], r


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_on_the_small_tables(session):
    docs = session.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in session.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "source_mix",
                            "bpe_encode"]

    one = stages["quality_classifier"](session, docs, SF_SMALL)
    assert one.columns == docs.columns
    kept, before = _texts(one), _texts(docs)
    assert all(before[i] == t for i, t in kept.items())
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)

    two = stages["minhash_near_dedup"](session, one, SF_SMALL)
    assert two.columns == docs.columns
    _, group = brute.near_groups(kept, 5)
    assert _texts(two) == {i: t for i, t in kept.items() if group[i] == i}

    three = stages["suffix_array_dedup"](session, two, SF_SMALL)
    cut = _texts(three)
    spans = brute.repeated_spans(_texts(two))
    for i, t in _texts(two).items():
        w = brute.words(t)
        gone = {k for j, a, b, removed in spans if j == i and removed for k in range(a, b)}
        left = [x for k, x in enumerate(w) if k not in gone]
        assert brute.words(cut.get(i)) == left and (i in cut or not left)
    assert three.filter(F.length("text") != F.col("n_chars")).count() == 0

    four = stages["source_mix"](session, three, SF_SMALL)
    assert four.columns == docs.columns
    times = {r.doc_id: r.times for r in mixing.mix(three).collect() if r.times}
    assert {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()} == times

    five = stages["bpe_encode"](session, four, SF_SMALL)
    assert five.count() == sum(times.values())
    assert {"doc_id", "n_tokens", "ids"} <= set(five.columns)


def test_stages_take_odd_and_empty_tables(session, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(session, nothing, SF_SMALL).count() == 0, name
        out = stage(session, odd, SF_SMALL)
        assert out.count() > 0
        if name != "bpe_encode":
            assert out.columns == odd.columns


def test_rows_that_repeat_an_id_have_verdicts_of_their_own(session):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    one, near, other = words("a", 200), words("a", 199) + " end", words("c", 200)
    docs = session.createDataFrame([(1, one), (5, near), (5, other), (7, other), (8, words("d", 50)), (8, words("d", 50)),
                                    (None, one), (None, one)], "doc_id long, text string")
    out = corpus_pipeline.near_dedup(session, docs, SF_SMALL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted(
        [(0, one), (0, one), (1, one), (5, other), (8, words("d", 50))])


def test_rows_that_repeat_an_id_are_played_within_the_budget(session):
    rows = [(None if i % 2 else 1, "word " * 10, "ab"[i % 3 == 0]) for i in range(90)]
    docs = session.createDataFrame(rows, "doc_id long, text string, source string")
    times = {(r.doc_id, r.source): r["sum(times)"] for r in mixing.mix(docs, keep=["source"])
             .groupBy("doc_id", "source").sum("times").collect()}
    played = corpus_pipeline.mix_sources(session, docs, SF_SMALL)
    assert played.columns == docs.columns and played.count() <= 90
    per = {r.source: r["count"] for r in played.groupBy("source").count().collect()}
    for source, n in per.items():
        assert n == sum(t for (_, s), t in times.items() if s == source)
