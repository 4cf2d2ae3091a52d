"""Held-out accuracy of the learned operators, and recall of near copies at the threshold."""

import random

from pyspark.sql import functions as F

from tests.llm import brute
from transitlake.llm import catalog, minhash

SF = "/root/testdata/sf0.01"


def test_language_id_on_held_out_documents(session):
    got = catalog.JOBS["op1_language_id"](session, SF)
    docs = session.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    n, right = held.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.98


def test_quality_on_held_out_labels(session):
    got = catalog.JOBS["op4_quality_classifier"](session, SF)
    labels = session.read.parquet(f"{SF}/labels.parquet").filter("quality IS NOT NULL")
    held = got.filter("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    n, right = held.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 50 and right / n > 0.95


def test_every_pair_at_the_threshold_is_linked(session):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    texts, pairs = {}, []
    for k in range(400):
        a = [word() for _ in range(rnd.randint(60, 200))]
        b = a[:]
        # Words changed far enough apart cost five shingles each.
        for i in range(rnd.randint(1, max(1, len(a) // 45))):
            b[(i * 37 + 10) % len(b)] = word()
        b = b[:len(b) - rnd.randint(0, len(b) // 30)]
        texts[2 * k], texts[2 * k + 1] = " ".join(a), " ".join(b)
        sa, sb = brute.shingles(texts[2 * k], 5), brute.shingles(texts[2 * k + 1], 5)
        pairs.append((2 * k, 100 * len(sa & sb) >= 80 * len(sa | sb), len(sa & sb) / len(sa | sb)))
    near = [s for _, _, s in pairs if 0.76 <= s <= 0.86]
    assert len(near) > 100 and any(ok for *_, ok in ((p, p[1]) for p in pairs)) and not all(p[1] for p in pairs)
    docs = session.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    comp = {r.doc_id: r.component_id for r in minhash.groups(docs).collect()}
    for a, linked, s in pairs:
        assert (comp[a + 1] == a) == linked and comp[a] == a, s
