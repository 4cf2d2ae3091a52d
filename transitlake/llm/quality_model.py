"""Quality scores: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text are word n-grams hashed into ``2^BITS`` slots, each with
the share of the text's words at which it occurs: words and pairs of words
(lower-cased); one to three words written by their shape, with runs of capital
letters, other letters, digits and signs shortened to one sign; and triples of
words by which of them are equal. The score is the logistic function of the
sparse dot product with the weights plus a bias.

Training is follow-the-regularised-leader (FTRL-Proximal): every slot keeps z
and n, its weight is 0 while ``|z| <= L1``. The labelled rows are dealt into
``SHARDS`` groups by a hash of the id; each group runs FTRL over its rows in
hash order, starting from the common state, and the states are averaged slot
by slot over the groups that touched it. ``ROUNDS`` rounds of this make the
model. Rows beyond ``TRAIN_ROWS`` are sampled by hash, so training and the
state that passes the driver (``2^BITS`` slots) are bounded whatever the size
of the corpus; scoring is a map over all texts.

Defined cases: null and empty texts have no features and get the bias's score;
rows with a null id or label are not learned from but scored; without labelled
rows every score is 0.5; repeated rows are learned from and scored each; a
text with several labels counts once per label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm import words
from transitlake.llm.common import cut, pieces, tidy

BITS = 18
TRAIN_ROWS = 16_000
SHARDS = 8
ROUNDS = 3
ALPHA, BETA, L1, L2 = 5.0, 0.1, 1e-4, 1e-4

_U = np.uint64
_DIM = 1 << BITS
#: Byte → shape sign: capitals, other letters (and bytes of other scripts), digits, signs as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[48:58] = ord("0")


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape with runs shortened."""
    sign = _SHAPE[data]
    new = np.ones(len(sign), bool)
    new[1:] = sign[1:] != sign[:-1]
    new[starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    return words.hash_spans(sign[new], at[starts], at[ends])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and slot of every n-gram, and each text's number of words."""
    n = len(offsets) - 1
    starts, ends, first = words.spans(data, offsets)
    h = words.hash_spans(data, starts, ends, lower=True)
    s = _shapes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    texts, keys = [], []

    def add(key: np.ndarray, size: int, family: int) -> None:
        ok = words.inside(first, size, len(h))
        texts.append(owner[:len(ok)][ok])
        keys.append(words.mix(key[ok] + _U(0x9E3779B97F4A7C15 * family % 2**64)) >> _U(64 - BITS))

    if len(h):
        add(h, 1, 1)
        add(words.grams(h, 2), 2, 2)
        for size in (1, 2, 3):
            add(words.grams(s, size), size, 2 + size)
        a, b, c = h[:-2], h[1:-1], h[2:]
        add((a == b) * _U(1) + (b == c) * _U(2) + (a == c) * _U(4), 3, 6)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.diff(first)
    return np.concatenate(texts), np.concatenate(keys).astype(np.int64), np.diff(first)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train_pass(rows: list[tuple[np.ndarray, np.ndarray, float]], z: np.ndarray, n: np.ndarray) -> None:
    """One FTRL pass over (slots, values, label); slot 2^BITS is the bias."""
    for slots, values, label in rows:
        zi, ni = z[slots], n[slots]
        w = weights(zi, ni)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - label) * values
        step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[slots] = zi + g - step * w
        n[slots] = ni + g * g


def _rows_of(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct slots and their values, text by text, the bias last."""
    data, offsets = words.text_bytes(part.column(part.schema.get_field_index("text")))
    text, slot, n_words = features(data, offsets)
    key, count = np.unique(text * _DIM + slot, return_counts=True)
    text, slot = key // _DIM, key % _DIM
    at = np.searchsorted(text, np.arange(part.num_rows + 1))
    for i in range(part.num_rows):
        a, b = at[i], at[i + 1]
        yield (i, np.append(slot[a:b], _DIM).astype(np.int32),
               np.append(count[a:b] / max(1, n_words[i]), 1.0).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of all slots and the bias, from the texts that have labels."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).na.drop()
    total = marks.count()
    draw = F.xxhash64("id", F.lit("quality"))
    marks = marks.filter((draw.bitwiseAND(0xFFFFFFFF)).cast("double") / 2.0**32 < train_rows / max(1, total))
    # About TRAIN_ROWS marks, so they can be broadcast and the texts stay where they are.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id")
    rows = rows.select(F.pmod(draw, F.lit(SHARDS)).alias("shard"), draw.alias("place"), "label", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                got = list(_rows_of(part))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([s for _, s, _ in got], pa.list_(pa.int32())),
                     pa.array([v for _, _, v in got], pa.list_(pa.float64()))],
                    ["shard", "place", "label", "slots", "vals"])

    examples = cut(rows.mapInArrow(tidy(featurise), "shard long, place long, label double, slots array<int>, "
                                              "vals array<double>"))
    z, n = np.zeros(_DIM + 1), np.zeros(_DIM + 1)
    spark = docs.sparkSession
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def one_shard(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            shard, zs, ns, seen = None, None, None, None

            def out() -> pa.RecordBatch:
                at = np.flatnonzero(seen)
                return pa.RecordBatch.from_arrays([pa.array(at), pa.array(zs[at]), pa.array(ns[at])],
                                                  ["slot", "z", "n"])

            for b in batches:
                for i in range(b.num_rows):
                    if b.column("shard")[i].as_py() != shard:
                        if shard is not None:
                            yield out()
                        shard = b.column("shard")[i].as_py()
                        zs, ns = state.value[0].copy(), state.value[1].copy()
                        seen = np.zeros(_DIM + 1, bool)
                    slots = b.column("slots")[i].values.to_numpy()
                    train_pass([(slots, b.column("vals")[i].values.to_numpy(), b.column("label")[i].as_py())], zs, ns)
                    seen[slots] = True
            if shard is not None:
                yield out()

        # A shard is about TRAIN_ROWS / SHARDS examples; its rows stream through one task.
        shards = examples.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "label")
        means = (shards.mapInArrow(tidy(one_shard), "slot long, z double, n double")
                 .groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("z", "n"))).alias("x")).toArrow())
        z, n = z.copy(), n.copy()
        lists = means.column("x").combine_chunks()
        at = means.column("slot").to_numpy()
        width = np.diff(lists.offsets.to_numpy())
        first = lists.offsets.to_numpy()[:-1]
        values = lists.flatten()
        for target, name in ((z, "z"), (n, "n")):
            target[at] = np.add.reduceat(values.field(name).to_numpy(), first) / width if len(at) else 0
        state.unpersist()
    return weights(z, n)


def score(docs: DataFrame, w: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """id, ``keep`` columns and score of every text (a map, no shuffle)."""
    rows = docs.select(F.col(text_col).alias("_text_"), F.col(id_col), *[F.col(c) for c in keep or []])
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            for part in pieces(batch, "_text_"):
                text, slot, n_words = features(*words.text_bytes(part.column(0)))
                dot = np.bincount(text, weights=weight[slot], minlength=part.num_rows)
                dot = dot / np.maximum(1, n_words) + weight[-1]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(dot, -30, 30))))],
                    [*part.schema.names[1:], score_col])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(tidy(run), f"{kept}, {score_col} double")
