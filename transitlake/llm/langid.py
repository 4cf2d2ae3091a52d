"""Language identification with a bit-sliced Bloom filter of character trigrams.

One filter serves all languages: a slot holds a bit mask with one bit per
language, a trigram sets its language's bit in ``HASHES`` slots, and the AND
of a trigram's slots is the set of languages that contain it. A text counts,
per language, the trigrams whose mask has the language's bit. A language's
false-positive rate is its share of set slots to the power ``HASHES``; the
count is corrected for it and the largest corrected count decides.

Learning: trigrams of a sample of the labelled texts, ``SAMPLE_ROWS`` per
language on average, chosen by a hash of the id. A language contains a trigram
if the trigram makes up ``MIN_SHARE`` of its trigrams at least and its share
there is at least ``MIN_RATIO`` of the trigram's largest share anywhere. So
no language has more than ``1 / MIN_SHARE`` trigrams, which bounds the filter
and what the driver collects, whatever the size of the corpus.

Trigrams run over lower-cased letters; everything else is one space, words are
padded with spaces, and every trigram is centred on a letter.

Defined cases: null, empty and letterless texts are ``und`` with score 0; a
text with letters that hits no filter gets the language with most training
rows and score 0; ties go to the language first in code-point order; without
any labelled row every text is ``und``; rows with a null id are predicted, not
learned from; repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import cut, pieces
from transitlake.llm.words import mix, text_bytes

UNDETERMINED = "und"
SAMPLE_ROWS = 4000
MIN_SHARE = 1e-5
MIN_RATIO = 0.2
HASHES = 4
SLOT_BITS = 20

_U = np.uint64
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point → lower-cased letter, or 32 for what is no letter."""
    if not _letters:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of all texts and the text each belongs to."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offsets]
    n = len(offsets) - 1
    # A space before the first text and after each text.
    text_of = np.repeat(np.arange(n), np.diff(at) + 1)
    z = np.full(len(points) + n + 1, 32, np.uint64)
    z[1 + np.arange(len(points)) + np.repeat(np.arange(n), np.diff(at))] = _letter_table()[points]
    gap = z == 32
    keep = np.ones(len(z), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    z, owner = z[keep], np.concatenate([[0], text_of])[keep]
    if len(z) < 3:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    centred = z[1:-1] != 32
    key = (z[:-2] << _U(42)) | (z[1:-1] << _U(21)) | z[2:]
    return key[centred], owner[1:-1][centred]


def _slots(key: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (mix(key + _U((0x9E3779B97F4A7C15 * (i + 1)) % 2**64)) >> _U(64 - bits)).astype(np.int64)


@dataclass
class LanguageFilter:
    """Slots of language masks (``words`` 64-bit words per slot) and false-positive rates."""

    languages: list[str]
    fallback: int
    slots: np.ndarray
    false_rate: np.ndarray
    bits: int

    @classmethod
    def build(cls, languages: list[str], fallback: int, lang: np.ndarray, key: np.ndarray,
              bits: int = SLOT_BITS) -> LanguageFilter:
        words = max(1, -(-len(languages) // 64))
        slots = np.zeros((words, 1 << bits), _U)
        for i in range(HASHES):
            at = _slots(key, i, bits)
            for w in range(words):
                own = lang // 64 == w
                np.bitwise_or.at(slots[w], at[own], _U(1) << (lang[own] % 64).astype(_U))
        rate = np.array([((slots[l // 64] >> _U(l % 64)) & _U(1)).mean() ** HASHES for l in range(len(languages))])
        if len(languages) <= 8:
            slots = slots.astype(np.uint8)
        return cls(languages, fallback, slots, rate, bits)

    def masks(self, key: np.ndarray) -> np.ndarray:
        """Languages of each trigram, one row per 64 languages."""
        out = None
        for i in range(HASHES):
            got = self.slots[:, _slots(key, i, self.bits)]
            out = got if out is None else out & got
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        key, owner = trigrams(data, offsets)
        total = np.bincount(owner, minlength=n).astype(float)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        mask = self.masks(key)
        hits = np.empty((len(self.languages), n))
        for l in range(len(self.languages)):
            bit = (mask[l // 64] >> mask.dtype.type(l % 64)) & mask.dtype.type(1)
            seen = np.bincount(owner, weights=bit, minlength=n)
            hits[l] = np.maximum(0, (seen - total * self.false_rate[l]) / (1 - self.false_rate[l]))
        best, held = hits.argmax(axis=0), hits.sum(axis=0)
        top = hits.max(axis=0)
        score = np.divide(top, held, out=np.zeros(n), where=held > 0)
        names = [UNDETERMINED if total[i] == 0 else self.languages[best[i] if held[i] > 0 else self.fallback]
                 for i in range(n)]
        return names, score


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> LanguageFilter:
    """The filter of the languages in ``rows`` (rows with a null id, text or language are left out)."""
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang")).na.drop()
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter.build([], 0, np.zeros(0, np.int64), np.zeros(0, _U))
    rate = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, sample_rows / sizes[l]))])
    draw = (F.xxhash64("id", F.lit("langid")).bitwiseAND(0xFFFFFFFF)).cast("double") / 2.0**32
    rows = rows.filter(draw < F.element_at(rate, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                key, owner = trigrams(*text_bytes(part.column(1)))
                codes = part.column(0).dictionary_encode()
                lang = codes.indices.to_numpy()[owner]
                for l in range(len(codes.dictionary)):
                    found, n = np.unique(key[lang == l], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([codes.dictionary[l].as_py()] * len(found), pa.string()),
                         pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = cut(grams)
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = grams.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    kept = (shares.filter(F.col("share") >= MIN_SHARE).join(best, "gram")
            .filter(F.col("share") >= MIN_RATIO * F.col("best")).select("lang", "gram").toArrow())
    place = {l: i for i, l in enumerate(languages)}
    lang = np.array([place[l] for l in kept.column("lang").to_pylist()], np.int64)
    key = kept.column("gram").to_numpy().astype(np.int64).view(_U)
    fallback = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i))
    return LanguageFilter.build(languages, fallback, lang, key)


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """doc id, ``keep`` columns, lang_pred and score of every text (a map, no shuffle)."""
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col), *[F.col(c) for c in keep or []])
    # The filter's size is fixed by SLOT_BITS and the number of languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                names, score = shared.value.predict(*text_bytes(part.column(0)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(names, pa.string()), pa.array(score)],
                    [*part.schema.names[1:], "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")
