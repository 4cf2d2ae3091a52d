"""Passages that repeat across documents, by sparse suffix arrays.

A full suffix array would sort one suffix per word. Here only suffixes at
*minimiser* positions are kept: of every ``MIN_WORDS - GRAM + 1`` neighbouring
grams of ``GRAM`` words the one with the smallest hash. Two texts that share a
passage of ``MIN_WORDS`` words keep a suffix at the same place in it; about one
word in 16 starts a kept suffix.

1. *Copies*: texts with the same words throughout form a class; its first
   document stands for it, the others are repeats as a whole.
2. *Sort and compare*: kept suffixes are brought together by their leading
   gram, where neighbours are equal. Only "held by another document" matters,
   so a gram needs no list of its suffixes: its smallest and largest document
   differ or they don't, which is partially aggregated before the shuffle. A
   gram that a third of all documents hold is no hot task.
3. *Extend*: texts that keep suffixes with shared grams are read again, and
   each such suffix is extended left and right by every window of
   ``MIN_WORDS`` words that contains its gram. Windows are compared in the same
   way. A window that an earlier document holds is a repeat; the windows of a
   document, joined, are its maximal repeated spans.

The first document (smallest id) of a passage keeps it. Repeats within one
document alone do not count. Words are equal if their bytes are; white space
between them does not matter. Comparisons use 64-bit hashes of word sequences.

Defined cases: null, empty and short texts have no spans; rows with a null id
are left out of the comparison and keep their text; rows that repeat an id
count as one document and have the same spans if their texts are equal; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm import words
from transitlake.llm.common import cut, pieces, rejoin, tidy

#: Words of the shortest passage, and of the gram that leads a kept suffix.
MIN_WORDS = 50
GRAM = 20

_NONE = np.uint64(2**64 - 1)


def _smallest(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, by doubling."""
    out, have = x, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def minimisers(gram: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Positions whose gram is the smallest of some ``span`` neighbours in one text.

    ``gram`` holds the positions with a whole gram, text by text; ``owner``
    names their texts. Among equal grams all are chosen, so the choice depends
    on the words alone.
    """
    if len(gram) < span:
        return np.zeros(0, np.int64)
    low = _smallest(gram, span)
    low = np.where(owner[:len(low)] == owner[span - 1:], low, np.uint64(0))
    # A window's minimum never exceeds its grams: equal to the largest minimum
    # of the windows over a position means chosen by one of them.
    pad = np.full(span - 1, _NONE)
    largest = ~_smallest(np.concatenate([pad, ~low, pad]), span)
    return np.flatnonzero(largest == gram)


def _words(part: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch and each text's first word."""
    data, offsets = words.text_bytes(part.column(part.schema.get_field_index(col)))
    starts, ends, first = words.spans(data, offsets)
    return words.hash_spans(data, starts, ends), first


def _whole(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each text's words in their order."""
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    out = []
    for step in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(words.mix(h + place * np.uint64(step)), dtype=np.uint64, out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def kept_suffixes(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """doc_id, n, d1, d2, grams of texts that are long enough.

    Their words, the digest of all, and the distinct leading grams of the kept
    suffixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, first = _words(part, "text")
                lead = words.grams(h, gram)
                at = np.flatnonzero(words.inside(first, gram, len(h)))
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))[at]
                own = minimisers(lead[at], owner, min_words - gram + 1)
                key, owner = lead[at][own], owner[own]
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                key, owner = key[new], owner[new]
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(cuts), pa.array(key.view(np.int64)))
                n, (d1, d2) = np.diff(first), _whole(h, first)
                rows = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int32)), pa.array(d1), pa.array(d2), out],
                    ["doc_id", "n", "d1", "d2", "grams"])
                yield rows.filter(pa.array(n >= min_words))

    return docs.mapInArrow(tidy(run), "doc_id long, n int, d1 long, d2 long, grams array<long>")


def _windows(h: np.ndarray, first: np.ndarray, wanted: list[np.ndarray], min_words: int, gram: int):
    """Text, first word and hash of all windows that contain a wanted gram."""
    lead = words.grams(h, gram)
    whole = words.grams(h, min_words)
    text, at = [], []
    for i, grams in enumerate(wanted):
        a, b = int(first[i]), int(first[i + 1])
        if b - a < min_words:
            continue
        found = np.flatnonzero(np.isin(lead[a:b - gram + 1], grams))
        open_ = np.zeros(b - a + 1, np.int64)
        np.add.at(open_, np.maximum(found - (min_words - gram), 0), 1)
        np.subtract.at(open_, found + 1, 1)
        starts = np.flatnonzero(np.cumsum(open_)[:b - a - min_words + 1] > 0)
        text.append(np.full(len(starts), i))
        at.append(starts)
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, at = np.concatenate(text), np.concatenate(at)
    return text, at, whole[first[text] + at]


def extended(docs: DataFrame, shared: DataFrame, min_words: int, gram: int) -> DataFrame:
    """doc_id, starts, windows: places and hashes of the windows around shared grams."""
    rows = docs.join(shared, "doc_id").select("doc_id", "text", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, first = _words(part, "text")
                wanted = [np.array(x.values.to_numpy(), np.int64).view(np.uint64) for x in part.column(2)]
                text, at, key = _windows(h, first, wanted, min_words, gram)
                cuts = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(key.view(np.int64)))], ["doc_id", "starts", "windows"])

    return rows.mapInArrow(tidy(run), "doc_id long, starts array<int>, windows array<long>")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys of two documents or more, with the first of them."""
    return (rows.groupBy(key).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
            .filter("first_doc < last_doc").select(key, "first_doc"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """Repeated spans: doc_id, start_word, end_word, n_words, removed.

    ``removed`` spans stand in an earlier document too; the others are the
    places of a document that later ones repeat. Words count from 0 and
    ``end_word`` is the first word after the span.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).na.drop()
    kept = cut(kept_suffixes(texts, min_words, gram))
    classes = kept.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    kept = rejoin(kept, classes, ["d1", "d2", "n"])
    copies = kept.filter("doc_id > rep").select("doc_id", "n").distinct()
    copied = kept.filter("doc_id = rep AND last > rep").select("doc_id", "n").distinct()

    heads = kept.filter("doc_id = rep").select("doc_id", F.explode("grams").alias("gram"))
    shared = (rejoin(heads, _shared(heads, "gram").select("gram"), "gram", "left_semi")
              .groupBy("doc_id").agg(F.collect_set("gram").alias("grams")))
    around = extended(texts, shared, min_words, gram)
    rows = around.select("doc_id", F.explode(F.arrays_zip("starts", "windows")).alias("x")).select(
        "doc_id", F.col("x.starts").alias("start"), F.col("x.windows").alias("key"))
    held = rejoin(rows, _shared(rows, "key"), "key")
    earlier = F.col("doc_id") > F.col("first_doc")
    per = held.groupBy("doc_id").agg(F.collect_set(F.when(earlier, F.col("start"))).alias("gone"),
                                     F.collect_set(F.when(~earlier, F.col("start"))).alias("first"))
    per = per.join(copied, "doc_id", "full").select("doc_id", "n", "gone", "first")

    def spans(starts: np.ndarray) -> list[tuple[int, int]]:
        if not len(starts):
            return []
        gap = np.flatnonzero(np.diff(starts) > min_words)
        begin, end = starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])]
        return list(zip(begin.tolist(), (end + min_words).tolist(), strict=True))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int, bool]] = []
            for i in range(b.num_rows):
                doc, n = b.column("doc_id")[i].as_py(), b.column("n")[i].as_py()
                gone, first = (np.sort(np.array(b.column(c)[i].as_py() or [], np.int64)) for c in ("gone", "first"))
                if n is not None:
                    # A copy follows, so every other window has its first place here.
                    first = np.setdiff1d(np.arange(n - min_words + 1), gone)
                out += [(doc, x, y, y - x, removed) for s, removed in ((gone, True), (first, False))
                        for x, y in spans(s)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, _SPAN_TYPES, strict=True)], _SPAN_NAMES)

    whole = copies.select("doc_id", F.lit(0).alias("start_word"), F.col("n").alias("end_word"),
                          F.col("n").alias("n_words"), F.lit(True).alias("removed"))
    return per.mapInArrow(tidy(join_up), "doc_id long, start_word int, end_word int, n_words int, "
                                   "removed boolean").unionByName(whole)


_SPAN_NAMES = ["doc_id", "start_word", "end_word", "n_words", "removed"]
_SPAN_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the ``removed`` spans cut out of the texts, all columns kept.

    A text that loses all its words goes; other white space stays as it is.
    """
    per = (spans.filter("removed").groupBy(F.col("doc_id").alias("_id"))
           .agg(F.collect_set(F.struct("start_word", "end_word")).alias("_cuts")))
    rows = docs.join(per, docs[id_col].cast("long") == per["_id"], "left").drop("_id")
    # Only texts that lose a span go to the worker.
    cut_text = F.udf(_cut_text, "string", useArrow=True)
    shorter = cut_text(F.when(F.col("_cuts").isNotNull(), F.col(text_col)), F.col("_cuts"))
    text = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(shorter)
    rows = rows.withColumn(text_col, text)
    return rows.filter(F.col("_cuts").isNull() | F.col(text_col).isNotNull()).drop("_cuts")


def _cut_text(text: str | None, cuts: list | None) -> str | None:
    """``text`` without the word spans; None if no word is left."""
    if text is None or cuts is None:
        return None
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = words.spans(data, np.array([0, len(raw)]))
    stay = np.ones(len(raw), bool)
    for a, b in cuts:
        stay[starts[a]:starts[b] if b < len(starts) else len(raw)] = False
    left = data[stay].tobytes()
    return left.decode() if left.strip(b" \t\n\x0b\x0c\r") else None
