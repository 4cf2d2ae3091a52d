"""Benchmark passages in training texts by an FM-index of each training shard.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in
lower case (A-Z only). A benchmark item's *windows* are its runs of ``SIZE``
consecutive words; a shorter item that has words is one window. A training
word inside an occurrence of a window is hit.

A task turns a batch of texts into shards of ``SHARD`` words. Words that no
benchmark item holds become gaps, since no window reaches across one, and runs
of benchmark words shorter than the shortest window are left out for the same
reason. Runs are laid out in chunks of ``CHUNK`` words that overlap by a window
less a word, so each occurrence lies whole in a chunk and suffix sorting is
bounded. All windows are searched backwards together in the shard's FM-index
(``fmindex``); occurrences are located from the sampled suffix places, and the
words they cover are merged into removal spans.

Nothing of the texts is shuffled. The windows are broadcast, at most
``MAX_WINDOWS`` pairs of window and item at a time: a larger benchmark is
searched in several passes over the texts, each adding to the spans and items
of the passes before. Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no words and no spans; an item without
words has no windows; items that share a window are all found; rows that
repeat an item id count as one item; the words of an item with a null id are
hit, but there is no id to list; documents with equal or null ids are judged
row by row; an empty table of either kind gives no spans; other columns pass
only in ``keep``. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from transitlake.llm import words
from transitlake.llm.common import cut, pieces
from transitlake.llm.fmindex import FmIndex

SIZE = 10
#: Symbols of a shard's index and words of a chunk.
SHARD = 1 << 20
CHUNK = 128
#: Pairs of window and item that are broadcast at a time (about 20 MB).
MAX_WINDOWS = 200_000
#: Occurrences that are located at a time.
LOCATE = 1 << 20
#: Bytes of text that a task works on at a time (one text at least).
PIECE = 8 << 20

SPANS = "array<struct<first:int,last:int,begin:int,end:int>>"
_SPAN_TYPE = pa.struct([(c, pa.int32()) for c in ("first", "last", "begin", "end")])

# Each byte as it is compared: lower case, and a space for what separates words.
_FOLD = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word; first word and first byte of every text."""
    data, at = words.text_bytes(column)
    data = _FOLD[data]
    starts, ends, first = words.spans(data, at)
    return starts, ends, words.hash_spans(data, starts, ends), first, at


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, end to end."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Ranges of entries whose sizes add up to about ``limit`` (one entry at least)."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield slice(at, end)
        at = end


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(item, words): the distinct windows of each item as word hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                _, _, h, first, _ = _words(part.column(1))
                n = np.diff(first)
                length = np.minimum(n, size)
                count = np.where(n > 0, n - length + 1, 0)
                item = np.repeat(np.arange(len(n)), count)
                start, length = first[item] + _runs(count), length[item]
                flat = h[np.repeat(start, length) + _runs(length)].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(item)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["item", "words"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item string, words array<long>").distinct()


class Phrases:
    """Windows as rows of word numbers, and the items that hold each."""

    def __init__(self, found: pa.Table):
        lists = found.column("words").combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        rows = np.zeros((len(length), int(length.max(initial=1))), np.int64)
        rows[np.repeat(np.arange(len(length)), length), _runs(length)] = number + 1
        self.rows, of = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        names = found.column("item").combine_chunks().dictionary_encode()
        self.names = names.dictionary.to_pylist()
        item = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        of = of.ravel()
        by = np.argsort(of, kind="stable")
        self.items = item[by]
        self.first = np.searchsorted(of[by], np.arange(len(self.rows) + 1))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each word hash, 0 if no window holds it."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def occurrences(self, number: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, word at which it starts) of every occurrence, shard by shard; some come twice."""
        if not len(self.rows):
            return
        least, most = int(self.lengths.min()), int(self.lengths.max())
        known = number > 0
        edge = np.zeros(len(number) + 1, bool)
        edge[first] = True
        before = np.append(False, known[:-1])
        begin = np.flatnonzero(known & (~before | edge[:-1]))
        after = np.append(known[1:], False)
        length = np.flatnonzero(known & (~after | edge[1:])) + 1 - begin
        begin, length = begin[length >= least], length[length >= least]
        chunks = -(-length // CHUNK)
        run = np.repeat(np.arange(len(begin)), chunks)
        ahead = CHUNK * _runs(chunks)
        begin, length = begin[run] + ahead, np.minimum(length[run] - ahead, CHUNK + most - 1)
        for s in _slices(length + 1, SHARD):
            yield from self._shard(number, begin[s], length[s])

    def _shard(self, number: np.ndarray, begin: np.ndarray, length: np.ndarray):
        offset = _runs(length + 1)
        size = np.repeat(length, length + 1)
        origin = np.repeat(begin, length + 1) + offset
        inside = offset < size
        symbols = np.where(inside, number[np.minimum(origin, len(number) - 1)], 0)
        # The shard's own alphabet; windows with a word it lacks are out.
        alphabet = np.unique(symbols)
        dense = np.zeros(len(self.vocabulary) + 1, np.int64)
        dense[alphabet] = np.arange(len(alphabet))
        index = FmIndex(dense[symbols], size - offset, offset)
        rows = dense[self.rows]
        able = np.flatnonzero(((rows > 0) | (self.rows == 0)).all(axis=1))
        which, low, high = index.search(rows[able], self.lengths[able])
        which, count = able[which], high - low
        for s in _slices(count, LOCATE):
            suffix = np.repeat(low[s], count[s]) + _runs(count[s])
            yield np.repeat(which[s], count[s]), origin[index.locate(suffix)]


def _search(part: pa.RecordBatch, phrases: Phrases, head: list[str], names: list[str]) -> pa.RecordBatch:
    column = {c: part.column(i) for i, c in enumerate(part.schema.names)}
    starts, ends, h, first, at = _words(column["_text"])
    n = np.diff(first)
    total = len(h)
    step = np.zeros(total + 1, np.int64)
    # What earlier passes found.
    text, got = _flat(column["spans"])
    np.add.at(step, first[text] + got["first"], 1)
    np.add.at(step, first[text] + got["last"], -1)
    pairs = [np.zeros(0, np.int64)]
    for window, word in phrases.occurrences(phrases.numbers(h), first):
        np.add.at(step, word, 1)
        np.add.at(step, word + phrases.lengths[window], -1)
        doc = np.searchsorted(first, word, side="right") - 1
        pairs.append(np.unique(doc * len(phrases.rows) + window))
    hit = np.cumsum(step[:-1]) > 0
    items = column["items"].to_pylist()
    doc, window = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(phrases.rows)))
    count = phrases.first[window + 1] - phrases.first[window]
    item = phrases.items[np.repeat(phrases.first[window], count) + _runs(count)]
    doc = np.repeat(doc, count)[item >= 0]
    doc, item = np.divmod(np.unique(doc * max(1, len(phrases.names)) + item[item >= 0]), max(1, len(phrases.names)))
    for d, own in zip(*_grouped(doc, item), strict=True):
        items[d] = sorted({*items[d], *(phrases.names[i] for i in own)})
    edge = np.zeros(total + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(hit & (~np.append(False, hit[:-1]) | edge[:-1])) if total else np.zeros(0, np.int64)
    end = np.flatnonzero(hit & (~np.append(hit[1:], False) | edge[1:])) if total else np.zeros(0, np.int64)
    doc = np.searchsorted(first, begin, side="right") - 1
    values = [begin - first[doc], end + 1 - first[doc], starts[begin] - at[doc], ends[end] - at[doc]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in values], fields=list(_SPAN_TYPE)))
    made = {"n_words": pa.array(n), "spans": spans, "items": pa.array(items, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([made[c] if c in made else column[c] for c in names], names)


def _grouped(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys (sorted already) and the values of each."""
    keys, at = np.unique(key, return_index=True)
    return keys, np.split(values, at[1:]) if len(keys) else []


def _flat(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each span, and the spans' fields."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    inner = lists.flatten()
    return row, {f.name: inner.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(inner.type)}


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         keep: list[str] | None = None, size: int = SIZE, item_col: str = "item_id", item_text_col: str = "text",
         max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Id, kept columns, ``n_words``, ``spans`` to remove and the ``items`` found in each text.

    A span holds its first and last word (exclusive) and its bytes in the text.
    """
    spark = docs.sparkSession
    head = [id_col, *(keep or [])]
    pairs = cut(windows(benchmark, item_col, item_text_col, size))
    groups = max(1, -(-pairs.count() // max_windows))
    rows = docs.select(*head, F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(groups))
    for g in range(groups):
        shared = spark.sparkContext.broadcast(Phrases(pairs.filter(part == g).toArrow()))
        schema = rows.schema if g < groups - 1 else StructType([f for f in rows.schema if f.name != "_text"])
        rows = rows.mapInArrow(_pass(shared, head, schema.names), schema)
        if g < groups - 1:
            rows = cut(rows)
            shared.unpersist()
    return rows


def _pass(shared, head: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                yield _search(part, shared.value, head, names)
    return run


def without(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with its spans cut out of the text (a column that ``find`` was told to keep)."""
    schema = found.schema
    where = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(where)
            texts = column.cast(pa.binary()).to_pylist()
            row, span = _flat(b.column(b.schema.get_field_index("spans")))
            for i, own in zip(*_grouped(row, np.arange(len(row))), strict=True):
                kept = zip([0, *span["end"][own]], [*span["begin"][own], len(texts[i])], strict=True)
                texts[i] = b"".join(texts[i][a:b] for a, b in kept)
            yield b.set_column(where, text_col, pa.array(texts, pa.binary()).view(pa.string()))

    return found.mapInArrow(run, schema)
