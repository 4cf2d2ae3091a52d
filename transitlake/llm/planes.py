"""Token ids of a corpus as bit- or byte-plane files.

Format (a Parquet dataset, one row per *chunk*; Spark's commit protocol makes
the files whole or absent on any shared store):

``part, chunk``          place of the chunk in ascending document order
``first``                ids of the same part before the chunk
``n_ids, n_docs``        what the chunk holds
``doc_ids, lengths``     its documents and their id counts, in order
``plane_sizes``          the chunk index: compressed bytes of every plane, in order
``planes``               the compressed planes end to end

A chunk holds whole documents, ``CHUNK_IDS`` ids or a little more; its id
stream is cut into blocks of ``BLOCK_IDS`` ids, the last one shorter. Each
block of little-endian 32-bit ids is transposed into 4 byte planes (or 32 bit
planes) and each plane compressed with zstandard; an all-zero plane has size
0. A reader can take any block from ``plane_sizes`` alone, and reading the
index columns does not touch the planes.

Ids come from the ``tokenizers`` library. Texts are cut into words where the
byte-level pre-tokeniser is sure to cut: before a space that a visible
character follows. The worker keeps the library's ids of words, which repeat a
lot. Of the words of a batch that it has not seen, those of ASCII letters are
one pre-token each; the others are put end to end and encoded in one call,
where a token that begins with a space begins a word. A file whose
pre-tokeniser, normaliser or added tokens could cut otherwise is refused. The
end id follows every document.

Defined cases: a null text is empty and gives the end id alone; a null
``doc_id`` comes first; rows with equal ids are ordered by a hash of the text;
an empty table gives an empty dataset with the full schema.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitlake.llm.common import pieces

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 17
LEVEL = 1
END_ID = 0
#: Words that a worker keeps (twice as many at most, and those of a batch).
WORDS = 400_000
#: A space as the byte-level vocabulary writes it.
SPACE = "\u0120"
#: Words that one library call encodes.
CALL_WORDS = 50_000
#: Bytes of text encoded at a time (one text at least).
PIECE = 4 << 20

SCHEMA = ("part int, chunk int, first long, n_ids long, n_docs int, doc_ids array<long>, "
          "lengths array<int>, plane_sizes array<int>, planes binary")

_VISIBLE = rb"[!-~\xc3-\xdf\xe4-\xf4]"
_CUT = re.compile(rb"(?= " + _VISIBLE + rb")")
_ODD_SPACE = re.compile(rb" (?!" + _VISIBLE + rb")")
_workers: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """The library's ids of texts, by way of words that are encoded once."""

    def __init__(self, path: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self._check()
        self.limit, self.young, self.old = words, {}, {}
        # Ids whose token begins with a space: in words end to end, the first of each word.
        self.begins = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.begins[i] = token.startswith(SPACE)

    def _check(self) -> None:
        """Raise unless this file cuts before every space that a visible character follows."""
        rules = json.loads(self.tok.to_str())
        pre = rules["pre_tokenizer"] or {}
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"not the byte-level pre-tokeniser that the cuts rely on: {pre}")
        if rules["normalizer"] is not None or rules["model"].get("dropout"):
            raise ValueError("a normaliser or dropout changes words by their context")
        for t in self.tok.get_added_tokens_decoder().values():
            if " " in t.content or t.lstrip or t.rstrip or t.single_word or t.content.encode().isalpha():
                raise ValueError(f"the added token {t.content!r} could be cut")

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        """Ids of words, each with the space before it.

        A word of ASCII letters is one pre-token and goes straight to the
        library's model; the others are put end to end and encoded in one call.
        """
        plain = [w for w in new if w.isalpha()]
        model, ids, ends = self.tok.model.tokenize, [], []
        for w in plain:
            ids += [t.id for t in model(SPACE + w.decode())]
            ends.append(len(ids))
        self._keep(plain, np.array(ids, "<u4"), ends)
        other = [w for w in new if not w.isalpha()]
        if other:
            text = (b" " + b" ".join(other)).decode()
            # The call that tracks no offsets takes two thirds of the time.
            found = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            self._keep(other, found, [*np.flatnonzero(self.begins[found])[1:].tolist(), len(found)])

    def _keep(self, names: list[bytes], ids: np.ndarray, ends: list[int]) -> None:
        raw, cuts = ids.tobytes(), zip([0, *ends[:-1]], ends, strict=True) if ends else []
        self.young.update(zip(names, (raw[4 * a:4 * b] for a, b in cuts), strict=True))

    def _known(self, used: list[bytes]) -> list[bytes]:
        """Ids of distinct words without spaces, each with the space before it."""
        missing = set(used) - self.young.keys()
        back = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in back)
        new = list(missing - back)
        for s in range(0, len(new), CALL_WORDS):
            self._learn(new[s:s + CALL_WORDS])
        out = list(map(self.young.__getitem__, used))
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out

    def _odd(self, text: bytes) -> np.ndarray:
        """Ids of a text with runs of white space, from its surely cut parts."""
        parts = [np.array(self._ids(p.decode()), "<u4") for p in _CUT.split(text) if p]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; a null text has none."""
        raw = texts.cast(pa.binary()).to_pylist()
        odd = np.array([t is not None and _ODD_SPACE.search(t) is not None for t in raw], bool)
        plain = iter(self._plain(pc.fill_null(texts.filter(pa.array(~odd)), "")))
        return [self._odd(t) if o else next(plain) for t, o in zip(raw, odd, strict=True)]

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts in which every space has a visible character behind it."""
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        flat = lists.flatten()
        # A text's first word has no space before it; the others go by their distinct forms.
        first = np.zeros(len(flat), bool)
        first[at[:-1]] = True
        heads = [np.array(self._ids(h), "<u4").tobytes() if h else b"" for h in flat.filter(pa.array(first)).to_pylist()]
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        names = self._known(rest.dictionary.cast(pa.binary()).to_pylist())
        which = np.empty(len(flat), np.int64)
        which[first] = np.arange(len(heads)) + len(names)
        which[~first] = rest.indices.to_numpy()
        size = np.fromiter(map(len, (*names, *heads)), np.int64, len(names) + len(heads)) // 4
        pool = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)),
                                        pa.array(np.frombuffer(b"".join([*names, *heads]), "<u4")))
        taken = pool.take(pa.array(which))
        ids, cuts = taken.flatten().to_numpy(), taken.offsets.to_numpy()[at]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a byte-level BPE file."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def pack(ids: np.ndarray, kind: str, level: int) -> tuple[list[int], bytes]:
    """Plane sizes and compressed planes of one chunk."""
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    sizes, out = [], []
    for s in range(0, len(ids), BLOCK_IDS):
        block = ids[s:s + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, 4)
        rows = np.ascontiguousarray(block.T)
        if kind == "bit":
            rows = np.packbits(np.unpackbits(block, axis=1, bitorder="little").T, axis=1)
        for row in rows:
            z = squeeze(row.tobytes()) if row.any() else b""
            sizes.append(len(z))
            out.append(z)
    return sizes, b"".join(out)


def unpack(n_ids: int, sizes: list[int], planes: bytes) -> np.ndarray:
    """Ids of a chunk; the number of planes per block tells byte from bit planes."""
    import zstandard
    open_ = zstandard.ZstdDecompressor().decompress
    blocks = -(-n_ids // BLOCK_IDS)
    per = len(sizes) // blocks if blocks else 4
    out, at, k = np.empty(n_ids, "<u4"), 0, 0
    for s in range(0, n_ids, BLOCK_IDS):
        n = min(BLOCK_IDS, n_ids - s)
        width = n if per == 4 else -(-n // 8)
        rows = np.zeros((per, width), np.uint8)
        for p in range(per):
            if sizes[k]:
                rows[p] = np.frombuffer(open_(planes[at:at + sizes[k]]), np.uint8)
            at += sizes[k]
            k += 1
        if per == 32:
            rows = np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1, bitorder="little").T
        out[s:s + n] = np.ascontiguousarray(rows.T).view("<u4").ravel()
    return out


def chunks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           kind: str = "byte", level: int = LEVEL) -> DataFrame:
    """Chunk rows of all documents in ascending id order.

    One shuffle: texts range-partitioned by id (texts are smaller in a shuffle
    than their ids); encoding, transposing and compressing run on the sorted
    partitions and hold one chunk at a time.
    """
    if kind not in ("byte", "bit"):
        raise ValueError(f"kind must be byte or bit, not {kind}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4")
        state = {"chunk": 0, "first": 0}
        ids, docs_in, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(ids)
            sizes, planes = pack(stream, kind, level)
            row = [part, state["chunk"], state["first"], len(stream), len(docs_in), list(docs_in),
                   list(lengths), sizes, planes]
            state["chunk"] += 1
            state["first"] += len(stream)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for part_ in pieces(batch, "text", PIECE):
                for name, found in zip(part_.column(0).to_pylist(), enc.encode(part_.column(1)), strict=True):
                    ids += [found, end]
                    docs_in.append(name)
                    lengths.append(len(found) + 1)
                    held += lengths[-1]
                    if held >= CHUNK_IDS:
                        yield flush()
                        ids, docs_in, lengths, held = [], [], [], 0
        if docs_in:
            yield flush()

    return rows.select("doc_id", "text").mapInArrow(run, SCHEMA)


_NAMES = ["part", "chunk", "first", "n_ids", "n_docs", "doc_ids", "lengths", "plane_sizes", "planes"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
          pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Encode ``docs`` and write the plane files to ``path``."""
    # The planes are compressed already.
    chunks(docs, tokenizer, **options).write.option("compression", "none").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Chunk index with ``start``, the ids of the whole dataset before the chunk."""
    rows = spark.read.parquet(path).select("part", "chunk", "first", "n_ids", "n_docs", "plane_sizes")
    return _with_start(rows, rows)


def _with_start(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``start`` from the parts' totals: one row per partition of the write, broadcast."""
    per = ids.groupBy("part").agg(F.sum("n_ids").alias("held"))
    before = per.select("part", F.coalesce(F.sum("held").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("first"))
            .drop("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, ids (little-endian 32-bit integers)."""
    rows = spark.read.parquet(path)
    data = _with_start(rows.select("part", "first", "n_ids", "doc_ids", "lengths", "plane_sizes", "planes"),
                       rows.select("part", "n_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                raw = unpack(row["n_ids"].as_py(), row["plane_sizes"].as_py(), row["planes"].as_py()).tobytes()
                ends = np.cumsum(row["lengths"].values.to_numpy())
                starts_ = np.concatenate([[0], ends[:-1]])
                names = row["doc_ids"].values
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(starts_ + row["start"].as_py(), pa.int64()),
                     pa.array([raw[4 * a:4 * b] for a, b in zip(starts_, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"])

    return data.mapInArrow(run, "doc_id long, start long, ids binary")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of ``read``."""
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
