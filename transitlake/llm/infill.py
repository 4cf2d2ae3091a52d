"""Fill-in-the-middle transformation with a learned rank index for the cuts.

Cuts are code point numbers, texts are UTF-8 bytes. ``RankIndex`` maps one to
the other for a whole batch of texts: the byte offsets at which characters
start are a rising function of their rank, which is fitted by straight
segments that err by at most ``ERROR`` bytes. A segment that errs more is
halved, so segments are long in plain ASCII and short where scripts change.
The error that is left at each boundary is kept in one byte. A cut is the
segment's prediction plus the kept error: exact, without decoding a text.

Forms, decided by four numbers from the hash of seed and id: ``plain`` (the
text), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle),
each part behind its mark. A text that holds a mark stays plain, so the marks
of an output are found without doubt and ``restore`` rebuilds the text from
output and form alone.

Defined cases: a null or empty text is plain with an empty output; a null id
hashes as an empty number, so such rows share their four numbers; rows that
repeat an id are cut alike; an empty table gives an empty result; other
columns pass only if they are named in ``keep``. Texts are cut whole; the
index reads ``SPAN`` bytes at a time and holds one byte a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from transitlake.llm import words
from transitlake.llm.common import pieces

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest error of a segment's prediction in bytes; errors are kept in one byte.
ERROR = 100
#: Ranks of a segment before any halving (a power of two).
SEGMENT = 4096
#: Bytes whose boundaries are fitted at a time.
SPAN = 1 << 20


class RankIndex:
    """Byte offset of the character of a given rank in a buffer of UTF-8 bytes.

    Rank ``total`` is the buffer's end. ``at`` holds the ranks of ``marks``
    (byte offsets of characters, in ascending order).
    """

    def __init__(self, data: np.ndarray, marks: np.ndarray):
        parts, errors, ranks, seen, n = [], [], [], 0, len(data)
        for start in range(0, n + 1, SPAN):
            end = min(start + SPAN, n)
            found = np.flatnonzero((data[start:end] & 0xC0) != 0x80) + start
            if end == n:
                found = np.append(found, n)
            inside = marks[(marks >= start) & ((marks < end) | (end == n))]
            ranks.append(seen + np.searchsorted(found, inside))
            segments, error = _fit(found)
            segments[0] += seen
            parts.append(segments)
            errors.append(error)
            seen += len(found)
            if end == n:
                break
        self.start, self.offset, self.rise, self.length = np.concatenate(parts, axis=1)
        self.error = np.concatenate(errors)
        self.at = np.concatenate(ranks)
        self.total = seen - 1

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Byte offset of each rank: prediction of its segment plus the kept error."""
        s = np.searchsorted(self.start, ranks, side="right") - 1
        predicted = self.offset[s] + (ranks - self.start[s]) * self.rise[s] // (self.length[s] - 1)
        return predicted + self.error[ranks]


def _fit(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (first rank, first offset, rise, ranks) and the error at each boundary."""
    n = len(found)
    if not n:
        return np.zeros((4, 0), np.int64), np.zeros(0, np.int8)
    pad = -n % SEGMENT
    # Ranks after the last one carry on with slope 1; none of them is asked for.
    offsets = np.concatenate([found, found[-1] + 1 + np.arange(pad)]).astype(np.int64)
    error = np.zeros(len(offsets), np.int8)
    first = np.arange(0, len(offsets), SEGMENT)
    length, out = SEGMENT, []
    while len(first):
        rows = offsets[first[:, None] + np.arange(length)] if length < SEGMENT else offsets.reshape(-1, SEGMENT)
        rise = rows[:, -1] - rows[:, 0]
        left = rows - rows[:, :1] - np.arange(length) * rise[:, None] // (length - 1)
        good = np.abs(left).max(axis=1) <= ERROR
        error[first[good][:, None] + np.arange(length)] = left[good]
        out.append(np.stack([first[good], rows[good, 0], rise[good], np.full(good.sum(), length)]))
        length //= 2
        first = np.concatenate([first[~good], first[~good] + length])
    segments = np.concatenate(out, axis=1)
    segments = segments[:, np.argsort(segments[0])]
    return segments[:, segments[0] < n], error[:n]


def _assemble(text: bytes, form: str, a: int, b: int, marks: tuple[bytes, bytes, bytes]) -> bytes:
    if form == "plain":
        return text
    p, s, m = marks
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


def _strings(values: list[bytes]) -> pa.Array:
    # A view, not a cast: bytes that are no valid UTF-8 pass unchanged.
    return pa.array(values, pa.binary()).view(pa.string())


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
              seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
              marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Id, kept columns, ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each row."""
    keep = keep or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(text, F.lit(m))
    form = (F.when((text == "") | marked | (h[2] % 100 >= 100 - plain_percent), "plain")
            .when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    rows = docs.select(F.col(id_col), *keep, form.alias("form"), h[0].alias("_h1"), h[1].alias("_h2"),
                       text.alias("_text"))
    head = [id_col, *keep]
    schema = StructType([docs.schema[c] for c in head] + [
        StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()), StructField("output", StringType())])
    raw = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                yield cut(part)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        column = {name: part.column(i) for i, name in enumerate(part.schema.names)}
        data, at = words.text_bytes(column["_text"])
        index = RankIndex(data, at)
        rank = index.at
        n = np.diff(rank)
        forms = column["form"].to_pylist()
        plain = np.array([f == "plain" for f in forms], bool)
        one, two = (column[h].to_numpy() % (n + 1) for h in ("_h1", "_h2"))
        first, last = np.minimum(one, two), np.maximum(one, two)
        a, b = (index.offsets(rank[:-1] + k) - at[:-1] for k in (first, last))
        output = [_assemble(data[at[i]:at[i + 1]].tobytes(), f, int(a[i]), int(b[i]), raw)
                  for i, f in enumerate(forms)]
        return pa.RecordBatch.from_arrays(
            [*(column[c] for c in head), pa.array(n), column["form"], pa.array(first, mask=plain),
             pa.array(last - first, mask=plain), _strings(output)], schema.names)

    return rows.mapInArrow(run, schema)


def restore(found: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text",
            marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``found`` with the text rebuilt from output and form alone."""
    p, s, m = marks
    out = F.col(output_col)

    def after(column, mark):
        return F.substring_index(column, mark, -1)

    def before(column, mark):
        return F.substring_index(column, mark, 1)

    middle = after(out, m)
    head = before(out, m)
    psm = F.concat(after(before(head, s), p), middle, after(head, s))
    spm = F.concat(after(head, p), middle, after(before(head, p), s))
    return found.withColumn(text_col, F.when(F.col(form_col) == "psm", psm)
                            .when(F.col(form_col) == "spm", spm).otherwise(out))
