"""Near-duplicate groups by MinHash, banding and connected components.

1. *Sketch* (a map over the texts): the set of word shingles as 64-bit hashes,
   a 128-bit digest of the set, and ``BANDS x ROWS`` minima of universal hash
   functions, one key per band. A pair at similarity 0.8 shares no band with
   probability (1 - 0.8^7)^50, below 1e-5, and seven rows keep pairs that only
   share a passage from meeting.
2. *Copies*: documents with equal digests form a class; its smallest id stands
   for it from here on, so a group of copies costs one row per band.
3. *Buckets*: (band key, class) rows; buckets of one class go.
4. *Stars*: every member of a bucket is compared with the bucket's smallest
   member, signatures first and then the full sets. This is linear, settles
   nearly all buckets and collapses groups of near copies.
5. *Rest*: buckets that still hold several components. Comparing their pairs
   as rows would be quadratic output, so they are compared inside tasks: each
   class belongs to its largest open bucket (its home), homes that meet in a
   bucket form units of work, large homes are dealt into chunks and units are
   pairs of chunks. A unit compares the full sets of all its pairs of different
   components exactly and emits a spanning set of the links between components.
   So every candidate pair has been compared or is linked otherwise, no pair is
   compared twice in the same pair of homes, and the output stays linear. The
   work is quadratic only in a bucket whose members do not link to one another.

Full sets are made only for classes that share a bucket, in a second pass over
their texts, and never carried through the band shuffle.

Defined cases: a text with fewer words than a shingle is one shingle, its
whole sequence; a text without words (or null) has an empty set, links with
nothing and is kept; a row with a null id links with nothing, has a null
component and is kept; rows that repeat an id and a text are in one class and
both kept if the id is the smallest; rows of one id with different texts are
placed by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm import words
from transitlake.llm.common import cut, pieces, rejoin, tidy
from transitlake.llm.components import components

BANDS, ROWS = 50, 7
#: Least share of equal minima that a pair needs before its sets are compared:
#: six standard deviations below the share expected at the threshold.
SIGMAS = 6
#: Classes of a chunk of a home.
CHUNK = 256
#: Shingles whose columns are multiplied at a time.
_COLUMNS = 4096

_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_ROW = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text end to end, and their offsets."""
    n = len(offsets) - 1
    starts, ends, first = words.spans(data, offsets)
    h = words.hash_spans(data, starts, ends, lower=True)
    gram = words.grams(h, size)
    at = np.flatnonzero(words.inside(first, size, len(h)))
    owner = np.repeat(np.arange(n), np.diff(first))[at]
    key = gram[at]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    if len(short):
        whole = [words.grams(h[first[i]:first[i + 1]], int(first[i + 1] - first[i]))[0] for i in short]
        owner, key = np.concatenate([owner, short]), np.concatenate([key, np.array(whole, np.uint64)])
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    owner, key = owner[new], key[new]
    return key, np.searchsorted(owner, np.arange(n + 1))


def minima(keys: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set."""
    x = (keys >> np.uint64(32)).astype(np.uint32)
    out = None
    for s in range(0, len(x), 1024):
        low = (_A * x[s:s + 1024] + _B).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def _sketch(data: np.ndarray, offsets: np.ndarray, size: int):
    key, at = shingle_sets(data, offsets, size)
    n = len(at) - 1
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(words.mix(key ^ np.uint64(salt)), dtype=np.uint64)])
            for salt in (0x51ED270B, 0xA2C2A3D1)]
    digest = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
    full = np.flatnonzero(np.diff(at))
    low = np.array([minima(key[at[i]:at[i + 1]]) for i in full], np.uint32).reshape(-1, BANDS, ROWS)
    band = (low.astype(np.uint64) * _ROW).sum(axis=2, dtype=np.uint64)
    band = words.mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    sizes = np.zeros(n + 1, np.int32)
    sizes[full + 1] = BANDS
    bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(band.ravel()))
    return np.diff(at), digest, bands


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest), bands of every text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n, (d1, d2), bands = _sketch(*words.text_bytes(part.column(1)), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), bands],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """v, n, signature (16 bits of each minimum) and the sorted set of the ids in ``wanted``."""
    rows = (docs.select(F.col(id_col).cast("long").alias("v"), F.col(text_col).alias("text"))
            .join(wanted, "v", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                key, at = shingle_sets(*words.text_bytes(part.column(1)), size)
                sets = [key[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                sigs = [(m := minima(k), ((m >> np.uint32(16)) ^ m).astype(np.uint16).tobytes())[1]
                        if len(k) else b"" for k in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(sigs, pa.binary()),
                     pa.array([k.tobytes() for k in sets], pa.binary())], ["v", "n", "sig", "shingles"])

    return rows.mapInArrow(tidy(run), "v long, n long, sig binary, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of similarity ``percent`` or more: signatures first, then full sets."""
    p = percent / 100
    least = p - SIGMAS * (p * (1 - p) / (BANDS * ROWS)) ** 0.5

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(c) for c in b.schema.names}
            left, right = ([np.frombuffer(x.as_buffer(), np.uint16) for x in col[c]] for c in ("sa", "sb"))
            ok = np.array([np.mean(x == y) >= least if len(x) and len(y) else False
                           for x, y in zip(left, right, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(ok))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(c)] for c in ("ka", "kb"))
            ok = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["hi", "lo"]).filter(
                pa.array(ok, pa.bool_()))

    # The smaller id of a pair is the one that can be a hub; the other end is
    # fetched first so that a pair's rows spread before they meet the hub.
    sig = sets.select("v", "n", "sig")
    rows = pairs.join(sig.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    rows = rows.join(sig.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    rows = rows.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    rows = rows.select("a", "b", "sa", "sb").mapInArrow(tidy(alike), "a long, b long")
    keys = sets.select("v", "shingles")
    rows = rows.join(keys.select(F.col("v").alias("b"), F.col("shingles").alias("kb")), "b")
    rows = rows.join(keys.select(F.col("v").alias("a"), F.col("shingles").alias("ka")), "a")
    return rows.select("a", "b", "ka", "kb").mapInArrow(tidy(linked), "hi long, lo long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the left sets with the right ones."""
    flat = np.concatenate([*left, *right])
    key, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Only shingles of two sets or more can meet.
    shared = np.full(len(key), -1)
    shared[count > 1] = np.arange((count > 1).sum())
    column = shared[column]
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for s in range(0, int(shared.max(initial=-1)) + 1, _COLUMNS):
        a, b = np.searchsorted(column, [s, s + _COLUMNS])
        held = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        held[row[a:b], column[a:b] - s] = 1
        out += held[:len(left)] @ held[len(left):].T
    return out.astype(np.int64)


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what earlier ones have not joined."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in links.tolist():
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((max(x, y), min(x, y)))
    return out


def _unit_of_work(percent: int):
    def run(t: pa.Table) -> pa.Table:
        side, comp = t.column("side").to_numpy(), t.column("c").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        both = _overlaps([sets[i] for i in left], [sets[i] for i in right])
        size = np.array([len(x) for x in sets])
        ok = 100 * both >= percent * (size[left][:, None] + size[right] - both)
        ok &= comp[left][:, None] != comp[right]
        i, j = np.nonzero(ok)
        found = _spanning(np.unique(np.stack([comp[left][i], comp[right][j]], axis=1), axis=0))
        return pa.table({"hi": pa.array([x for x, _ in found], pa.int64()),
                         "lo": pa.array([y for _, y in found], pa.int64())})
    return run


def _hosted(rows: DataFrame, home: DataFrame) -> DataFrame:
    """Homes smaller than a chunk moved into the largest home they meet.

    Else each member of a large home would be sent to every small home it
    meets. Any labels are right: pairs of homes are found from the buckets.
    """
    sizes = home.groupBy("home").agg(F.count("*").alias("n"))
    met = rows.select("key", "v").join(home.select("v", "home"), "v").select("key", "home").distinct()
    met = met.join(sizes, "home")
    largest = met.groupBy("key").agg(F.max(F.struct("n", "home")).alias("host"))
    host = rejoin(met, largest, "key").groupBy("home", "n").agg(F.max("host").alias("host"))
    moved = host.filter((F.col("n") < CHUNK) & (F.col("host.n") > F.col("n"))).select("home", F.col("host.home").alias("to"))
    return home.join(moved, "home", "left").select("v", "c", F.coalesce("to", "home").alias("home"))


def _rest(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket, as edges of component ids."""
    rows = members.join(comp, "v", "left").select("key", "v", F.coalesce("comp", "v").alias("c"))
    open_ = (rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size"))
             .filter("x < y").select("key", "size"))
    rows = cut(rejoin(rows, open_, "key"))
    first = rows.groupBy("v", "c").agg(F.max(F.struct("size", "key"))["key"].alias("home"))
    home = cut(_hosted(rows, cut(first)))
    chunks = home.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k"))
    met = rows.select("key", "v").join(home.select("v", "home"), "v").select("key", "home").distinct()
    pairs = (met.select("key", F.col("home").alias("h1")).join(met.select("key", F.col("home").alias("h2")), "key")
             .filter("h1 <= h2").select("h1", "h2").distinct()
             .join(chunks.select(F.col("home").alias("h1"), F.col("k").alias("k1")), "h1")
             .join(chunks.select(F.col("home").alias("h2"), F.col("k").alias("k2")), "h2"))
    pairs = cut(pairs)
    own = F.pmod(F.xxhash64("v"), F.col("k")).cast("int")
    placed = home.join(chunks, "home").select("v", "c", "home", own.alias("o"))

    def units(at: str, other: str, side: int) -> DataFrame:
        """Rows of the homes on one side of a pair, once for each chunk of the other side."""
        chunk = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("p")
        x = placed.withColumnRenamed("home", at).join(pairs, at).select("h1", "h2", "v", "c", "o", chunk)
        same, first = F.col("h1") == F.col("h2"), F.col("o") <= F.col("p")
        one = F.when(same, F.least("o", "p")).otherwise(F.col("o") if side == 0 else F.col("p"))
        two = F.when(same, F.greatest("o", "p")).otherwise(F.col("p") if side == 0 else F.col("o"))
        rows_ = x if side == 0 else x.filter(~same)
        return rows_.select("h1", "h2", one.alias("c1"), two.alias("c2"), "v", "c",
                            F.when(same, F.when(first, 0).otherwise(1)).otherwise(side).alias("side"))

    work = units("h1", "k2", 0).unionByName(units("h2", "k1", 1)).join(sets.select("v", "shingles"), "v")
    return work.groupBy("h1", "h2", "c1", "c2").applyInArrow(_unit_of_work(percent), "hi long, lo long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
           percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    ``size`` words make a shingle; documents whose sets have a Jaccard
    similarity of ``percent`` / 100 or more are linked.
    """
    sk = cut(sketch(docs, id_col, text_col, size))
    some = sk.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    placed = cut(rejoin(some.drop("bands"), classes, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "rep"))

    reps = placed.filter("doc_id = rep").select("doc_id").distinct()
    rows = some.join(reps, "doc_id", "left_semi").select(F.explode("bands").alias("key"), F.col("doc_id").alias("v"))
    shared = rows.groupBy("key").agg(F.min("v").alias("x"), F.max("v").alias("y")).filter("x < y").select("key")
    members = cut(rejoin(rows, shared, "key", "left_semi").distinct())
    sets = cut(full_sets(docs, id_col, text_col, size, members.select("v").distinct()))

    centre = members.groupBy("key").agg(F.min("v").alias("a"))
    pairs = rejoin(members, centre, "key").filter("v <> a").select("a", F.col("v").alias("b")).distinct()
    comp = components(_confirm(pairs, sets, percent))
    more = cut(_rest(members, comp, sets, percent))
    if not more.isEmpty():
        comp = components(comp.select(F.col("v").alias("hi"), F.col("comp").alias("lo")).unionByName(more))

    root = F.coalesce(F.col("comp"), F.col("rep"))
    out = (placed.join(comp.withColumnRenamed("v", "rep"), "rep", "left")
           .select("doc_id", "n_shingles", root.alias("component_id")))
    alone = sk.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles",
                                                                  F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
