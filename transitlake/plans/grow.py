"""Forests grown over partitioned rows: regression, and classification into two classes.

``pyspark.ml`` shuffles a table of every feature's bins for every node of every
tree once a partition, rows or none, so a deep forest moves nodes x partitions.
Here rows move instead, as in PLANET:

1. *Bins*: at most ``maxBins`` a feature, by the rule of ``pyspark.ml`` over as
   many sampled rows; a row is a byte a feature, kept in packed blocks.
2. *Upper levels*: nodes of more than ``NODE_ROWS`` rows are split level by
   level. Tasks add up their blocks' bins, a group per node adds up the tasks'
   and picks the split. Only splits reach the driver, and a pass takes no more
   nodes than fit ``TABLE_BYTES``.
3. *Lower levels*: each row goes once to its node of each tree that drew it, and
   a group per (tree, node) grows what is below, a level at a time. No more trees
   are dealt at a time than ``DEAL_BYTES`` hold; their shuffle goes before the next.

Draws are Poisson(1) by a hash of row key and tree, so a forest does not rest on
the layout of its rows (rows with one key are drawn together). Splits, stops and
the saved form are those of ``RandomForestRegressor``. Of labels 0 and 1 the Gini
impurity is twice the variance, so a ``RandomForestClassifier`` is grown the same
way, over the features that a hash chooses for each node; leaves of one parent that
vote alike are then one leaf, as there.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.ml.util import MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.session import checkpoint_dir, stored

#: Drawn rows of a node that one group grows by itself.
NODE_ROWS = 3_000_000
#: Bytes of bins that a task adds up at a time.
TABLE_BYTES = 64 << 20
BLOCK_ROWS = 1 << 16
#: Bytes of rows, before they are compressed, that lie in a shuffle at a time (one tree's at least).
DEAL_BYTES = 4 << 30
#: Levels after which a group lays its rows out by node again, so that a node's rows stay in the processor's cache.
ORDER_LEVELS = 4
#: Rows that place the bins, as in pyspark.ml.
BIN_ROWS = 10_000

_DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]),
                         (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Splits of one feature: between all its values, or ``bins`` of about equal counts."""
    value, count = np.unique(values, return_counts=True)
    between = (value[1:] + value[:-1]) / 2
    if len(between) < bins:
        return between
    stride, below = len(values) / bins, np.cumsum(count)
    out, target = [], stride
    for i in range(len(between)):
        if abs(below[i] - target) < abs(below[i + 1] - target):
            out.append(between[i])
            target += stride
    return np.array(out)


def _mixed(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    x = keys ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often ``tree`` draws each row."""
    return _DRAWS[_mixed(keys, tree, seed) >> np.uint64(48)]


def subset_size(estimator, width: int) -> int:
    """Features that a node may split on, by the estimator's strategy."""
    strategy = estimator.getFeatureSubsetStrategy()
    sizes = {"all": width, "sqrt": math.ceil(math.sqrt(width))}
    if strategy not in sizes:
        raise ValueError(f"featureSubsetStrategy is one of {sorted(sizes)}, not {strategy!r}")
    return sizes[strategy]


def chosen(paths: np.ndarray, tree: int, seed: int, width: int, many: int) -> np.ndarray:
    """Which of ``width`` features each node may split on (nodes x features). A node is known by its way from
    the root, which is 1: the children of p are 2p and 2p + 1."""
    if many >= width:
        return np.ones((len(paths), width), bool)
    keys = np.asarray(paths).astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93) + np.arange(width, dtype=np.uint64)
    out = np.zeros((len(paths), width), bool)
    np.put_along_axis(out, np.argsort(_mixed(keys, tree, seed), axis=1, kind="stable")[:, :many], True, axis=1)
    return out


def blocks(rows: DataFrame, splits: list[np.ndarray]) -> DataFrame:
    """Rows (key, y, a column a feature) as packed blocks: key, y, and a byte a feature, feature by feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block():
            t = pa.Table.from_batches(held)
            codes = np.stack([np.searchsorted(s, t.column(2 + f).to_numpy()).astype(np.uint8)
                              for f, s in enumerate(splits)])
            one = [t.column(0).to_numpy().tobytes(), t.column(1).to_numpy().tobytes(), codes.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in one], ["key", "y", "codes"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return rows.mapInArrow(run, "key binary, y binary, codes binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for key, y, codes in zip(*(b.column(c) for c in ("key", "y", "codes")), strict=True):
            keys = np.frombuffer(key.as_buffer(), np.uint64)
            yield (keys, np.frombuffer(y.as_buffer(), np.float64),
                   np.frombuffer(codes.as_buffer(), np.uint8).reshape(-1, len(keys)))


def tables(codes: np.ndarray, node: np.ndarray, nodes: int, w: np.ndarray, wy: np.ndarray, widths: list[int],
           rows: np.ndarray | None = None, may: np.ndarray | None = None):
    """(weights, sums of y) of each node's bins, feature by feature; ``rows`` are those of ``codes`` meant (default: all).

    ``may`` tells which features a node wants (nodes x features; default: all). A feature's tables are then those of
    the nodes that want it, which are told besides; the rows of a node have to lie together, node after node.
    """
    at = np.empty(len(node), np.intp)
    base = {width: node * width for width in set(widths)} if may is None else {}
    scale = 2.0 ** math.ceil(math.log2(2 * float(np.abs(wy).sum()) + 2))
    # Counts and sums of whole numbers share one double where both fit exactly.
    both = (w * scale + wy) if float(w.sum()) * scale < 2.0**52 and (wy == np.rint(wy)).all() else None
    def binned(size, *values):
        if both is None:
            return np.bincount(at, values[0], size), np.bincount(at, values[1], size)
        sums = np.bincount(at, values[0], size)
        n = np.rint(sums / scale)
        return n, sums - n * scale

    values = (w, wy) if both is None else (both,)
    if may is not None:
        held = np.bincount(node, minlength=nodes)
        first = np.cumsum(held) - held
    for f, (c, width) in enumerate(zip(codes, widths, strict=True)):
        if may is None:
            np.add(base[width], c if rows is None else c.take(rows), out=at)
            yield tuple(x.reshape(nodes, width) for x in binned(nodes * width, *values))
            continue
        which = np.flatnonzero(may[:, f])
        many = held[which]
        # The rows of these nodes, one node after the other.
        mine = _ranges(first[which], many)
        at = np.repeat(np.arange(len(which)) * width, many) + c.take(mine if rows is None else rows[mine])
        yield (*(x.reshape(len(which), width) for x in binned(len(which) * width, *(v[mine] for v in values))), which)


def _from_parents(parents: list, codes: np.ndarray, held: np.ndarray, can: np.ndarray, w: np.ndarray, wy: np.ndarray,
                  widths: list[int], rows: np.ndarray):
    """``tables`` of the nodes ``can``: the child of fewer rows is added up, the other is what its parent has besides.

    ``held`` is the number of rows of each node, which lie together.
    """
    both = held.reshape(-1, 2)
    small = 2 * np.arange(len(both)) + (both[:, 1] < both[:, 0])
    pairs = np.flatnonzero(can.reshape(-1, 2).any(axis=1))
    mine = _ranges((np.cumsum(held) - held)[small[pairs]], held[small[pairs]])
    node = np.repeat(np.arange(len(pairs)), held[small[pairs]])
    which = np.flatnonzero(can)
    pair = which // 2
    at, large = np.searchsorted(pairs, pair), np.flatnonzero(small[pair] != which)
    counted = tables(codes, node, len(pairs), w[mine], wy[mine], widths, rows[mine])
    for one, whole in zip(counted, parents, strict=True):
        out = [x[at] for x in one]
        for x, y in zip(out, whole, strict=True):
            x[large] = y[pair[large]] - x[large]
        yield tuple(out)


def best_splits(stats: np.ndarray, features: Iterator[tuple[np.ndarray, np.ndarray]], least: int, info: float):
    """Feature (-1: none), bin and gain of each node's best split; ``stats`` are its n, sum, sum of squares.

    ``features`` are their tables, of all nodes or of those told besides.
    """
    feature, bin_ = np.full(stats.shape[1], -1), np.zeros(stats.shape[1], np.int64)
    gain = np.maximum(1e-12 * stats[2] / np.maximum(stats[0], 1), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        for f, (hn, hs, *which) in enumerate(features):
            which = which[0] if which else np.arange(len(feature))
            n, s = stats[0][which], stats[1][which]
            ln, ls = hn.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
            rn, rs = n[:, None] - ln, s[:, None] - ls
            g = np.where((ln >= least) & (rn >= least), ls * ls / ln + rs * rs / rn, -np.inf)
            at = g.argmax(axis=1)
            g = (g[np.arange(len(n)), at] - s * s / n) / n
            better = (g > gain[which]) & (g >= info)
            mine = which[better]
            feature[mine], bin_[mine], gain[mine] = f, at[better], g[better]
    return feature, bin_, np.where(feature >= 0, gain, -1.0)


def _sums(node: np.ndarray, nodes: int, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(node, v, nodes) for v in (w, w * y, w * y * y)])


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many`` numbers from each ``first`` on, one range after the other."""
    return np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)


def grown(codes: np.ndarray, y: np.ndarray, w: np.ndarray, levels: int, bins: int, least: int, info: float,
          many: int | None = None, tree: int = 0, seed: int = 0, path: int = 1) -> pd.DataFrame:
    """Nodes of the tree over these rows, level after level: n, s, q, feature, bin, gain, left.

    A node splits on ``many`` of the features (default: all), chosen by its way from the root, that of the first being ``path``.
    """
    paths = np.array([path])
    out, made = [], 1
    # Rows of a node lie together, in their first order; ``held`` counts them.
    rows, held = np.arange(len(y)), np.array([len(y)])
    w = w.astype(np.float64)
    wy, flat = w * y, codes.ravel()
    wyy = wy * y
    # A feature has no more bins than codes; sums of whole numbers may be taken from one another exactly.
    widths = [min(bins, max(2, int(c.max()) + 1)) for c in codes]
    exact, parents = bool((y == np.rint(y)).all() and np.abs(wy).sum() < 2.0**52), None
    some = many is not None and many < len(codes)
    for level in range(levels + 1):
        nodes, first = len(held), np.cumsum(held) - held
        w_, wy_ = w.take(rows), wy.take(rows)
        stats = np.stack([np.add.reduceat(v, first) for v in (w_, wy_, wyy.take(rows))])
        feature, bin_, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, -1.0)
        # A node of fewer rows has no split that leaves enough on both sides.
        can = (stats[0] >= 2 * least) & (level < levels)
        kept = [] if exact and not some and 16 * int(can.sum()) * sum(widths) <= TABLE_BYTES else None
        if can.any():
            if parents is None:
                mine = slice(None) if can.all() else _ranges(first[can], held[can])
                node = np.repeat(np.arange(int(can.sum())), held[can])
                may = chosen(paths[can], tree, seed, len(codes), many) if some else None
                found = tables(codes, node, int(can.sum()), w_[mine], wy_[mine], widths, rows[mine], may)
            else:
                found = _from_parents(parents, codes, held, can, w_, wy_, widths, rows)
            if kept is not None:
                found = (kept.append(t) or t for t in found)
            feature[can], bin_[can], gain[can] = best_splits(stats[:, can], found, least, info)
        split = feature >= 0
        left = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
        out.append(np.stack([*stats, feature, bin_, gain, left]))
        made += 2 * int(split.sum())
        if not split.any():
            break
        parents = None if kept is None else [tuple(x[split[can]] for x in t) for t in kept]
        paths = (2 * paths[split][:, None] + np.arange(2)).ravel()
        if not split.all():
            rows, first, held = rows[_ranges(first[split], held[split])], None, held[split]
        right = flat.take(np.repeat(feature[split] * codes.shape[1], held) + rows) > np.repeat(bin_[split].astype(np.uint8), held)
        node = np.repeat(np.arange(0, 2 * len(held), 2, dtype=np.uint16 if len(held) < 1 << 15 else np.intp), held) + right
        rows, held = rows.take(np.argsort(node, kind="stable")), np.bincount(node, minlength=2 * len(held))
        if level % ORDER_LEVELS == ORDER_LEVELS - 1:
            codes = codes.take(rows, axis=1)
            flat, rows, w, wy, wyy = codes.ravel(), np.arange(len(rows)), *(v.take(rows) for v in (w, wy, wyy))
    return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["n", "s", "q", "feature", "bin", "gain", "left"])


def _places(tree: dict[str, list], codes: np.ndarray) -> np.ndarray:
    """The node of the upper tree that each row has come to."""
    feature, bin_, left = (np.array(tree[c]) for c in ("feature", "bin", "left"))
    at = np.zeros(codes.shape[1], np.intp)
    while (moves := np.flatnonzero(left[at] >= 0)).size:
        a = at[moves]
        at[moves] = left[a] + (codes[feature[a], moves] > bin_[a])
    return at


def _level(packed: DataFrame, trees: list[dict], wide: dict[int, list[int]], width: int, bins: int, seed: int,
           least: int, info: float, many: int) -> list:
    """Split of every node in ``wide`` (tree -> nodes) after one pass over the blocks."""
    shared = packed.sparkSession.sparkContext.broadcast((trees, wide))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wide = shared.value
        total = {t: np.zeros((len(ns), 3 + 2 * width * bins)) for t, ns in wide.items()}
        for keys, y, codes in _unpacked(batches):
            for t, ns in wide.items():
                w = drawn(keys, t, seed)
                slot = np.full(len(trees[t]["left"]), -1)
                slot[ns] = np.arange(len(ns))
                node = slot[_places(trees[t], codes)]
                mine = np.flatnonzero((w > 0) & (node >= 0))
                may = None
                if many < width:
                    mine = mine[np.argsort(node[mine], kind="stable")]
                    may = chosen([trees[t]["path"][i] for i in ns], t, seed, width, many)
                node, w_, y_ = node[mine], w[mine].astype(np.float64), y[mine]
                total[t][:, :3] += _sums(node, len(ns), w_, y_).T
                found = tables(codes, node, len(ns), w_, w_ * y_, [bins] * width, mine, may)
                for f, (n, s, *which) in enumerate(found):
                    at, which = 3 + 2 * f * bins, which[0] if which else slice(None)
                    total[t][which, at:at + bins] += n
                    total[t][which, at + bins:at + 2 * bins] += s
        for t, ns in wide.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(ns), pa.int32()), pa.array(ns, pa.int32()),
                 pa.array([row.tobytes() for row in total[t]], pa.binary())], ["tree", "node", "sums"])

    def choose(key: tuple, t: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("sums"))
        each = sums[3:].reshape(width, 2, 1, bins)
        feature, bin_, gain = best_splits(sums[:3, None], ((n, s) for n, s in each), least, info)
        below = float(each[feature[0], 0, 0, :bin_[0] + 1].sum())
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "n": [sums[0]], "s": [sums[1]], "q": [sums[2]],
                         "feature": pa.array(feature), "bin": pa.array(bin_), "gain": pa.array(gain), "below": [below]})

    found = (packed.mapInArrow(add, "tree int, node int, sums binary").groupBy("tree", "node").applyInArrow(
        choose, "tree int, node int, n double, s double, q double, feature long, bin long, gain double, below double"))
    rows = found.collect()
    shared.unpersist()
    return rows


def _upper(packed: DataFrame, rows: int, est, width: int, bins: int, seed: int, info: float) -> list[dict]:
    """Every tree as far as its nodes hold more than ``NODE_ROWS`` rows; the others are marked ``open``."""
    columns = ("n", "s", "q", "feature", "bin", "gain", "left", "depth", "open", "path")
    trees = [{c: [v] for c, v in zip(columns, (float(rows), 0.0, 0.0, -1, 0, -1.0, -1, 0, True, 1), strict=True)}
             for _ in range(est.getNumTrees())]
    many = subset_size(est, width)
    a_pass = max(1, TABLE_BYTES // (8 * (3 + 2 * width * bins)))

    def large(tree: dict, i: int) -> bool:
        return tree["open"][i] and tree["n"][i] > NODE_ROWS and tree["depth"][i] < est.getMaxDepth()

    todo = [(t, i) for t, tree in enumerate(trees) for i in range(1) if large(tree, i)]
    while todo:
        next_ = []
        for k in range(0, len(todo), a_pass):
            wide: dict[int, list[int]] = {}
            for t, i in todo[k:k + a_pass]:
                wide.setdefault(t, []).append(i)
            for r in _level(packed, trees, wide, width, bins, seed, est.getMinInstancesPerNode(), info, many):
                tree, i = trees[r["tree"]], r["node"]
                for c in ("n", "s", "q", "feature", "bin", "gain"):
                    tree[c][i] = r[c]
                tree["open"][i] = False
                if r["feature"] >= 0:
                    tree["left"][i] = left = len(tree["n"])
                    for side, n in enumerate((r["below"], r["n"] - r["below"])):
                        new = (n, 0.0, 0.0, -1, 0, -1.0, -1, tree["depth"][i] + 1, True, 2 * tree["path"][i] + side)
                        for c, v in zip(columns, new, strict=True):
                            tree[c].append(v)
                    next_ += [(r["tree"], j) for j in (left, left + 1) if large(tree, j)]
        todo = next_
    return trees


def _squeezed(y: np.ndarray, w: np.ndarray, codes: np.ndarray) -> bytes:
    """Rows to be dealt, compressed: the bytes of y plane by plane (most are equal), w, and the codes feature by feature."""
    planes = np.ascontiguousarray(y).view(np.uint8).reshape(len(y), 8).T
    return pa.Codec("zstd", compression_level=1).compress(np.concatenate([planes, w[None], codes]).tobytes(), asbytes=True)


def _opened(n: int, data: pa.Buffer, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, w and codes of the ``n`` rows in ``data``."""
    flat = pa.Codec("zstd").decompress(data, (9 + width) * n)
    x = np.frombuffer(flat, np.uint8).reshape(9 + width, n)
    return np.ascontiguousarray(x[:8].T).view(np.float64).ravel(), x[8], x[9:]


def _dealt(packed: DataFrame, trees, these: range, seed: int) -> DataFrame:
    """The rows that each of ``these`` trees drew, packed by its open nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, y, codes in _unpacked(batches):
            for t in these:
                tree = trees.value[t]
                w = drawn(keys, t, seed)
                at = _places(tree, codes)
                mine = np.flatnonzero((w > 0) & np.array(tree["open"])[at])
                mine = mine[np.argsort(at[mine], kind="stable")]
                node, first = np.unique(at[mine], return_index=True)
                parts = np.split(mine, first[1:]) if len(node) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(node), pa.int32()), pa.array(node, pa.int32()),
                     pa.array([len(p) for p in parts], pa.int32()),
                     pa.array([_squeezed(y[p], w[p], codes.take(p, axis=1)) for p in parts], pa.binary())],
                    ["tree", "node", "rows", "data"])

    return packed.mapInArrow(run, "tree int, node int, rows int, data binary")


def pruned(x: pd.DataFrame) -> pd.DataFrame:
    """The tree with leaves of one parent that vote for the same class as one leaf, numbered anew."""
    left, vote = x["left"].to_numpy(int).copy(), (2 * x["s"] > x["n"]).to_numpy()
    while True:
        inner = np.flatnonzero(left >= 0)
        a, b = left[inner], left[inner] + 1
        same = inner[(left[a] < 0) & (left[b] < 0) & (vote[a] == vote[b])]
        if not same.size:
            break
        left[same] = -1
    kept, level = np.zeros(len(x), bool), np.zeros(1, int)
    while level.size:
        kept[level] = True
        down = left[level][left[level] >= 0]
        level = np.concatenate([down, down + 1])
    new = np.cumsum(kept) - 1
    leaf = left < 0
    out = x.assign(left=np.where(leaf, -1, new[left]), feature=np.where(leaf, -1, x["feature"]),
                   gain=np.where(leaf, -1.0, x["gain"]))
    return out[kept].reset_index(drop=True)


def _joined(trees, splits: list[np.ndarray], classes: bool):
    """A tree's upper nodes and the parts grown below them, numbered from 0 with children after their node."""
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        t = key[0].as_py()
        tree = trees.value[t]
        columns = ["n", "s", "q", "feature", "bin", "gain", "left"]
        top = pd.DataFrame({c: tree[c] for c in columns}).astype(float)
        all_, size = [top], len(top)
        for node, *values in zip(*(parts.column(c).to_pylist() for c in ["node", *columns]), strict=True):
            if node is None:
                continue
            part = pd.DataFrame({c: np.frombuffer(v) for c, v in zip(columns, values, strict=True)})
            part.loc[part["left"] > 0, "left"] += size - 1
            top.loc[node] = part.iloc[0]
            all_.append(part.iloc[1:])
            size += len(part) - 1
        x = pd.concat(all_, ignore_index=True)
        if classes:
            x = pruned(x)
        feature, left = x["feature"].to_numpy(int), x["left"].to_numpy(int)
        cut = np.full(len(x), np.nan)
        for f, s in enumerate(splits):
            cut[feature == f] = s[x["bin"].to_numpy(int)[feature == f]]
        mean = x["s"] / x["n"]
        spread = np.maximum(x["q"] / x["n"] - mean * mean, 0)
        if classes:             # variance to Gini
            value, spread, gain = (mean > 0.5).astype(float), 2 * spread, x["gain"].where(left < 0, 2 * x["gain"])
        else:
            value, gain = mean, x["gain"]
        return pa.table({"tree": np.full(len(x), t, np.int32), "id": np.arange(len(x), dtype=np.int32), "prediction": value,
                         "impurity": spread, "n": x["n"], "s": x["s"], "q": x["q"],
                         "gain": gain, "left": left.astype(np.int32), "feature": feature.astype(np.int32),
                         "threshold": pa.array(cut, from_pandas=True)})
    return run


def fit(rows: DataFrame, features: list[str], key, estimator, template) -> "GrownForest":
    """The forest of ``estimator`` over ``rows``; ``key`` is a 64-bit hash of a row's own key.

    ``template`` is a model of the same estimator, whose saved form it takes.
    """
    spark = rows.sparkSession
    rows = rows.select(key.alias("key"), F.col(estimator.getLabelCol()).cast("double").alias("y"),
                       *[F.col(c).cast("double") for c in features])
    classes = isinstance(template, RandomForestClassificationModel)
    count, odd = rows.agg(F.count(F.lit(1)), F.count_if(~F.col("y").isin(0.0, 1.0))).first()
    if not count:
        raise ValueError("a forest needs training rows")
    if classes and odd:
        raise ValueError("classes are 0 and 1")
    bins = min(estimator.getMaxBins(), count)
    sample = rows.orderBy("key").limit(max(BIN_ROWS, bins * bins)).toPandas()
    splits = [thresholds(sample[c].to_numpy(), bins) for c in features]
    cores, seed = spark.sparkContext.defaultParallelism, estimator.getSeed()
    packed = stored(blocks(rows, splits))
    spread = max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), estimator.getNumTrees())
    packed = packed.repartition(2 * cores, "key")
    levels, least, many = estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), subset_size(estimator, len(features))
    info = estimator.getMinInfoGain() / (2 if classes else 1)
    trees = _upper(packed, count, estimator, len(features), bins, seed, info)
    shared = spark.sparkContext.broadcast(trees)

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        parts = [_opened(n, x.as_buffer(), len(splits)) for n, x in zip(t.column("rows").to_pylist(), t.column("data"), strict=True)]
        y, w, codes = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        del parts
        tree, node = key[0].as_py(), key[1].as_py()
        upper = shared.value[tree]
        part = grown(codes, y, w, levels - upper["depth"][node], bins, least, info, many, tree, seed, upper["path"][node])
        at = {"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32())}
        return pa.table(at | {c: [part[c].to_numpy().tobytes()] for c in part.columns})

    binary = "n binary, s binary, q binary, feature binary, bin binary, gain binary, left binary"
    at_a_time = max(1, DEAL_BYTES // max(1, int(count * (1 - math.exp(-1))) * (9 + len(features))))
    lower = None
    for k in range(0, len(trees), at_a_time):
        dealt = _dealt(packed, shared, range(k, min(k + at_a_time, len(trees))), seed)
        some = stored(dealt.repartition(spread, "tree", "node").groupBy("tree", "node")
                      .applyInArrow(grow, f"tree int, node int, {binary}"))
        lower = some if lower is None else lower.unionByName(some)
        if k + at_a_time < len(trees):
            # Spark removes the files of a shuffle once nothing on the driver refers to it.
            del dealt
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    # A tree without open nodes has no row of its own yet.
    every = spark.range(len(trees)).select(F.col("id").cast("int").alias("tree"))
    nodes = every.join(lower, "tree", "left").groupBy("tree").applyInArrow(_joined(shared, splits, classes), (
        "tree int, id int, prediction double, impurity double, n double, s double, q double, gain double, "
        "left int, feature int, threshold double"))
    split = F.col("left") >= 0
    at = F.struct(F.col("feature").alias("featureIndex"),
                  F.when(split, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                  F.lit(-1).alias("numCategories"))
    stats = F.array(F.col("n") - F.col("s"), "s") if classes else F.array("n", "s", "q")
    data = F.struct("id", "prediction", "impurity", stats.alias("impurityStats"),
                    F.col("n").cast("long").alias("rawCount"), "gain", F.col("left").alias("leftChild"),
                    F.when(split, F.col("left") + 1).otherwise(-1).alias("rightChild"), at.alias("split"))
    return GrownForest(template, stored(nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData"))), len(features))


class GrownForest(Model, MLWritable):
    """A forest whose nodes lie in a table; saved, it is a model of its template's class."""

    def __init__(self, template: RandomForestRegressionModel | RandomForestClassificationModel, nodes: DataFrame, width: int):
        super().__init__()
        self.template, self.nodes, self.width = template, nodes, width

    @cached_property
    def model(self) -> RandomForestRegressionModel | RandomForestClassificationModel:
        """All nodes on the driver."""
        path = f"{checkpoint_dir(self.nodes.sparkSession).rstrip('/')}/{self.uid}"
        self.write().save(path)
        return type(self.template).load(path)

    @property
    def trees(self):
        return self.model.trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)

    @cached_property
    def featureImportances(self):
        """Mean over the trees of each feature's share of the gain, as ``pyspark.ml`` has it."""
        n = F.col("nodeData")
        gains = (self.nodes.filter(n["leftChild"] >= 0)
                 .groupBy("treeID", n["split"]["featureIndex"].alias("f")).agg(F.sum(n["gain"] * n["rawCount"]).alias("g")))
        trees = gains.groupBy("treeID").agg(F.sum("g").alias("total"))
        rows = gains.join(trees, "treeID").groupBy("f").agg(F.sum(F.col("g") / F.col("total")).alias("g")).collect()
        total = sum(r["g"] for r in rows)
        return Vectors.sparse(self.width, {r["f"]: r["g"] / total for r in rows})

    def write(self) -> MLWriter:
        return _Writer(self)


class _Writer(MLWriter):
    def __init__(self, forest: GrownForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        self.forest.template.write().save(path)
        self.forest.nodes.write.mode("overwrite").parquet(f"{path}/data")
