"""Classification forests over all training rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from transitlake.plans import features as FE
from transitlake.plans import grow
from transitlake.plans import learning as L

FEATURES = ["a", "b", "c", "d", "e"]


def test_a_classifiers_trees_take_all_training_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "RF_TREES", 3)
    monkeypatch.setattr(L, "RF_DEPTH", 3)
    number = (F.col("id") % 24).cast("int")
    given = {c: number for c in FE.NUMERIC_FEATURES if not c.endswith("_i")}
    given |= {c: F.lit(False) for c in ("is_precipitation", "is_snow")}
    data = L.split(spark.range(0, 20_000, 1, 4).select(
        F.col("id").alias("prediction_id"), F.col("id").alias("trip_id"), F.col("id").alias("extracted_at"),
        (F.col("id") % 3).alias("route_id"), (F.col("id") % 7).alias("stop_id"), *[v.alias(k) for k, v in given.items()],
        number.between(8, 11).cast("int").alias("target_is_late"))).cache()
    train = data.filter("NOT is_test").count()
    model, scores = L.fit_forest(data, L.classification_models()["random_forest"])
    roots = model.stages[-1].nodes.filter("nodeData.id = 0").select("nodeData.rawCount").toPandas()["rawCount"]
    assert train > 15_000 and len(roots) == 3 and all(abs(n - train) < 6 * train ** 0.5 for n in roots)
    assert scores.count() == 20_000 - train


@pytest.fixture(scope="module")
def rows(spark):
    noise = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40)).alias(c) for k, c in enumerate(FEATURES)]
    late = (F.col("a") + F.col("b") + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(30)) > 55).cast("int")
    return spark.range(0, 3000, 1, 5).select("id", *noise).withColumn("y", late).cache()


def forest(rows, depth=5):
    est = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=depth, minInstancesPerNode=10,
                                 featureSubsetStrategy="sqrt", seed=42)
    one = rows.sparkSession.createDataFrame([(Vectors.dense([0.0] * 5), 0.0), (Vectors.dense([0.0] * 5), 1.0)], ["features", "y"])
    return grow.fit(rows, FEATURES, F.xxhash64("id"), est, est.fit(one))


def leaves(f):
    return sorted((r["treeID"], r["nodeData"]["prediction"], tuple(r["nodeData"]["impurityStats"]), r["nodeData"]["impurity"])
                  for r in f.nodes.filter("nodeData.leftChild < 0").collect())


def test_class_nodes_split_over_all_tasks_are_those_that_a_group_grows(rows, monkeypatch):
    whole = leaves(forest(rows.repartition(3)))
    assert len(whole) > 20
    monkeypatch.setattr(grow, "TABLE_BYTES", 5000)          # a few nodes a pass
    for few in (400, 0):
        monkeypatch.setattr(grow, "NODE_ROWS", few)
        assert leaves(forest(rows.repartition(11))) == whole


def test_every_class_split_is_the_best_of_the_features_it_may_use(rows):
    f = forest(rows, depth=3)
    table = rows.withColumn("key", F.xxhash64("id")).orderBy("id").toPandas()
    x, y = table[FEATURES].to_numpy(float), table["y"].to_numpy(float)
    cuts, used = [grow.thresholds(c, 32) for c in x.T], set()
    for t in range(3):
        tree = {r["nodeData"]["id"]: r["nodeData"] for r in f.nodes.filter(F.col("treeID") == t).collect()}
        w = grow.drawn(table["key"].to_numpy().view(np.uint64), t, 42).astype(float)
        todo, seen = [(0, w > 0, 0, 1)], 0
        while todo:
            i, at, depth, path = todo.pop()
            seen += 1
            node, one, all_ = tree[i], (w * y)[at].sum(), w[at].sum()
            assert list(node["impurityStats"]) == [all_ - one, one] and node["rawCount"] == all_
            assert node["prediction"] == float(2 * one > all_)
            assert node["impurity"] == pytest.approx(2 * one / all_ * (1 - one / all_))

            def gini(m):
                return 2 * (w * y)[m].sum() * (1 - (w * y)[m].sum() / w[m].sum())

            may = np.flatnonzero(grow.chosen([path], t, 42, 5, 3)[0])
            assert len(may) == 3
            best = max((gini(at) - gini(at & lo) - gini(at & ~lo) for k in may for c in cuts[k] for lo in [x[:, k] <= c]
                        if min(w[at & lo].sum(), w[at & ~lo].sum()) >= 10), default=0)
            if node["leftChild"] < 0:
                continue
            k = node["split"]["featureIndex"]
            assert depth < 3 and k in may and node["gain"] * all_ == pytest.approx(best)
            used.add(k)
            goes = x[:, k] <= node["split"]["leftCategoriesOrThreshold"][0]
            todo += [(node["leftChild"], at & goes, depth + 1, 2 * path), (node["rightChild"], at & ~goes, depth + 1, 2 * path + 1)]
        assert seen == len(tree) > 3
    assert len(used) > 1


def test_leaves_that_vote_alike_are_one():
    tree = pd.DataFrame({"n": [10.0, 4, 6, 2, 2, 3, 3], "s": [5.0, 1, 4, 0, 1, 2, 2], "q": [5.0, 1, 4, 0, 1, 2, 2],
                         "feature": [0.0, 1, 1, -1, -1, -1, -1], "bin": 0.0, "gain": [1.0, 1, 1, -1, -1, -1, -1],
                         "left": [1.0, 3, 5, -1, -1, -1, -1]})
    cut = grow.pruned(tree)
    assert cut["left"].tolist() == [1, -1, -1] and cut["s"].tolist() == [5, 1, 4] and cut["gain"].tolist() == [1, -1, -1]
    assert grow.pruned(tree.assign(s=[5.0, 1, 4, 0, 2, 2, 2])).shape[0] == 5


def test_classes_are_two(rows):
    with pytest.raises(ValueError, match="0 and 1"):
        forest(rows.withColumn("y", F.col("y") * 2))


def test_trees_dealt_a_few_at_a_time_are_the_same(rows, monkeypatch):
    whole, dealt, real = leaves(forest(rows)), [], grow._dealt
    monkeypatch.setattr(grow, "_dealt", lambda packed, trees, these, seed: dealt.append(these) or real(packed, trees, these, seed))
    monkeypatch.setattr(grow, "DEAL_BYTES", 2 * 2000 * (9 + len(FEATURES)))
    assert leaves(forest(rows)) == whole
    assert [len(these) for these in dealt] == [2, 1]


def test_dealt_rows_are_small_and_whole():
    r = np.random.default_rng(1)
    y, w = r.integers(-1800, 3600, 5000) / np.array([1.0, 7.0] * 2500), r.integers(1, 5, 5000).astype(np.uint8)
    codes = r.integers(0, 24, (6, 5000)).astype(np.uint8)
    data = grow._squeezed(y, w, codes)
    for a, b in zip((y, w, codes), grow._opened(5000, pa.py_buffer(data), 6), strict=True):
        assert np.array_equal(a, b) and a.dtype == b.dtype
    assert len(grow._squeezed(np.rint(y), w, codes)) < 5000 * (8 + 1 + 6) / 2


@pytest.mark.parametrize("many", [None, 2])
def test_rows_laid_out_again_grow_the_same_tree(monkeypatch, many):
    r = np.random.default_rng(4)
    codes = np.stack([r.integers(0, k, 4000) for k in (32, 2, 9, 17)]).astype(np.uint8)
    y, w = codes[0] * 9.0 + codes[2] * 40 + r.integers(-50, 50, 4000), r.integers(1, 4, 4000).astype(np.uint8)
    trees = []
    for levels in (1, 4, 99):
        monkeypatch.setattr(grow, "ORDER_LEVELS", levels)
        trees.append(grow.grown(codes, y, w, 9, 32, 10, 0.0, many, 1, 42))
    assert trees[0].equals(trees[1]) and trees[0].equals(trees[2]) and len(trees[0]) > 40
