"""Regression forests over partitioned rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from transitlake.plans import forests, grow

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    noise = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(41))
    return spark.range(0, 3000, 1, 5).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(500)).alias("a"), (F.col("id") % 7 / 3).alias("b"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(90)).alias("c"),
        (F.when(F.col("id") % 7 > 3, 300).otherwise(0) + noise).cast("int").alias("y")).cache()


def forest(rows, depth=6, **settings):
    est = RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=depth, minInstancesPerNode=10,
                                featureSubsetStrategy="all", seed=42, **settings)
    one = rows.sparkSession.createDataFrame([(Vectors.dense([0.0] * 3), 0.0)], ["features", "y"])
    return grow.fit(rows, FEATURES, F.xxhash64("id"), est, est.fit(one))


def nodes(f):
    return sorted((r["treeID"], r["nodeData"]["id"], r["nodeData"]["prediction"], r["nodeData"]["rawCount"],
                   r["nodeData"]["split"]["featureIndex"], tuple(r["nodeData"]["split"]["leftCategoriesOrThreshold"]))
                  for r in f.nodes.collect())


def leaves(f):
    return sorted((r["treeID"], r["nodeData"]["prediction"], r["nodeData"]["rawCount"], r["nodeData"]["impurity"])
                  for r in f.nodes.filter("nodeData.leftChild < 0").collect())


def test_a_forest_does_not_rest_on_the_layout_of_its_rows(rows):
    one, other = forest(rows.repartition(3)), forest(rows.repartition(11))
    assert nodes(one) == nodes(other) and len(nodes(one)) > 40


def test_nodes_split_over_all_tasks_are_those_that_a_group_grows(rows, monkeypatch):
    whole = forest(rows)
    monkeypatch.setattr(grow, "TABLE_BYTES", 5000)          # a few nodes a pass
    for few in (2500, 400, 0):
        monkeypatch.setattr(grow, "NODE_ROWS", few)
        assert leaves(forest(rows)) == leaves(whole)


def test_every_split_is_the_best_of_its_rows(rows):
    f = forest(rows, depth=3)
    table = rows.withColumn("key", F.xxhash64("id")).orderBy("id").toPandas()
    x, y = table[FEATURES].to_numpy(float), table["y"].to_numpy(float)
    by_tree = {}
    for r in f.nodes.collect():
        by_tree.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    cuts = [grow.thresholds(c, 32) for c in x.T]
    for t, tree in by_tree.items():
        w = grow.drawn(table["key"].to_numpy().view(np.uint64), t, 42).astype(float)
        todo, seen = [(0, w > 0, 0)], 0
        while todo:
            i, at, depth = todo.pop()
            seen += 1
            node, (w_, y_) = tree[i], (w[at], y[at])
            assert node["rawCount"] == w_.sum() and node["prediction"] == pytest.approx(np.average(y_, weights=w_))

            def loss(m):
                return (w_[m] * (y_[m] - np.average(y_[m], weights=w_[m])) ** 2).sum()

            best = max((loss(y_ > -1) - loss(m) - loss(~m) for k in range(3) for c in cuts[k]
                        for m in [x[at, k] <= c] if min(w_[m].sum(), w_[~m].sum()) >= 10), default=0)
            if node["leftChild"] < 0:
                assert depth == 3 or best < 1e-6
                continue
            assert node["gain"] * w_.sum() == pytest.approx(best)
            goes = x[:, node["split"]["featureIndex"]] <= node["split"]["leftCategoriesOrThreshold"][0]
            todo += [(node["leftChild"], at & goes, depth + 1), (node["rightChild"], at & ~goes, depth + 1)]
        assert seen == len(tree) > 3


def test_importances_are_those_of_the_saved_model(rows):
    f = forest(rows)
    assert np.allclose(f.featureImportances.toArray(), f.model.featureImportances.toArray())
    assert f.model.getMaxDepth() == 6 and len(f.trees) == 4


def test_labels_that_are_no_whole_numbers_and_a_single_value(rows):
    f = forest(rows.withColumn("y", F.col("y") / 7))
    assert [n[1:4:2] for n in nodes(f)] and f.featureImportances.toArray().argmax() == 1
    one = forest(rows.withColumn("y", F.lit(5)))
    assert [(n[1], n[2]) for n in nodes(one)] == [(0, 5.0)] * 4 and not one.featureImportances.toArray().any()
    with pytest.raises(ValueError, match="training rows"):
        forest(rows.filter("id < 0"))


def _numbers(n=4000, whole=True):
    r = np.random.default_rng(3)
    codes = np.stack([r.integers(0, 32, n), r.integers(0, 2, n), r.integers(0, 9, n), np.zeros(n, int)]).astype(np.uint8)
    y = codes[0] * 9.0 + codes[2] * 40 + r.integers(-50, 50, n)
    return codes, y if whole else y / 7, r.integers(1, 4, n).astype(np.uint8)


def test_only_the_smaller_child_of_a_node_is_added_up(monkeypatch):
    seen, tables = [], grow.tables

    def counted(codes, node, *args):
        seen.append(len(node))
        return tables(codes, node, *args)

    codes, y, w = _numbers()
    monkeypatch.setattr(grow, "tables", counted)
    whole = grow.grown(codes, y, w, 7, 32, 10, 0.0)
    assert seen[0] == len(y) and len(seen) > 4 and all(n <= len(y) // 2 for n in seen[1:])
    seen.clear()
    monkeypatch.setattr(grow, "TABLE_BYTES", 0)             # no parents' bins are kept
    assert grow.grown(codes, y, w, 7, 32, 10, 0.0).equals(whole)
    assert max(seen[1:]) > len(y) // 2


def test_sums_of_fractions_are_not_taken_from_one_another(monkeypatch):
    codes, y, w = _numbers(whole=False)
    monkeypatch.setattr(grow, "_from_parents", None)
    assert len(grow.grown(codes, y, w, 7, 32, 10, 0.0)) > 40


def test_a_grown_forest_is_scored_from_its_nodes(rows, monkeypatch):
    f = forest(rows)
    expected = {r["id"]: r["prediction"] for r in f.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)).collect()}
    monkeypatch.setattr(grow.GrownForest, "write", None)    # not saved again
    monkeypatch.setattr(type(rows), "toPandas", None)       # nor collected row by row
    found = {r["id"]: r["prediction"] for r in forests.scored(f, rows.select("id", *FEATURES), FEATURES).collect()}
    assert found == expected
