"""Scores of fitted forests: a tree at a time over an Arrow batch.

``pyspark.ml`` takes each row through all trees in turn, so every step of the
walk fetches a node from a forest that is larger than the processor's caches.
Here a batch goes through one tree before the next, level by level. Votes add
up in the order of the trees, so the scores are those of the model's own
``transform`` to the bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.plans.grow import GrownForest
from transitlake.session import checkpoint_dir


def votes_classes(forest) -> bool:
    """Whether the forest tells classes rather than a number."""
    return isinstance(forest.template if isinstance(forest, GrownForest) else forest, RandomForestClassificationModel)


def trees(spark: SparkSession, forest) -> list[tuple]:
    """Feature, threshold, children (left and right in turn) and values of every tree's nodes, and its depth.

    A leaf is its own child, so a walk of ``depth`` steps ends at the row's
    leaf. Its values are the shares of the two classes, or the prediction.
    The nodes are those of the saved model: a bounded number, whatever the rows.
    They come as Arrow columns, small numbers in narrow types: deep trees have millions.
    """
    if isinstance(forest, GrownForest):
        saved = forest.nodes
    else:
        path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
        forest.write().save(path)
        saved = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    stats = n["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    values = ([F.when(total != 0, F.get(stats, F.lit(i)) / total).otherwise(0.0) for i in range(2)]
              if votes_classes(forest) else [n["prediction"]])
    nodes = saved.select(
        "treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        *[v.alias(f"v{i}") for i, v in enumerate(values)]).toArrow().to_pandas()
    out = []
    for _, t in nodes.groupby("treeID", sort=True):
        t = t.sort_values("id")
        leaf = (t["left"] < 0).to_numpy()
        child = np.where(leaf[:, None], np.arange(len(t))[:, None], t[["left", "right"]].to_numpy()).astype(np.int32)
        depth, level = 0, np.zeros(1, np.intp)
        while not leaf[level].all():
            depth, level = depth + 1, child[level[~leaf[level]]].ravel()
        out.append((depth, np.where(leaf, 0, t["feature"]).astype(np.int16),
                    np.where(leaf, np.inf, t["threshold"]), child.ravel(),
                    t[[f"v{i}" for i in range(len(values))]].to_numpy().T.copy()))
    return out


def votes(forest: list[tuple], rows: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for every row of ``rows`` (rows x features)."""
    n, width = rows.shape
    flat, start = rows.ravel(), np.arange(n) * width
    out = np.zeros((len(forest[0][4]), n))
    for depth, feature, threshold, child, values in forest:
        node = np.zeros(n, np.intp)
        for _ in range(depth):
            right = flat.take(start + feature.take(node)) > threshold.take(node)
            node = child.take(2 * node + right)
        for total, value in zip(out, values, strict=True):
            total += value.take(node)
    return out


def scored(forest, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with the model's ``prediction`` and, of two classes, ``probability_late`` (that of class 1)."""
    classes = votes_classes(forest)
    if classes and not isinstance(forest, GrownForest) and forest.numClasses != 2:
        return forest.transform(rows)
    shared = rows.sparkSession.sparkContext.broadcast(trees(rows.sparkSession, forest))
    names = ["prediction", "probability_late"] if classes else ["prediction"]

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            sums = votes(shared.value, np.column_stack([c.to_numpy() for c in columns]))
            if classes:
                yield pd.DataFrame({"prediction": (sums[1] > sums[0]).astype(float),
                                    "probability_late": sums[1] / (sums[0] + sums[1])})
            else:
                yield pd.DataFrame({"prediction": sums[0] / len(shared.value)})

    run = F.pandas_udf(score, ", ".join(f"{c} double" for c in names))
    s = run(*[F.col(c).cast("double") for c in features])
    return rows.withColumn("_scores", s).select(*rows.columns, *[F.col("_scores")[c].alias(c) for c in names])
