"""Mixing sources to target weights by weighted fair queueing.

Every source plays its documents in a shuffled order, up to ``MAX_EPOCHS``
times over. A document's *virtual finish time* is the number of words its
source has played up to and with it, divided by the source's target. All
plays are ordered by finish time and taken until the total budget is used, so
each source is served in proportion to its target.

Plan: one pass over the texts gives (id, source, size, shuffle key), which is
checkpointed; everything after works on these small rows. Running sums come
from two levels: the shuffle key is dealt into ranges, the ranges' sums are
accumulated per source, and only rows of one (source, range) meet in a window.
The budget's cut is found on a histogram of finish times, and only the plays
of the one bin that holds the cut are ordered. Ranges and bins grow in number
with the rows, so a hot source is spread over many of them.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source whose documents are all empty has target 0; a
document of size 0 takes 0 words; repeated rows are documents of their own
(those with one id and different texts spread over the ranges);
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitlake.llm.common import WORD, cut

#: No document is played more often than this.
MAX_EPOCHS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows that a range of the shuffle key or a bin of finish times holds on average.
ROWS_PER_RANGE = 2000
#: Hex digits of the md5 of id and text that make the shuffle key.
KEY_DIGITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """The text is part of the key, so that rows that repeat an id, or have none, spread over the ranges."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"),
                     F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.substring(F.md5(whole.cast("binary")), 1, KEY_DIGITS)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, weight, source_size, target) from rows of (source, size).

    The total of all sizes is shared by weight; a target stops at
    ``MAX_EPOCHS`` times its source's size and the excess is shared by weight
    among the others. Filling in order of size over weight, a source is capped
    if its cap lies below its share of what the sources before it leave.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = (per.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight)
           .withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
           .withColumn("level", F.col("cap") / F.col("weight")))
    fill = W.orderBy("level", "rank")
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(
        F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("share", left / weights_left)
    per = per.withColumn("capped", F.col("cap") < F.col("share") * F.col("weight"))
    # The first source that is not capped sets the level of all others.
    level = F.min(F.when(~F.col("capped"), F.struct("level", "rank", "share"))).over(W.partitionBy())
    return (per.withColumn("open", level["share"])
            .select("source", "rank", "weight", "source_size",
                    F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open") * F.col("weight"))
                    .alias("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, size, source_size, target, times.

    ``times`` is how often the mix plays the document (0 to ``MAX_EPOCHS``).
    """
    keep = keep or []
    rows = cut(docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep],
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        shuffle_key(F.col(id_col), F.col(text_col)).alias("key")))
    targets = cut(source_targets(rows.select("source", "size")))
    n, budget = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(16, n // ROWS_PER_RANGE)
    rows = rows.withColumn(
        "range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * ranges))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    rows = (rows.alias("s").join(targets.alias("t"), same)
            .select("s.*", "rank", "source_size", "target"))

    sums = rows.groupBy("rank", "range").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(
        W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("rank", "range", before.alias("before"))
    running = F.sum("size").over(
        W.partitionBy("rank", "range").orderBy("key", "doc_id", "size")
        .rowsBetween(W.unboundedPreceding, 0))
    rows = (rows.join(sums, ["rank", "range"]).withColumn("done", F.col("before") + running))
    rows = cut(rows.drop("range", "before"))

    # Plays: the document's finish time in each epoch.
    plays = (rows.filter("size > 0")
             .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(MAX_EPOCHS)])))
             .withColumn("finish", _finish(F.col("epoch"))))
    bins = max(16, n // ROWS_PER_RANGE)
    plays = plays.withColumn("bin", F.floor(F.col("finish") * bins))
    held = plays.groupBy("bin").agg(F.sum("size").alias("held"))
    up_to = F.sum("held").over(W.orderBy("bin"))
    cut_bin = (held.withColumn("up_to", up_to).filter(F.col("up_to") > budget)
               .orderBy("bin").select("bin", (F.col("up_to") - F.col("held")).alias("before")).first())
    times = [F.lit(1)] * MAX_EPOCHS
    if cut_bin is not None:
        order = ["finish", "rank", "epoch", "key", "doc_id", "done"]
        at = (plays.filter(F.col("bin") == cut_bin["bin"])
              .withColumn("up_to", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
              .filter(F.col("up_to") + cut_bin["before"] <= budget))
        last = at.agg(F.max(F.struct(*order)).alias("x")).first()["x"]
        times = [_taken(e, cut_bin["bin"], bins, last) for e in range(MAX_EPOCHS)]
    total = sum(times, F.lit(0))
    return rows.select(*[F.col(f"k_{c}").alias(c) for c in keep], "doc_id", "size", "source_size", "target",
                       F.when(F.col("size") > 0, total).otherwise(0).alias("times"))


def _finish(epoch: Column) -> Column:
    return (F.col("source_size") * epoch + F.col("done")).cast("double") / F.col("target")


def _taken(epoch: int, cut_bin: int, bins: int, last) -> Column:
    """1 if the play of this epoch comes no later than the last one taken."""
    finish = _finish(F.lit(epoch))
    whole = F.floor(finish * bins) < cut_bin
    if last is None:
        return F.when(whole, 1).otherwise(0)
    tie = F.lit(False)
    steps = [(finish, last["finish"]), (F.col("rank"), last["rank"]), (F.lit(epoch), last["epoch"]),
             (F.col("key"), last["key"]), (F.col("doc_id"), last["doc_id"]), (F.col("done"), last["done"])]
    for left, right in reversed(steps):
        tie = _before(left, right) | (left.eqNullSafe(F.lit(right)) & tie)
    same = F.lit(True)
    for left, right in steps:
        same = same & left.eqNullSafe(F.lit(right))
    return F.when(whole | tie | same, 1).otherwise(0)


def _before(left: Column, right) -> Column:
    """left < right with null first, as Spark orders."""
    if right is None:
        return F.lit(False)
    return left.isNull() | (left < F.lit(right))
