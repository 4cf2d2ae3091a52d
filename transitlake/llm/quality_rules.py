"""Quality rules whose cutoffs are certified against false rejection.

Counts of every text (words, their code points, symbols, duplicate lines,
words in repeated 8-word windows) give five ratios. Each ratio is a rule: a
text is rejected above the rule's cutoff in the text's stratum. Cutoffs come
from labelled good texts that were set aside for it: for a cutoff, the number
x of n good texts above it is binomial, and the exact test P(Bin(n, a) <= x)
rejects "more than a share a of good texts is lost" (the same as a
Clopper-Pearson upper bound below a). In each stratum a rule gets an equal
part of ``ALPHA``, so all rules together reject at most ``ALPHA`` of the
stratum's good texts. Cutoffs of a rule are tested from the loosest to the
strictest and testing ends at the first that fails (a fixed sequence needs no
correction); rules and strata are corrected by Bonferroni, so all guarantees
hold together with confidence ``1 - DELTA``. Among a rule's certified cutoffs
the one that rejects most labelled bad texts less labelled good texts is
taken, the loosest among equals, so little good is risked without gain.

Texts are read once; the counts (a few integers per text) are checkpointed and
all statistics are grouped counts of (stratum, rule, level), whose number does
not depend on the size of the corpus.

Defined cases: a null or empty text has no words and fails the base rules; a
null stratum is a stratum of its own; a stratum with too few labels to certify
anything gets no cutoff and keeps all that pass the base rules; a text with
several labels is good if all say so; labels of unknown ids are ignored;
repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitlake.llm import words
from transitlake.llm.common import cut, pieces

#: Most good texts that the rules together may reject in a stratum, and the risk of that promise failing.
ALPHA = 0.05
DELTA = 0.05
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Rule → ratio that is bad when large (texts that pass the base rules have words).
RULES = {
    "symbols": "try_divide(n_symbols, n_words)",
    "long_words": "try_divide(word_chars, n_words)",
    "short_words": "-try_divide(word_chars, n_words)",
    "duplicate_lines": "try_divide(n_dup_lines, n_words)",
    "repeated_words": "try_divide(n_repeat_words, n_words)",
}
#: Rule → cutoffs from the loosest to the strictest, as many for each rule.
CUTOFFS = {
    "symbols": [2.0 * 0.8**i for i in range(24)],
    "long_words": [30.0 * 0.92**i for i in range(24)],
    "short_words": [-1.0 - 0.15 * i for i in range(24)],
    "duplicate_lines": [0.5 * 0.8**i for i in range(24)],
    "repeated_words": [0.3 * 0.8**i for i in range(24)],
}


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a batch."""
    n = len(offsets) - 1

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[offsets[1:]] - total[offsets[:-1]]

    solid = ~words.SPACE[data]
    starts, ends, first = words.spans(data, offsets)
    out = {"n_words": np.diff(first), "word_chars": per_text(solid & ((data & 0xC0) != 0x80)),
           "n_symbols": per_text(_SYMBOL[data])}

    # Lines that hold a word: their bytes' hash seen before in the same text.
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_text = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_text + 1])
    held = np.concatenate([[0], np.cumsum(solid)])
    full = held[line_end] > held[line_start]
    line_start, line_end, line_text = line_start[full], line_end[full], line_text[full]
    trim = data[line_end - 1] == 10 if len(line_end) else np.zeros(0, bool)
    key = words.hash_spans(data, line_start, line_end - trim)
    out["n_dup_lines"] = np.bincount(line_text[_seen_before(line_text, key)], minlength=n)

    h = words.hash_spans(data, starts, ends)
    gram = words.grams(h, WINDOW)
    at = np.flatnonzero(words.inside(first, WINDOW, len(h)))
    owner = np.repeat(np.arange(n), np.diff(first))
    twice = at[_repeated(owner[at], gram[at])]
    cover = np.zeros(len(h) + 1, np.int64)
    cover[twice] += 1
    np.subtract.at(cover, np.minimum(twice + WINDOW, len(h)), 1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _groups(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    return order, (o[1:] == o[:-1]) & (k[1:] == k[:-1])


def _seen_before(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Mask: an equal key of the same owner stands before (the sort is stable)."""
    order, same = _groups(owner, key)
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    return out


def _repeated(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Mask: the owner has the key twice or more."""
    order, same = _groups(owner, key)
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """doc_id, stratum, the counts and base_failed of every text (a map over the texts)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"),
                       F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = counts(*words.text_bytes(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(found[c].astype(np.int64)) for c in _COUNTS]],
                    ["doc_id", "stratum", *_COUNTS])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def binomial_tail(x: int, n: int, p: float) -> float:
    """Exact P(Bin(n, p) <= x)."""
    if x >= n:
        return 1.0
    k = np.arange(x + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k])
    log += k * math.log(p) + (n - k) * math.log1p(-p)
    top = log.max()
    return min(1.0, float(np.exp(top) * np.exp(log - top).sum()))


def _level(rule: str):
    """How many of the rule's cutoffs the ratio exceeds."""
    return sum(((F.expr(RULES[rule]) > c).cast("int") for c in CUTOFFS[rule]), F.lit(0))


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
            alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) certified on the labelled texts that pass the base rules."""
    marks = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("good")).na.drop()
             .groupBy("doc_id").agg(F.min("good").alias("good")))
    seen = measured.filter(~F.col("base_failed")).join(marks, "doc_id")
    seen = seen.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), _level(r).alias("level")) for r in RULES])).alias("x"))
    seen = seen.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level")).agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("bad"))
    # Cutoffs fall, so texts above cutoff i (from 1 on) exceed all from i on.
    size = len(next(iter(CUTOFFS.values())))
    steps = F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")
    cells = seen.groupBy("stratum", "rule").agg(F.sum("good").alias("n"),
                                                F.collect_list(F.struct("level", "good", "bad")).alias("levels"))
    tests = cells.select("stratum", "rule", "n", "levels", steps)
    above = F.filter("levels", lambda v: v["level"] > size - F.col("step"))
    tests = tests.select("stratum", "rule", "n", "step",
                         F.aggregate(above, F.lit(0).cast("long"), lambda a, v: a + v["good"]).alias("lost"),
                         F.aggregate(above, F.lit(0).cast("long"), lambda a, v: a + v["bad"]).alias("caught"))
    tests = tests.crossJoin(F.broadcast(cells.agg(F.count("*").alias("family"))))
    share = alpha / len(RULES)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fails"] = [int(binomial_tail(int(x), int(n), share) > delta / m) if n else 1
                          for x, n, m in zip(b["lost"], b["n"], b["family"], strict=True)]
            yield b

    tests = tests.mapInPandas(test, "stratum string, rule string, n long, step int, lost long, caught long, "
                                    "family long, fails int")
    order = W.partitionBy("stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    passed = tests.withColumn("failed", F.sum("fails").over(order)).filter("failed = 0 AND caught > lost")
    chosen = passed.groupBy("stratum", "rule").agg(
        F.max(F.struct((F.col("caught") - F.col("lost")).alias("gain"), (-F.col("step")).alias("step"))).alias("x"))
    grid = F.create_map(*[v for r, cs in CUTOFFS.items()
                          for v in (F.lit(r), F.array(*[F.lit(float(c)) for c in cs]))])
    return chosen.select("stratum", "rule",
                         F.element_at(F.element_at(grid, F.col("rule")), -F.col("x.step")).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, the first rule that rejects (``reason``) and kept of every text."""
    measured = cut(measure(docs, id_col, text_col, stratum_col))
    limits = cut(cutoffs(measured, labels, id_col=id_col, alpha=alpha, delta=delta)
                 .groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
                 .withColumnsRenamed({r: f"cut_{r}" for r in RULES}))
    same = F.col("m.stratum").eqNullSafe(F.col("l.stratum"))
    rows = measured.alias("m").join(limits.alias("l"), same, "left")
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for r in RULES:
        reason = reason.when(F.expr(RULES[r]) > F.col(f"cut_{r}"), F.lit(r))
    rows = rows.withColumn("reason", reason)
    return rows.select("doc_id", *_COUNTS, "base_failed", F.col("reason").isNull().alias("kept"),
                       "m.stratum", "reason")
