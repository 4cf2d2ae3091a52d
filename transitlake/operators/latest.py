"""Latest-row-per-key and de-duplication as aggregations.

``max(struct(order…, rest…))`` keeps one row per key with a partial
(map-side) aggregate, so a hot key is collapsed before the shuffle and no
task ever sorts a whole group — unlike ``row_number`` over a window, which
shuffles and sorts every row of the group. Every column crosses the shuffle
once: keys as the grouping columns, ordering columns at the head of the
struct. NULL ordering fields compare lowest (the same as ``ORDER BY … DESC
NULLS LAST``); the struct itself is never NULL, so no row is skipped. The
keys come out as grouping columns, so a later join on them needs no further
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` tuple.

    Add tie-breakers to ``order`` until it is a total order over the rows
    that can differ, so the survivor is deterministic; rows that tie on it are
    ordered by their other columns, which must have an order (no maps).
    """
    # Ordering columns stand for themselves; computed ones come on top.
    head = [(o, f"_o{i}") for i, o in enumerate(order) if not (isinstance(o, str) and o in keys)]
    at = {o: name for o, name in reversed(head) if isinstance(o, str)}
    rest = [c for c in df.columns if c not in keys and c not in at]
    fields = [(F.col(o) if isinstance(o, str) else o).alias(name) for o, name in head]
    out = (df.groupBy(*[F.col(k) for k in keys])
             .agg(F.max(F.struct(*fields, *[F.col(c) for c in rest])).alias("_row")))
    return out.select(*[F.col(c) if c in keys else F.col("_row")[at.get(c, c)].alias(c) for c in df.columns])


def dedupe_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep one row per key; the survivor is the greatest row over all
    non-key columns (deterministic replacement for an arbitrary pick)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    return latest_per_key(df, keys, rest)
