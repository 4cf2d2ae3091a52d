"""Parameterised analytics queries (N1–N47) as ``(Models, params) -> DataFrame``.

Parameters are Python values turned into Column literals — never spliced
into SQL text. Optional filters (``'all'``) are decided in Python, so the
plan carries no constant-true predicates. Every top-k carries a total
order (a key column last) so the cut is deterministic.
"""
