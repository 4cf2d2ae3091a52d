"""A bounded memo for the workers."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` computes and keeps ``fn(key)``.

    Two generations of ``limit`` entries: when the young one is full it
    becomes the old one, so what is used often stays and memory is bounded.
    """

    def __init__(self, fn: Callable, limit: int):
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
