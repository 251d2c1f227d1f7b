"""Indexes of the roots in use: at most a few, one refresh at a time for each."""

from __future__ import annotations

import threading
from collections import OrderedDict

from pyspark.sql import SparkSession

from codeloom.plans.api import CodeIndex

MOST_ROOTS = 4


class Registry:
    """Least recently used roots go first. Paths marked dirty are extracted again by the next ``get``."""

    def __init__(self, spark: SparkSession, base: str, most: int = MOST_ROOTS):
        self.spark, self.base, self.most = spark, base, most
        self._held: OrderedDict[str, CodeIndex] = OrderedDict()
        self._dirty: dict[str, set[str]] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._epochs: dict[str, int] = {}  # how often each root was dropped
        self._guard = threading.Lock()

    def mark(self, root: str, *paths: str) -> None:
        with self._guard:
            self._dirty.setdefault(root, set()).update(paths or ("*",))

    def get(self, root: str) -> CodeIndex:
        with self._guard:
            lock = self._locks.setdefault(root, threading.Lock())
        with lock:  # callers of one root wait for one refresh
            while True:
                with self._guard:
                    dirty = self._dirty.pop(root, None)
                    held, epoch = self._held.get(root), self._epochs.get(root, 0)
                    if held is not None and not dirty:
                        self._held.move_to_end(root)
                        while len(self._held) > self.most:
                            old, _ = self._held.popitem(last=False)
                            self._dirty.pop(old, None)
                        return held
                index = CodeIndex.refresh(self.spark, root, self.base, forced=sorted(dirty or ()))
                with self._guard:
                    if self._epochs.get(root, 0) != epoch:  # dropped meanwhile: it isn't held again
                        return index
                    self._held[root] = index

    def drop(self, root: str) -> None:
        with self._guard:
            self._epochs[root] = self._epochs.get(root, 0) + 1
            self._held.pop(root, None)
            self._dirty.pop(root, None)
