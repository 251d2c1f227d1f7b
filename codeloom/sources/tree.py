"""A data source for source trees: ``spark.read.format("source_tree").option("root", ...)``.

The walk prunes excluded and ignored folders before it enters them and tests extensions before it reads anything. The
top folders are the partitions, so large trees are walked in parallel; file contents are read by the executors.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from codeloom import schema as S
from codeloom.parsing.extract import language_for
from codeloom.sources import ignore

MAX_BYTES = 1_000_000
#: Parts that a snapshot of a tree is compared in.
BUCKETS = 8


class Walk(InputPartition):
    def __init__(self, folder: str, files: tuple[str, ...] | None):
        self.folder, self.files = folder, files


def read_rules(root: str, folder: str) -> list[ignore.Rule]:
    try:
        with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return ignore.compile_rules(f.read())
    except OSError:
        return []


def entries(root: str, folder: str, excluded: set[str], layers: list) -> tuple[list[str], list[str], list]:
    """Files and folders to keep directly in a folder, and the rule layers that hold below it."""
    own = read_rules(root, folder)
    layers = [*layers, (folder, own)] if own else layers
    files, folders = [], []
    try:
        found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return [], [], layers
    for e in found:
        rel = f"{folder}/{e.name}" if folder else e.name
        if e.is_dir(follow_symlinks=False):
            if e.name not in excluded and not ignore.verdict(layers, rel, True):
                folders.append(rel)
        elif e.is_file(follow_symlinks=False) and language_for(e.name) and not ignore.verdict(layers, rel, False):
            files.append(rel)
    return files, folders, layers


def walk(root: str, folder: str, excluded: set[str], layers: list) -> Iterator[str]:
    files, folders, below = entries(root, folder, excluded, layers)
    yield from files
    for f in folders:
        yield from walk(root, f, excluded, below)


def layers_above(root: str, folder: str) -> list:
    parts = folder.split("/") if folder else []
    above = ["/".join(parts[:k]) for k in range(len(parts))]
    return [(b, r) for b in above if (r := read_rules(root, b))]


def snapshot(root: str, excluded: set[str]) -> dict[str, float]:
    out = {}
    for rel in walk(root, "", excluded, []):
        try:
            out[rel] = os.stat(os.path.join(root, rel)).st_mtime_ns / 1e6
        except OSError:
            continue
    return out


def read_files(paths, root: str):
    """``root, path, lang, mtime_ms, code`` of the given paths (a DataFrame with ``path``) only: each is opened once, by the executors.

    A file that has gone gives no row; one that is too large or can't be read has a null code.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for rel in b["path"]:
                full, code = os.path.join(root, rel), None
                try:
                    st = os.stat(full)
                    if st.st_size <= MAX_BYTES:
                        with open(full, encoding="utf-8", errors="replace") as f:
                            code = f.read()
                except OSError:
                    continue
                rows.append((root, rel, language_for(rel), st.st_mtime_ns / 1e6, code))
            yield pd.DataFrame(rows, columns=["root", "path", "lang", "mtime_ms", "code"])

    return paths.select("path").mapInPandas(run, "root string, path string, lang string, mtime_ms double, code string")


def _excluded(options: dict) -> set[str]:
    return set(S.EXCLUDED_DIRS) | set(filter(None, options.get("excludeDirs", "").split(",")))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.excluded, self.with_code = options["root"], _excluded(options), options.get("code", "true") == "true"

    def partitions(self):
        files, folders, _ = entries(self.root, "", self.excluded, [])
        return [Walk("", tuple(files)), *(Walk(f, None) for f in folders)]

    def read(self, part: Walk):
        found = part.files if part.files is not None else walk(self.root, part.folder, self.excluded, layers_above(self.root, part.folder))
        for rel in found:
            full, code = os.path.join(self.root, rel), None
            try:
                st = os.stat(full)
                if self.with_code and st.st_size <= MAX_BYTES:
                    with open(full, encoding="utf-8", errors="replace") as f:
                        code = f.read()
            except OSError:
                continue
            yield (self.root, rel, language_for(rel), st.st_mtime_ns / 1e6, code)


class Snapshots:
    """Numbered states of a tree: in memory, or in a folder that driver and executors share, where they outlive the query.

    A state in a folder is one file for each bucket of top folders, so that it is compared in parts.
    """

    def __init__(self, folder: str | None):
        self.folder, self.states = folder, {0: {}}

    @staticmethod
    def bucket(path: str) -> int:
        return zlib.crc32(path.split("/", 1)[0].encode("utf-8", "surrogatepass")) % BUCKETS

    def last(self) -> int:
        if self.folder is None:
            return max(self.states)
        return max((int(n) for n in os.listdir(self.folder) if n.isdigit()), default=0) if os.path.isdir(self.folder) else 0

    def part(self, n: int, bucket: int) -> dict[str, float]:
        if self.folder is None:
            return {p: ms for p, ms in self.states.get(n, {}).items() if self.bucket(p) == bucket}
        if n == 0:
            return {}
        with open(os.path.join(self.folder, str(n), f"{bucket}.json"), encoding="utf-8", errors="surrogatepass") as f:
            return json.load(f)

    def whole(self, n: int) -> dict[str, float]:
        return {p: ms for k in range(BUCKETS) for p, ms in self.part(n, k).items()}

    def add(self, n: int, state: dict[str, float]) -> None:
        if self.folder is None:
            self.states[n] = state
            return
        draft = os.path.join(self.folder, f"_{n}_{uuid.uuid4().hex}")
        os.makedirs(draft)
        for k in range(BUCKETS):
            with open(os.path.join(draft, f"{k}.json"), "w", encoding="utf-8", errors="surrogatepass") as f:
                json.dump({p: ms for p, ms in sorted(state.items()) if self.bucket(p) == k}, f)
        os.rename(draft, os.path.join(self.folder, str(n)))  # whole or not at all

    def drop_before(self, n: int) -> None:
        if self.folder is None:
            for k in [k for k in self.states if k < n]:
                del self.states[k]
        elif os.path.isdir(self.folder):
            for k in os.listdir(self.folder):
                if k.isdigit() and int(k) < n:
                    shutil.rmtree(os.path.join(self.folder, k), ignore_errors=True)


class TreeStream(DataSourceStreamReader):
    """Changes of a tree as events, found by comparing snapshots; a lost event is repaired by the next one.

    With the option ``stateDir`` (a path that driver and executors share, one for each query) snapshots are kept there, so a
    query that is stopped and started again gives exactly what has changed in between.
    """

    def __init__(self, options: dict):
        self.root, self.excluded = options["root"], _excluded(options)
        self.states = Snapshots(options.get("stateDir"))

    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        n, now = self.states.last(), snapshot(self.root, self.excluded)
        if now != self.states.whole(n):
            n += 1
            self.states.add(n, now)
        return {"n": n}

    def partitions(self, start, end):
        a, b = start["n"], end["n"]
        sent = self.states.folder is None  # what only the driver's memory holds goes with the partition
        return [Events(k, a, b, (self.states.part(a, k), self.states.part(b, k)) if sent else None) for k in range(BUCKETS)]

    def read(self, part):
        old, new = part.sides or (self.states.part(part.start, part.bucket), self.states.part(part.end, part.bucket))
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path):
                yield (self.root, path, "unlink" if path not in new else "add" if path not in old else "change", new.get(path))

    def commit(self, end):
        self.states.drop_before(end["n"])


class Events(InputPartition):
    def __init__(self, bucket: int, start: int, end: int, sides: tuple[dict, dict] | None):
        self.bucket, self.start, self.end, self.sides = bucket, start, end, sides


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "root string, path string, lang string, mtime_ms double, code string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class SourceTreeEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree_events"

    def schema(self) -> str:
        return "root string, path string, op string, mtime_ms double"

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(SourceTreeEvents)
