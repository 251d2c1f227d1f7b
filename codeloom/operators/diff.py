"""Unified diffs: parsing, hunk-to-symbol mapping, change classification, rename pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
FILE_CHANGE = "old_path string, new_path string, status string, hunks array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int>>"


def unquote(text: str) -> str:
    """A path as git prints it; C-style quoted if it has unusual characters."""
    if not (len(text) >= 2 and text[0] == text[-1] == '"'):
        return text
    out, body, i = bytearray(), text[1:-1], 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            if m := re.match(r"[0-7]{1,3}", body[i + 1 :]):
                out.append(int(m[0], 8) & 255)
                i += 1 + len(m[0])
                continue
            out += _ESCAPES.get(body[i + 1], body[i + 1]).encode()
            i += 2
            continue
        out += body[i].encode()
        i += 1
    return out.decode("utf-8", "replace")


def _side(text: str) -> str | None:
    name = unquote(text.split("\t")[0].rstrip("\r") if not text.startswith('"') else text.rstrip("\r"))
    return None if name == "/dev/null" else re.sub(r"^[ab]/", "", name)


class _File:
    def __init__(self, old: str | None = None, new: str | None = None):
        self.old, self.new, self.how, self.hunks = old, new, None, []

    def row(self) -> tuple:
        old, new = self.old, self.new
        if self.how == "added" or old is None:
            status, old = "added", None
        elif self.how == "deleted" or new is None:
            status, new = "deleted", None
        else:
            status = "renamed" if self.how == "renamed" else "modified"
        return old, new, status, self.hunks


def parse(text: str | None) -> Iterator[tuple]:
    """File changes of one unified diff: (old path, new path, status, hunks). Lines within a hunk never count as headers."""
    file: _File | None = None
    minus = plus = 0  # lines that the open hunk still has
    for line in (text or "").split("\n"):
        if minus > 0 or plus > 0:
            if line.startswith("\\"):
                continue
            minus -= line[:1] != "+"
            plus -= line[:1] != "-"
            continue
        if line.startswith("diff --git "):
            if file:
                yield file.row()
            names = re.findall(r'"(?:[^"\\]|\\.)*"', line[11:])
            if len(names) == 2:
                file = _File(*map(_side, names))
            else:
                m = re.match(r"a/(.*) b/(.*)$", line[11:].rstrip("\r"))
                file = _File(m[1], m[2]) if m else _File()
                rest = line[11:].rstrip("\r")
                half = len(rest) // 2
                if rest[:half][2:] == rest[half + 1 :][2:]:  # equal names, also with " b/" within
                    file = _File(rest[:half][2:], rest[half + 1 :][2:])
        elif line.startswith("--- ") and not (file and file.hunks and not line[4:]):
            if file is None or file.hunks:
                if file:
                    yield file.row()
                file = _File()
            file.old = _side(line[4:])
        elif line.startswith("+++ ") and file:
            file.new = _side(line[4:])
        elif file and (m := _HUNK.match(line)):
            a, b, c, d = (int(x) if x is not None else 1 for x in m.groups())
            file.hunks.append((a, b, c, d))
            minus, plus = b, d
        elif file and line.startswith("new file mode"):
            file.how = "added"
        elif file and line.startswith("deleted file mode"):
            file.how = "deleted"
        elif file and line.startswith("rename from "):
            file.how, file.old = "renamed", unquote(line[12:].rstrip("\r"))
        elif file and line.startswith("rename to "):
            file.how, file.new = "renamed", unquote(line[10:].rstrip("\r"))
    if file:
        yield file.row()


def register(spark: SparkSession) -> None:
    """Make ``parse_unified_diff(text)`` callable from SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=FILE_CHANGE)
    class ParseUnifiedDiff:
        def eval(self, text: str):
            yield from parse(text)

    spark.udtf.register("parse_unified_diff", ParseUnifiedDiff)


def changes(diffs: DataFrame) -> DataFrame:
    """``diff_id`` and the file changes of each text. diffs: ``diff_id, text``."""
    out = "diff_id string, " + FILE_CHANGE
    names = ("old_start", "old_lines", "new_start", "new_lines")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(d, o, n, s, [dict(zip(names, h, strict=True)) for h in hunks]) for d, t in zip(b["diff_id"], b["text"], strict=True) for o, n, s, hunks in parse(t)]
            yield pd.DataFrame(rows, columns=["diff_id", "old_path", "new_path", "status", "hunks"])

    return diffs.select(F.col("diff_id").cast("string").alias("diff_id"), "text").mapInPandas(run, out)


def check_paths(rows: DataFrame) -> DataFrame:
    """Fail on a path that leaves the repository."""
    bad = lambda c: F.coalesce(F.col(c).rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)|\x00"), F.lit(False))
    message = F.concat(F.lit("unsafe path: "), F.coalesce("new_path", "old_path"))
    return rows.withColumn("status", F.when(bad("old_path") | bad("new_path"), F.raise_error(message).cast("string")).otherwise(F.col("status")))


def ranges(files: DataFrame) -> DataFrame:
    """``side, file, start, stop``: line ranges of hunks, on the current side where lines were added, else on the base side."""
    h = files.select("old_path", "new_path", "status", F.explode("hunks").alias("h"))
    now = h.where("h.new_lines > 0 and new_path is not null").select(F.lit("current").alias("side"), F.col("new_path").alias("file"), F.col("h.new_start").alias("start"), (F.col("h.new_start") + F.greatest("h.new_lines", F.lit(1)) - 1).alias("stop"))
    base = h.where("h.old_lines > 0 and old_path is not null").select(F.lit("base").alias("side"), F.col("old_path").alias("file"), F.col("h.old_start").alias("start"), (F.col("h.old_start") + F.greatest("h.old_lines", F.lit(1)) - 1).alias("stop"))
    return now.unionByName(base)


#: Lines are covered by blocks of 1, 16, 256, ... lines, up to so many levels.
_BASE, _LEVELS = 16, 7


def _block(level: int, n: Column) -> Column:
    """A block of a level by its number, as one number."""
    return n * 8 + level


def _blocks(start: Column, stop: Column) -> Column:
    """The fewest blocks that make up the lines start to stop."""
    whole = lambda x, k: F.floor(x / F.lit(_BASE**k)).cast("long")
    first = lambda k: whole(start + _BASE**k - 1, k)
    end = lambda k: whole(stop + 1, k)
    none = F.array().cast("array<bigint>")

    def span(k: int, a: Column, b: Column) -> Column:
        return F.when(a < b, F.transform(F.sequence(a, b - 1), lambda n: _block(k, n))).otherwise(none)

    parts = []
    for k in range(_LEVELS):
        if k + 1 == _LEVELS:
            parts.append(span(k, first(k), end(k)))
            continue
        inner = first(k + 1) < end(k + 1)  # a level up takes the middle
        parts += [span(k, first(k), F.when(inner, _BASE * first(k + 1)).otherwise(end(k))), F.when(inner, span(k, _BASE * end(k + 1), end(k))).otherwise(none)]
    return F.concat(*parts)


def _around(line: Column) -> Column:
    """The blocks that a line stands in, one of each level."""
    return F.array(*[_block(k, F.floor(line / F.lit(_BASE**k)).cast("long")) for k in range(_LEVELS)])


def overlaps(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hunks with the declarations they touch. hunks: ``file, start, stop, ...``.

    Either the declaration begins within the hunk, or the hunk begins within the rest of the declaration. Both are a line in
    a range: the range is dealt out to the few blocks that make it up, the line to the blocks around it, and one of them
    is equal exactly if it's within. So an equi-join makes the result's rows only, also in a file of very many of both.
    Spark takes a table for as large before its rows are dealt out as after, so both sides are sorted and merged: none is sent
    whole to the driver.
    """
    s = symbols.withColumnRenamed("file", "of_file")
    same = (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block"))
    within = hunks.withColumn("block", F.explode(_blocks(F.col("start"), F.col("stop")))).join(s.withColumn("of_block", F.explode(_around(F.col("line")))).hint("merge"), same)
    inside = hunks.withColumn("block", F.explode(_around(F.col("start")))).join(s.withColumn("of_block", F.explode(_blocks(F.col("line") + 1, F.col("end_line")))).hint("merge"), same)
    columns = ["file", *[c for c in hunks.columns if c != "file"], *[c for c in symbols.columns if c != "file"]]
    return within.select(*columns).unionAll(inside.select(*columns))


def outside(hunks: DataFrame, symbols: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Hunks that touch no declaration. touched: ``overlaps`` of the two, if at hand."""
    touched = overlaps(hunks, symbols) if touched is None else touched
    return hunks.join(touched.select("file", "start", "stop").distinct(), ["file", "start", "stop"], "left_anti").select(*hunks.columns)


def identity_counts(symbols: DataFrame) -> DataFrame:
    """``file, kind, name, scope_names, n``: how often a structural identity (ordinals left out) stands in a file."""
    scope = F.transform("scope", lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name")))
    return symbols.groupBy("file", "kind", "name", F.to_json(scope).alias("scope_names")).agg(F.count("*").alias("n"))


def classify(current: DataFrame, base: DataFrame) -> DataFrame:
    """``file, kind, name, scope_names, side, change`` by the counts of an identity on either side.

    current, base: ``identity_counts`` of the two sides of the changed files.
    """
    keys = ["file", "kind", "name", "scope_names"]
    both = current.withColumnRenamed("n", "n_now").join(base.withColumnRenamed("n", "n_base"), keys, "full_outer").na.fill(0, ["n_now", "n_base"])
    change = (
        F.when((F.col("n_now") == 1) & (F.col("n_base") == 0), "added").when((F.col("n_now") == 1) & (F.col("n_base") == 1), "modified").when((F.col("n_now") == 0) & (F.col("n_base") == 1), "deleted").otherwise("unclassified")
    )
    return both.select(*keys, F.when(F.col("n_now") > 0, "current").otherwise("base").alias("side"), change.alias("change"))


def rename_pairs(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """``old_path, new_path``: files of equal content paired one to one, in order of path. Inputs: ``path, content``."""
    number = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    side = lambda d, n: d.select(F.col("path").alias(n), F.sha2(F.col("content"), 256).alias("hash")).withColumn("path", F.col(n)).withColumn("k", number).drop("path")
    return side(deleted, "old_path").join(side(added, "new_path"), ["hash", "k"]).select("old_path", "new_path")
