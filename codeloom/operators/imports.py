"""Import resolution as an equi-join: every file announces the bases it answers, with a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import scalars as X

_N = len(S.EXTENSIONS)
_ALIAS, _INDEX = 100, 200


def _rank_of(ext: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in S.EXTENSIONS]), ext).cast("int")


def lookup(paths: DataFrame) -> DataFrame:
    """``base, target``: which file a base path means. paths: ``path``.

    The order of preference per base: the path itself; the base plus an extension, in the fixed order of extensions;
    a script extension that stands for a typed one; an index file, then a package file, of a folder. A base that could
    mean an ``.ets`` file and another one means none.
    """
    path = F.col("path")
    ext = F.regexp_extract(path, r"(\.(?:c\+\+|[A-Za-z0-9]+))$", 1)
    stem = F.expr("substring(path, 1, length(path) - length(ext))")
    name = F.element_at(F.split(F.col("stem"), "/"), -1)
    folder = X.dirname(path)
    rows = paths.select("path").distinct().withColumn("ext", ext).withColumn("stem", stem).withColumn("rank", _rank_of(F.col("ext")))
    key = lambda base, rank: F.struct(base.alias("base"), rank.cast("int").alias("rank"))
    none = F.lit(None).cast("struct<base:string,rank:int>")
    aliases = [F.when(F.col("ext") == ts, key(F.concat("stem", F.lit(js)), F.lit(_ALIAS + k))).otherwise(none) for js, targets in S.JS_TO_TS.items() for k, ts in enumerate(targets)]
    answers = F.array(
        key(path, F.lit(0)),
        F.when(F.col("rank") > 0, key(F.col("stem"), F.col("rank"))).otherwise(none),
        *aliases,
        F.when((F.col("rank") > 0) & (name == "index") & (folder != ""), key(folder, _INDEX + 2 * F.col("rank"))).otherwise(none),
        F.when((F.col("rank") > 0) & (name == "__init__") & (folder != ""), key(folder, _INDEX + 2 * F.col("rank") + 1)).otherwise(none),
    )
    keys = rows.select("path", F.explode(F.filter(answers, lambda x: x.isNotNull())).alias("k")).select("path", "k.base", "k.rank").where("base <> ''")
    plain, index = F.col("rank").between(1, _N), F.col("rank") >= _INDEX
    ets = lambda c: F.max(F.when(c & F.endswith("path", F.lit(".ets")), 1).otherwise(0)) * F.when(F.sum(F.when(c, 1).otherwise(0)) > 1, 1).otherwise(0)
    best = lambda c: F.min(F.when(c, F.struct("rank", "path")))["path"]
    by = keys.groupBy("base").agg(
        best(F.col("rank") == 0).alias("own"), best(plain).alias("plain"), best(F.col("rank").between(_ALIAS, _INDEX - 1)).alias("alias"), best(index).alias("index"), ets(plain).alias("torn"), ets(index).alias("torn_index")
    )
    target = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("torn") == 1, F.lit(None)).otherwise(F.coalesce("plain", "alias", F.when(F.col("torn_index") == 0, F.col("index"))))
    return by.select("base", target.alias("target")).where("target is not null")


def bases(file: Column, specifier: Column) -> Column:
    """Base paths of a specifier in order: relative to the importing file, or whole and then by dropped leading segments."""
    relative = F.startswith(specifier, F.lit("./")) | F.startswith(specifier, F.lit("../"))
    folder = X.dirname(file)
    joined = X.normalise(F.when(folder == "", specifier).otherwise(F.concat(folder, F.lit("/"), specifier)))
    parts = F.split(specifier, "/")
    dropped = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    return F.when(specifier.rlike(S.SDK_SPECIFIER), F.array().cast("array<string>")).when(relative, F.array(joined)).otherwise(dropped)


def resolve(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (with ``file, specifier``) plus ``target`` (null if none) and ``suffix_skipped``.

    Specifiers are resolved once per (file, specifier). Files answer at most a handful of bases each, so the join is
    linear in imports and files, where probing every extension would multiply the imports.
    """
    sites = imports.select("file", "specifier").distinct()
    tried = sites.select("file", "specifier", F.posexplode(bases(F.col("file"), F.col("specifier"))).alias("at", "base"))
    hit = tried.join(lookup(paths), "base").groupBy("file", "specifier").agg(F.min(F.struct("at", "target")).alias("hit"))
    found = hit.select("file", "specifier", F.col("hit.target").alias("target"), (F.col("hit.at") > 0).alias("suffix_skipped"))
    return imports.join(found, ["file", "specifier"], "left").withColumn("suffix_skipped", F.coalesce("suffix_skipped", F.lit(False)))


def module_graph(resolved: DataFrame) -> DataFrame:
    """``src, dst``: distinct file-to-file imports without loops, re-exports included."""
    return resolved.where("target is not null and target <> file").select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()


def reference_counts(graph: DataFrame) -> DataFrame:
    """How many files import a file."""
    return graph.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n_importers"))
