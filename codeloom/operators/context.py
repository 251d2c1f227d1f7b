"""Task context: routing a task text, scoring declarations and files against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import scalars as X

_PROHIBITED = r"(不要|无需|不必|禁止)[^，。；,.;]{0,12}"
_FILE_TOKEN = r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+"
# Intent words of tasks in Chinese.
_ZH = {"change": "修改|修复|变更|影响|回归|改动|错误|故障", "test": "测试|用例|覆盖率", "architecture": "架构|流程|设计|启动|生命周期|加载", "explore": "哪里|在哪|实现|新增|添加|理解|定位|入口"}


def _word(pattern: str) -> str:
    return rf"(?i)(^|[^A-Za-z0-9_]){pattern}($|[^A-Za-z0-9_])"


def masked(task: Column) -> Column:
    """The task without file names and path-like text, and without what it asks not to do."""
    return F.regexp_replace(F.regexp_replace(task, _PROHIBITED, " "), _FILE_TOKEN, " ")


def route(task: Column, has_symbol: Column, has_test_file: Column | None = None) -> Column:
    """Kind of a task; the first rule that holds decides."""
    t = masked(task)
    test_file = has_test_file if has_test_file is not None else F.exists(F.regexp_extract_all(task, F.lit(_FILE_TOKEN), F.lit(0)), lambda p: X.is_test_path(p))
    return (
        F.when(t.rlike(_ZH["change"]), "change").when(t.rlike(_ZH["test"]), "test").when(t.rlike(_word(S.TASK_TEST)) | test_file, "test").when(t.rlike(_word(S.TASK_CHANGE)), "change").when(has_symbol, "symbol")
        .when(t.rlike(_ZH["architecture"]), "architecture").when(t.rlike(_word(S.TASK_EXPLORE)) | t.rlike(_ZH["explore"]), "exploration").when(t.rlike(_word(S.TASK_ARCHITECTURE)), "architecture").otherwise("ambiguous")
    )


def exact_names(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """``task_id, name``: symbol names that a task spells out as code, found by an equi-join on its tokens.

    A token counts if it looks like code (an inner capital, an underscore, a dollar, a call) or isn't a prose word.
    """
    token = F.explode(F.array_distinct(F.regexp_extract_all("task", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name")
    tokens = tasks.select("task_id", "task", token)
    coded = F.col("name").rlike("[a-z][A-Z]|[_$]") | F.contains("task", F.concat("name", F.lit("("))) | F.contains("task", F.concat(F.lit("`"), "name", F.lit("`")))
    plain = ~F.lower("name").isin(S.PROSE_WORDS + S.STOP_WORDS) & (F.length("name") >= 3)
    return tokens.where(coded | plain).join(symbols.select("name").distinct(), "name", "left_semi").select("task_id", "name")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def route_score(query: Column, name_terms: Column, signature_terms: Column, path_terms: Column, hit: Column, exact: Column, mentioned: Column, callable_: Column, test: Column) -> Column:
    """Score of a declaration for a task."""
    flag = lambda c: c.cast("int")
    sig = F.array_except(signature_terms, name_terms)
    path = F.array_except(F.array_except(path_terms, name_terms), signature_terms)
    return 24 * overlap(name_terms, query) + 4 * overlap(sig, query) + 2 * overlap(path, query) + 5 * hit + 200 * flag(exact) + 30 * flag(mentioned) + 30 * flag(callable_) - 45 * flag(test & ~mentioned & ~exact)


def primary_symbols(symbols: DataFrame, query: str, *, names: list[str] = (), mentioned: list[str] = (), limit: int = 10, ambiguous: bool = False) -> DataFrame:
    """The declarations that fit a task best: exact names, or scores of 20 and more."""
    spark = symbols.sparkSession
    terms = [r[0] for r in spark.createDataFrame([(query,)], "t string").select(F.explode(X.context_terms(F.col("t")))).collect()]  # terms of one task
    q = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    n, s, p = X.context_terms(F.col("name")), X.context_terms(F.col("signature")), X.context_terms(F.col("file"))
    rows = symbols.withColumns({"name_terms": n, "sig_terms": s, "path_terms": p})
    exact = F.col("name").isin(list(names)) if names else F.lit(False)
    said = F.lit(False)
    for m in mentioned:
        said = said | X.file_mention(F.col("file"), F.lit(m))
    matched = overlap(F.array_union("name_terms", F.array_union("sig_terms", "path_terms")), q)
    hit = F.when(exact, 1.0).otherwise(F.least(F.lit(0.8), 0.2 * matched))
    score = route_score(q, F.col("name_terms"), F.col("sig_terms"), F.col("path_terms"), hit, exact, said, F.col("kind").isin("function", "method"), X.is_test_path(F.col("file"), insensitive=True))
    rows = rows.withColumns({"exact": exact, "mentioned": said, "matched": matched, "score": score, "direct": overlap(F.array_union("name_terms", "sig_terms"), q) > 0})
    rows = rows.where((F.col("matched") > 0) | F.col("exact"))
    if ambiguous and len(terms) > 1:
        rows = rows.where(F.col("exact") | (F.col("matched") >= 2))
    rows = rows.where(F.col("exact") | (F.col("score") >= 20))
    any_direct = rows.agg(F.coalesce(F.bool_or("direct"), F.lit(False)).alias("any_direct"))
    kept = rows.crossJoin(any_direct).where(~F.col("any_direct") | F.col("direct") | F.col("mentioned"))  # one row on the right
    return kept.select("id", "name", "kind", "file", "line", "end_line", "signature", "exact", "score").orderBy(F.desc("score"), F.desc("exact"), "file", "line", "id").limit(limit)


#: Score of a file for a task, by why it is taken; a primary file gets its symbol's score plus 45.
FILE_LADDER = {"mentioned": 120, "changed": 115, "changed-path": 90, "affected-test": 75, "import-dependent": 65, "entry-path": 60}


def relevant_files(sources: dict[str, DataFrame], limit: int = 12) -> DataFrame:
    """``path, score, reason``: the highest score of each path over all sources (``path``, and ``score`` for other reasons)."""
    every = None
    for reason, df in sources.items():
        score = F.lit(float(FILE_LADDER[reason])) if reason in FILE_LADDER else F.col("score").cast("double")
        rows = df.select("path", score.alias("score"), F.lit(reason).alias("reason"))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("path").agg(F.max("score").alias("score"), F.max_by("reason", F.struct("score", "reason")).alias("reason"))
    return best.orderBy(F.desc("score"), "path").limit(limit)
