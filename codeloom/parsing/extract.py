"""Extraction over a table of files: one parse for each file, then three tables by explode."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import schema as S
from codeloom.parsing import braces, model, python

KERNELS = {
    "python": python.parse,
    "typescript": lambda c: braces.script(c, "typescript"),
    "javascript": lambda c: braces.script(c, "javascript"),
    "arkts": lambda c: braces.script(c, "arkts"),
    "go": braces.go,
    "rust": braces.rust,
    "java": braces.java,
    "cpp": lambda c: braces.c_family(c, "cpp"),
    "c": lambda c: braces.c_family(c, "c"),
}
_OF_EXTENSION = {e: lang for lang, exts in S.LANGUAGES.items() for e in exts}


def language_for(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    return _OF_EXTENSION.get("." + name.rsplit(".", 1)[1]) if "." in name else None


def extract_text(code: str | None, lang: str | None, path: str) -> dict:
    """Rows of one file; a file that can't be read at all gives none and a failed state."""
    empty = {"symbols": [], "imports": [], "calls": []}
    failed = lambda why: {**empty, "diagnostic": {"status": "failed", "error_count": 1, "missing_count": 0, "issues": [], "reason": why}}
    if code is None:
        return failed("not readable")
    if lang not in KERNELS:
        return failed("unknown language")
    try:
        return model.rows(path, lang, KERNELS[lang](code))
    except Exception as e:  # one odd file must not fail an index of millions
        return failed(f"{type(e).__name__}: {e}"[:200])


_OUT = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("diagnostic", S.DIAGNOSTIC),
    T.StructField("symbols", T.ArrayType(S.SYMBOLS)), T.StructField("imports", T.ArrayType(S.IMPORTS)), T.StructField("calls", T.ArrayType(S.CALLS)),
])


def _arrow(kind: T.DataType):
    """The Arrow type of the rows that kernels give."""
    import pyarrow as pa

    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}[kind]


#: Sources whose rows a task holds at once.
BATCH_SOURCES = 500


def extract(sources: DataFrame) -> DataFrame:
    """``path, diagnostic, symbols, imports, calls`` for every source. sources: ``path, lang, code`` (code null: not readable).

    Rows go to Arrow as they are: nested columns through pandas take longer than parsing.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        out = pa.schema(list(_arrow(_OUT)))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_SOURCES):
                some = batch.slice(at, BATCH_SOURCES).to_pylist()
                yield pa.RecordBatch.from_pylist([{"path": s["path"], **extract_text(s["code"], s["lang"], s["path"])} for s in some], schema=out)

    return sources.select("path", "lang", "code").mapInArrow(run, _OUT)


#: Sources for one task; parsing takes about a millisecond each.
TASK_SOURCES = 2000


def dealt(sources: DataFrame) -> DataFrame:
    """The sources dealt out evenly: a table of very many of them can be so small on disk that Spark reads it in one task."""
    return sources.repartition(max(1, -(-sources.count() // TASK_SOURCES)))


def tables(extracted: DataFrame) -> dict[str, DataFrame]:
    """The symbols, imports and calls of extracted files as tables."""
    return {name: extracted.select(F.explode(name).alias("r")).select("r.*") for name in ("symbols", "imports", "calls")}


def register(spark: SparkSession) -> None:
    """Make ``code_symbols_of(text, lang, path)`` callable from SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="id string, name string, kind string, line int, end_line int, exported boolean, signature string")
    class CodeSymbolsOf:
        def eval(self, text: str, lang: str, path: str):
            for s in extract_text(text, lang, path)["symbols"]:
                yield s["id"], s["name"], s["kind"], s["line"], s["end_line"], s["exported"], s["signature"]

    spark.udtf.register("code_symbols_of", CodeSymbolsOf)
