"""Generations of an index on disk: Parquet tables beside a pointer file."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom import schema as S


def key(root: str) -> str:
    return hashlib.sha1(root.encode()).hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(spark: SparkSession, base: str, root: str, tables: dict[str, DataFrame]) -> str:
    """Write a new generation; readers see it whole or not at all, as the pointer moves last."""
    name = uuid.uuid4().hex
    folder = f"{base}/{key(root)}"
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{t}")
    meta = {"schema_version": S.SCHEMA_VERSION, "root": root, "generation": name, "generated_ms": int(time.time() * 1000)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/{name}/meta")
    fs, p = _fs(spark, f"{folder}/{name}/meta")
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}")
    out = fs.create(tmp, True)
    out.write(bytearray(name.encode()))
    out.close()
    _replace(spark, tmp, pointer)
    return name


def _replace(spark: SparkSession, source, target) -> None:
    """Rename over an existing file: in one step where the file system can, so that readers find the old or the new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    qualified = [source.getFileSystem(conf).makeQualified(p) for p in (source, target)]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[1].toUri(), conf).rename(*qualified, how)


def load(spark: SparkSession, base: str, root: str) -> dict[str, DataFrame] | None:
    """Tables of the current generation; None where there is none, or it's damaged or of another schema version.

    A storage that can't be reached is an error: it must not look like an index that was never made.
    """
    folder = f"{base}/{key(root)}"

    def there(path: str) -> bool:
        fs, p = _fs(spark, path)
        return fs.exists(p)

    if not there(f"{folder}/current"):
        return None
    name = spark.read.text(f"{folder}/current").first()
    if name is None or not all(there(f"{folder}/{name[0]}/{t}") for t in ("meta", *S.TABLES)):
        return None
    meta = spark.read.text(f"{folder}/{name[0]}/meta").first()
    try:
        known = json.loads(meta[0] if meta else "")
    except ValueError:
        return None
    if not isinstance(known, dict) or known.get("schema_version") != S.SCHEMA_VERSION or known.get("root") != root:
        return None
    return {t: spark.read.schema(schema).parquet(f"{folder}/{name[0]}/{t}") for t, schema in S.TABLES.items()}


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Index documents of other tools, permissively: unreadable parts become null."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark run records below a folder; malformed ones are skipped."""
    return spark.read.schema(S.RUNS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.run.json").option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).where("run_id is not null")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task and arm definitions."""
    return spark.read.option("multiLine", True).json(path)
