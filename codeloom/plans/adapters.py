"""The driver's tables read as an index: SQL that Spark and DuckDB both run.

Suppliers are files, parts are declarations, line items are calls and imports, orders are edited line ranges. Every
common table expression below gives one index table (or a part of one) under the name in its comment.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.checkpoints import kept

CTES = {
    # files: fid, path, lang, seq, status
    "nf": "SELECT count(*) AS n FROM supplier",
    "files": """SELECT s_suppkey AS fid, concat('src/n', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING),
        CASE WHEN s_suppkey % 23 = 7 THEN '/index.ts' WHEN s_suppkey % 5 = 0 THEN '.spec.ts' WHEN s_suppkey % 5 = 1 THEN '.ts' WHEN s_suppkey % 5 = 2 THEN '.py' WHEN s_suppkey % 5 = 3 THEN '.go' ELSE '.rs' END) AS path,
        CASE WHEN s_suppkey % 23 = 7 THEN 'typescript' WHEN s_suppkey % 5 < 2 THEN 'typescript' WHEN s_suppkey % 5 = 2 THEN 'python' WHEN s_suppkey % 5 = 3 THEN 'go' ELSE 'rust' END AS lang, CAST(s_suppkey AS INT) AS seq,
        CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_acctbal < 1000 THEN 'partial' WHEN s_suppkey % 11 = 3 THEN NULL ELSE 'parsed' END AS status, s_acctbal AS mtime_ms FROM supplier""",
    # symbols: pid, id, name, kind, fid, file, line, end_line, exported, depth, container_path, self_path
    "sym0": """SELECT p_partkey AS pid, replace(p_name, ' ', '_') AS name, CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'variable' END AS kind,
        p_partkey % n AS fid, CAST(p_partkey * 10 AS INT) AS line, CAST(p_partkey * 10 + p_size AS INT) AS end_line, p_partkey % 3 <> 0 AS exported,
        CASE WHEN p_size % 4 = 2 THEN concat('class:c', CAST(p_partkey % 2 AS STRING), '@1') ELSE '' END AS container_path, CAST(p_partkey AS INT) AS seq FROM part CROSS JOIN nf""",
    "symbols": """SELECT s.*, f.path AS file, concat(s.container_path, CASE WHEN s.container_path = '' THEN '' ELSE '/' END, s.kind, ':', s.name, '@', CAST(s.pid AS STRING)) AS self_path,
        concat('sym:v1:', f.path, '#', s.container_path, CASE WHEN s.container_path = '' THEN '' ELSE '/' END, s.kind, ':', s.name, '@', CAST(s.pid AS STRING)) AS id FROM sym0 s JOIN files f ON s.fid = f.fid""",
    # calls: fid, name, line, from_pid (null at module level), qualifier; one row for each distinct site
    "call0": """SELECT DISTINCT l_suppkey AS fid, replace(p_name, ' ', '_') AS name, CAST(l_linenumber AS INT) AS line,
        CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_suppkey + n * (l_orderkey % 15) END AS from_pid,
        CASE WHEN l_linenumber = 3 THEN concat('ns', CAST(l_partkey % 7 AS STRING)) ELSE NULL END AS qualifier
        FROM lineitem JOIN part ON l_partkey = p_partkey CROSS JOIN nf""",
    "calls": """SELECT c.fid, f.path AS file, c.name, c.line, c.from_pid, s.id AS from_id, s.name AS from_name, c.qualifier,
        CAST(row_number() OVER (PARTITION BY c.fid ORDER BY c.line, c.name, coalesce(c.from_pid, -1), coalesce(c.qualifier, '')) AS INT) AS seq
        FROM call0 c JOIN files f ON c.fid = f.fid LEFT JOIN symbols s ON c.from_pid = s.pid""",
    # imports: src file, specifier, bindings (imported, local, how)
    "imp0": """SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, (l_suppkey + 7 * l_linenumber) % n AS dst FROM lineitem CROSS JOIN nf) WHERE src <> dst""",
    "imp": """SELECT i.src AS src_fid, i.dst AS dst_fid, a.path AS src, b.path AS dst,
        CASE WHEN (i.src + i.dst) % 3 = 0 THEN 'named' WHEN (i.src + i.dst) % 3 = 1 THEN 'namespace' ELSE 'none' END AS how, concat('ns', CAST(i.dst % 7 AS STRING)) AS ns, s.name AS bound
        FROM imp0 i JOIN files a ON i.src = a.fid JOIN files b ON i.dst = b.fid JOIN sym0 s ON s.pid = i.dst""",
    # sparse: one import of each file that was parsed, so that there are several cycles and files without neighbours
    "spa0": """SELECT fid AS src, (3 * fid + CAST(floor(abs(mtime_ms)) AS BIGINT)) % n AS dst FROM files CROSS JOIN nf WHERE status IS NULL OR status = 'parsed'""",
    "sparse": """SELECT DISTINCT a.path AS src, b.path AS dst FROM spa0 i JOIN files a ON i.src = a.fid JOIN files b ON i.dst = b.fid WHERE i.src <> i.dst""",
    # dense: a link from each line item's supplier to the file of its part, all of them
    "dense": """SELECT a.path AS src, b.path AS dst FROM (SELECT DISTINCT l_suppkey AS x, l_partkey % n AS y FROM lineitem CROSS JOIN nf) JOIN files a ON x = a.fid JOIN files b ON y = b.fid WHERE x <> y""",
    # hunks: hid, fid, file, start, stop
    "hunks": """SELECT o_orderkey AS hid, f.fid, f.path AS file, CAST(o_orderkey AS INT) AS start, CAST(o_orderkey + 5 AS INT) AS stop FROM orders CROSS JOIN nf JOIN files f ON o_custkey % n = f.fid""",
    # runs: one experiment run for each document
    "runs": """SELECT source AS block_id, concat('a', CAST(d.doc_id % 4 AS STRING)) AS arm_id, l.quality = 1 AS success, CASE WHEN l.toxic = 1 THEN NULL ELSE n_chars END AS tokens, n_chars * 2 AS wall_ms, d.doc_id % 97 = 0 AS excluded, d.doc_id
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}


def needed(body: str) -> list[str]:
    """The expressions that a statement uses, in order of definition."""
    used: set[str] = set()
    todo = body
    for name in reversed(CTES):
        if re.search(rf"\b{name}\b", todo):
            used.add(name)
            todo += " " + CTES[name]
    return [n for n in CTES if n in used]


def with_ctes(body: str, extra: str = "", recursive: bool = False) -> str:
    """A statement over the index tables; extra: further expressions, comma-separated."""
    parts = [f"{n} AS ({CTES[n]})" for n in needed(body + " " + extra)] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body


_BASE = ("supplier", "part", "lineitem", "orders", "documents", "labels")


class Adapter:
    """Index tables of one data folder as DataFrames, made from the same SQL as the oracle's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, body: str) -> DataFrame:
        text = with_ctes(body)
        used = {t: self.table(t) for t in _BASE if re.search(rf"\b{t}\b", text)}
        for t in used:
            text = re.sub(rf"\b{t}\b(?!_)", "{" + t + "}", text)
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in CTES:
            raise AttributeError(name)
        if name not in self._made:  # made once, as the tables of an index would be
            self._made[name] = kept(self._numbered_calls() if name == "calls" else self.sql(f"SELECT * FROM {name}"))
        return self._made[name]

    def _numbered_calls(self) -> DataFrame:
        """The rows of ``calls``."""
        owners = self.symbols.select(F.col("pid").alias("from_pid"), F.col("id").alias("from_id"), F.col("name").alias("from_name"))
        return self.calls_of(owners).select("fid", "file", "name", "line", "from_pid", "from_id", "from_name", "qualifier", "seq")

    def calls_of(self, owners: DataFrame) -> DataFrame:
        """Calls with what owners (``from_pid`` and more) say: sites are dealt out by file to be made distinct and numbered, and once more to meet their owners."""
        sites = self.sql(CTES["call0"].replace("SELECT DISTINCT", "SELECT", 1)).repartition("fid").distinct()
        order = Window.partitionBy("fid").orderBy("line", "name", F.coalesce("from_pid", F.lit(-1)), F.coalesce("qualifier", F.lit("")))
        files = self.files.select("fid", F.col("path").alias("file"))
        return sites.withColumn("seq", F.row_number().over(order)).join(files, "fid").join(owners, "from_pid", "left")
