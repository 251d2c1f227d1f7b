"""The user's queries over one repository's index."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.checkpoints import kept, kept_in_order
from codeloom.functions import scalars as X
from codeloom.operators import change, context, diff, evidence, excerpts, graph, imports, incremental, references, search
from codeloom.parsing import extract as E
from codeloom.plans import report
from codeloom.sources import git, store, tree


class CodeIndex:
    """Index tables of one root. ``refresh`` makes or renews them; every query is one plan over them."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, DataFrame]):
        self.spark, self.root, self.tables = spark, root, tables
        self.files, self.symbols, self.imports, self.calls = (tables[t] for t in ("files", "symbols", "imports", "calls"))
        self._edges = self._graph = self._resolved = None

    # -- maintenance
    @classmethod
    def refresh(cls, spark: SparkSession, root: str, base: str, *, forced: list[str] = (), exclude: list[str] = ()) -> CodeIndex:
        """Scan, extract what changed, keep the rest, and write a new generation if anything differs."""
        tree.register(spark)
        reader = spark.read.format("source_tree").option("root", root).option("excludeDirs", ",".join(exclude))
        previous = store.load(spark, base, root)
        scan = reader.option("code", "false").load().drop("code")
        if previous:
            plan = kept(incremental.plan(scan, previous["files"], list(forced)))
            stale = [r.path for r in plan.where("action = 'extract'").select("path").collect()]
            gone = not previous["files"].join(plan, "path", "left_anti").isEmpty()
            if not stale and not gone:
                return cls(spark, root, previous)
            sources = tree.read_files(plan.where("action = 'extract'").select("path").repartition(max(2, spark.sparkContext.defaultParallelism)), root)
        else:
            plan, sources = None, reader.option("code", "true").load()
        fresh = kept(E.extract(sources.repartition(max(2, spark.sparkContext.defaultParallelism))))
        tables = cls._tables(scan, fresh)
        if plan is not None:
            reused = plan.where("action = 'reuse'").select("path")
            old_files = previous["files"].drop("seq").join(reused, "path", "left_semi")
            tables["files"] = cls._numbered(tables["files"].drop("seq").unionByName(old_files))
            for t in ("symbols", "imports", "calls"):
                tables[t] = incremental.merge(plan, previous[t], tables[t], "file")
            same = all(incremental.difference(tables[t], previous[t], "path" if t == "files" else "file").isEmpty() for t in tables)
            if same:
                return cls(spark, root, previous)
        store.save(spark, base, root, tables)
        return cls(spark, root, store.load(spark, base, root))

    @staticmethod
    def _numbered(files: DataFrame) -> DataFrame:
        from pyspark.sql.window import Window

        w = Window.partitionBy("root").orderBy("path")  # files of one repository
        return files.withColumn("seq", F.row_number().over(w).cast("int")).select(*S.FILES.names)

    @classmethod
    def _tables(cls, scan: DataFrame, fresh: DataFrame) -> dict[str, DataFrame]:
        files = scan.join(fresh.select("path", "diagnostic"), "path").select("root", "path", "lang", "mtime_ms", "diagnostic")
        return {"files": cls._numbered(files), **E.tables(fresh)}

    @classmethod
    def from_sources(cls, spark: SparkSession, sources: list[tuple[str, str]], root: str = "mem") -> CodeIndex:
        """An index of (path, code) pairs."""
        df = spark.createDataFrame([(root, p, E.language_for(p), 0.0, c) for p, c in sources], "root string, path string, lang string, mtime_ms double, code string")
        fresh = kept(E.extract(df))
        return cls(spark, root, {k: kept(v) for k, v in cls._tables(df, fresh).items()})

    # -- shared tables
    @property
    def resolved(self) -> DataFrame:
        if self._resolved is None:
            self._resolved = kept(imports.resolve(self.imports, self.files))
        return self._resolved

    @property
    def module_graph(self) -> DataFrame:
        if self._graph is None:
            self._graph = kept(imports.module_graph(self.resolved))
        return self._graph

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = kept(references.edges(self.files, self.symbols, self.imports, self.calls))
        return self._edges

    # -- queries
    def status(self) -> DataFrame:
        return search.status(self.files, self.symbols)

    def integrity(self) -> DataFrame:
        return search.integrity(self.files)

    def find_symbols(self, query: str = "", *, file: str | None = None, kind: str | None = None, exported_only: bool = False, limit: int = 50) -> DataFrame:
        return search.ranked(self.symbols, self.calls, query, limit=limit, file=file, kind=kind, exported_only=exported_only)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.ranked(self.symbols, self.calls, query, limit=limit)

    def map(self, files: int = S.MAP_FILES) -> DataFrame:
        dens = search.density(self.symbols)
        nodes = dens.select(F.lit(self.root).alias("root"), "path", F.col("density").alias("weight"))
        ranks = graph.ranked(nodes, self.module_graph.withColumn("root", F.lit(self.root)))
        return graph.repo_map(self.symbols, ranks, dens, files=files)

    def map_text(self, chars: int = S.MAP_CHARS) -> str:
        return report.render_map([r.asDict(recursive=True) for r in self.map().collect()], max(200, chars))

    def refs(self, name: str, direction: str = "callers", limit: int = 50) -> DataFrame:
        if direction == "callers":
            # ArkTS calls match by their edges; names alone would catch built-in components
            arkts = self.files.where("lang = 'arkts'").select(F.col("path").alias("file"))
            plain = self.calls.join(arkts, "file", "left_anti").where(F.col("name") == name).select("file", "line", "from_name")
            ids = self.symbols.where(F.col("name") == name).select(F.col("id").alias("target_id"))
            sources = self.symbols.select(F.col("id").alias("source_id"), F.col("name").alias("from_name"))
            by_edge = self.edges.join(arkts, self.edges.call_file == arkts.file, "left_semi").join(ids, "target_id").join(sources, "source_id", "left")
            by_edge = by_edge.select(F.col("call_file").alias("file"), F.col("call_line").alias("line"), F.coalesce("from_name", F.lit("")).alias("from_name"))
            return plain.unionByName(by_edge).orderBy("file", "line", "from_name").limit(limit)
        order = self.files.select(F.col("path").alias("file"), F.col("seq").alias("file_seq"))
        return references.callees_of(self.calls.join(order, "file"), self.symbols, name, limit)

    def health(self, limit: int = 50) -> dict[str, DataFrame]:
        g = self.module_graph
        return {"cycles": graph.import_cycles(g.withColumn("root", F.lit(self.root))).orderBy("members").limit(limit), "orphans": graph.orphans(self.files, self.symbols, g).orderBy("path").limit(limit)}

    def change_context(self, *, diff_text: str | None = None, files: list[str] | None = None, symbols: list[str] | None = None, base_ref: str | None = None, base_sources: dict[str, str] | None = None, focus_files: list[str] = (), only_files: set[str] | None = None, **limits) -> dict:
        """What a change touches and reaches. Exactly one of diff_text, files, symbols and base_ref says what changed.

        base_sources: contents of changed files before the change; with base_ref they come from git. A diff without them
        runs no git command, and its changes stay unclassified.
        """
        if sum(x is not None for x in (diff_text, files, symbols, base_ref)) != 1:
            raise ValueError("give exactly one of diff_text, files, symbols, base_ref")
        at = {k: X.clamp(limits.get(k), k) for k in ("max_depth", "max_impact", "max_paths", "max_tests")}
        unmapped: list[dict] = []
        sym = self.symbols
        if files is not None or symbols is not None:
            for f in files or []:
                if not f or f.startswith(("/", "\\")) or re.search(r"(^|/)\.\.(/|$)|\x00|^[A-Za-z]:", f):
                    raise ValueError(f"unsafe path: {f!r}")
            hit = sym.where(F.col("file").isin(list(files)) if files is not None else F.col("name").isin(list(symbols)) | F.col("id").isin(list(symbols)))
            changed = hit.withColumns({"side": F.lit("current"), "change": F.lit("unclassified")})
            paths = self.spark.createDataFrame([(f,) for f in files or []], "path string") if files else hit.select(F.col("file").alias("path")).distinct()
        else:
            text = self.spark.createDataFrame([("d", diff_text)], "diff_id string, text string")
            rows = kept(diff.check_paths(git.working_tree_changes(self.spark, self.root, base_ref) if base_ref else diff.changes(text).drop("diff_id")))
            paths = rows.select(F.explode(F.array("old_path", "new_path")).alias("path")).where("path is not null").distinct()
            old = [r[0] for r in rows.where("old_path is not null").select("old_path").collect()]
            if base_ref:
                base_sources = {p: c for p in old if (c := git.file_at(self.root, base_ref, p)) is not None}
            base = CodeIndex.from_sources(self.spark, list((base_sources or {}).items())).symbols if base_sources else self.symbols.limit(0)
            ranges = kept(diff.ranges(rows))
            now = diff.overlaps(ranges.where("side = 'current'"), sym).select(*sym.columns).distinct()
            was = diff.overlaps(ranges.where("side = 'base'"), base).select(*sym.columns).distinct()
            key = ["file", "kind", "name", "scope_names"]
            known = diff.classify(diff.identity_counts(sym), diff.identity_counts(base)).select(*key, "change")
            scope = F.to_json(F.transform("scope", lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"))))
            has_base = self.spark.createDataFrame([(p,) for p in base_sources or {}], "file string").withColumn("has_base", F.lit(True))
            added = rows.where("status = 'added'").select(F.col("new_path").alias("file"), F.lit(True).alias("is_new"))
            label = F.when(F.col("is_new"), "added").when(F.col("has_base"), F.col("change")).otherwise("unclassified")
            name = lambda df: df.withColumn("scope_names", scope).join(known, key, "left").join(has_base, "file", "left").join(added, "file", "left").withColumn("change", F.coalesce(label, F.lit("unclassified")))
            gone = name(was).where("change = 'deleted'").withColumn("side", F.lit("base"))
            changed = name(now).withColumn("side", F.lit("current")).select(*sym.columns, "side", "change").unionByName(gone.select(*sym.columns, "side", "change"))
            lost = diff.outside(ranges.where("side = 'current'"), sym)
            unmapped = [r.asDict() for r in lost.orderBy("file", "start").limit(report.XRAY["unmapped"] + 1).collect()]
        touched = paths
        if only_files is not None:  # before any limit, so that nothing else takes the task's place
            changed, paths = changed.where(F.col("file").isin(list(only_files))), paths.where(F.col("path").isin(list(only_files)))
        changed = kept_in_order(changed.orderBy("side", "file", "line", "id"))
        top = [r.asDict(recursive=True) for r in changed.select("id", "name", "kind", "file", "line", "end_line", "side", "change").limit(at["max_impact"] + 1).collect()]
        seeds = changed.select("id", F.monotonically_increasing_id().alias("ord"))  # in the order of the checkpointed rows
        info = sym.select("id", "name", "kind", "file", "line")
        reach = kept(graph.impact(self.edges, seeds, at["max_depth"]))
        direct = kept(graph.direct_callers(self.edges, seeds)).join(info, "id").orderBy("file", "line", "id")
        far = reach.where("depth >= 2").join(info, "id")
        if focus_files:
            far = far.join(graph.focus_ancestors(reach, sym, list(focus_files), at["max_depth"]).withColumn("focus", F.lit(1)), "id", "left").withColumn("focus", F.coalesce("focus", F.lit(0)))
        else:
            far = far.withColumn("focus", F.lit(0))
        far = far.orderBy(F.desc("focus"), "depth", F.desc("strength"), "file", "line", "id")
        named = lambda df, n: [r.asDict() for r in df.withColumn("resolution", X.label_of(F.col("strength"))).limit(n + 1).collect()]
        callers, impact = named(direct, at["max_impact"]), named(far, at["max_impact"])
        entries = graph.entry_symbols(sym, references.incoming_counts(self.edges))
        found = graph.entry_paths(self.edges, changed.select("id").distinct(), entries, at["max_depth"])
        e, c = info.select(*[F.col(k).alias(f"entry_{k}") for k in info.columns]), info.select(*[F.col(k).alias(f"changed_{k}") for k in info.columns])
        found = found.join(e, "entry_id").join(c, "changed_id").withColumn("resolution", X.label_of(F.col("strength"))).orderBy("entry_file", "entry_line", "changed_file", "changed_line", "entry_id").limit(at["max_paths"] + 1)
        paths_ = [{"entry": r.entry_name, "changed": r.changed_name, "changed_id": r.changed_id, "depth": r.depth, "resolution": r.resolution, "hops": [h.asDict() for h in r.hops]} for r in found.collect()]
        known_paths = self.files.select("path").unionByName(paths.select("path")).distinct()
        resolved = imports.resolve(self.imports, known_paths)  # files that the change deleted can still be imported
        deps = [r.asDict() for r in change.dependents(resolved, paths).orderBy("file", "changed_file", "specifier").limit(at["max_impact"] + 1).collect()]
        impact_files = reach.where("depth >= 2").join(info, "id").groupBy(F.col("file").alias("path")).agg(F.min("depth").alias("depth"))
        tests = change.ordered_tests(change.affected_tests(self.files, imports.module_graph(resolved), self.calls, paths, changed.select("name"), impact_files), at["max_tests"] + 1)
        tests = [r.asDict() for r in tests.collect()]
        said = evidence.summary(self.files, self.calls, self.edges, changed.select("id", "file"))
        counts = said.first().asDict()
        gaps = [r[0] for r in evidence.gaps(said).collect()]
        full = {"changed": (top, at["max_impact"]), "unmapped": (unmapped, report.XRAY["unmapped"]), "callers": (callers, at["max_impact"]), "impact": (impact, at["max_impact"]), "paths": (paths_, at["max_paths"]), "dependents": (deps, at["max_impact"]), "tests": (tests, at["max_tests"])}
        return {"files": [r[0] for r in touched.orderBy("path").collect()], "gaps": gaps, "evidence": counts, "truncated": {k: len(v) > n for k, (v, n) in full.items()}, **{k: v[:n] for k, (v, n) in full.items()}}

    def change_text(self, **options) -> str:
        return report.render_change(self.change_context(**options))

    def xray(self, **options) -> dict:
        return report.check_xray(report.xray(self.change_context(**options)))

    def review(self, budget_chars: int | None = None, **options) -> dict:
        return report.review(self.change_context(**options), X.clamp(budget_chars, "budget_chars"))

    def context(self, task: str, *, budget_chars: int | None = None, max_files: int | None = None, max_symbols: int | None = None, sources: DataFrame | None = None, base_ref: str | None = None) -> dict:
        """A pack of what a task needs, within a budget of characters. sources (``path, code``) give excerpts."""
        budget, n_files, n_symbols = X.clamp(budget_chars, "budget_chars"), X.clamp(max_files, "max_files"), X.clamp(max_symbols, "max_symbols")
        tasks = self.spark.createDataFrame([(0, task)], "task_id int, task string")
        names = [r.name for r in context.exact_names(tasks, self.symbols).orderBy("name").limit(n_symbols).collect()]
        kind = tasks.select(context.route(F.col("task"), F.lit(bool(names)))).first()[0]
        tokens = [t.replace("\\", "/") for t in re.findall(r"[A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+", task)]
        mention = F.lit(False)
        for t in tokens:
            mention = mention | X.file_mention(F.col("path"), F.lit(t))
        mentioned = [r.path for r in self.files.where(mention).select("path").orderBy("path").limit(n_files).collect()]
        primary = context.primary_symbols(self.symbols, task, names=names, mentioned=mentioned, limit=n_symbols, ambiguous=kind == "ambiguous")
        rows = [r.asDict() for r in primary.collect()]
        own_files = {r["file"] for r in rows}
        changed = self.change_context(base_ref=base_ref, focus_files=mentioned, only_files=own_files or None) if base_ref and kind in ("change", "test") else None
        none = self.spark.createDataFrame([], "path string, depth int")

        def seed_tests(paths: set[str], names: set[str]) -> DataFrame:
            own = [self.spark.createDataFrame([(x,) for x in sorted(given)], f"{c} string") for given, c in ((paths, "path"), (names, "name"))]
            return change.affected_tests(self.files, self.module_graph, self.calls, *own, none)

        if changed and rows:
            found = seed_tests({r["file"] for r in changed["changed"]}, {r["name"] for r in changed["changed"]})
            changed["tests"] = [r.asDict() for r in change.ordered_tests(found).collect()]
        ids = self.spark.createDataFrame([(r["id"],) for r in rows], "id string")
        around = references.neighbours(self.edges, ids).join(self.symbols.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("file").alias("other_file")), "other") if kind != "ambiguous" else None
        near = [r.asDict() for r in around.orderBy("id", "direction", "call_line", "other").collect()] if around is not None else []
        pool = {"mentioned": self.spark.createDataFrame([(p,) for p in mentioned], "path string"), "primary": self.spark.createDataFrame([(r["file"], float(r["score"]) + 45) for r in rows], "path string, score double")}
        if changed:
            pool["changed-path"] = self.spark.createDataFrame([(f,) for f in changed["files"]], "path string")
            pool["affected-test"] = self.spark.createDataFrame([(t["file"],) for t in changed["tests"]], "path string")
            pool["import-dependent"] = self.spark.createDataFrame([(d["file"],) for d in changed["dependents"]], "path string")
        else:
            seed = seed_tests({r["file"] for r in rows} | set(mentioned), {r["name"] for r in rows})
            pool["affected-test"] = seed.select(F.col("file").alias("path"))
        if not rows and kind in ("architecture", "exploration", "ambiguous"):
            pool["map"] = self.map(n_files).select("path", F.least(F.lit(35.0), F.col("score") + 10).alias("score"))
        files = [r.asDict() for r in context.relevant_files(pool, n_files).collect()]
        forms: dict[str, list] = {}
        if sources is not None and rows:
            own = self.spark.createDataFrame([(r["id"], r["file"], r["line"], r["end_line"], r["signature"]) for r in rows], "id string, path string, line int, end_line int, signature string")
            decl = own.join(sources.select("path", F.col("code").alias("text")), "path").withColumn("focus", F.lit(None).cast("int"))
            for r in excerpts.variants(decl).orderBy("id", "rank").collect():
                forms.setdefault(r.id, []).append(r)
        items = []
        for i, r in enumerate(rows):
            head = f"{r['kind']} {r['name']} {r['file']}:{r['line']} {r['signature']}"
            own = [{"head": head, "file": r["file"], "start": x.start, "lines": x.excerpt.split("\n")} if x.form != "signature" else f"{head}\n{x.excerpt}" for x in forms.get(r["id"], [])]
            items.append({"key": r["id"], "file": r["file"], "priority": 100 if i < 4 else 45, "forms": [*own, head]})
        for c in changed["changed"] if changed else []:
            items.append({"key": ("change", c["id"], c["side"]), "file": c["file"], "priority": 80 if c["side"] == "current" else 40, "text": f"{c['change']} {c['kind']} {c['name']} {c['file']}:{c['line']}"})
        for n in near:
            strong = n["resolution"] != "name-only"
            items.append({"key": (n["id"], n["direction"], n["other"]), "file": n["other_file"], "priority": 75 if strong else 20, "text": f"{n['direction']} {n['other_name']} {n['other_file']} [{n['resolution']}]"})
        for i, f in enumerate(files):
            test = f["reason"] == "affected-test"
            items.append({"key": ("file", f["path"]), "priority": (60 if i < 2 else 30) if test else 35 if f["reason"] == "import-dependent" else 10, "text": f"{f['reason']} {f['path']}"})
        chosen = report.select_pack(items, budget, n_files)
        return {"kind": kind, "symbols": rows, "files": files, "neighbours": near, "items": chosen, "text": report.render_pack(chosen, budget), "change": changed}

    def read_sources(self, paths: list[str]) -> DataFrame:
        """Current text of indexed files only: inside the root, at most a megabyte, unchanged since they were indexed."""
        known = self.files.where(F.col("path").isin(list(paths))).select("path", "mtime_ms")
        root, out = os.path.realpath(self.root), "path string, code string"

        def run(batches):
            import pandas as pd

            for b in batches:
                codes = []
                for p, ms in zip(b["path"], b["mtime_ms"], strict=True):
                    full, code = os.path.realpath(os.path.join(root, p)), None
                    try:
                        before = os.stat(full)
                        if full.startswith(root + os.sep) and before.st_size <= tree.MAX_BYTES and before.st_mtime_ns / 1e6 == ms:
                            with open(full, encoding="utf-8", errors="replace") as f:
                                code = f.read()
                            code = code if os.stat(full).st_mtime_ns == before.st_mtime_ns else None
                    except OSError:
                        code = None
                    codes.append(code)
                yield pd.DataFrame({"path": b["path"], "code": codes})

        return known.mapInPandas(run, out).where("code is not null")
