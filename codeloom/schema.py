"""Schemas of the index tables and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 4

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCOPE = T.ArrayType(_struct(kind=_S, name=_S, ordinal=_I))
BINDINGS = T.ArrayType(_struct(imported=_S, local=_S, kind=_S))
DIAGNOSTIC = _struct(status=_S, error_count=_I, missing_count=_I, issues=T.ArrayType(_struct(kind=_S, line=_I)), reason=_S)
FILES = _struct(root=_S, path=_S, lang=_S, mtime_ms=_D, diagnostic=DIAGNOSTIC, seq=_I)
SYMBOLS = _struct(
    id=_S, name=_S, kind=_S, file=_S, line=_I, end_line=_I, exported=_B, signature=_S, scope=SCOPE, ordinal=_I, decorators=T.ArrayType(_S), container_path=_S, self_path=_S, seq=_I
)
IMPORTS = _struct(file=_S, seq=_I, specifier=_S, line=_I, kind=_S, bindings=BINDINGS)
CALLS = _struct(file=_S, seq=_I, name=_S, line=_I, from_name=_S, from_id=_S, qualifier=_S, context=_S)
EDGES = _struct(source_id=_S, target_id=_S, call_file=_S, call_line=_I, name=_S, provenance=_S, resolution=_S, strength=_I, candidate_count=_I, seq=_L)
TABLES = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "calls": CALLS}
HUNKS = T.ArrayType(_struct(old_start=_I, old_lines=_I, new_start=_I, new_lines=_I))
CHANGES = _struct(old_path=_S, new_path=_S, status=_S, hunks=HUNKS)
RUNS = _struct(
    run_id=_S, block_id=_S, task_id=_S, category=_S, arm_id=_S, seed=_I, model=_S, temperature=_D, wall_ms=_L, tokens=_struct(input=_L, output=_L, cached=_L, reasoning=_L, source=_S),
    tool_calls=_I, turns=_I, plugin_context_chars=_L, exit_code=_I, timed_out=_B, excluded=_B, exclusion_reason=_S, success=_B, notes=_S,
)

# Names, orders, weights, limits and patterns that results have to agree on.
EXCLUDED_DIRS = ["node_modules", ".git", ".idea", ".vscode", "dist", "build", "out", "coverage", ".next", ".nuxt", ".cache", "target", "vendor", ".codeloom"]
EXTENSIONS = [".ets", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".go", ".rs", ".java", ".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hxx", ".hh", ".h", ".ipp", ".tpp", ".inl", ".c"]
LANGUAGES = {
    "arkts": [".ets"], "typescript": [".ts", ".tsx", ".mts", ".cts"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py", ".pyi"], "go": [".go"], "rust": [".rs"], "java": [".java"],
    "cpp": [".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hxx", ".hh", ".h", ".ipp", ".tpp", ".inl"], "c": [".c"],
}
JS_TO_TS = {".js": [".ts", ".tsx"], ".jsx": [".tsx", ".ts"], ".mjs": [".mts", ".ts"], ".cjs": [".cts", ".ts"]}
KIND_WEIGHTS = {"class": 1.0, "interface": 1.0, "type": 0.8, "function": 0.8, "method": 0.7, "enum": 0.9, "variable": 0.25, "field": 0.2, "import": 0.05, "module": 0.3}
OTHER_WEIGHT, EXPORT_BONUS, BLOAT, TEST_DAMP = 0.3, 0.3, 0.04, 0.2
STRENGTH = {"exact": 3, "import-scoped": 2, "name-only": 1}
TEST_RANK = {"changed-test": 0, "imports-changed-file": 1, "imports-impact-file": 2, "references-symbol-name": 3, "path-convention": 4}
DAMPING, TOLERANCE, MAX_ROUNDS = 0.85, 1e-6, 100
#: Links of one graph that a worker holds at once; a larger graph is done in distributed form.
WORKER_LINKS = 1_000_000
CANDIDATE_CAP, MAP_FILES, MAP_SYMBOLS, MAP_CHARS, PAGERANK_WEIGHT = 8, 24, 18, 3200, 0.5
TEST_PATH = r"(^|/)(tests?|__tests__)(/|$)|\.(?:spec|test)\.(?:[cm]?[jt]sx?|ets)$|(^|/)(?:test_[^/]+\.py|[^/]+_test\.(?:py|go))$"
ENTRY_FILE = r"(^|/)(main|index|cli|server|app)\.[^./]+$"
ENTRY_FILE_WIDE = r"(^|/)(index|main|cli|app|server|mod|lib|__init__)\.[A-Za-z0-9]+$|(^|/)(bin|cmd|scripts)/|\.config\.[A-Za-z0-9]+$"
SDK_SPECIFIER = r"^@(ohos|kit)\."
# name: (least, most, default)
LIMITS = {
    "max_depth": (1, 6, 3), "max_impact": (1, 200, 40), "max_paths": (1, 50, 10), "max_tests": (1, 100, 20),
    "budget_chars": (300, 20000, 5000), "max_files": (1, 50, 12), "max_symbols": (1, 50, 10),
}
STOP_WORDS = "a an and are be by does for from how in is it my of on or the this to what where why with src lib test tests spec fix explain please help current change changes code repo repository function symbol git".split()
PROSE_WORDS = "config configuration loading startup file files path directory index scan tool flow coverage error errors impact source keep other behavior scope root".split()
CONCEPTS = {
    "忽略|白名单|嵌套规则|gitignore": "ignore git", "扫描": "scan", "索引": "index scan", "监听|watcher": "watch", "刷新": "refresh", "工具": "tool", "配置": "config", "加载": "load", "空白|空格": "whitespace", "启动": "startup",
}
TASK_CHANGE = r"(fix|bug|broken|breaks?|change|changed|current|working\s+tree|regression|impact|modified|duplicate|fails?|failure)"
TASK_TEST = r"(test|tests|spec|specs|failing|assert|coverage)"
TASK_ARCHITECTURE = r"(architecture|architectural|flow|loading|authentication|authorization|plugin|startup|overview|pipeline|lifecycle|design|works?)"
TASK_EXPLORE = r"(where|implement|add|feature|introduce|entry\s+point|similar|explore|understand|locate)"
CLAIM_DECIDE, CLAIM_PUBLISH = 30, 60
