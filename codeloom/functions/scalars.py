"""Scalar expressions over columns; all of them stay in the JVM."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import schema as S


def clamp(value: float | None, name: str) -> int:
    """A limit given by a user: floored and bounded; the default where it isn't a finite number."""
    low, high, default = S.LIMITS[name]
    if value is None or isinstance(value, bool) or not math.isfinite(value):
        return default
    return min(high, max(low, math.floor(value)))


def subsequence_pattern(query: str) -> str:
    """Regular expression of the names that hold the query's characters in order."""
    return ".*".join(re.escape(c) for c in query)


def match_score(name: Column, query: str) -> Column:
    """1 equal, 0.8 prefix, 0.5 substring, 0.3 subsequence (of three characters or more), else 0; case-insensitive."""
    q, n = query.lower(), F.lower(name)
    near = n.rlike("(?s)" + subsequence_pattern(q)) if len(q) >= 3 else F.lit(False)
    return F.when(n == q, 1.0).when(F.startswith(n, F.lit(q)), 0.8).when(F.contains(n, F.lit(q)), 0.5).when(near, 0.3).otherwise(0.0)


def _locate(c: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", c, text, start)


def is_subsequence(needle: Column, haystack: Column) -> Column:
    """Whether all characters of needle occur in haystack in order, for needles that differ by row."""
    step = lambda at, c: F.when(at < 0, at).otherwise(F.when(_locate(c, haystack, at + 1) > 0, _locate(c, haystack, at + 1)).otherwise(F.lit(-1)))
    return F.aggregate(F.filter(F.split(needle, ""), lambda c: c != ""), F.lit(0), step) >= 0


def is_test_path(path: Column, insensitive: bool = False) -> Column:
    return path.rlike(("(?i)" if insensitive else "") + S.TEST_PATH)


def is_entry_file(path: Column, wide: bool = False) -> Column:
    return path.rlike(S.ENTRY_FILE_WIDE if wide else S.ENTRY_FILE)


def is_plain_test_name(path: Column) -> Column:
    """The reduced test predicate of context packs: only spec and test suffixes and test folders."""
    return path.rlike(r"(^|/)(tests?|__tests__)/|\.(spec|test)\.")


def kind_weight(kind: Column) -> Column:
    out = None
    for k, w in S.KIND_WEIGHTS.items():
        out = F.when(kind == k, F.lit(w)) if out is None else out.when(kind == k, F.lit(w))
    return out.otherwise(F.lit(S.OTHER_WEIGHT))


def strength(label: Column) -> Column:
    out = None
    for k, w in S.STRENGTH.items():
        out = F.when(label == k, F.lit(w)) if out is None else out.when(label == k, F.lit(w))
    return out


def label_of(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("name-only"), F.lit("import-scoped"), F.lit("exact")), rank)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit(None).cast("string")
    for lang, exts in S.LANGUAGES.items():
        out = F.when(ext.isin(exts), F.lit(lang)).otherwise(out)
    return out


def path_stem(path: Column) -> Column:
    """File name without folders, extension and test marks."""
    base = F.element_at(F.split(path, "/"), -1)
    base = F.regexp_replace(base, r"\.[^.]+$", "")
    base = F.regexp_replace(base, r"\.(spec|test)$", "")
    base = F.regexp_replace(base, r"^test_", "")
    return F.regexp_replace(base, r"_test$", "")


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def normalise(path: Column) -> Column:
    """POSIX normal form of a relative path; a trailing slash stays."""

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        up = (x == "..") & last.isNotNull() & (last != "..")
        return F.when((x == "") | (x == "."), acc).when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(parts, "/"), F.when(F.endswith(path, F.lit("/")) & (F.size(parts) > 0), F.lit("/")).otherwise(F.lit("")))


def specifier_tail(specifier: Column) -> Column:
    """Last segment of a specifier, without quotes and extension."""
    last = F.element_at(F.split(F.regexp_replace(specifier, "[\"']", ""), r"[/:]+"), -1)
    return F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "")


def dotted_to_path(name: Column) -> Column:
    return F.translate(name, ".", "/")


def python_relative(specifier: Column) -> Column:
    """``.a.b`` -> ``./a/b``, ``..a`` -> ``../a``: one dot is the own package, each further one a level up."""
    dots = F.length(F.regexp_extract(specifier, r"^\.+", 0))
    rest = dotted_to_path(F.regexp_replace(specifier, r"^\.+", ""))
    return F.when(dots == 0, rest).when(dots == 1, F.concat(F.lit("./"), rest)).otherwise(F.concat(F.repeat(F.lit("../"), dots - 1), rest))


def rust_use_path(path: Column) -> Column:
    """Base path of a use item: without the crate's prefix, lists, aliases and globs."""
    base = F.regexp_replace(F.regexp_replace(path, r"\s+as\s+\w+$", ""), r"::(\{.*|\*)$", "")
    return F.regexp_replace(base, "::", "/")


def encode_component(text: Column) -> Column:
    """Percent-encoding of an id component."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signature(text: Column, cap: int = 80) -> Column:
    flat = collapse_space(text)
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 3), F.lit("..."))).otherwise(flat)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def go_exported(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def root_key(root: Column) -> Column:
    """Cache key of a repository root."""
    return F.substring(F.sha1(root), 1, 12)


def file_mention(path: Column, mention: Column) -> Column:
    p, m = F.lower(path), F.lower(mention)
    return (p == m) | F.endswith(p, F.concat(F.lit("/"), m))


def mentions_name(text: Column, name: Column) -> Column:
    """Whether an identifier stands in a text as a whole word (ASCII word characters)."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, "[^A-Za-z0-9_$]+", " "), F.lit(" "))
    return F.contains(spaced, F.concat(F.lit(" "), name, F.lit(" ")))


def context_terms(text: Column) -> Column:
    """Distinct search terms of a task: concept bridge, camel-case split, lower case, stop words, stems."""
    bridged = F.concat_ws(" ", text, *[F.when(text.rlike(f"(?i)({k})"), F.lit(v)) for k, v in S.CONCEPTS.items()])
    camel = F.regexp_replace(F.regexp_replace(bridged, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.filter(F.split(F.lower(camel), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(S.STOP_WORDS))
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    stems = lambda w: F.filter(
        F.array(
            w,
            F.when((F.length(w) > 5) & F.endswith(w, F.lit("ing")), cut(w, 3)),
            F.when((F.length(w) > 5) & F.endswith(w, F.lit("ed")), cut(w, 1)),
            F.when((F.length(w) > 5) & F.endswith(w, F.lit("ed")), cut(w, 2)),
            F.when((F.length(w) > 4) & F.endswith(w, F.lit("s")), cut(w, 1)),
        ),
        lambda x: x.isNotNull(),
    )
    return F.array_distinct(F.flatten(F.transform(parts, stems)))


def imul32(x: Column, y: Column) -> Column:
    """Product of two unsigned 32-bit numbers held in longs, modulo 2^32, without overflow."""
    low = lambda c: c.bitwiseAND(F.lit(65535).cast("long"))
    high = F.shiftright(x, 16)
    return (low(x) * y + F.shiftleft(low(high * low(y)), 16)).bitwiseAND(F.lit(4294967295).cast("long"))


def mulberry32(seed: Column, draw: Column) -> Column:
    """Draw number ``draw`` (1-based) of the public mulberry32 generator, in [0, 1): a pure function of seed and number."""
    mask = lambda c: c.bitwiseAND(F.lit(4294967295).cast("long"))
    state = mask(seed.cast("long") + mask(draw.cast("long") * F.lit(1831565813).cast("long")))
    t = imul32(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1).cast("long")))
    t2 = mask(t + imul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long"))))
    t = t.bitwiseXOR(t2)
    return mask(t.bitwiseXOR(F.shiftright(t, 14))) / F.lit(4294967296.0)
