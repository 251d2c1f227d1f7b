"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans, which may overlap: the fixed formats (kept as they are), looser forms of them such as
written-out mail addresses, phone numbers without a country code, IPv6 addresses and cards with other separators, and
secrets: long runs of the characters that keys and tokens are written in. Every loose span is
described by format features (digits, groups, separators) and context features (what stands before and after). Boosted
trees of its kind score it, and one threshold per kind, calibrated on held-out examples for precision, selects the redactions.
A selected span that touches a fixed one, or an earlier one of its kind, is not added again.

The trees are fitted on the driver to ``TRAIN_ROWS`` labelled examples that are generated here from templates (a bounded
set that doesn't depend on the corpus), and become nested CASE expressions; so the corpus is read in one pass without a
shuffle and without Python. Each regular expression runs in time linear in the text: a match may only start where a run
of its first character class starts or the last match ended.

Null texts have no spans; repeated rows give repeated rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.quality import let, text_of

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
CONTEXT = 24
TRAIN_ROWS, ROUNDS, RATE = 2000, 16, 0.4
PRECISION = 0.98
_BLOCK = 256

BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose forms. Bounded parts, so that a start costs bounded time.
LOOSE_PATTERNS = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.,/-])[0-9]{3,6}(?:[\x20./_-]{1,2}[0-9]{2,7}){2,5}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_.@-])[A-Za-z0-9+/_-]{20,256}={0,2}(?![A-Za-z0-9+/_=@-])",
    "phone": r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])",
}
_CONTEXT_WORDS = r"(?i)(?:tel|phone|telefon|mobile|mobil|cell|call|fax|whatsapp|mail|contact|reach|write|address|host|server)[a-zé]*\W{0,3}(?:\w{0,8}\W{1,2})?$"
_KEY_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|passphrase|bearer|credential|auth[a-z]*|api[_ -]?key|[a-z_]*key)[\"']?\s{0,2}[:=]{0,2}\s{0,2}[\"'`]?$"
_NUMBER_WORDS = r"(?i)(?:version|order|invoice|isbn|page|pages|chapter|section|total|price|date|no|nr|id|ref|build|score)\W{0,3}$"


# -- positions ---------------------------------------------------------------------------------------------------------
def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, stop, span, before, after)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(m: Column, g: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x))
        total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

        def of(s: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))
            ends = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

            def row(b: Column) -> Column:
                at = lambda i: F.get(b, F.floor(i / _BLOCK).cast("int")) + total(F.slice(s, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))
                item = lambda x, i: let(
                    at(i) + F.length(F.get(g, i)), lambda p: F.struct(p.alias("start"), (p + F.length(x)).alias("stop"), x.alias("span"), F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(g, i + 1), F.lit(CONTEXT)).alias("after"))
                )
                return F.transform(m, item)

            return let(ends, row)

        return let(steps, of)

    empty = F.array().cast("array<struct<start:int,stop:int,span:string,before:string,after:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(let(gaps, lambda g: placed(m, g))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        value = lambda i: F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.floor(value(i) / 10).cast("int") + value(i) % 10) % 10 == 0

    return let(digits, of)


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(span, "\\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(_digits(span), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda c: _valid(kind, c["span"])


def _said(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.concat(F.lit(f"{kind}:"), c["start"].cast("string"), F.lit(":"), c["stop"].cast("string"))


def _tagged(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.lit(kind).alias("kind"))


# -- features and trees ------------------------------------------------------------------------------------------------
def features(kind: str, span: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numeric features of one candidate; the same expressions serve training and scoring."""
    count = lambda x, keep: F.length(F.regexp_replace(x, f"[^{keep}]", ""))
    flag = lambda c: c.cast("int")
    return {
        "digits": count(span, "0-9"),
        "length": F.length(span),
        "groups": F.size(F.split(span, r"[^0-9A-Za-z]+")),
        "spaces": count(span, " "),
        "dots": count(span, "."),
        "slashes": count(span, "/"),
        "dashes": count(span, r"\-"),
        "brackets": count(span, r"\(\)\[\]"),
        "zero_first": flag(span.rlike(r"^\(?0")),
        "year_like": flag(span.rlike(r"(?:19|20)[0-9]{2}")),
        "word_tail": flag(span.rlike(r"(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$")),
        "said_before": flag(before.rlike(_CONTEXT_WORDS)),
        "number_before": flag(before.rlike(_NUMBER_WORDS)),
        "digit_near": flag(before.rlike(r"[0-9]\W{0,2}$") | after.rlike(r"^\W{0,2}[0-9]")),
        "unit_after": flag(after.rlike(r"(?i)^ ?(?:%|€|\$|eur|usd|kg|km|m|cm|pages?|items?|years?)")),
        "sign_before": flag(before.rlike(r"[$€£=#]\s?$")),
        "key_before": flag(before.rlike(_KEY_WORDS)),
        "capitals": count(span, "A-Z"),
        "smalls": count(span, "a-z"),
        "hex_only": flag(span.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "known_first": flag(span.rlike(r"^(?:sk|pk|rk|gh[a-z]|xox[a-z]|AKIA|AIza|eyJ|glpat)[-_A-Za-z0-9]")),
        "card_before": flag(before.rlike(r"(?i)(?:card|carte|karte|tarjeta|visa|mastercard|amex|credit|pan)\W{0,3}(?:\w{0,8}\W{1,2})?$")),
    }


NAMES = ("digits", "length", "groups", "spaces", "dots", "slashes", "dashes", "brackets", "zero_first", "year_like", "word_tail", "said_before", "number_before", "digit_near", "unit_after", "sign_before", "key_before", "capitals", "smalls", "hex_only", "known_first", "card_before")


def examples(seed: int = 7, n: int = TRAIN_ROWS) -> list[tuple[str, str, int]]:
    """(text, kind, label): generated texts with exactly the loose form asked for, personal or not."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice(["anna", "j.doe", "max", "info", "li.wei", "r_m", "sara"]) + rng.choice(["", "1", "77"])
    host = lambda: rng.choice(["mail", "example", "corp", "uni", "web"]) + number(rng.randrange(3))
    tail = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
    word = lambda: "".join(rng.choice(["an", "the", "re", "ou", "st", "on", "de", "ier"]) for _ in range(rng.randrange(1, 4)))
    filler = lambda: " ".join(rng.choice(["the", "of", "la", "und", "report", "was", "que", "entre", "shown", "we", "saw"]) for _ in range(rng.randrange(2, 6)))
    ask = lambda: rng.choice(["Tel: ", "phone ", "call me at ", "Telefon ", "Mobile: ", "fax ", "contact ", "reach us on "])
    at, dot = (lambda: rng.choice([" at ", " (at) ", " [at] ", "[at]"])), (lambda: rng.choice([" dot ", " (dot) ", "[dot]"]))
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    key = lambda: rng.choice(["token", "secret", "password", "api_key", "apikey", "auth", "access_key", "Bearer", "client_secret"]) + rng.choice([" = ", "=", ": ", " "]) + rng.choice(["", '"', "'"])
    said = lambda: rng.choice([some("0123456789abcdef", rng.choice([24, 32, 40, 64])), some(low + up + digits, rng.randrange(22, 60)), "sk-" + some(low + up + digits, 32), "ghp_" + some(low + up + digits, 36), "AKIA" + some(up + digits, 16), some(low + up + digits + "+/", 43) + "="])

    def card_number(parts: list[int], sep: str) -> str:
        body = number(sum(parts) - 1)
        total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
        full = body + str(-total % 10)
        return sep.join(full[sum(parts[:k]) : sum(parts[: k + 1])] for k in range(len(parts)))

    def dull() -> str:
        pick = rng.randrange(6)
        if pick == 0:
            return "".join(word() for _ in range(12))[: rng.randrange(20, 40)].ljust(20, "n")
        if pick == 1:
            return "/".join([word() for _ in range(8)] + ["index"])
        if pick == 2:
            return "-".join(word() for _ in range(9)).ljust(20, "-")
        if pick == 3:
            return rng.choice("-_=+")[:1].replace("=", "-") * rng.randrange(20, 60)
        if pick == 4:
            return number(rng.randrange(20, 30))
        return "".join(word().title() for _ in range(9)).ljust(20, "e")

    yes: dict[str, Callable[[], str]] = {
        "email": lambda: f"{filler()} {rng.choice(['mail ', 'write to ', 'contact: ', ''])}{name()}{at()}{host()}{dot()}{tail()} {filler()}",
        "phone": lambda: f"{filler()} {ask()}{rng.choice([f'({number(3)}) {number(3)}-{number(4)}', f'0{number(2)} {number(4)} {number(4)}', f'0{number(3)}/{number(3)} {number(3)}', f'{number(3)}-{number(3)}-{number(4)}', f'0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}'])} {filler()}",
        "card": lambda: f"{filler()} {rng.choice(['card ', 'Visa: ', 'credit card no ', 'paid with card ', ''])}{card_number(rng.choice([[4, 4, 4, 4], [4, 6, 5]]), rng.choice(['.', '/', '_', '  ']))} {filler()}",
        "secret": lambda: f"{filler()} {rng.choice([key(), key(), key(), ''])}{said()}{rng.choice(['', chr(34)])} {filler()}",
        "ip": lambda: f"{filler()} {rng.choice(['host ', 'from ', 'address '])}{':'.join(f'{rng.randrange(65536):x}' for _ in range(8))} {filler()}",
    }
    no: dict[str, Callable[[], str]] = {
        "email": lambda: f"{filler()} {rng.choice(['look', 'was', 'stood', 'met'])} at {rng.choice(['noon', 'home', 'the', word()])}.{rng.choice(['Then', 'The', 'It', 'He', 'De', 'Es', word().title()])} {filler()}",
        "phone": lambda: f"{filler()} {rng.choice(['version ', 'pages ', 'on ', 'order ', 'between ', '', 'total ', 'from '])}{rng.choice([f'{number(2)}/{number(2)}/20{number(2)}', f'20{number(2)}-{number(2)}-{number(2)}', f'19{number(2)}-20{number(2)}', f'{number(2)}.{number(2)}.{number(4)}', f'{number(3)} {number(3)}', f'{number(4)} {number(4)} {number(4)} {number(4)}', f'{number(2)}.{number(2)}', f'20{number(2)} 20{number(2)} 20{number(2)}'])}{rng.choice(['', ' %', ' km', ' pages'])} {filler()}",
        "card": lambda: f"{filler()} {rng.choice(['order ', 'ref ', 'isbn ', 'version ', 'total ', 'id '])}{card_number(rng.choice([[3, 2, 3, 3, 3], [5, 5, 5], [4, 2, 2, 2, 4]]), rng.choice(['.', '/', '_']))} {filler()}",
        "secret": lambda: f"{filler()} {rng.choice(['', '', 'key ', 'see ', 'id '])}{dull()} {filler()}",
        "ip": lambda: f"{filler()} {rng.choice(['time ', 'ref ', ''])}{':'.join(number(2) for _ in range(8))} {filler()}",
    }
    out = []
    for i in range(n):
        kind, label = ("email", "phone", "ip", "card", "secret")[i % 5], int(i // 5 % 2 == 0)
        out.append(((yes if label else no)[kind](), kind, label))
    return out


def fit(rows: list[tuple[list[float], int]], rounds: int = ROUNDS, rate: float = RATE) -> list:
    """Gradient-boosted trees of depth 2 for the logistic loss, on a bounded list of (features, label)."""
    xs, ys = [r[0] for r in rows], [r[1] for r in rows]
    scores = [0.0] * len(rows)

    def best_split(at: list[int], g: list[float], h: list[float]):
        total_g, total_h = sum(g[i] for i in at), sum(h[i] for i in at)
        best = (1e-9, None, None)
        for f in range(len(xs[0]) if at else 0):
            by: dict[float, list[float]] = {}
            for i in at:
                s = by.setdefault(xs[i][f], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            left_g = left_h = 0.0
            values = sorted(by)
            for a, b in zip(values, values[1:]):
                left_g, left_h = left_g + by[a][0], left_h + by[a][1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, f, (a + b) / 2)
        return best[1], best[2], rate * total_g / (total_h + 1)

    def grow(at: list[int], g, h, depth: int):
        f, cut, value = best_split(at, g, h)
        if f is None or depth == 0:
            return value
        return f, cut, grow([i for i in at if xs[i][f] <= cut], g, h, depth - 1), grow([i for i in at if xs[i][f] > cut], g, h, depth - 1)

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = grow(list(range(len(rows))), [y - q for y, q in zip(ys, p, strict=True)], [q * (1 - q) for q in p], 2)
        trees.append(tree)
        scores = [s + value_of(tree, x) for s, x in zip(scores, xs, strict=True)]
    return trees


def value_of(tree, x: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def as_column(trees: list, x: Callable[[str], Column]) -> Column:
    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(x(NAMES[tree[0]]) <= F.lit(float(tree[1])), one(tree[2])).otherwise(one(tree[3]))

    out = F.lit(0.0)
    for t in trees:
        out = out + one(t)
    return out


def calibrated(scored: list[tuple[float, int]], precision: float = PRECISION) -> float:
    """The lowest threshold from which on held-out precision holds, but never below even odds; infinite if none does.

    It lies halfway between the lowest score that it lets in and the next lower one.
    """
    best, hits, ranked = math.inf, 0, sorted(scored, reverse=True)
    for n, (score, label) in enumerate(ranked, 1):
        hits += label
        below = ranked[n][0] if n < len(ranked) else score - 1
        if below < score and hits / n >= precision:  # equal scores stand or fall together
            best = max(0.0, (score + below) / 2)
    return best


@lru_cache(maxsize=2)
def model(spark: SparkSession, seed: int = 7) -> tuple[dict[str, list], dict[str, float]]:
    """(trees by kind, threshold by kind), fitted to one half of the examples and calibrated on the other."""
    made = examples(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "i int, text string, kind string, label int")
    rows: list[tuple[int, list[float], str, int]] = []
    for kind, pattern in LOOSE_PATTERNS.items():
        found = df.where(F.col("kind") == kind).select("i", "label", F.explode(matches(F.col("text"), pattern)).alias("c"))
        values = features(kind, F.col("c.span"), F.col("c.before"), F.col("c.after"))
        rows += [(r[0], [float(v) for v in r[2:]], kind, r[1]) for r in found.select("i", "label", *[values[n] for n in NAMES]).collect()]  # at most TRAIN_ROWS texts
    trees = {k: fit([(x, y) for i, x, kind, y in rows if kind == k and i // 10 % 2 == 0]) for k in LOOSE_PATTERNS}
    held = {k: [(sum(value_of(t, x) for t in trees[k]), y) for i, x, kind, y in rows if kind == k and i // 10 % 2] for k in LOOSE_PATTERNS}
    return trees, {k: calibrated(v) for k, v in held.items()}


def find(docs: DataFrame, *, fitted: tuple[dict[str, list], dict[str, float]] | None = None) -> DataFrame:
    """``doc_id, text`` and for each kind ``added_<kind>``, for each but secrets ``base_<kind>``: arrays of spans (start, stop, span, ...)."""
    trees, thresholds = fitted or model(docs.sparkSession)
    text = F.col("text")
    rows = docs.select("doc_id", text_of().alias("text"))
    based = rows.select("doc_id", "text", *[F.filter(matches(text, p), _checked(kind)).alias(f"base_{kind}") for kind, p in BASE_PATTERNS.items()])
    touches = lambda c, others: F.exists(others, lambda o: (c["start"] < o["stop"]) & (o["start"] < c["stop"]))

    def added(kind: str) -> Column:
        if kind not in LOOSE_PATTERNS or thresholds[kind] == math.inf:
            return F.array().cast("array<struct<start:int,stop:int,span:string,before:string,after:string>>")
        long_enough = lambda c: _valid(kind, c["span"]) if kind in ("phone", "card") else F.lit(True)

        def chosen(c: Column) -> Column:
            values = features(kind, c["span"], c["before"], c["after"])
            free = ~(touches(c, F.col("base_email")) | touches(c, F.col("base_ip")) | touches(c, F.col("base_card")) | touches(c, F.col("base_phone")))
            score = let(F.struct(*[values[n].cast("double").alias(n) for n in NAMES]), lambda v: as_column(trees[kind], lambda n: v[n]))
            return long_enough(c) & free & (score >= F.lit(thresholds[kind]))

        return F.filter(matches(text, LOOSE_PATTERNS[kind]), chosen)

    return based.select("doc_id", "text", *[f"base_{k}" for k in KINDS], *[added(k).alias(f"added_{k}") for k in ALL_KINDS])


def report(docs: DataFrame, **options) -> DataFrame:
    """The result of op5: counts of base spans, their digest, all spans (secrets last), their number, and whether there are any."""
    found = find(docs, **options)
    base = F.concat(*[F.transform(f"base_{k}", _said(k)) for k in KINDS])
    both = F.concat(*[F.transform(F.array_sort(F.concat(f"base_{k}", f"added_{k}")), _said(k)) for k in KINDS], F.transform("added_secret", _said("secret")))
    number = sum((F.size(f"{w}_{k}") for k in ALL_KINDS for w in ("base", "added") if w == "added" or k in KINDS), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(both, ",").alias("spans"),
        number.alias("n_spans"),
        (number > 0).alias("has_spans"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text`` with every selected span replaced by its kind in brackets; overlapping spans become one."""
    found = find(docs, **options)
    tagged = F.array_sort(F.concat(*[F.transform(f"{w}_{k}", _tagged(k)) for k in ALL_KINDS for w in ("base", "added") if w == "added" or k in KINDS]))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col("text")

    def step(acc: Column, c: Column) -> Column:
        new = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], c["stop"]).alias("at"), F.when(c["start"] >= acc["at"], new).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate(tagged, first, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.select("doc_id", done.alias("text"))
