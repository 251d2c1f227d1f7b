"""The pipeline against a plain version on the whole small table."""

import base64
import hashlib
import os
import re

import public_tokenizers
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def good(t):
    w = re.findall(WORD, t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in set(grams) if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    chars = sum(map(len, w))
    bad = len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or t.count("!") > len(w)
    return not (bad or chars > 20 * len(w) or chars < 2 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines))


def without_repeats(docs):
    seen, out = set(), {}
    for d in sorted(docs):
        lines = docs[d].split("\n")
        at = [p for p, x in enumerate(lines) if re.search(WORD, x)]
        gone = set()
        for i in range(len(at)):
            for n in (1, 2, 3):
                run = tuple(lines[p] for p in at[i : i + n])
                if len(run) == n and (n == 3 or sum(len(re.findall(WORD, x)) for x in run) > 50):
                    if run in seen:
                        gone |= set(at[i : i + n])
                    seen.add(run)
        text = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        if not gone or re.search(WORD, text):
            out[d] = text
    return out


def one_of_each(docs):
    sets = {}
    for d, t in docs.items():
        w = re.findall(WORD, low(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in docs}
    changed = True
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {d: docs[d] for d in docs if label[d] == d}


def decontaminated(docs, items):
    out = {}
    for d, t in docs.items():
        spans = [m.span() for m in re.finditer(ALNUM, t)]
        words = [low(t[a:b]) for a, b in spans]
        text, hit, names = " ".join(words), set(), set()
        for name, item in items:
            iw = re.findall(ALNUM, low(item))
            n = min(8, len(iw))
            for k in range(len(iw) - n + 1) if iw else ():
                if " ".join(iw[k : k + n]) in text:
                    for i in range(len(words) - n + 1):
                        if words[i : i + n] == iw[k : k + n]:
                            hit |= set(range(i, i + n))
                            names.add(name)
        if len(names) < 2:
            left, at = "", 0
            for i in sorted(hit):
                if i - 1 not in hit:
                    left += t[at : spans[i][0]]
                at = spans[i][1]
            out[d] = left + t[at:]
    return out


def test_pipeline_equals_plain(spark):
    import tiktoken

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for want in ({d: t for d, t in docs.items() if good(t)},):
        want = decontaminated(one_of_each(without_repeats(want)), items)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for d, t in want.items():
        assert got[d].ids == enc.encode_ordinary(t)
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int, k1 string"
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", None, None, 1, "a"), (None, body, None, "s", 3, 2, "b"), (2, body, "en", "s", 3, 3, "c"), (2, body, "en", "s", 3, 3, "c"), (3, "", None, None, 0, 4, "d")]
    docs = spark.createDataFrame(rows, schema)
    for df, left in ((docs, {None, 2}), (docs.limit(0), set())):
        for _, stage in pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        assert {r.doc_id for r in df.collect()} <= left
        assert pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
    assert [r.doc_id for r in pipeline.near_dedup(spark, docs, SF).where("text is not null and text <> ''").collect()] == [2]


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert os.path.exists(SF)
