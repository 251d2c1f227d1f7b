"""BPE, decontamination and quality rules against plain versions."""

import hashlib
import random
import re

import public_tokenizers
import pytest

from codeloom.llm import bpe, decontam, quality

SCHEMA = "doc_id long, text string, n_tokens int, k1 string"
EDGE = [None, "", " ", "a", "A b\tc\n\nd", "  x   y  ", "éé ñ 漢字 \U0001f600!!", "ab " * 90, "don't  we're\n\n\n z", "1234567 89"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def enc():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, enc):
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choice("ab é'st\n  1漢") for _ in range(n)) for n in (50, 700, 3000, 3000)] + ["x" * 900, " " * 900, "y" * 400 + " " + "z" * 500]
    docs = table(spark, texts)
    for chunk, overlap in ((32768, 512), (200, 20), (64, 7)):
        got = {r.doc_id: r for r in bpe.encode(docs.unionAll(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect()}
        for i, t in enumerate(texts):
            assert got[i].ids == enc.encode_ordinary(t or ""), (chunk, t)
            assert bytes(got[i].decoded) == (t or "").encode()
    rows = bpe.digests(docs.unionAll(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digests(table(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def plain_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        if name is None:
            continue
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        size = min(8, len(iw))
        for k in range(len(iw) - size + 1) if iw else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == iw[k : k + size]:
                    hit |= set(range(i, i + size))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("shard_bytes", [8_000_000, 400])
def test_decontamination_equals_plain(spark, shard_bytes):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "Éa", "c9"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([9, 12, 8, 3, 1, 20, 10])] + [(7, None), (8, "--"), (None, "a b"), (0, "c9 c9 b")]
    texts = EDGE + [", ".join(word() for _ in range(n)) for n in (30, 200, 5)] + ["x " + items[5][1].replace(" ", "...") + " y"]
    docs = table(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(docs.unionAll(docs), bench, shard_bytes=shard_bytes).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        n, hit, names = plain_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), decontam.items_digest(names), len(names) >= 2)
    for r in decontam.find(docs, bench, shard_bytes=shard_bytes).collect():
        for h in r.hits:
            part = texts[r.doc_id][h.start : h.stop]
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", part)) == h.last - h.first + 1
    assert decontam.report(table(spark, []), bench).count() == 0
    assert all(r.n_items == 0 for r in decontam.report(docs, bench.limit(0)).collect())


def test_quality_counts_equal_plain(spark):
    rng = random.Random(3)
    texts = EDGE + [" ".join(rng.choice("abc") + rng.choice(["", "\n", "#"]) for _ in range(n)) for n in (3, 4, 60, 300)]
    for r in quality.judge(table(spark, texts), quality.RULES).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_order_does_not_change_the_verdict(spark):
    docs = table(spark, EDGE + ["word " + " ".join(f"w{i}" for i in range(80)), "## " * 70])
    one = quality.judge(docs, quality.RULES).collect()
    two = quality.judge(docs, quality.ordered(docs)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    kept = quality.keep(docs.unionAll(docs))
    assert kept.columns == docs.columns
    assert kept.count() == 2 * sum(r.kept for r in one)
    assert quality.judge(docs.limit(0)).count() == 0
