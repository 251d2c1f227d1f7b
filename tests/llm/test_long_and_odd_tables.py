"""Very long texts, columns whose names clash with an operator's own, and ids of other types."""

import hashlib
import random
import re

import public_tokenizers
import pytest

from codeloom.llm import decontam, license, linedup, minhash, packing, quality, suffix

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = " ".join(word() + ("\n" if rng.random() < 0.02 else "") for _ in range(60_000))
    return [long, long + " " + word(), long[:200] + " under the mit license", None, "short"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    names = "k1 string, k2 string, node string, print string, anchor string, context string, n long, block string, row string, word string"
    return spark.createDataFrame([(i, t, *["x"] * 6, 1, *["y"] * 3) for i, t in enumerate(texts)], f"doc_id long, text string, {names}")


def test_long_texts(spark, docs, texts):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, shingle_words=2).collect()}
    assert [got[i].component_id for i in range(5)] == [0, 0, 2, 3, 4]
    words = WORD.findall(texts[0])
    assert got[0].n_shingles == len(set(zip(words, words[1:])))
    bench = spark.createDataFrame([("q", " ".join(words[30_000:30_008])), ("r", "never there at all")], "item_id string, text string")
    found = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert [(found[i].n_words, found[i].n_hit, found[i].n_items) for i in (0, 1)] == [(60_000, 8, 1), (60_001, 8, 1)]
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert judged[0].n_words == 60_000 and judged[0].word_chars == 300_000 and not judged[0].base_failed and judged[4].base_failed
    lines = {r.doc_id: r for r in linedup.report(docs).collect()}
    assert lines[0].n_removed == 0 and lines[1].n_removed > 1000
    seen = {r.doc_id: r for r in license.report(docs).collect()}
    assert seen[0].n_words == 60_000 and seen[2].base_labels == "mit" and seen[0].base_labels == ""


def test_suffix_dedup_with_clashing_columns(docs, texts):
    got = {r.doc_id: r for r in suffix.report(docs).collect()}
    long = len(texts[0].encode())
    assert (got[0].n_removed, got[0].n_spans) == (long, 1) and got[1].n_removed == long and got[4].n_removed == 0
    assert got[1].kept_sha256 == hashlib.sha256(texts[1].encode()[long:]).hexdigest()


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_packing_keeps_ids_of_any_type(spark, kind):
    ids = ["1", "2", None] if kind == "string" else [1, 2, None]
    df = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string")
    rows = packing.pack(df, RANKS, public_tokenizers.PATTERN, length=64).collect()
    assert sorted((x for r in rows for x in r.doc_ids), key=str) == sorted(ids, key=str)
    none = packing.pack(df.where("doc_id is null"), RANKS, public_tokenizers.PATTERN, length=64).collect()
    assert [r.doc_ids for r in none] == [[None]]
