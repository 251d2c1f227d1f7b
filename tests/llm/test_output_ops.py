"""Packing, WARC and license scans against plain versions and exact round trips."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import bpe, license, packing, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing_equals_plain(sizes):
    rows = packing.best_fit_decreasing(sizes, 20)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    rooms: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 20) - sizes[i])
    assert sorted(rooms) == sorted(20 - sum(sizes[i] for i in r) for r in rows)


def test_packing_is_lossless(spark):
    rng = random.Random(4)
    texts = [None, "", "a", *(" ".join(rng.choice(["ab", "é", "x1"]) for _ in range(rng.randrange(1, 200))) for _ in range(40))]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "again")], "doc_id long, text string, pack_id string")
    coder = bpe.loaded(RANKS, public_tokenizers.PATTERN)
    for block in (8_000_000, 1_000):
        found, whole = defaultdict(list), 0
        for r in packing.pack(docs, RANKS, public_tokenizers.PATTERN, length=32, block_chars=block).collect():
            ids, pos = np.frombuffer(r.input_ids, "<i4"), np.frombuffer(r.position_ids, "<i4")
            assert len(ids) == len(pos) == 32 and r.cu_seqlens[-1] == r.n_tokens <= 32
            for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
                found[d].append((k, ids[a:b].tolist()))
                assert pos[a:b].tolist() == list(range(b - a))
            whole += r.n_tokens
        for i, t in enumerate(texts):
            pieces = [p for k, p in sorted(found[i])]
            want = coder.encode(t or "")
            if i == 3:
                assert sorted(x for p in pieces for x in p) == sorted(want * 2)
            else:
                assert [x for p in pieces for x in p] == want
    assert packing.pack(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packed_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(30)], "doc_id long, text string")
    packs = packing.pack(docs, RANKS, public_tokenizers.PATTERN, length=64)
    rows = {r.pack_id: r for r in packs.collect()}
    for m in packing.write(packs, f"file://{tmp_path}").collect():
        ids = np.fromfile(tmp_path / f"{m.stem}.ids.bin", "<i4").reshape(-1, 64)
        assert [x.tobytes() for x in ids] == [bytes(rows[p].input_ids) for p in m.pack_ids]


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/é\n x", "<p>1"), (2, None, "<p>1"), (3, "u", None), (4, "u", ""), (5, "u", "a\r\n\r\nb"), (6, "u", "x" * 9000), (7, "u", "<p>1"), (7, "u", "<p>1"), (None, "u", "<p>1"), (None, "v", "only")]
    df = spark.createDataFrame([(*p, "w") for p in pages], "page_id long, url string, html string, refers_to string")
    for options in ({}, {"frame_bytes": 300, "bundle_bytes": 200}, {"min_payload": 5}):
        got = Counter(tuple(r) for r in warc.round_trip(df, **options).collect())
        want = Counter()
        for page, _, html in pages:
            payload = (html or "").encode()
            last = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
            revisit = len(payload) >= options.get("min_payload", 0) and last is not None and (page is None or page < last)
            want[(page, len(payload), warc.sha1_base32(payload), "revisit" if revisit else "response", last if revisit else None)] += 1
        assert got == want
    folder = f"file://{tmp_path}"
    manifest = warc.write(df, folder, frame_bytes=300)
    full = warc.read(manifest, folder).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in full} == {h or "" for _, _, h in pages}
    for m in manifest.collect():
        data = (tmp_path / m.bundle).read_bytes()
        plain = b"".join(warc.read_frame(data, f) for f in warc.seek_table(data))
        import io

        import zstandard

        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == plain
        for head, _ in warc.parse(plain):
            assert head["WARC-Record-ID"].encode() in warc.read_record(data, head["WARC-Record-ID"])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_matching_statistics_equal_plain():
    rng = random.Random(5)
    for _ in range(60):
        seqs = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        text = [rng.choice("abcd") for _ in range(30)]
        made = license.SuffixAutomaton(seqs)
        subs = {tuple(s[i:j]): (k, j) for k, s in enumerate(seqs) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        assert len(made.len) <= 2 * sum(map(len, seqs)) + 1
        for i, (length, state) in enumerate(made.statistics(text)):
            assert length == max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in subs), default=0)
            for k, ends in made.where[state].items() if length else ():
                for end in ends:
                    assert seqs[k][end - length : end] == text[i + 1 - length : i + 1]
            if length:
                has = {k for k, s in enumerate(seqs) if any(s[a : a + length] == text[i + 1 - length : i + 1] for a in range(len(s)))}
                assert has == set(made.where[state])


def test_license_report(spark):
    grant = license.TEMPLATES[("mit", "grant")]
    words = grant.split()
    texts = [None, "", "MIT License mit license MIT-License", "the Apache\nlicense and general public license", grant, " ".join(words[:50]) + " changed here " + " ".join(words[52:]), " ".join(words[:12]), "plain words of no kind at all"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license.report(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = sorted(k for p in license.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = sorted({x for p, x in license.PHRASES.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))})
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert 0 <= r.score <= 1 and set(labels) <= set(r.labels.split(",")) | {""}
    assert got[4].score == 1 and got[4].labels == "mit"
    assert got[5].labels == "mit" and 0.9 < got[5].score < 1
    assert got[6].labels == "" and 0 < got[6].score < license.MIN_SCORE
    assert got[7].score == 0
    assert license.report(docs.limit(0)).count() == 0
    assert len(license.report(docs.unionAll(docs)).collect()) == 2 * len(texts)


@pytest.mark.parametrize("n", [1, 7])
def test_seek_table(n):
    bundle = warc.Bundle(10)
    for k in range(n):
        bundle.add(f"r{k}", b"x" * (k + 1))
    data = bundle.done()
    assert b"".join(warc.read_frame(data, f) for f in warc.seek_table(data)) == b"x" * (n * (n + 1) // 2)
    assert warc.read_record(data, f"r{n - 1}") == b"x" * n


def test_warc_string_ids_with_line_breaks_and_a_payload_beyond_a_bundle(spark):
    pages = [("a\r\n\r\nb: c", "<p>"), ("é %41", "<p>"), ("long", "y" * 50_000)]
    df = spark.createDataFrame([(p, None, h) for p, h in pages], "page_id string, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df, bundle_bytes=1000, frame_bytes=500).collect()}
    assert got == {"a\r\n\r\nb: c": (3, "revisit", "é %41"), "é %41": (3, "response", None), "long": (50_000, "response", None)}
