import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from carepulse.llm import bytepairs
from carepulse.llm.common import IdCache
from carepulse.llm.queries import op12_byte_bpe
from tests.llm.conftest import EDGE

RANKS = bytepairs.Ranks.load()


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(RANKS.token)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bytepairs.Encoder(RANKS, bytepairs.class_table())


def same(encoder, library, texts):
    ids, count = encoder.encode(texts)
    stop = np.cumsum(count)
    for text, a, b in zip(texts, stop - count, stop):
        assert ids[a:b].tolist() == library.encode_ordinary(text), text[:80]


def test_blocked_scan_equals_a_walk():
    scan, rng = bytepairs.Scan(), np.random.default_rng(4)
    for n in (0, 1, 255, 256, 257, 1000, 70_000):
        classes = rng.integers(0, bytepairs.E + 1, n).astype(np.uint8)
        state, walked = bytepairs.START, []
        for c in classes.tolist():
            state = bytepairs._after(state, c)
            walked.append(state)
        assert scan.from_start[scan.prefixes(scan.of_class[classes], width=16)].tolist() == walked


def test_short_texts_of_awkward_characters(encoder, library):
    rng = random.Random(1)
    some = "aestmdrvlST'’ \n\t \x0b1½三é!?.-_\0\x1c\x85 \U0001f600٣́"
    for n in range(1, 8):
        same(encoder, library, ["".join(rng.choice(some) for _ in range(n)) for _ in range(3000)])
    same(encoder, library, ["".join(rng.choice("'stmdrvle ") for _ in range(9)) for _ in range(20_000)])


def test_every_code_point(encoder, library):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    same(encoder, library, ["a" + "1 ".join(map(chr, points[i : i + 4096])) for i in range(0, len(points), 4096 * 8)])


def test_long_pieces(encoder, library):
    same(encoder, library, ["x" * 5000, "ab" * 3000, " " * 3000 + "a", "é" * 2000, "thequickbrownfox" * 20, "-" * 97, "=" * 96])


def test_given_texts(spark, encoder, library):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(encoder, library, texts)


def test_a_full_cache_drops_rare_strings_only():
    asked = []

    def solve(strings):
        asked.extend(strings)
        return [np.array([len(s), 7], dtype=np.int32) for s in strings]

    cache = IdCache(solve, limit=10)
    for i in range(40):
        ids, size = cache.ids_of(["often", "x" * (i + 1), "often"])
        assert ids.tolist() == [5, 7, i + 1, 7, 5, 7] and size.tolist() == [2, 2, 2]
    assert asked.count("often") == 1 and len(cache.number) <= 12


def test_spans_decode_by_their_offsets(spark, library):
    text = "Grüße 你好, it's  we'll\n see 1234 😀!"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    coded = bytepairs.encode(docs, ["doc_id"])
    for row in coded.collect():
        assert row["n_tokens"] == len(row["ids"]) == len(row["offsets"])
    whole = {r["doc_id"]: bytes(r["decoded"]) for r in bytepairs.decode(coded, ["doc_id"]).collect()}
    assert whole == {1: text.encode(), 2: b"", 3: b""}
    span = bytepairs.decode(coded, ["doc_id"], first=3, last=6).where("doc_id = 1").first()
    at = span["decoded_at"]
    assert text.encode()[at : at + len(span["decoded"])] == bytes(span["decoded"]) and len(span["decoded"]) > 0
    missing = coded.selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids", "CAST(NULL AS array<int>) AS offsets")
    assert all(r["decoded"] is None for r in bytepairs.decode(missing, ["doc_id"]).collect())


def test_edge_rows(edge_docs, no_docs):
    rows = bytepairs.decode(bytepairs.encode(edge_docs, ["doc_id", "n", "fp"]), ["doc_id"]).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((e[1] or "").encode() for e in EDGE)
    assert bytepairs.encode(no_docs, ["doc_id"]).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
