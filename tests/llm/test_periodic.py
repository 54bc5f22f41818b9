import hashlib
import random

import numpy as np

from carepulse.llm import periodic
from carepulse.llm.queries import _plant_period, op11_periodic_runs
from tests.llm.conftest import EDGE


def brute_runs(words):
    """All runs by walking every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def periodic_words(rng, longest):
    kinds, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.randrange(longest)
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 8:
            a = rng.randrange(n)
            p, stop = rng.randrange(1, max(2, (n - a) // 3 + 1)), rng.randrange(a, n + 1)
            for i in range(a, stop):
                words[i] = words[a + (i - a) % p]
    return [b"w%d" % w for w in words]


def test_transform_is_a_convolution():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, periodic.PRIME, (2, 32)).astype(np.uint64) for _ in range(2))
    back = periodic._backward(periodic._forward(x))
    assert (back == x).all()
    got = periodic._backward(periodic._mod(periodic._forward(x) * periodic._forward(y)))
    want = [[sum(int(x[r, i]) * int(y[r, (k - i) % 32]) for i in range(32)) % periodic.PRIME for k in range(32)] for r in range(2)]
    assert got.tolist() == want


def test_bands_cover_every_period_once():
    seen = [q for k in range(1, 12) for q in range(periodic.band(2**k)[0], periodic.band(2**k)[1] + 1)]
    assert seen == list(range(1, seen[-1] + 1))


def test_copies_are_exact_for_large_word_numbers():
    """Sums of squares of words up to 2**30, that differ only by a multiple of the prime's factors."""
    rng = random.Random(2)
    words = np.array([rng.choice([5, 5 + (1 << 30), 5 + (1 << 15), 5 + 45360]) for _ in range(4000)], dtype=np.int64)
    starts = np.arange(0, 3900, 4)
    row, distance = periodic.copies(words, starts, 4)
    low, high = periodic.band(4)
    want = {(i, d) for i, s in enumerate(starts.tolist()) for d in range(low, high + 1) if (words[s : s + 4] == words[s + d : s + d + 4]).all()}
    assert set(zip(row.tolist(), distance.tolist())) == want


def test_runs_against_brute_force():
    rng = random.Random(3)
    for longest, rounds in ((9, 40), (60, 60), (400, 40), (3000, 5)):
        for _ in range(rounds):
            texts = [periodic_words(rng, longest) for _ in range(rng.choice([1, 5, 12]))]
            for words, (runs, text) in zip(texts, periodic._describe(texts)):
                assert runs == brute_runs(words)
                assert text == collapsed(words, runs)


def test_one_word_a_hundred_thousand_times_and_texts_without_a_run():
    assert periodic._describe([[b"a"] * 100_000])[0] == ([(0, 100_000, 1)], b"a")
    assert periodic._describe([[b"%d" % i for i in range(50_000)]])[0][0] == []
    assert periodic._describe([[], [b"x"]]) == [([], b""), ([], b"x")]
    assert periodic._strongest([(0, 8, 2), (9, 8, 1), (20, 16, 2)]) == (9, 8, 1)


def test_edge_rows(edge_docs, no_docs):
    rows = periodic.periodic_runs(edge_docs, ["doc_id", "n", "fp"]).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert r["runs"] == [] and r["strongest"] is None and r["collapsed"] == ""
        if r["doc_id"] == 7:
            assert [tuple(x) for x in r["runs"]] == [(0, 30_000, 1)] and r["collapsed"] == "word"
    assert periodic.periodic_runs(no_docs, ["doc_id"]).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    for r in rows:
        words = _plant_period({"doc_id": r["doc_id"]}, (texts[r["doc_id"]] or "").encode().split())
        if len(words) > 1500:
            continue  # brute force takes too long; such texts are compared above
        runs = brute_runs(words)
        best = periodic._strongest(runs) or (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs)).hexdigest()
