import random
import tracemalloc

import numpy as np

from carepulse.llm import decontaminate as dc
from tests.llm.conftest import EDGE


def plain_leak(item, text, k):
    """Fewest word edits between the item and any stretch of the text, by definition (None if over k)."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(row[j - 1] + (w != t), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row) if min(row) <= k else None


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = "zz" + str(rng.randrange(99))
        elif kind == 1:
            words.pop(at)
        else:
            words.insert(at, "yy" + str(rng.randrange(99)))
    return words


def test_against_brute_force_with_edited_passages(spark):
    rng = random.Random(7)
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()]
    index = dc.LeakIndex(list(range(len(items))), [dc.words_of(t) for t in items])
    filler = dc.words_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").first()["text"])
    texts = []
    for i in range(120):
        item = index.items[i % len(items)]
        k = rng.randrange(int(index.edits[i % len(items)]) + 4)
        at = rng.randrange(len(filler) // 2)
        texts.append(" ".join(filler[at : at + 60] + edited(rng, item, k) + filler[at + 60 : at + 90]))
    got = {(d, m): e for d, m, e, _, _ in index.find(texts)}
    want = {}
    for d, t in enumerate(texts):
        for m, item in enumerate(index.items):
            e = plain_leak(item, dc.words_of(t), int(index.edits[m]))
            if e is not None:
                want[d, m] = e
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want)


def test_spans_and_exact_passages(spark):
    benchmark = spark.createDataFrame([(1, "One two three four five six seven eight"), (2, "short one"), (3, ""), (4, None), (None, "nine ten eleven")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(10, "x y ONE, two; three four five six seven eight. z"), (11, "a short one here"), (12, "short two"), (13, "one two three four FIVE six eight seven"), (None, "Nine ten\neleven")],
        "doc_id long, text string",
    )
    got = sorted(map(str, (tuple(r) for r in dc.find_leaks(docs, benchmark).collect())))
    assert got == sorted(map(str, [(10, 1, 0, 8, 2, 10), (11, 2, 0, 2, 1, 3), (13, 1, 1, 8, 0, 7), (None, None, 0, 3, 0, 3)])) or got == sorted(
        map(str, [(10, 1, 0, 8, 2, 10), (11, 2, 0, 2, 1, 3), (13, 1, 1, 8, 0, 8), (None, None, 0, 3, 0, 3)])
    )


def test_every_planted_passage_and_no_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    plain = lambda t: " ".join(dc.words_of(t))
    items = {r["item_id"]: f" {plain(r['text'])} " for r in benchmark.collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in f" {plain(r['text'])} "}
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, benchmark).collect()}
    assert exact <= got and len(got) <= len(exact) * 1.2
    kept = dc.drop_leaked(docs, benchmark)
    assert kept.schema == docs.schema and kept.count() == docs.count() - len({d for d, _ in got})


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(tuple(r) for r in dc.find_leaks(docs, benchmark).collect())
    monkeypatch.setattr(dc, "BLOCK_WORDS", 300)
    assert len(list(dc.index_blocks(benchmark))) > 1
    assert sorted(tuple(r) for r in dc.find_leaks(docs, benchmark).collect()) == whole


def test_edge_rows(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (2, "word word word word word word")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(edge_docs, benchmark).collect()}
    assert got == {(5, 1), (7, 2)}
    assert dc.drop_leaked(edge_docs, benchmark).count() == len(EDGE) - 3
    assert dc.find_leaks(no_docs, benchmark).count() == 0 and dc.find_leaks(edge_docs, benchmark.limit(0)).count() == 0


def test_cgk_walk_stops_at_the_window(spark):
    index = dc.LeakIndex([1], [["a", "b", "c", "d", "e"]])
    long, short = np.array([[1, 2, 3, 4, 5]]), np.array([[1, 2, 3, 9, 9]])
    assert (index.signatures(long, np.array([3]), 4) == index.signatures(short, np.array([3]), 4)).all()


def test_long_items_at_exactly_k_edits():
    rng = random.Random(11)
    lengths = [10, 20, 40, 80, 100, 150, 300, 600]
    items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in lengths for _ in range(4)] + [["s", "t", "u", "v", "w"]] * 400
    index = dc.LeakIndex(list(range(len(items))), items)
    texts = [" ".join(["a"] * 30 + edited(rng, items[i % 32], int(index.edits[i % 32])) + ["b"] * 30) for i in range(160)]
    got = {(d, m): e for d, m, e, _, _ in index.find(texts)}
    for c, n in enumerate(lengths):
        found = sum((i, i % 32) in got for i in range(160) if i % 32 // 4 == c)
        assert found >= 19, n
    assert all(e <= index.edits[m] for (_, m), e in got.items())


def test_a_very_long_item_takes_little_memory():
    long = [f"w{i}" for i in range(2000)]
    items = [long] + [[f"u{i}", f"v{i}", "x", "y", f"z{i}"] for i in range(3000)]
    text = " ".join(["a"] * 50 + long[:900] + ["q"] * 20 + long[920:] + ["b"] * 50)
    tracemalloc.start()
    try:
        got = dc.LeakIndex(list(range(len(items))), items).find([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [(0, 0, 20, 50, 2050)] and peak < 150 << 20


def test_blocks_are_searched_one_after_the_other(spark, monkeypatch):
    """No plan holds more than one block's index, and blocks are bounded by words as they are indexed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(r["doc_id"] for r in dc.drop_leaked(docs, benchmark).collect())
    monkeypatch.setattr(dc, "BLOCK_WORDS", 300)
    kept = dc.drop_leaked(docs, benchmark)
    plans = [x._jdf.queryExecution().toString() for x in (kept, dc.find_leaks(docs, benchmark))]
    assert not any("MapInArrow" in x for x in plans) and sorted(r["doc_id"] for r in kept.collect()) == whole
    joined = spark.createDataFrame([(i, "-".join(f"w{i}x{j}" for j in range(50))) for i in range(40)], "item_id long, text string")
    assert all(len(x.word) <= 300 for x in dc.index_blocks(joined))


def test_scripts_without_spaces():
    assert dc.words_of("Ab1_c 漢字かな x") == ["ab1", "c", "漢", "字", "か", "な", "x"]
    assert dc.words_of("กำ ที่") == ["กำ"[0], "กำ"[1], "ที่"]
    item, other = "天地玄黄宇宙洪荒日月盈昃", "ภาษาไทยไม่มีช่องว่างระหว่างคำ"
    index = dc.LeakIndex([1, 2], [dc.words_of(item), dc.words_of(other)])
    texts = ["他说" + item + "是开头", "他说" + item.replace("宙", "空") + "是开头", "好" + other + "ครับ", "天地日月"]
    assert [(d, m, e) for d, m, e, _, _ in index.find(texts)] == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]


def plain_windows(index, texts):
    """Codes by the definition: per item, the places whose following k hold enough shared runs."""
    out = set()
    for d, t in enumerate(texts):
        w = [index.vocabulary.get(x, 0) for x in dc.words_of(t)]
        for m, item in enumerate(index.items):
            n, k = len(item), int(index.edits[m])
            q = min(max((n - k) // (k + 1), 1), dc.LONGEST_RUN)
            own = [index.vocabulary[x] for x in item]
            at = [p - j for p in range(len(w) - q + 1) if 0 not in w[p : p + q] for j in range(n - q + 1) if own[j : j + q] == w[p : p + q]]
            out |= {(d, m) for p in set(at) if sum(p <= x <= p + k for x in at) >= int(index.shared[m])}
    return out


def test_small_groups_of_items_and_stretches_give_the_same(monkeypatch):
    rng = random.Random(3)
    items = [[rng.choice("ab") + str(rng.randrange(3)) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    items.append(["a0"] * 40)
    texts = [" ".join(rng.choice("abc") + str(rng.randrange(3)) for _ in range(rng.randrange(90))) for _ in range(12)]
    texts += ["a0 " * 120, "", None, "b1"]
    index = dc.LeakIndex(list(range(len(items))), items)
    whole = index.find(texts)
    for d, m, e, _, _ in whole:
        assert plain_leak(items[m], dc.words_of(texts[d]), 99) == e
    exact = {(d, m) for d, t in enumerate(texts) for m, item in enumerate(items) if plain_leak(item, dc.words_of(t or ""), 0) is not None}
    assert exact <= {(d, m) for d, m, *_ in whole}
    assert {(d, m) for d, m, *_ in whole} <= plain_windows(index, [t or "" for t in texts])
    for hits in (5, 64, 1000):
        monkeypatch.setattr(dc, "HITS", hits)
        assert index.find(texts) == whole, hits


def test_a_run_shared_by_thousands_of_items_takes_little_memory():
    items = [["of", "the", "of", "the", f"x{i}"] for i in range(3000)] + [["of", "the", f"y{i}", f"z{i}", "q"] for i in range(5000)]
    index = dc.LeakIndex(list(range(len(items))), items)
    text = "of the " * 800
    tracemalloc.start()
    try:
        got = index.find([text, "and of the of the end"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [r[:3] for r in got] == [(d, m, 1) for d in (0, 1) for m in range(3000)] and peak < 200 << 20


def test_equal_items_are_searched_once_and_all_named(spark):
    text = "one two three four five six seven eight"
    benchmark = spark.createDataFrame([(i % 50 if i else None, text) for i in range(400)] + [(900, "nine ten eleven")], "item_id long, text string")
    assert [len(x.items) for x in dc.index_blocks(benchmark)] == [2]
    docs = spark.createDataFrame([(1, f"a {text} b"), (2, "nine ten eleven"), (3, "clean")], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, benchmark).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, i % 50 if i else None) for i in range(400)] + [(2, 900)]))
    assert [r["doc_id"] for r in dc.drop_leaked(docs, benchmark).collect()] == [3]
