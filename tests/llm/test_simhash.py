import random
import re

import xxhash
from pyspark.sql import functions as F

from carepulse.llm import common, simhash
from carepulse.llm.components import connected_components
from tests.llm.conftest import EDGE


def plain_fingerprint(text, words=3):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = {(r["doc_id"], f, c) for r, f, c in zip(rows, fps, plain_components(fps, [r["doc_id"] for r in rows]))}
    got = {(r["id"], r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_links_of_random_fingerprints_against_all_pairs(spark):
    rng = random.Random(1)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        base = rng.getrandbits(64)
        for flips in (0, 1, 1, 2, 2, 2, 3, 4):
            x = base
            for b in rng.sample(range(64), flips):
                x ^= 1 << b
            fps.add(x)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    for bits in (1, 2, 3, 4):
        found = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), bits).collect()
        want = {(a[0], b[0]) for a in signed for b in signed if a < b and bin((a[0] ^ b[0]) % 2**64).count("1") <= bits}
        assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_edge_rows(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == len(EDGE)
    fps = [plain_fingerprint(r[1]) for r in EDGE]
    want = sorted(map(str, zip([r[0] for r in EDGE], fps, plain_components(fps, [r[0] for r in EDGE]))))
    assert sorted(str((r["id"], r["fp"] % 2**64, r["component"])) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_row_of_each_component(spark, edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.schema == edge_docs.schema and simhash.keep_one(no_docs).count() == 0
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    # 1-3 share fingerprint 0; the two rows of 5 are one; the two texts of 8 are two.
    assert ids == sorted(["1", "4", "5", "7", "8", "8", "None"])


def test_columns_named_like_the_row_number_pass_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 7), (2, "a b c d", "y", 8), (3, "other words here", "z", 9)], "doc_id long, text string, `__ROW` string, `__row_` int")
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d", "x", 7), (3, "other words here", "z", 9)]


def test_rows_of_files_are_told_apart_by_their_place(spark, tmp_dir):
    """A plain read is neither written again nor shuffled; columns named like the row's place pass as they are."""
    rows = [(i, f"text {i // 3} of some words {i // 3}", "f", i, "m") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, `__file` string, `__INDEX` int, `_metadata` string").repartition(5).write.parquet(f"{tmp_dir}/docs")
    docs = spark.read.parquet(f"{tmp_dir}/docs")
    kept = simhash.keep_one(docs)
    want = [r for r in rows if r[0] in {c for c in plain_components([plain_fingerprint(r[1]) for r in rows], [r[0] for r in rows])}]
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == want
    assert sorted(kept.inputFiles()) == sorted(docs.inputFiles())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_many_rows_that_go_are_joined_by_a_shuffle(spark, tmp_dir, monkeypatch):
    spark.range(90).selectExpr("id AS doc_id", "concat('same words here ', id % 9) AS text").write.parquet(f"{tmp_dir}/docs")
    docs = spark.read.parquet(f"{tmp_dir}/docs")
    few = sorted(map(tuple, simhash.keep_one(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == few


def test_a_hot_group_of_copies_keeps_one(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the very same text again and again")).otherwise(F.concat(F.lit("text number "), F.sha1(F.col("id").cast("string")))).alias("text"),
    )
    found = simhash.near_duplicates(docs)
    assert found.where("id % 3 = 0").select("component").distinct().collect()[0][0] == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(300)]
    edges += [(None, 3), (4, None), (7, 7)]
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = start
                    stack += near[x]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r["node"]: r["root"] for r in connected_components(frame, "a", "b").collect()} == want
    assert connected_components(frame.limit(0), "a", "b").count() == 0
