import hashlib

import duckdb
import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from carepulse.llm import chat, queries, sharding, warc
from carepulse.llm.common import number_rows

SF = "/root/testdata/sf0.001"


def oracle(name, tables, sf=SF):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted(str(tuple(r[n] for n in names)) for r in frame.collect())


def test_registered_queries_match_their_sql(spark):
    assert spark_rows(queries.op1_warc_seekable_zstd(spark, SF)) == oracle("op1_warc_seekable_zstd", ["pages"])
    assert spark_rows(queries.op3_chat_perspectives(spark, SF)) == oracle("op3_chat_perspectives", ["conversations"])


def test_warc_round_trip_copies_and_edge_rows(spark, tmp_path):
    big, small = "ü<p>" * 400, "tiny"
    rows = [(1, "http://a/ b\n", big), (5, "http://b", big), (3, None, big), (None, "http://c", big), (7, "u", small), (8, "u", small), (9, "u", None), (10, "u", ""), (11, "u", "x" * 3_000_000), (5, "http://b", big)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, digest int, size string").repartition(3)
    index = warc.write_bundles(pages, str(tmp_path), frame_bytes=2000)
    got = warc.read_records(index, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        body = next(h for p, _, h in rows if p == r["page_id"]) or ""
        raw = body.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        if body == big and r["page_id"] != 5:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 5, None)
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None) and bytes(r["payload"]) == raw
    # Any one record by its identifier; the seek table tells the same frames as the index.
    one = warc.read_records(index.where("record_id = '<urn:page:7>'")).collect()
    assert [(r["page_id"], r["payload_bytes"]) for r in one] == [(7, 4)]
    for bundle, frames in index.groupBy("bundle").agg(F.collect_set(F.struct("frame_offset", "frame_bytes"))).collect():
        table = warc.read_seek_table(bundle)
        assert sorted((o, n) for o, n, _, _ in table) == sorted((f[0], f[1]) for f in frames)
        for o, n, size, check in table:
            raw = warc.read_frame(bundle, o, n)
            assert len(raw) == size and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF == check
        whole = open(bundle.removeprefix("file:"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == index.where(F.col("bundle") == bundle).count()


def test_warc_of_no_pages(spark, tmp_path):
    index = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path))
    assert index.count() == 0 and warc.read_records(index).count() == 0


def plain_ring(docs, shards, slack=0.0):
    """The rule row by row: home shards first, then overflow clockwise, round and round."""
    points, owner = sharding.ring(shards)
    rows = sorted((int(np.searchsorted(points, h)) % len(points), h, i) for i, h in docs)
    room, home, left = sharding.bounds(len(rows), shards, slack), {}, []
    for arc, h, i in rows:
        if room[owner[arc]]:
            room[owner[arc]] -= 1
            home[i] = int(owner[arc])
        else:
            left.append((arc, i))
    waiting = []
    for turn in range(2):
        for point in range(len(points)):
            while waiting and room[owner[point]]:
                room[owner[point]] -= 1
                home[waiting.pop(0)] = int(owner[point])
            if not turn:
                waiting += [i for arc, i in left if arc == point]
    return home


def test_sharding_against_the_rule_row_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hashes = [(r[0], r[1]) for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(False))).collect()]
    for shards, slack in ((8, 0.0), (9, 0.0), (8, 0.1)):
        got = sharding.shard_documents(docs, shards, slack=slack).collect()
        assert {r["doc_id"]: r["shard"] for r in got} == plain_ring(hashes, shards, slack)
        for s in range(shards):
            own = sorted(r["slot"] for r in got if r["shard"] == s)
            assert own == list(range(len(own))) and len(own) <= sharding.bounds(len(got), shards, slack)[s]


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) / len(a) < 2 / 9


def test_sharding_edge_rows_and_a_hot_id(spark, edge_docs, no_docs):
    got = sharding.shard_documents(edge_docs, 3).collect()
    assert len(got) == edge_docs.count() and sharding.shard_documents(no_docs, 3).count() == 0
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1} and {r["text_crc32"] for r in got if r["doc_id"] in (1, 2)} == {0}
    hot = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    counts = sharding.shard_documents(hot, 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert sorted(r["n"] for r in counts) == [112] * 4 + [113] * 4 and all(r["m"] + 1 == r["n"] == r["d"] for r in counts)


def test_row_numbers_with_hot_and_null_groups(spark):
    rows = [(None if i % 5 == 0 else ("hot" if i % 3 else str(i)), i % 7) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(9)
    got = {}
    for r in number_rows(frame, ["g"], ["v"], "n").collect():
        got.setdefault(r["g"], []).append((r["n"], r["v"]))
    for g, pairs in got.items():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(len(pairs))) and [v for _, v in pairs] == sorted(v for _, v in pairs), g
    assert sum(map(len, got.values())) == 2000 and number_rows(frame.limit(0), ["g"], ["v"], "n").count() == 0


def test_perspectives_by_hand(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (2, 0, "system", "alone"), (None, 0, " ", "x"), (3, 0, None, "a"), (3, 0, None, "a")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk int")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.perspectives(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "unknown")}
    ann = got[1, "ann"]
    assert ann["text"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    marked = [ann["text"][int(a) : int(b)] for a, b in (m.split(":") for m in ann["mask"].split(","))]
    assert marked == ["Hi < |im_end|><|im_end|>\n", "Bye<|im_end|>\n"] and (ann["n_turns"], ann["n_own"]) == (4, 2)
    assert got[3, "unknown"]["n_own"] == 2
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_a_long_conversation_comes_in_chunks(spark):
    turns = spark.range(1000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.perspectives(turns, chunk=64).collect()
    assert len(got) == 2 * 16 and sum(r["n_turns"] for r in got) == 2000 and sum(r["n_own"] for r in got) == 1000
    text = "".join(r["text"] for r in sorted(got, key=lambda r: r["chunk"]) if r["speaker"] == "a")
    assert [int(x.split("\n")[1].split("<")[0]) for x in text.split("<|im_start|>")[1:]] == list(range(1000))
