import corpus_pipeline
from carepulse.llm import decontaminate, quality, sentencepieces, toxicity
from pyspark.sql import functions as F
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    tox = toxicity.fit(docs, labels, F.lit(True))
    rejected = {r["doc_id"] for r in toxicity.score(docs, tox, ["doc_id"]).where("score >= 0.3").collect()}
    left = {i: t for i, t in left.items() if i not in rejected}
    qual = quality.fit(docs, labels, F.lit(True))
    left = {i: t for i, t in left.items() if qual.quality([t])[0] >= 0.5}
    ids = sorted(left)
    parts = plain_components([plain_fingerprint(left[i]) for i in ids], ids)
    left = {i: left[i] for i, c in zip(ids, parts) if i == c}
    index, = decontaminate.index_blocks(benchmark)
    left = {i: t for i, t in left.items() if not index.find([t])}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(left) and len(got) == len(left)
    seg = sentencepieces.Segmenter(sentencepieces.PieceModel.load())
    assert all(seg.decode(r["ids"]) == left[r["doc_id"]] and r["round_trip"] for r in got)


def test_stages_keep_the_columns_and_take_edge_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs.withColumn("ids", F.lit(1)), no_docs.withColumn("source", F.lit("s"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert out.columns == docs.columns, name
            out.collect()
