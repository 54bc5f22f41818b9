"""The registered queries of the corpus operators, and the SQL of those SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..session import run_dir
from . import (
    bytepairs,
    chat,
    decontaminate,
    dialogue_repair,
    embeddings,
    langid,
    periodic,
    quality,
    sentencepieces,
    sharding,
    simhash,
    toxicity,
    warc,
)
from .common import remainder, ship_package


def _table(spark, sf_dir, name):
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_toxicity_subsequence_svm(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("__id", 4) != 2)
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_quality_crf(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, remainder("__id", 3) != 1)
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_langid_output_codes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("__id", 3) != 1)
    return langid.predict(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op10_decontaminate_cgk(spark, sf_dir):
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sentencepiece_nbest(spark, sf_dir):
    return sentencepieces.encode(_table(spark, sf_dir, "documents"), ["doc_id"])


def op9_embedding_near_dedup_itq(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op1_warc_seekable_zstd(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return warc.read_records(warc.write_bundles(pages, run_dir(spark, "warc")))


def op3_chat_perspectives(spark, sf_dir):
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op5_shard_bounded_ring(spark, sf_dir):
    found = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _plant_period(row, words):
    """The contract's change: every tenth document (by hash) repeats a stretch to its end."""
    if row["doc_id"] is None or not words:
        return words
    h = zlib.crc32(str(row["doc_id"]).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(_table(spark, sf_dir, "documents"), ["doc_id"], edit=_plant_period)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark, sf_dir):
    encoded = bytepairs.encode(_table(spark, sf_dir, "documents"), ["doc_id"])
    digested = encoded.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256))
    return bytepairs.decode(digested, ["doc_id", "n_tokens", "ids_sha256"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _damage(turns):
    """The contract's damage, by a hash of conversation and turn; ``copy`` is 1 for a repeated row."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
    )


def op13_dialogue_repair(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    found = dialogue_repair.Repair(_damage(turns), copy_col="copy").report().withColumnRenamed("conv_id", "conv")
    counts = ["gaps", *dialogue_repair._FAULTS, "illegal", "cost"]
    every = turns.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(dialogue_repair.EMPTY_DIGEST)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_warc_seekable_zstd": op1_warc_seekable_zstd,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op5_shard_bounded_ring": op5_shard_bounded_ring,
    "op8_sentencepiece_nbest": op8_sentencepiece_nbest,
    "op9_embedding_near_dedup_itq": op9_embedding_near_dedup_itq,
    "op4_langid_output_codes": op4_langid_output_codes,
    "op10_decontaminate_cgk": op10_decontaminate_cgk,
    "op7_quality_crf": op7_quality_crf,
    "op6_toxicity_subsequence_svm": op6_toxicity_subsequence_svm,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_dialogue_repair": op13_dialogue_repair,
}

#: Equal payloads have equal html, so the page that the others revisit is found by html.
OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
top AS (SELECT body, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY body)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN p.page_id < top.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < top.first THEN top.first END AS refers_to
FROM p LEFT JOIN top ON p.n >= 1000 AND p.body = top.body
"""

def _op13_sql() -> str:
    """The repair as a recursion over the rows from the last to the first: for every role
    written before a row, the cheapest way on as six digits of cost and the edits, so that
    the least text is the cheapest way and, of equal costs, that whose edits come first."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    )

    def plus(way: str, cost: str, edit: str) -> str:
        return f"(lpad(CAST(CAST(substr({way}, 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || '{edit}' || substr({way}, 7))"

    def when(cond: str, way: str) -> str:
        return f"CASE WHEN {cond} THEN {way} END"

    extra = "(CASE WHEN fault = 't' THEN 5 ELSE 0 END)"

    def row(state: int) -> str:
        """Ways from before a row, without insertions; states: nothing, system, user, assistant."""
        to = 3 if state == 2 else 2
        ways = [plus(f"w{state}", "2", "D"), when("fault IN ('-', 't')", plus(f"w{to}", f"1 + {extra}", "R"))]
        ways.append(when(f"fault IN ('-', 't') AND initial = '{'a' if to == 3 else 'u'}'", plus(f"w{to}", extra, "K")))
        if state == 0:
            ways.append(when("fault IN ('-', 't') AND initial = 's'", plus("w1", extra, "K")))
        return f"least({', '.join(ways)})"

    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds JOIN (VALUES (0), (1)) c(copy) ON kind = 3 OR copy = 0 WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
coded AS (
  SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS initial,
    CASE WHEN rtrim(text, E' \\t\\n\\x0b\\f\\r') = '' THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(rtrim(text, E' \\t\\n\\x0b\\f\\r'), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    substr(role, 1, 1) || lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM numbered),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY conv_id),
ways AS (
  SELECT conv_id, n + 1 AS i, '000000' AS w0, '000010II' AS w1, '000005I' AS w2, '000000' AS w3 FROM counted
  UNION ALL
  SELECT conv_id, i, least(v0, {plus('v2', '5', 'I')}, {plus('v3', '10', 'II')}), least(v1, {plus('v2', '5', 'I')}, {plus('v3', '10', 'II')}),
    least(v2, {plus('v3', '5', 'I')}), least(v3, {plus('v2', '5', 'I')})
  FROM (SELECT c.conv_id, c.i, {', '.join(f'{row(s)} AS v{s}' for s in range(4))}
    FROM ways JOIN coded c ON c.conv_id IS NOT DISTINCT FROM ways.conv_id AND c.i = ways.i - 1) t),
solved AS (SELECT conv_id, CAST(substr(w0, 1, 6) AS BIGINT) AS cost, substr(w0, 7) AS audit FROM ways WHERE i = 1),
edits AS (
  SELECT conv_id, p, substr(audit, CAST(p AS INTEGER), 1) AS edit, length(replace(substr(audit, 1, CAST(p AS INTEGER)), 'I', '')) AS i
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM solved) t),
written AS (
  SELECT e.conv_id, e.p, e.edit, c.role, CASE WHEN e.edit = 'I' THEN '' ELSE c.text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY e.p) AS place,
    max(CASE WHEN e.edit = 'K' AND c.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS has_system
  FROM edits e LEFT JOIN coded c ON e.edit <> 'I' AND c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.i = e.i WHERE e.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS body
  FROM written GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(s.cost, 0) AS cost, coalesce(s.audit, '') AS audit,
  sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc_seekable_zstd": OP1_SQL,
    "op3_chat_perspectives": chat.ORACLE,
    "op13_dialogue_repair": _op13_sql(),
}
