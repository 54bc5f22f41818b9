"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``replicas`` points on the ring of 64-bit hashes. A row belongs to the
point that follows its id's hash clockwise. A shard takes no more rows than its bound;
rows beyond it go on clockwise to the next point whose shard has room. Rows at their
own shard come first there, so overflow never displaces them.

How many rows of which arc go where follows from the row counts of the arcs alone
(``replicas`` * ``shards`` numbers), which are collected; a row's shard and its slot
then follow from its place in its arc, numbered by a range sort over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, number_rows

REPLICAS = 128
SEED = 42


def ring(shards: int, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """(points, shard of each) in clockwise order, as signed 64-bit numbers."""
    import xxhash

    at = [(xxhash.xxh64_intdigest(f"{s}/{r}", SEED), s) for s in range(shards) for r in range(replicas)]
    points = np.array([p for p, _ in at], dtype=np.uint64).view(np.int64)
    order = np.lexsort((np.array([s for _, s in at]), points))
    return points[order], np.array([s for _, s in at])[order]


def bounds(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """The most rows each shard takes: with no slack the counts are at most one apart."""
    if slack > 0:
        return np.full(shards, int(np.ceil(rows / shards * (1 + slack))), dtype=np.int64)
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


@dataclass
class Plan:
    """Pieces of arcs: rows [start, stop) of an arc go to a shard, in slots from ``slot`` on."""

    arc: np.ndarray
    start: np.ndarray
    shard: np.ndarray
    slot: np.ndarray


def place(counts: np.ndarray, owner: np.ndarray, most: np.ndarray) -> Plan:
    """Who takes which rows of every arc, given the arcs' row counts and the shards' bounds."""
    room = most.astype(np.int64).copy()
    used = np.zeros_like(room)
    pieces = []

    def take(arc: int, start: int, n: int, shard: int) -> int:
        got = int(min(n, room[shard]))
        if got:
            pieces.append((arc, start, shard, int(used[shard])))
            room[shard] -= got
            used[shard] += got
        return got

    left = []
    for arc, n in enumerate(counts.tolist()):
        got = take(arc, 0, n, int(owner[arc]))
        if got < n:
            left.append((arc, got, n - got))
    waiting: list[tuple[int, int, int]] = []
    late = dict((x[0], x) for x in left)
    for turn in range(2):  # once round for all that overflow, once more for what passed the start
        for point in range(len(owner)):
            while waiting and room[owner[point]]:
                arc, start, n = waiting.pop(0)
                got = take(arc, start, n, int(owner[point]))
                if got < n:
                    waiting.insert(0, (arc, start + got, n - got))
            if not turn and point in late:
                waiting.append(late[point])
    if waiting:
        raise ValueError("the shards' bounds hold fewer rows than there are")
    pieces.sort()
    return Plan(*(np.array([p[i] for p in pieces], dtype=np.int64) for i in range(4)))


def _arcs(points: np.ndarray):
    def run(batches):
        for b in batches:
            at = np.searchsorted(points, np.asarray(b.column(b.num_columns - 1)), side="left") % len(points)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int64))], names=[*b.schema.names, "arc"])

    return run


def _shards(plan: Plan, width: int):
    key = plan.arc << 40 | plan.start

    def run(batches):
        for b in batches:
            arc, rank = np.asarray(b.column(width)), np.asarray(b.column(width + 1))
            i = np.searchsorted(key, arc << 40 | rank, side="right") - 1
            made = [pa.array(plan.shard[i].astype(np.int32)), pa.array(plan.slot[i] + rank - plan.start[i])]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], names=[*b.schema.names[:width], "shard", "slot"])

    return run


def assign(rows: DataFrame, shards: int, id_col: str, order: list[str], slack: float = 0.0, replicas: int = REPLICAS) -> DataFrame:
    """``rows`` (narrow ones) with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The id's hash gives the place on the ring; ``order`` (columns) settles rows of one
    place, and equal rows are interchangeable. A null id has a place of its own, so all
    its rows stand together and overflow like any others. With ``slack`` 0 the shards'
    row counts are at most one apart; with more, each takes at most (1 + slack) times
    its even share and fewer rows move when shards are added. An empty table gives no rows.
    """
    points, owner = ring(shards, replicas)
    names = rows.columns
    hashed = rows.withColumn("__pos", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull()))
    schema = T.StructType([*hashed.schema.fields, T.StructField("arc", T.LongType())])
    placed = hashed.mapInArrow(_arcs(points), schema)
    ranked = cut(number_rows(placed, ["arc"], ["__pos", id_col, *order], "__rank").select(*names, "arc", "__rank"))
    counts = np.zeros(len(points), dtype=np.int64)
    for r in ranked.groupBy("arc").count().collect():  # replicas * shards rows at most
        counts[r["arc"]] = r["count"]
    plan = place(counts, owner, bounds(int(counts.sum()), shards, slack))
    out = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return ranked.mapInArrow(_shards(plan, len(names)), out)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row; the text itself is not moved.

    ``size`` is the text's length in UTF-8 bytes plus 1, ``text_crc32`` its unsigned
    CRC-32; a null text has no bytes (size 1, crc 0). Further columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return assign(narrow, shards, "doc_id", ["size", "text_crc32"], slack)
