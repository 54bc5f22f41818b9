"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, rerank.

Rotations are learned on a bounded sample (``SAMPLE`` vectors by hash): principal
directions turned until their signs lose least (ITQ), one rotation from each of
several random starts. A vector's sign codes are cut into segments; each segment is a
table in which vectors of one label with an equal segment meet. Segment width follows
the number of vectors (so buckets of unrelated vectors stay small) and the number of
tables follows from it, the target recall and the angle that a pair at the threshold has
as seen from the mean; vectors too near to the mean for that meet by codes about the origin. Vectors that meet are compared by the
cosine of the original vectors in double precision; of a pair that meets in several
tables only the first one counts it.

Equal vectors collapse to one with a count before anything is joined. Only buckets of
two or more fetch vectors, and a large bucket is dealt as pairs of blocks of about
``BLOCK`` vectors, so no task gets a whole bucket. Pairs are never written out: a block
pair gives each vector's number of links and one link to the block's spanning forest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import connected_components

SAMPLE = 20_000
BLOCK = 256
CODE_BITS = 64
TARGET_RECALL = 0.98
ITQ_STEPS = 30
#: Tables beyond which segments are made narrower.
TABLES = 64


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (safe for very large and small values)."""
    v = np.asarray(v, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def plan_tables(vectors: int, dims: int, threshold: float, target: float = TARGET_RECALL, length: float = 1.0) -> tuple[int, int, int]:
    """(segment width, segments of a rotation, rotations) for so many vectors.

    Unit vectors at the threshold lie a chord apart; seen from a centre at least
    ``length`` away from both, that chord is an angle. They differ in a sign with
    probability p = angle / pi, and share a segment of w signs with (1 - p) ** w; tables
    are added until the chance to miss in all of them is at most 1 - target. Segments
    get narrower (and buckets larger) where that would take over ``TABLES`` tables.
    """
    bits = min(dims, CODE_BITS)
    width = min(bits, max(8, min(30, math.ceil(math.log2(max(2, vectors))))))
    apart = math.acos(min(1.0, threshold))
    if length != 1:
        apart = 2 * math.asin(min(1.0, math.sin(apart / 2) / length))
    while True:
        share = (1 - apart / math.pi) ** width
        tables = 1 if share >= 1 else math.ceil(math.log(1 - target) / math.log(1 - share)) if share else TABLES + 1
        if tables <= TABLES or width <= 1:
            per = bits // width
            return width, per, max(1, math.ceil(tables / per))
        width -= 1


def centred_length(sample: np.ndarray, threshold: float) -> float:
    """How far from the mean vectors must lie to be compared by centred codes: a little
    less than nearly all do, but never so near that a pair's angle says nothing."""
    chord = 2 * math.sin(math.acos(max(-1.0, min(1.0, threshold))) / 2)
    far = np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1))
    return max(1e-3, 1.5 * chord, 0.8 * float(np.quantile(far, 0.01)))


def learn_rotations(sample: np.ndarray, rotations: int, seed: int = 42) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean and, per rotation, the (dims x bits) map whose signs are the code."""
    mean = sample.mean(axis=0)
    x = sample - mean
    bits = min(x.shape[1], CODE_BITS)
    _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    y = x @ axes
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(ITQ_STEPS):
            u, _, w = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, out


def segment_keys(v: np.ndarray, mean: np.ndarray, maps: list[np.ndarray], width: int, per: int) -> np.ndarray:
    """(rows x tables) integer keys: each segment's signs as a number."""
    power = 1 << np.arange(width, dtype=np.int64)
    keys = []
    for m in maps:
        sign = (v - mean) @ m > 0
        keys += [sign[:, s * width : (s + 1) * width] @ power for s in range(per)]
    return np.stack(keys, axis=1)


@dataclass
class Codes:
    """Centred codes for vectors at least ``near`` from the mean; the others (core), and
    those within a chord of them, have codes about the origin, where the angle is their own."""

    mean: np.ndarray
    maps: list[np.ndarray]
    plan: tuple[int, int]
    origin_maps: list[np.ndarray]
    origin_plan: tuple[int, int]
    near: float
    chord: float

    @property
    def centred(self) -> int:
        return len(self.maps) * self.plan[1]

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x tables) keys, centred ones first and -1 where a vector is not in a table, and core."""
        far = np.sqrt(((v - self.mean) ** 2).sum(axis=1))
        a = segment_keys(v, self.mean, self.maps, *self.plan)
        b = segment_keys(v, np.zeros_like(self.mean), self.origin_maps, *self.origin_plan)
        a[far < self.near] = -1
        b[far >= self.near + self.chord + 1e-9] = -1
        return np.hstack([a, b]), far < self.near


def plan_codes(sample: np.ndarray, vectors: int, threshold: float) -> Codes:
    """Tables for so many vectors like the sample's unit vectors."""
    dims = sample.shape[1]
    chord = 2 * math.sin(math.acos(max(-1.0, min(1.0, threshold))) / 2)
    near = centred_length(sample, threshold)
    width, per, rotations = plan_tables(vectors, dims, threshold, length=near)
    mean, maps = learn_rotations(sample, rotations)
    origin_width, origin_per, rotations = plan_tables(vectors, dims, threshold)
    rng = np.random.default_rng(43)
    origin = [np.linalg.qr(rng.standard_normal((dims, min(dims, CODE_BITS))))[0] for _ in range(rotations)]
    return Codes(mean, maps, (width, per), origin, (origin_width, origin_per), near, chord)


def _coder(codes: Codes):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = unit(np.asarray(b.column(2).flatten(), dtype=np.float64).reshape(b.num_rows, -1))
            keys, core = codes.keys(v)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * keys.shape[1]
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made, pa.array(core)], names=["gid", "label", "keys", "core"])

    return run


def _compare(threshold: float, centred: int):
    """Groups (bucket, lo, hi), contiguous in the partition, to each vector's links and its root.

    After the first ``centred`` tables only pairs with a core vector are compared."""

    def group(g: pd.DataFrame, out: list) -> None:
        lo, hi = g["lo"].iat[0], g["hi"].iat[0]
        v = unit(np.stack(g["v"].to_numpy()))
        keys = np.stack(g["keys"].to_numpy())
        gid, n, block = (g[c].to_numpy() for c in ("gid", "n", "block"))
        label = pd.factorize(g["label"])[0]
        t = int(g["t"].iat[0])
        link = (v @ v.T >= threshold) & (label[:, None] == label[None, :]) & (keys[:, None, t] == keys[None, :, t])
        for earlier in range(t if t < centred else centred):
            link &= (keys[:, None, earlier] != keys[None, :, earlier]) | (keys[:, None, earlier] < 0)
        if t >= centred:
            core = g["core"].to_numpy(dtype=bool)
            link &= core[:, None] | core[None, :]
            for earlier in range(centred, t):
                link &= keys[:, None, earlier] != keys[None, :, earlier]
        if lo != hi:
            link &= block[:, None] != block[None, :]
        np.fill_diagonal(link, False)
        if not link.any():
            return
        root = np.arange(len(g))
        while True:
            least = np.where(link, root[None, :], len(g)).min(axis=1)
            nxt = np.minimum(root, least)
            nxt = nxt[nxt]
            if (nxt == root).all():
                break
            root = nxt
        got = np.flatnonzero(link.any(axis=1))
        out.append(pd.DataFrame({"gid": gid[got], "links": (link[got] * n[None, :]).sum(axis=1), "mate": gid[root[got]]}))

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            new = (b[["bucket", "lo", "hi"]].diff().iloc[1:] != 0).any(axis=1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(b)]])
            out: list[pd.DataFrame] = []
            for a, z in zip(edges[:-2], edges[1:-1]):
                group(b.iloc[a:z], out)
            rest = b.iloc[edges[-2] :]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest):
            out = []
            group(rest, out)
            if out:
                yield out[0]

    return run


def _linked(groups: DataFrame, dims: int, total: int, threshold: float) -> DataFrame:
    """(gid, links, mate) of the ``total`` distinct vectors of ``dims`` components."""
    sample = groups.orderBy(F.xxhash64("h1", "h2"), "h1").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    sample = unit(np.asarray(sample.flatten(), dtype=np.float64).reshape(len(sample), -1))
    coder = plan_codes(sample, total, threshold)
    codes = groups.select("gid", "label", "v").mapInArrow(_coder(coder), "gid long, label string, keys array<long>, core boolean")
    codes = cut(codes)
    slots = codes.select("gid", "label", "core", F.posexplode("keys").alias("t", "key")).where("key >= 0")
    if not codes.where("core").limit(1).count():
        slots = slots.where(F.col("t") < coder.centred)
    slots = slots.select("gid", "t", F.xxhash64("label", "t", "key").alias("bucket"), (F.col("core") | (F.col("t") < coder.centred)).alias("worth"))
    shared = cut(slots.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("count"), F.max("worth").alias("w")).where("count > 1 AND w").drop("w"))
    met = slots.join(shared, slots["bucket"] == shared["b"]).select("gid", "t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    met = met.withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("gid", "t", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = groups.select(F.col("gid").alias("g"), "v", "n", "label").join(codes.select(F.col("gid").alias("g2"), "keys", "core"), F.col("g") == F.col("g2"))
    dealt = met.join(full, F.col("gid") == F.col("g")).select("bucket", "lo", "hi", "t", "block", "gid", "label", "n", "v", "keys", "core")
    dealt = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "gid")
    return cut(dealt.mapInPandas(_compare(threshold, coder.centred), "gid long, links long, mate long"))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Vectors of one label with a cosine of at least ``threshold`` are linked; ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id reachable
    (the own one included) and ``kept`` says whether that is the row's own. Rows with a
    null label or vector, with null or non-finite components or without a length link
    with nothing. Vectors of any sizes may be mixed: only those of one size can link, and
    each size with several different vectors gets tables of its own. Labels are compared
    as they are, whatever their type. Repeated rows are rows of their own, linked to each
    other; a null id is never the smallest. An empty table gives no rows; further columns
    are not read.
    """
    kind = vectors.schema[label_col].dataType
    label = F.col(label_col) + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(label_col)  # -0.0 equals 0.0
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    fine = F.expr("label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # 128 bits of hash stand for (label, vector).
    h1, h2 = F.xxhash64("label", "v"), F.xxhash64(F.lit(7), "v", "label")
    rows = rows.select("vec_id", "label", "v", "fine", F.when(F.col("fine"), h1).alias("h1"), F.when(F.col("fine"), h2).alias("h2"))
    groups = rows.where("fine").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("first")
    )
    groups = cut(groups.withColumn("gid", F.monotonically_increasing_id()))
    # One row per size of vector; a vector alone in its size links with its copies only.
    sizes = groups.groupBy(F.size("v").alias("dims")).count().where("count > 1").orderBy("dims").collect()
    parts_found = [_linked(groups.where(F.size("v") == r["dims"]), r["dims"], r["count"], threshold) for r in sizes]
    none = vectors.sparkSession.createDataFrame([], "gid long, links long, mate long")
    found = reduce(DataFrame.union, parts_found, none) if len(parts_found) != 1 else parts_found[0]
    links = found.groupBy(F.col("gid").alias("lg")).agg(F.sum("links").alias("links"))
    parts = cut(connected_components(found, "gid", "mate"))
    member = groups.join(parts, groups["gid"] == parts["node"], "left").join(links, F.col("gid") == F.col("lg"), "left")
    member = cut(member.select("h1", "h2", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "gid").alias("root")))
    least = cut(member.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component")))
    named = member.join(least, member["root"] == least["r"])
    named = cut(named.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("links") + F.col("n") - 1).alias("links"), "component"))
    out = rows.select("vec_id", "h1", "h2").join(named, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
