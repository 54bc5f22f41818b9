"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are cut into so few segments that, of two within ``max_bits`` bits, one
segment differs by one bit at most. Each distinct fingerprint is indexed under that
segment as it is and with each one of its bits wild; fingerprints meet by an equality
join on those signatures and the whole distance is then checked. A pair is taken from
the first segment that is at most one bit apart and there from one signature only, so
it comes out once.

Copies collapse to one fingerprint before anything is joined, so a group of copies
of any size costs one row; documents are attached to their component at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_PLACE, cut, row_place, stored, without_rows
from .components import connected_components

SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: str, words: int):
    """Column expressions (words array, hashes array) for a text column's name."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower), SPACE), lambda w: w != "")
    parts = ", ".join(f"__w[i + {k}]" for k in range(words))
    hashes = F.expr(
        f"CASE WHEN size(__w) = 0 THEN array() WHEN size(__w) < {words} THEN array(xxhash64(array_join(__w, ' '))) "
        f"ELSE transform(sequence(0, size(__w) - {words}), i -> xxhash64(concat_ws(' ', {parts}))) END"
    )
    return split, hashes


def _majority(batches):
    """A fingerprint per list of hashes: bit b is 1 if over half of the hashes have it."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values = np.asarray(lists.flatten(), dtype=np.int64).view(np.uint8).reshape(-1, 8)
        size = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        ends = np.cumsum(size)
        out = np.zeros(len(size), dtype=np.int64)
        full = np.flatnonzero(size)
        first = 0
        while first < len(full):  # about a million hashes at a time
            last = max(first + 1, int(np.searchsorted(ends[full], ends[full[first]] - size[full[first]] + 1_000_000)))
            rows = full[first:last]
            lo, hi = ends[rows[0]] - size[rows[0]], ends[rows[-1]]
            votes = np.zeros((len(rows), 64), dtype=np.int64)
            for byte in range(8):
                bits = np.unpackbits(values[lo:hi, byte : byte + 1], axis=1, bitorder="little")
                votes[:, byte * 8 : byte * 8 + 8] = np.add.reduceat(bits, ends[rows] - size[rows] - lo, axis=0, dtype=np.int64)
            out[rows] = np.packbits(votes * 2 > size[rows, None], axis=1, bitorder="little").view(np.int64)[:, 0]
            first = last
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=["id", "more", "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, more: Column | None = None, more_type: str = "long", words: int = 3) -> DataFrame:
    """(id, more, fp) per row: the signed 64 bits of the SimHash of the whole text.

    A-Z are lower-cased, words are runs without ASCII space, shingles are ``words``
    words long with repeats; a shorter text is one shingle, none (or null) gives 0.
    """
    split, hashes = shingle_hashes("__t", words)
    extra = F.lit(None) if more is None else more
    rows = docs.select(F.col(id_col).cast("long").alias("id"), extra.cast(more_type).alias("more"), F.col(text_col).cast("string").alias("__t"))
    rows = rows.select("id", "more", split.alias("__w")).select("id", "more", hashes.alias("__h"))
    return rows.mapInArrow(_majority, f"id long, more {more_type}, fp long")


def _signatures(max_bits: int) -> tuple[str, list[tuple[int, int]]]:
    """SQL for the array of packed signatures, and each segment's (shift, width)."""
    n = max(2, max_bits // 2 + 1)
    cuts = [64 * i // n for i in range(n + 1)]
    segments = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]
    parts = []
    for s, (shift, width) in enumerate(segments):
        seg = f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"
        parts.append(f"array(shiftleft({64 * s + 63}L, 32) | {seg})")
        # The last segment needs no wild bits where the others' two bits each use up all.
        if s < n - 1 or max_bits > 2 * (n - 1):
            parts.append(f"transform(sequence(0, {width - 1}), j -> shiftleft({64 * s}L + j, 32) | ({seg} & ~shiftleft(1L, j)))")
    return f"concat({', '.join(parts)})", segments


def fingerprint_links(distinct_fp: DataFrame, max_bits: int) -> DataFrame:
    """(fp_a, fp_b) once for every two distinct fingerprints within ``max_bits`` bits."""
    signatures, segments = _signatures(max_bits)
    rows = distinct_fp.select("fp", F.explode(F.expr(signatures)).alias("sig"))
    left, right = rows.toDF("fp_a", "sig"), rows.toDF("fp_b", "sig")
    far = f"bit_count(fp_a ^ fp_b) <= {max_bits}"
    earlier = " ".join(
        f"AND (shiftright(sig, 32) < {64 * (s + 1)} OR bit_count(shiftrightunsigned(fp_a ^ fp_b, {shift}) & {(1 << width) - 1}L) >= 2)"
        for s, (shift, width) in enumerate(segments[:-1])
    )
    own = "CASE shiftright(sig, 38) " + " ".join(
        f"WHEN {s} THEN shiftrightunsigned(fp_a ^ fp_b, {shift}) & {(1 << width) - 1}L" for s, (shift, width) in enumerate(segments)
    ) + " END"
    once = f"(shiftright(sig, 32) & 63 = 63 OR bit_count({own}) = 1)"
    return left.join(right, "sig").where(f"fp_a < fp_b AND {far} {earlier} AND {once}").select("fp_a", "fp_b")


def _rooted(groups: DataFrame, max_bits: int) -> DataFrame:
    """``groups`` (fp, first), a fingerprint once, with the root of each one's component."""
    links = fingerprint_links(groups.select("fp"), max_bits)
    parts = cut(connected_components(links, "fp_a", "fp_b"))
    member = groups.join(parts, groups["fp"] == parts["node"], "left")
    return cut(member.select("fp", "first", F.coalesce("root", "fp").alias("root")))


def _grouped(rows: DataFrame, max_bits: int) -> DataFrame:
    """``rows`` (id, fp and more) with root (a fingerprint) and component (smallest id) added."""
    member = _rooted(cut(rows.groupBy("fp").agg(F.min("id").alias("first"))), max_bits)
    least = cut(member.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component")))
    named = cut(member.join(least, member["root"] == least["r"]).select(F.col("fp").alias("k"), "root", "component"))
    return rows.join(named, rows["fp"] == named["k"]).drop("k")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp, component) for every row of ``docs``.

    ``component`` is the smallest id reachable over links of at most ``max_bits`` bits,
    the row's own included. Rows without text have fingerprint 0 and link like any
    other; a null id gets a fingerprint and a component but is never the smallest
    (null only if the whole component has no id). Repeated rows are kept as they are.
    An empty table gives no rows; further columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words=words))
    return _grouped(rows, max_bits).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: one with the group's smallest id.

    All columns pass as they are. Where several rows share that id, or no row of the
    group has an id, one of them stays: the first by file and place in it. Texts of any
    length count whole. Rows are known by their file and place, so that exactly the chosen
    row is taken however often tasks rerun; ``docs`` is written only where it is not a
    plain read of Parquet files. The rows that go are joined, not those that stay.
    """
    table = stored(docs, "simhash")
    place = F.struct(*row_place(table))
    rows = cut(fingerprints(table, id_col, text_col, place, f"struct<{ROW_PLACE}>", words))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "more"))
    member = _rooted(cut(rows.groupBy("fp").agg(first.alias("first"))), max_bits)
    kept = member.groupBy("root").agg(F.min(F.struct("first", "fp")).alias("kept"))
    kept = kept.select(F.col("kept.fp").alias("k"), F.col("kept.first.more").alias("stays"))
    gone = rows.join(kept, rows["fp"] == kept["k"], "left").where("NOT stays <=> more").select("more.__file", "more.__index")
    return without_rows(table, cut(gone))
