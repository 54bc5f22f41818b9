"""Helpers shared by the corpus operators: cut lineage, text batches, exact row numbers.

Nothing here gathers a group: numbering range-partitions the rows, and the only
rows that reach the driver are one per shuffle partition.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root, run_dir

#: A task hands an operator at most this much text at once (one longer text goes alone).
SLICE_BYTES = 2 << 20

#: Rows that go are broadcast up to this size (measured before).
BROADCAST_BYTES = 8 << 20

#: What tells the rows of Parquet files apart, however often tasks run again.
ROW_PLACE = "__file string, __index bigint"

_ARROW = {
    T.BooleanType: pa.bool_(),
    T.IntegerType: pa.int32(),
    T.LongType: pa.int64(),
    T.DoubleType: pa.float64(),
    T.StringType: pa.string(),
    T.BinaryType: pa.binary(),
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(package)
        folder = tempfile.mkdtemp(prefix=f"{name}-py-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", os.path.dirname(package), name))
        _shipped.add(app)


def arrow_type(dtype: T.DataType) -> pa.DataType:
    if isinstance(dtype, T.ArrayType):
        return pa.list_(arrow_type(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in dtype.fields])
    return _ARROW[type(dtype)]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: fixes the rows and ends the lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def row_place(table: DataFrame) -> list[Column]:
    """The file and the place in it of each row of a plain read of Parquet files."""
    place = table.metadataColumn("_metadata")
    return [place["file_path"].alias("__file"), place["row_index"].alias("__index")]


def stored(docs: DataFrame, kind: str) -> DataFrame:
    """``docs`` as a plain read of Parquet files: itself, or written once to the shared folder."""
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            docs.select(*row_place(docs))
            return docs
        except AnalysisException:
            pass  # not read from Parquet files
    path = run_dir(docs.sparkSession, kind)
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def without_rows(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``table``, a plain read, whose ``row_place`` is not in ``gone`` (checkpointed).

    Up to BROADCAST_BYTES of them are broadcast, more are joined by a shuffle."""
    taken = {c.lower() for c in table.columns}
    names = ["__file", "__index"]
    while taken & set(names):
        names = [f"{n}_" for n in names]
    size = gone.agg(F.sum(F.octet_length("__file") + 64)).first()[0] or 0
    gone = gone.toDF(*names)
    placed = table.select("*", *[c.alias(n) for c, n in zip(row_place(table), names)])
    return placed.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, names, "left_anti").drop(*names)


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most SLICE_BYTES of text (or one row)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(size):
        return
    total = np.cumsum(size)
    first = 0
    while first < len(size):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


class IdCache:
    """Id lists of strings solved before, kept flat. Beyond ``limit`` strings the half that
    was used least goes, so frequent strings are never solved twice in a task.

    ``solve(strings)`` gives one int32 array for each of a list of distinct strings.
    """

    def __init__(self, solve: Callable[[list[str]], list[np.ndarray]], limit: int):
        self.solve, self.limit = solve, limit
        self.number: dict[str, int] = {}
        self.ids, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)

    def _drop_rare(self) -> None:
        keep = np.zeros(len(self.number), dtype=bool)
        keep[np.argsort(-self.used, kind="stable")[: self.limit // 2]] = True
        old = np.flatnonzero(keep)
        place = np.cumsum(keep) - 1
        self.number = {s: int(place[k]) for s, k in self.number.items() if keep[k]}
        self.ids = self.ids[np.repeat(keep, self.size)]
        self.size, self.used = self.size[old], self.used[old] // 2
        self.at = np.cumsum(self.size) - self.size

    def ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The id lists of ``strings`` one after the other, and how long each is."""
        if len(self.number) > self.limit:
            self._drop_rare()
        new = [s for s in set(strings) if s not in self.number]
        if new:
            lists = self.solve(new)
            for s in new:
                self.number[s] = len(self.number)
            self.ids = np.concatenate([self.ids, *lists])
            self.size = np.append(self.size, np.array([len(x) for x in lists], dtype=np.int64))
            self.used = np.append(self.used, np.zeros(len(new), dtype=np.int64))
            self.at = np.cumsum(self.size) - self.size
        if not strings:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        which = np.array(list(map(self.number.__getitem__, strings)), dtype=np.int64)
        self.used += np.bincount(which, minlength=len(self.used))
        size = self.size[which]
        stop = np.cumsum(size)
        return self.ids[np.arange(stop[-1]) + np.repeat(self.at[which] - (stop - size), size)], size


def map_texts(
    df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], start: Callable[[], Callable]
) -> DataFrame:
    """``keep`` columns plus ``fields`` computed from ``text``, row for row, without a shuffle.

    ``start()`` runs once per task and returns ``fn(texts) -> {field: values}`` for a
    list of strings (None for null).
    """
    kept = [df.schema[c] for c in keep]
    schema = T.StructType(kept + fields)
    width = len(keep)

    def run(batches):
        fn = start()
        for batch in batches:
            for part in text_slices(batch, width):
                made = fn(part.column(width).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(width)]
                    + [pa.array(made[f.name], type=arrow_type(f.dataType)) for f in fields],
                    names=[f.name for f in schema.fields],
                )

    inner = df.select([F.col(c) for c in keep] + [F.col(text).cast("string").alias("__text")])
    return inner.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, start: Callable[[], Callable]) -> DataFrame:
    """The rows of ``df`` (all columns as they are) whose text ``fn`` accepts, without a shuffle."""
    where = df.columns.index(text)

    def run(batches):
        fn = start()
        for batch in batches:
            for part in text_slices(batch, where):
                yield part.filter(pa.array(fn(part.column(where).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the 0-based position of each row in its group, by ``order``.

    Rows are range-partitioned by (group, order, a unique tie-breaker), so Spark's
    sampled bounds spread a group of any size, even one of identical rows, over many
    tasks. Each task numbers its own runs; a group can begin in an earlier partition
    only if it is the first one of its partition, so one row per partition says how
    far each first run is shifted. Equal rows are numbered in an arbitrary but fixed
    order (the numbered rows are checkpointed). NULL keys form a group of their own.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in [*group, *order]] + [F.col("__tie")]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    at = [df.columns.index(c) for c in group]
    schema = T.StructType(
        [*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__run", T.IntegerType()), T.StructField("__at", T.LongType())]
    )

    def run(batches):
        from pyspark import TaskContext

        part, run_no, at_run, last = TaskContext.get().partitionId(), -1, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            first = tuple(b.column(i)[0].as_py() for i in at)
            new[0] = last is None or first != last
            for i in at:
                c = b.column(i)
                x, y = c.slice(0, n - 1), c.slice(1)
                differ = pc.if_else(
                    pc.and_(pc.is_valid(x), pc.is_valid(y)), pc.fill_null(pc.not_equal(x, y), False), pc.not_equal(pc.is_valid(x), pc.is_valid(y))
                )
                new[1:] |= np.asarray(differ, dtype=bool)
            runs = run_no + np.cumsum(new)
            starts = np.flatnonzero(new)
            base = np.full(n, -at_run, dtype=np.int64)
            if len(starts):
                base[starts[0]:] = np.repeat(starts, np.diff(np.append(starts, n)))
            pos = np.arange(n, dtype=np.int64) - base
            run_no, at_run = int(runs[-1]), int(pos[-1]) + 1
            last = tuple(b.column(i)[n - 1].as_py() for i in at)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part), pa.int32()), pa.array(runs, pa.int32()), pa.array(pos)],
                names=[f.name for f in schema.fields],
            )

    rows = cut(ranged.mapInArrow(run, schema))
    # One row per partition: its first group, its last group and that run's length.
    edge = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
    ends = (
        rows.groupBy("__part")
        .agg(
            F.min_by(edge, F.col("__run")).alias("head"),
            F.max_by(edge, F.col("__run")).alias("tail"),
            F.max("__run").alias("runs"),
            F.max_by(F.col("__at"), F.struct("__run", "__at")).alias("tail_at"),
        )
        .orderBy("__part")
        .collect()
    )
    shift, carry, tail = [], 0, None
    for i, e in enumerate(ends):
        add = carry if i and e["head"] == tail else 0
        shift.append((e["__part"], add))
        carry = e["tail_at"] + 1 + (add if e["runs"] == 0 else 0)
        tail = e["tail"]
    moved = spark.createDataFrame([s for s in shift if s[1]], "`__part` int, `__shift` long")
    return (
        rows.withColumn("__part", F.when(F.col("__run") == 0, F.col("__part")))
        .join(F.broadcast(moved), "__part", "left")
        .select(*[F.col(c) for c in df.columns], (F.col("__at") + F.coalesce(F.col("__shift"), F.lit(0))).alias(name))
    )


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trained, per_class: int, id_col: str = "doc_id", text_col: str = "text", classes=(0, 1)) -> DataFrame:
    """(__y, __text): at most ``per_class`` documents of each label of ``classes``.

    Taken by a hash of the id among the labels that ``trained`` (a condition on the id
    column, ``__id``) admits, so the sample is the same at every run and is bounded at
    every size; the chosen ids (per_class rows of two numbers for each label) are broadcast.
    Null ids, labels and texts are not learned from; of rows with one id one is taken.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).where(trained)
    picks = [rows.where(F.col("__y") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in classes]
    chosen = F.broadcast(reduce(DataFrame.union, picks).dropDuplicates(["__id"]))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return texts.where("__text IS NOT NULL").join(chosen, "__id").dropDuplicates(["__id"]).select("__y", "__text")
