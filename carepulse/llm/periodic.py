"""Periodic runs of words, found by block convolution with an exact number-theoretic transform.

A run is a maximal stretch of words with smallest period q that holds at least ``COPIES``
periods and ``SHORTEST`` words. The texts of a slice form one sequence of word numbers
with a number of its own behind every text, so no run crosses texts.

At the dyadic scale B the sequence is cut into aligned blocks of B words. A run of period
q, (2B - 1) / (COPIES - 1) <= q < (4B - 1) / (COPIES - 1), holds a whole block together
with its copy q words on, so each scale owns a band of periods and looks for the copies
of its blocks at these distances only. The sum of squared differences between a block and
every place of its window is a convolution; it is taken by a number-theoretic transform
modulo a prime that is larger than any such sum, so a result of zero is a copy and a copy
gives zero. Neighbouring blocks with a copy at the same distance are one seed, which is
extended word by word to both sides. Of equal stretches that with the smallest period
stays; a stretch that long has its smaller period as a divisor, so nothing else is lost.

Blocks that hold a word which doesn't come again within the window have no copy and are
not transformed; neither are those inside a run of a smaller scale.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

COPIES = 4
SHORTEST = 6
#: 15 * 2**27 + 1, a prime with roots of unity of every order up to 2**27, and a generator.
PRIME, GENERATOR = 2013265921, 31
#: Transformed words that are held at a time.
BATCH_WORDS = 1 << 20

_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size / 2 - 1 of a primitive root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    out = np.ones(1, dtype=np.uint64)
    while len(out) < size // 2:  # doubles: the second half is the first times a power
        out = np.concatenate([out, _mod(out * np.uint64(pow(root, len(out), PRIME)))])
    return out


def _forward(a: np.ndarray) -> np.ndarray:
    """Transform of each row (natural order in, bit-reversed order out)."""
    rows, n = a.shape
    size = n
    while size > 1:
        half = size // 2
        a = a.reshape(rows, n // size, 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        out = np.empty_like(a)
        np.add(u, v, out=out[:, :, 0])
        out[:, :, 0] -= _P * (out[:, :, 0] >= _P)
        out[:, :, 1] = _mod((u + _P - v) * _roots(size, False))
        a, size = out, half
    return a.reshape(rows, n)


def _backward(a: np.ndarray) -> np.ndarray:
    """The inverse of ``_forward``."""
    rows, n = a.shape
    size = 2
    while size <= n:
        half = size // 2
        a = a.reshape(rows, n // size, 2, half)
        u, v = a[:, :, 0], _mod(a[:, :, 1] * _roots(size, True))
        out = np.empty_like(a)
        out[:, :, 0] = _mod(u + v)
        out[:, :, 1] = _mod(u + _P - v)
        a, size = out, size * 2
    return _mod(a.reshape(rows, n) * np.uint64(pow(n, PRIME - 2, PRIME)))


def band(block: int) -> tuple[int, int]:
    """The least and greatest period that blocks of this length look for."""
    return max(1, -(-(2 * block - 1) // (COPIES - 1))), -(-(4 * block - 1) // (COPIES - 1)) - 1


def copies(words: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``starts``, distance) of every exact copy of a block at a distance of the band.

    ``words`` are numbers below 2**31; the squared differences are summed over their
    digits, which are taken so small that no sum reaches the prime.
    """
    low, high = band(block)
    size = 2 * block
    bits = max(1, int(np.log2(np.sqrt((PRIME - 1) / block))))
    shifts = range(0, max(1, int(words.max(initial=0)).bit_length()), bits)
    padded = np.concatenate([words, np.zeros(size + high, dtype=words.dtype)])
    here, there = np.arange(block), low + np.arange(size)
    rows, distances = [], []
    step = max(1, BATCH_WORDS // size)
    for lo in range(0, len(starts), step):
        at = starts[lo : lo + step]
        total, product = None, None
        for s in shifts:
            x = (padded[at[:, None] + here] >> s) & ((1 << bits) - 1)
            y = (padded[at[:, None] + there] >> s) & ((1 << bits) - 1)
            squares = np.concatenate([np.zeros((len(at), 1), dtype=np.int64), np.cumsum(y * y, axis=1)], axis=1)
            part = (x * x).sum(axis=1)[:, None] + squares[:, block : block + high - low + 1] - squares[:, : high - low + 1]
            turned = np.zeros((len(at), size), dtype=np.uint64)
            turned[:, 0], turned[:, size - block + 1 :] = x[:, 0], x[:, :0:-1]
            made = _mod(_forward(turned) * _forward(y.astype(np.uint64)))
            total = part if total is None else total + part
            product = made if product is None else _mod(product + made)
        cross = _backward(product)[:, : high - low + 1].astype(np.int64)
        row, distance = np.nonzero((total - 2 * cross) % PRIME == 0)
        rows.append(row + lo)
        distances.append(distance + low)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row, distance = np.concatenate(rows), np.concatenate(distances)
    real = starts[row] + distance + block <= len(words)
    return row[real], distance[real]


def _grow(words: np.ndarray, at: np.ndarray, distance: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on (``way`` 1, or backwards with -1) equal those ``distance`` behind."""
    grown = np.zeros(len(at), dtype=np.int64)
    live, chunk = np.arange(len(at)), 8
    while len(live):
        reach = np.arange(chunk) * way
        for lo in range(0, len(live), max(1, (1 << 21) // chunk)):
            some = live[lo : lo + max(1, (1 << 21) // chunk)]
            i = (at[some] + way * grown[some])[:, None] + reach
            j = i + distance[some][:, None]
            inside = (i >= 0) & (j < len(words))
            same = inside & (words[np.where(inside, i, 0)] == words[np.where(inside, j, 0)])
            ended = ~same
            first = np.where(ended.any(axis=1), ended.argmax(axis=1), chunk)
            grown[some] += first
            live[lo : lo + len(some)] = np.where(first == chunk, some, -1)
        live = live[live >= 0]
        chunk = min(chunk * 2, 1 << 14)
    return grown


def find_runs(words: np.ndarray, text_sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs, by start and period.

    ``words`` are the word numbers of texts that each end with a number used only there;
    ``text_sizes`` are the texts' sizes with it.
    """
    n = len(words)
    none = np.zeros((0, 3), dtype=np.int64)
    if not n:
        return none
    words = np.asarray(words, dtype=np.int64)
    own_size = np.repeat(text_sizes - 1, text_sizes)
    # Distance to the next place of the same word.
    order = np.argsort(words, kind="stable")
    follows = np.full(n, n, dtype=np.int64)
    same = words[order[1:]] == words[order[:-1]]
    follows[order[:-1][same]] = (order[1:] - order[:-1])[same]
    reach = np.zeros(n, dtype=np.int64)  # how far a run that holds the word is known to go
    found = [none]
    block = 2
    while COPIES * band(block)[0] <= own_size.max():
        low, high = band(block)
        starts = np.arange(0, n - block + 1, block)
        farthest = follows[: len(starts) * block].reshape(-1, block).max(axis=1)
        starts = starts[(farthest <= high) & (own_size[starts] >= max(COPIES * low, SHORTEST)) & (reach[starts] < starts + block + high)]
        row, distance = copies(words, starts, block)
        at = starts[row]
        new = reach[at] < at + block + distance
        at, distance = at[new], distance[new]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        joins = np.zeros(len(at), dtype=bool)
        joins[1:] = (distance[1:] == distance[:-1]) & (at[1:] == at[:-1] + block)
        first = np.flatnonzero(~joins)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        left, right, distance = at[first], at[last] + block, distance[first]
        start = left - _grow(words, left - 1, distance, -1)
        end = right + _grow(words, right, distance, 1) + distance
        long = end - start >= np.maximum(COPIES * distance, SHORTEST)
        runs = np.stack([start[long], end[long], distance[long]], axis=1)
        found.append(runs)
        for s, e, q in runs.tolist():
            if q <= block:
                np.maximum(reach[s:e], e, out=reach[s:e])
        block *= 2
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end and period
    keep = np.ones(len(runs), dtype=bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[keep]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
FIELDS = [
    T.StructField("runs", T.ArrayType(_RUN)),
    T.StructField("strongest", _RUN),
    T.StructField("collapsed", T.StringType()),
]
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties by start, then period."""
    best = None
    for r in runs:  # in the order that breaks ties
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _describe(found: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each list of words."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    for i, words in enumerate(found):
        ids += [number.setdefault(w, len(number)) for w in words]
        ids.append(-1 - i)
    sequence = np.array(ids, dtype=np.int64)
    ends = sequence < 0
    sequence[ends] = len(number) - 1 - sequence[ends]
    sizes = np.array([len(w) + 1 for w in found], dtype=np.int64)
    runs = find_runs(sequence, sizes)
    firsts = np.cumsum(sizes) - sizes
    of = np.searchsorted(firsts, runs[:, 0], side="right") - 1
    out = []
    bounds = np.searchsorted(of, np.arange(len(found) + 1))
    for i, words in enumerate(found):
        mine = runs[bounds[i] : bounds[i + 1]]
        listed = [(s - int(firsts[i]), e - s, q) for s, e, q in mine.tolist()]
        if listed:
            kept = np.ones(len(words), dtype=bool)
            for s, size, q in listed:
                kept[s + q : s + size] = False
            words = [words[k] for k in np.flatnonzero(kept).tolist()]
        out.append((listed, b" ".join(words)))
    return out


def periodic_runs(
    docs: DataFrame, keep: list[str], text_col: str = "text", edit: Callable[[dict, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """``keep`` with the ``runs`` (by start, then period), the ``strongest`` run and the text
    ``collapsed`` to one period per run, for each row of ``docs``.

    Words are what stands between space, tab, line feed, vertical tab, form feed and
    carriage return. A null or blank text has no word: no runs, null strongest, empty
    collapsed text. Equal rows give equal results, an empty table gives none. Whole texts
    are searched; a text longer than a slice goes by itself, with memory in proportion.
    Of runs that are equally strong the first, then that with the smaller period, is the
    strongest. ``edit(kept columns, words)`` may change a row's words before the search.
    """
    width = len(keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], *FIELDS])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, width):
                found = [(t or "").encode().split() for t in part.column(width).to_pylist()]
                if edit:
                    rows = part.select(list(range(width))).to_pylist() if width else [{}] * len(found)
                    found = [edit(row, words) for row, words in zip(rows, found)]
                made = _describe(found)
                as_run = [None if b is None else {"start": b[0], "length": b[1], "period": b[2]} for b in (_strongest(r) for r, _ in made)]
                flat = np.array([x for r, _ in made for x in r], dtype=np.int64).reshape(-1, 3)
                ends = np.append(0, np.cumsum([len(r) for r, _ in made])).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in range(width)],
                        pa.ListArray.from_arrays(pa.array(ends), values),
                        pa.array(as_run, type=_ARROW_RUN),
                        pa.array([c.decode() for _, c in made], type=pa.string()),
                    ],
                    names=schema.names,
                )

    inner = docs.select([F.col(c) for c in keep] + [F.col(text_col).cast("string").alias("__text")])
    return inner.mapInArrow(run, schema)
