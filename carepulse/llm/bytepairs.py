"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A slice of texts becomes one array of code points and, by a table, one array of their
classes. A small automaton over the classes knows where pieces begin. Every class is a
function from state to state; the functions that arise by composing them are few, so a
composition is a table lookup, and since it is associative the states at all characters
come from a blocked prefix scan instead of a walk. Looking at the state before a
character, its class and the next class says whether a piece begins there; no pattern
is matched against the text.

The pieces then go through a cache of merged pieces. Those not seen before are merged
together, many pieces of one length at a time: in every round each piece joins its
leftmost pair of lowest rank. Every token keeps its byte offset, so any span of tokens
decodes to its part of the text without decoding from the start.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IdCache, text_slices

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
CACHE = 200_000
LONG_PIECE = 96
NONE = np.int32(2**31 - 1)

# Classes of characters.
END, SPACE, BLANK, NUMBER, OTHER, QUOTE, LETTER, SHORT, R_OR_V, ELL, E = range(11)
# What the automaton remembers after a character.
START, AFTER_SPACE, AFTER_BLANK, IN_NUMBER, IN_OTHER, IN_LETTERS, AT_QUOTE, SUFFIX, QUOTE_RV, QUOTE_L = range(10)
_LETTERS = (LETTER, SHORT, R_OR_V, ELL, E)


def _after(state: int, cls: int) -> int:
    """The state after a character of class ``cls``."""
    if cls in (END, SPACE, BLANK, NUMBER, OTHER):
        return {END: START, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, NUMBER: IN_NUMBER, OTHER: IN_OTHER}[cls]
    if cls == QUOTE:  # begins a piece unless a space or a run of symbols holds it
        return IN_OTHER if state in (AFTER_SPACE, IN_OTHER, AT_QUOTE) else AT_QUOTE
    if state == AT_QUOTE and cls in (SHORT, R_OR_V, ELL):
        return {SHORT: SUFFIX, R_OR_V: QUOTE_RV, ELL: QUOTE_L}[cls]
    if (state, cls) in ((QUOTE_RV, E), (QUOTE_L, ELL)):
        return SUFFIX
    return IN_LETTERS


def _begins(state: int, cls: int, following: int) -> bool:
    """Whether a piece begins at a character of class ``cls`` read in ``state``."""
    if state in (START, SUFFIX) or cls == END:
        return True
    if cls in (SPACE, BLANK):  # the last blank of several stands apart from the others
        return state not in (AFTER_SPACE, AFTER_BLANK) or following not in (END, SPACE, BLANK)
    if state == AFTER_SPACE:
        return False
    if cls == NUMBER:
        return state != IN_NUMBER
    if cls in (OTHER, QUOTE):
        return state not in (IN_OTHER, AT_QUOTE)
    if state == AT_QUOTE:
        joins = cls == SHORT or (cls == R_OR_V and following == E) or (cls == ELL and following == ELL)
        return not joins
    return state not in (IN_LETTERS, QUOTE_RV, QUOTE_L)


class Scan:
    """The functions that classes generate under composition, and prefix scans over them."""

    def __init__(self):
        states, classes = range(QUOTE_L + 1), range(E + 1)
        made = {tuple(states): 0}
        for c in classes:
            made.setdefault(tuple(_after(s, c) for s in states), len(made))
        found = list(made)
        for f in found:  # grows while it is walked
            for c in classes:
                g = tuple(_after(s, c) for s in f)
                if g not in made:
                    made[g] = len(made)
                    found.append(g)
        if len(made) > 256:
            raise AssertionError("functions no longer fit a byte")
        self.of_class = np.array([made[tuple(_after(s, c) for s in states)] for c in classes], dtype=np.uint8)
        self.size = len(made)
        self.then = np.array([[made[tuple(g[s] for s in f)] for g in found] for f in found], dtype=np.uint8).reshape(-1)
        self.from_start = np.array([f[START] for f in found], dtype=np.uint8)
        self.begins = np.array([[[_begins(s, c, n) for n in classes] for c in classes] for s in states]).reshape(-1)

    def prefixes(self, functions: np.ndarray, width: int = 256) -> np.ndarray:
        """The composition of the first i + 1 functions, for every i."""
        n = len(functions)
        if n <= width:
            out, at = np.empty(n, dtype=np.uint8), 0
            for i, f in enumerate(functions.tolist()):
                at = int(self.then[at * self.size + f])
                out[i] = at
            return out
        rows = -(-n // width)
        grid = np.zeros((rows, width), dtype=np.uint8)  # filled up with the identity
        grid.reshape(-1)[:n] = functions
        grid = np.ascontiguousarray(grid.T)
        for j in range(1, width):
            grid[j] = self.then[grid[j - 1].astype(np.int32) * self.size + grid[j]]
        before = np.append(np.uint8(0), self.prefixes(grid[-1])[:-1])
        return self.then[before.astype(np.int32)[None, :] * self.size + grid].T.reshape(-1)[:n]

    def boundaries(self, classes: np.ndarray) -> np.ndarray:
        """Where pieces begin (each END begins one, too); the text begins in state START."""
        state = self.from_start[self.prefixes(self.of_class[classes])]
        before = np.append(np.uint8(START), state[:-1]).astype(np.int32)
        following = np.append(classes[1:], np.uint8(END))
        return np.flatnonzero(self.begins[(before * (E + 1) + classes) * (E + 1) + following])


def class_table() -> np.ndarray:
    """The class of every code point. Letters, numbers and blanks are as the tokenizer's own
    pattern language counts them: the library marks them once, over all code points."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for name, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        marked = bytes(tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        table[np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32)] = cls
    for chars, cls in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("rv", R_OR_V), ("l", ELL), ("e", E)):
        table[[ord(c) for c in chars]] = cls
    return table


@dataclass
class Ranks:
    """A rank file: the bytes of every token, its rank being its id."""

    token: list[bytes]

    @staticmethod
    def load(path: str | None = None) -> Ranks:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(DEFAULT_RANKS)
        with open(path, "rb") as f:
            ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
        if sorted(ranks) != list(range(len(ranks))) or not {bytes([b]) for b in range(256)} <= set(ranks.values()):
            raise ValueError("ranks 0 to n - 1 with all single bytes are needed")
        return Ranks([ranks[i] for i in range(len(ranks))])


class Speller:
    """Spells ids as bytes."""

    def __init__(self, ranks: Ranks):
        self.spelled = np.frombuffer(b"".join(ranks.token), dtype=np.uint8)
        self.size = np.array([len(t) for t in ranks.token], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        size = self.size[ids]
        stop = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, dtype=np.uint8)
        return self.spelled[np.arange(stop[-1]) + np.repeat(self.at[ids] - (stop - size), size)]


class Merger:
    """Merges pieces to ids."""

    def __init__(self, ranks: Ranks):
        self.rank = {t: i for i, t in enumerate(ranks.token)}
        self.size = np.array([len(t) for t in ranks.token], dtype=np.int64)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {
            (self.rank[t[:k]], self.rank[t[k:]]): i
            for i, t in enumerate(ranks.token)
            for k in range(1, len(t))
            if t[:k] in self.rank and t[k:] in self.rank
        }
        n = len(ranks.token)
        key = np.array([a * n + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.key, self.joined = key[order], np.array(list(pairs.values()), dtype=np.int32)[order]
        self.pairs = pairs
        of_bytes = self._joined(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.of_bytes = of_bytes

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two neighbours make, or NONE."""
        key = left.astype(np.int64) * len(self.size) + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.joined[at], NONE)

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of distinct pieces."""
        spelled = [p.encode() for p in pieces]
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(spelled):
            whole = self.rank.get(b)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(b) > LONG_PIECE:
                out[i] = self._long(b)
            else:
                by_size.setdefault(len(b), []).append(i)
        for n, at in by_size.items():
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                raw = np.frombuffer(b"".join([spelled[i] for i in part]), dtype=np.uint8).reshape(len(part), n)
                for i, ids in zip(part, self._rounds(raw)):
                    out[i] = ids
        return out

    def _rounds(self, raw: np.ndarray) -> list[np.ndarray]:
        rows, n = raw.shape
        ids = self.byte[raw]
        rank = np.full((rows, n), NONE, dtype=np.int32)  # of the pair that begins here; the last begins none
        rank[:, :-1] = self.of_bytes[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
        out: list[np.ndarray] = [None] * rows
        who, column = np.arange(rows), np.arange(n)
        length = n
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), at]
            done = best == NONE
            for r in np.flatnonzero(done).tolist():
                out[who[r]] = ids[r, :length].copy()
            if done.all():
                return out
            if done.any():
                left = ~done
                who, ids, rank, at, best = who[left], ids[left], rank[left], at[left], best[left]
            # One pair of every piece becomes one token: what lies behind it moves up.
            length -= 1
            row = np.arange(len(who))
            moved = column[:length][None, :] + (column[:length][None, :] > at[:, None])
            ids, rank = np.take_along_axis(ids, moved, 1), np.take_along_axis(rank, moved, 1)
            ids[row, at] = best
            rank[row, at] = NONE
            some = at + 1 < length
            rank[row[some], at[some]] = self._joined(best[some], ids[row[some], at[some] + 1])
            some = at > 0
            rank[row[some], at[some] - 1] = self._joined(ids[row[some], at[some] - 1], best[some])

    def _long(self, raw: bytes) -> np.ndarray:
        """One long piece: a heap of pairs over a linked list of tokens."""
        ids = self.byte[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or self.pairs.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = r, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (m := self.pairs.get((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (m, a))
        return np.array([t for t in ids if t is not None], dtype=np.int32)


class Encoder:
    """Texts to ids, with a cache of merged pieces."""

    def __init__(self, ranks: Ranks, table: np.ndarray, cache: int = CACHE):
        self.table, self.scan, self.merger = table, Scan(), Merger(ranks)
        self.cache = IdCache(self.merger.merge, cache)

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all texts in order, and how many each text has."""
        joined = "\0".join(texts) + "\0"
        classes = self.table[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[ends] = END
        begin = self.scan.boundaries(classes)
        is_end = classes[begin] == END
        stops = np.append(begin[1:], len(classes))
        found = [joined[a:b] for a, b in zip(begin[~is_end].tolist(), stops[~is_end].tolist())]
        count = np.diff(np.append(-1, np.flatnonzero(is_end))) - 1
        return found, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        if not texts:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        found, count = self.pieces(texts)
        ids, size = self.cache.ids_of(found)
        total = np.append(0, np.cumsum(size))
        stop = np.cumsum(count)
        return ids, total[stop] - total[stop - count]


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("offsets", T.ArrayType(T.IntegerType())),
]


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """``keep`` with ``n_tokens``, the token ``ids`` and each token's byte ``offsets`` in the text.

    A null text is an empty one: no tokens. Whole texts are encoded, however long; a text
    longer than a slice goes by itself. Repeated rows give equal results, an empty table
    none. Strings of special tokens are ordinary text. Columns of ``docs`` that bear the
    names made here come back under ``keep`` only, so they must not be kept.
    """
    vocabulary, table = Ranks.load(ranks), class_table()
    width = len(keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], *FIELDS])

    def run(batches):
        encoder = Encoder(vocabulary, table)
        for batch in batches:
            for part in text_slices(batch, width):
                ids, count = encoder.encode([t or "" for t in part.column(width).to_pylist()])
                size = encoder.merger.size[ids]
                before = np.cumsum(size) - size
                first = np.cumsum(count) - count
                offsets = before - np.repeat(before[np.minimum(first, max(len(before) - 1, 0))] if len(before) else first, count)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(width)], pa.array(count, pa.int64()), _lists(ids, count), _lists(offsets, count)], names=schema.names
                )

    inner = docs.select([F.col(c) for c in keep] + [F.col(text_col).cast("string").alias("__text")])
    return inner.mapInArrow(run, schema)


def decode(encoded: DataFrame, keep: list[str], ids_col: str = "ids", offsets_col: str = "offsets", ranks: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """``keep``, the bytes ``decoded`` of each row's tokens from ``first`` to before ``last`` (all by
    default) and the byte ``decoded_at`` at which they begin in the text.

    A null list gives null, an empty one no bytes.
    """
    vocabulary = Ranks.load(ranks)
    width = len(keep)
    fields = [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_at", T.LongType())]
    schema = T.StructType([*[encoded.schema[c] for c in keep], *fields])

    def run(batches):
        speller = Speller(vocabulary)
        for batch in batches:
            step = max(1, 2_000_000 // max(1, -(-len(batch.column(width).flatten()) // max(1, batch.num_rows))))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                made, at = [], []
                for ids, offsets in zip(part.column(width), part.column(width + 1)):
                    if not ids.is_valid:
                        made.append(None), at.append(None)
                        continue
                    span = ids.values.to_numpy()[first:last]
                    made.append(speller.spell(span).tobytes())
                    at.append(offsets.values[first].as_py() if offsets.is_valid and first < len(offsets.values) else 0)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(width)], pa.array(made, pa.binary()), pa.array(at, pa.int64())], names=schema.names
                )

    inner = encoded.select([F.col(c) for c in keep] + [F.col(ids_col).alias("__ids"), F.col(offsets_col).alias("__offsets")])
    return inner.mapInArrow(run, schema)
