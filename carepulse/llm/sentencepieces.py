"""SentencePiece encoding and decoding with exact N-best segmentations.

A text is encoded as the best path through the lattice of vocabulary pieces, by the
pieces' scores in the model; characters outside the vocabulary fall back to bytes.
Forward Viterbi gives the best score up to every position. For the N best paths a
search goes backwards from the end; the forward score of a position is exactly what
the rest of the path can still reach at best, so A* with it pops complete paths in
order of their score.

No piece of a supported vocabulary holds a space mark after another character (this is
checked), so the lattice of a text is the chain of the lattices of its words. Each
distinct word is solved once per task, many words of one length at a time; the N best
of a text differ from the best in those N - 1 word occurrences whose second-best path
costs least, and only for their words the A* search is run. That is exact.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 200_000
LONG_WORD = 256

_BASE = np.uint64(0xD6E8FEB86659FD93)
_LIKELY_BITS = 23
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


@dataclass
class PieceModel:
    """Pieces with ids and scores, the ids of the 256 bytes, and the score of an unknown character."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    bytes_at: list[int]
    unknown_score: float
    text_of: list[bytes]

    @staticmethod
    def load(path: str = DEFAULT_MODEL) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces that hold a space mark after another character are not supported")
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids) or sp.normalize("ﬁ  x") != f"{MARK}ﬁ{MARK}{MARK}x":
            raise ValueError("a model with byte fallback, a space in front and no other normalisation is needed")
        scores = np.array([sp.get_score(i) for i in plain])
        text_of = [b""] * size
        for i, p in zip(plain, pieces):
            text_of[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            text_of[i] = bytes([b])
        return PieceModel(pieces, np.array(plain), scores, byte_ids, float(scores.min()) - UNKNOWN_PENALTY, text_of)


class Segmenter:
    """Segments words (strings that begin with the space mark) and joins them to texts."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.piece = {p: (float(s), int(i)) for p, s, i in zip(model.pieces, model.scores, model.ids)}
        self.longest = max(map(len, model.pieces))
        self.tables = {}
        for n in sorted(set(map(len, model.pieces))):
            at = [k for k, p in enumerate(model.pieces) if len(p) == n]
            key = self._prefix(np.array([[ord(c) for c in model.pieces[k]] for k in at], dtype=np.uint64))[:, -1]
            order = np.argsort(key)
            self.tables[n] = (key[order], model.scores[at][order], model.ids[at][order])
        # Most substrings are no pieces; a table of the hashes' upper bits rules them out.
        self.likely = np.zeros(1 << _LIKELY_BITS, dtype=bool)
        for key, _, _ in self.tables.values():
            self.likely[key >> np.uint64(64 - _LIKELY_BITS)] = True
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.best, self.second = np.zeros(0), np.zeros(0)
        self.ids, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)
        self.ways: dict[str, list[tuple[float, list[int]]]] = {}

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of every prefix of each row."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                mixed = (codes[:, j] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                out[:, j + 1] = out[:, j] * _BASE + (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best and second-best scores of words of one length, their best paths' ids one after
        the other, and how many ids each has."""
        n, rows = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(rows, n).astype(np.uint64)
        prefix = self._prefix(codes)
        best = np.full((rows, n + 1), -np.inf)
        second = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0.0
        step = np.zeros((rows, n + 1), dtype=np.int32)
        piece = np.full((rows, n + 1), -1, dtype=np.int32)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                power.append(power[-1] * _BASE)
            for p in range(1, n + 1):
                for size in sorted((s for s in self.tables if s <= p), reverse=True):
                    keys, scores, ids = self.tables[size]
                    key = prefix[:, p] - prefix[:, p - size] * power[size]
                    hit = np.flatnonzero(self.likely[key >> np.uint64(64 - _LIKELY_BITS)])
                    if len(hit):
                        at = np.minimum(np.searchsorted(keys, key[hit]), len(keys) - 1)
                        real = keys[at] == key[hit]
                        hit, at = hit[real], at[real]
                    if size == 1 and len(hit) < rows:
                        miss = np.setdiff1d(np.arange(rows), hit, assume_unique=True)
                        self._offer(best, second, step, piece, miss, p, 1, np.full(len(miss), self.model.unknown_score), np.full(len(miss), -1))
                    if len(hit):
                        self._offer(best, second, step, piece, hit, p, size, scores[at], ids[at])
        back = np.full((rows, n), -2, dtype=np.int32)
        pos, count = np.full(rows, n), 0
        live = np.arange(rows)
        while len(live):
            back[live, n - 1 - count] = piece[live, pos[live]]
            pos[live] -= step[live, pos[live]]
            live = live[pos[live] > 0]
            count += 1
        real = back != -2
        size, ids = real.sum(axis=1), back[real]
        unknown = np.flatnonzero((back == -1).any(axis=1))
        if len(unknown):  # characters outside the vocabulary become several bytes
            stop, done, parts = np.cumsum(size), 0, []
            for i, first, last in zip(unknown.tolist(), (stop - size)[unknown].tolist(), stop[unknown].tolist()):
                spelled = np.array(self._with_bytes(words[i], ids[first:last].tolist()), dtype=np.int32)
                parts += [ids[done:first], spelled]
                done, size[i] = last, len(spelled)
            ids = np.concatenate([*parts, ids[done:]])
        return best[:, n], second[:, n], ids, size

    @staticmethod
    def _offer(best, second, step, piece, rows, p, size, score, ids) -> None:
        start = p - size
        first, other = best[rows, start] + score, second[rows, start] + score
        old = best[rows, p]
        better = first > old
        second[rows, p] = np.maximum(np.maximum(second[rows, p], other), np.minimum(first, old))
        at = rows[better]
        best[at, p] = first[better]
        step[at, p] = size
        piece[at, p] = ids[better]

    def _with_bytes(self, word: str, ids: list[int]) -> list[int]:
        """Ids with each unknown character (-1) as the ids of its bytes."""
        out, at = [], 0
        for i in ids:
            if i == -1:
                out += [self.model.bytes_at[b] for b in word[at].encode("utf-8", "replace")]
                at += 1
            else:
                out.append(i)
                at += len(self.model.text_of[i].decode())
        return out

    def _learn(self, words: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        best, second, ids, size = [self.best], [self.second], [self.ids], [np.diff(self.ends)]
        for n in sorted(by_size):
            if n > LONG_WORD:  # few and long: one at a time
                for w in by_size[n]:
                    paths = self.word_paths(w, 2)
                    best.append(np.array([paths[0][0]]))
                    second.append(np.array([paths[1][0] if len(paths) > 1 else -np.inf]))
                    ids.append(np.array(paths[0][1], dtype=np.int32))
                    size.append(np.array([len(paths[0][1])]))
            else:
                step = max(1, 500_000 // n)
                for lo in range(0, len(by_size[n]), step):
                    b, s, i, k = self._solve(by_size[n][lo : lo + step])
                    best.append(b), second.append(s), ids.append(i.astype(np.int32)), size.append(k)
            for w in by_size[n]:
                self.number[w] = len(self.number)
        self.best, self.second, self.ids = np.concatenate(best), np.concatenate(second), np.concatenate(ids)
        self.ends = np.append(0, np.cumsum(np.concatenate(size), dtype=np.int64))
        self.used = np.append(self.used, np.zeros(len(self.best) - len(self.used), dtype=np.int64))

    def _forget_rare(self) -> None:
        """Keeps the half of the cached words that was used most."""
        keep = np.zeros(len(self.number), dtype=bool)
        keep[np.argsort(-self.used, kind="stable")[: CACHE // 2]] = True
        place, size = np.cumsum(keep) - 1, np.diff(self.ends)
        self.number = {w: int(place[k]) for w, k in self.number.items() if keep[k]}
        self.ids = self.ids[np.repeat(keep, size)]
        self.ends = np.append(0, np.cumsum(size[keep], dtype=np.int64))
        self.best, self.second, self.used = self.best[keep], self.second[keep], self.used[keep] // 2
        self.ways = {w: p for w, p in self.ways.items() if w in self.number}

    def word_paths(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of one word: backward A*, with forward Viterbi scores as what is left.

        Equal scores come in the order of the longer last piece.
        """
        size = len(word)
        edges: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-np.inf] * size
        for p in range(1, size + 1):
            for k in range(1, min(p, self.longest) + 1):
                got = self.piece.get(word[p - k : p])
                if got is None and k == 1:
                    got = (self.model.unknown_score, -1)
                if got is not None:
                    edges[p].append((k, *got))
                    forward[p] = max(forward[p], forward[p - k] + got[0])
        # Partial paths are kept as (next step, id), so long words cost no copies. Of equal
        # scores the one that has come nearest to the start goes on: the longer last piece.
        chain: list[tuple[int, int]] = [(-1, -1)]
        heap = [(-forward[size], size, 0, 0.0)]
        out: list[tuple[float, list[int]]] = []
        while heap and len(out) < n:
            _, p, node, behind = heapq.heappop(heap)
            if p == 0:
                path = []
                while chain[node][0] >= 0:
                    path.append(chain[node][1])
                    node = chain[node][0]
                out.append((behind, self._with_bytes(word, path) if -1 in path else path))
                continue
            for k, score, i in reversed(edges[p]):
                chain.append((node, i))
                heapq.heappush(heap, (-(behind + score + forward[p - k]), p - k, len(chain) - 1, behind + score))
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """The text's words with their space marks; the first has the mark that encoding adds."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return _WORD.findall(MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def encode(self, texts: list[str], n: int = N_BEST) -> list[tuple[float, np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """Per text: the best score, its ids, and the n best paths in order.

        A path is (score, changes); a change (at, drop, ids) puts ids in the place of
        ``drop`` pieces of the best path from position ``at`` on. The first has none.
        """
        lists = [self.words(t) for t in texts]
        if len(self.number) > CACHE:
            self._forget_rare()
        new = {w for ws in lists for w in ws if w not in self.number}
        if new:
            self._learn(list(new))
        which = np.array([k for ws in lists for k in map(self.number.__getitem__, ws)], dtype=np.int64)
        self.used += np.bincount(which, minlength=len(self.used))
        out, done = [], 0
        for ws in lists:
            if not ws:
                out.append((0.0, np.zeros(0, dtype=np.int32), [(0.0, [])]))
                continue
            at, done = which[done : done + len(ws)], done + len(ws)
            size = self.ends[at + 1] - self.ends[at]
            stop = np.cumsum(size)
            ids = self.ids[np.arange(stop[-1]) + np.repeat(self.ends[at] - (stop - size), size)]
            total = float(self.best[at].sum())
            loss = self.best[at] - self.second[at]
            some = np.argpartition(loss, n - 1)[: n - 1] if len(loss) >= n else np.arange(len(loss))
            ways = [(0.0, ())]
            for o in sorted(some[np.isfinite(loss[some])].tolist(), key=lambda o: (loss[o], o)):
                if ws[o] not in self.ways:
                    self.ways[ws[o]] = self.word_paths(ws[o], n)
                paths = self.ways[ws[o]]
                more = [(s + p[0] - paths[0][0], (*c, (o, r)) if r else c) for s, c in ways for r, p in enumerate(paths)]
                ways = heapq.nsmallest(n, more, key=lambda w: -w[0])
            found = []
            for s, choice in ways[:n]:
                changes = [(int(stop[o] - size[o]), int(size[o]), self.ways[ws[o]][r][1]) for o, r in sorted(choice)]
                found.append((total + s, changes))
            out.append((total, ids, found))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, without the space that encoding put in front."""
        joined = b"".join(map(self.model.text_of.__getitem__, ids))
        return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


_CHANGE = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
_WAY = T.StructType([T.StructField("path_score", T.DoubleType()), T.StructField("changes", T.ArrayType(_CHANGE))])
FIELDS = [
    T.StructField("n_pieces", T.LongType()),
    T.StructField("best_score", T.DoubleType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("n_best", T.ArrayType(_WAY)),
    T.StructField("round_trip", T.BooleanType()),
]
_ARROW_WAYS = pa.list_(pa.struct([("path_score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", model: str = DEFAULT_MODEL, n: int = N_BEST) -> DataFrame:
    """``keep``, the best path (``n_pieces``, ``best_score``, ``ids``), the ``n_best`` paths and
    ``round_trip`` (the ids decode to the text) per row of ``docs``.

    Null texts have null results; an empty text has no pieces, score 0 and one path.
    Texts holding the space mark itself decode to spaces, as in SentencePiece. Whole
    texts are encoded, however long; repeated rows give equal results. ``n_best`` paths
    are given as changes to the best one.
    """
    pieces = PieceModel.load(model)
    width = len(keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], *FIELDS])

    def run(batches):
        segmenter = Segmenter(pieces)
        for batch in batches:
            for part in text_slices(batch, width):
                texts = part.column(width).to_pylist()
                made = segmenter.encode([t or "" for t in texts], n)
                null = np.array([t is None for t in texts], dtype=bool)
                size = np.array([len(x[1]) for x in made], dtype=np.int32)
                ends = np.append(np.int32(0), np.cumsum(size, dtype=np.int32))
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, mask=np.append(null, False)), pa.array(np.concatenate([x[1] for x in made]) if made else np.zeros(0, np.int32))
                )
                ways = [
                    None if t is None else [{"path_score": s, "changes": [{"at": a, "drop": d, "ids": i} for a, d, i in c]} for s, c in x[2]]
                    for t, x in zip(texts, made)
                ]
                back = [None if t is None else segmenter.decode(x[1].tolist()) == t for t, x in zip(texts, made)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in range(width)],
                        pa.array(size.astype(np.int64), mask=null),
                        pa.array(np.array([x[0] for x in made]), mask=null),
                        ids,
                        pa.array(ways, type=_ARROW_WAYS),
                        pa.array(back, pa.bool_()),
                    ],
                    names=schema.names,
                )

    inner = docs.select([F.col(c) for c in keep] + [F.col(text_col).cast("string").alias("__text")])
    return inner.mapInArrow(run, schema)
