"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is described by what it is made of (letters, capitals, signs, repeated
words, its length) and by the same of the lines before and after it. The field labels
each line good or bad; forward-backward gives each line's marginal probability of good,
and a document's quality is their mean weighted by line length.

Learning takes a bounded sample: ``PER_CLASS`` documents of each label, by hash, and
of a document at most ``TRAIN_LINES`` neighbouring lines; all lines of a training
document take its label. Scoring covers every line of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import filter_texts, labelled_sample, map_texts

PER_CLASS = 1500
TRAIN_LINES = 64
THRESHOLD = 0.5
_NO_MODEL = "quality: both labels are there but the documents of one have no line; without a model every score is 1 and no document is dropped"
#: What one line tells, in this order (shares are of its characters or words).
LINE_FEATURES = [
    "log_chars", "log_words", "letters", "capitals", "digits", "spaces", "stops", "shouts", "bars", "other_signs",
    "word_length", "repeats_last", "repeats_last_but_one", "distinct_words", "signed_words", "shouted_words", "line_repeats",
]
_WIDTH = len(LINE_FEATURES)

_NEWLINE, _SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _SHOUT, _BAR, _SIGN = range(9)


def _kinds() -> np.ndarray:
    kinds = np.full(1024, _SIGN, dtype=np.int8)
    for cp in range(1024):
        c = chr(cp)
        if c == "\n":
            kinds[cp] = _NEWLINE
        elif c.isspace():
            kinds[cp] = _SPACE
        elif c.isalpha():
            kinds[cp] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            kinds[cp] = _DIGIT
        elif c in ".,;:?'\"()-":
            kinds[cp] = _STOP
        elif c == "!":
            kinds[cp] = _SHOUT
        elif c == "|":
            kinds[cp] = _BAR
    return kinds


_KINDS = _kinds()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, text number) of every line that is not blank, in order."""
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = np.where(cps < 1024, _KINDS[np.minimum(cps, 1023)], _LOWER)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    line_end = np.flatnonzero(kind == _NEWLINE)
    line_start = np.append(0, line_end[:-1] + 1)
    line_of = np.cumsum(kind == _NEWLINE) - (kind == _NEWLINE)
    n = len(line_end)
    counts = np.stack([np.bincount(line_of[kind == k], minlength=n) for k in range(1, 9)], axis=1).astype(np.float64)
    inside = kind > _SPACE
    start = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    stop = np.flatnonzero(inside & ~np.append(inside[1:], False))
    word_line = line_of[start]
    words = np.bincount(word_line, minlength=n).astype(np.float64)
    rep1, rep2, distinct, signed, shouted = (np.zeros(n) for _ in range(5))
    line_hash = np.zeros(n, dtype=np.uint64)
    if len(start):
        with np.errstate(over="ignore"):
            owner = np.cumsum(inside & ~np.append(False, inside[:-1])) - 1
            at = np.flatnonzero(inside)
            place = (at - start[owner[at]]).astype(np.uint64)
            mixed = (cps[at].astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
            mixed ^= mixed >> np.uint64(29)
            hashed = np.zeros(len(start), dtype=np.uint64)
            hashed = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), np.searchsorted(at, start))
        same = lambda k: np.bincount(word_line[k:][(hashed[k:] == hashed[:-k]) & (word_line[k:] == word_line[:-k])], minlength=n)
        rep1, rep2 = same(1), same(2)
        order = np.lexsort((hashed, word_line))
        fresh = np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (word_line[order][1:] != word_line[order][:-1]))
        distinct = np.bincount(word_line[order][fresh], minlength=n)
        signed = np.bincount(word_line[kind[stop] == _SIGN], minlength=n)
        shouted = np.bincount(word_line[kind[stop] == _SHOUT], minlength=n)
        with np.errstate(over="ignore"):
            rank = (np.arange(len(start)) - np.searchsorted(word_line, word_line)).astype(np.uint64) + np.uint64(3)
            first = np.flatnonzero(np.append(True, word_line[1:] != word_line[:-1]))
            line_hash[word_line[first]] = np.add.reduceat(hashed * (rank * np.uint64(0x94D049BB133111EB) | np.uint64(1)), first)
    text_of = np.searchsorted(text_ends, line_start, side="right")
    full = np.flatnonzero(words > 0)
    order = np.lexsort((line_hash[full], text_of[full]))
    h, t = line_hash[full][order], text_of[full][order]
    again = np.zeros(n)
    if len(full) > 1:
        twin = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        again[full[order[1:][twin]]] = 1.0
        again[full[order[:-1][twin]]] = 1.0
    chars = np.maximum(1.0, (line_end - line_start).astype(np.float64))
    w = np.maximum(1.0, words)
    letters = counts[:, _LOWER - 1] + counts[:, _UPPER - 1]
    x = np.stack(
        [
            np.log(chars), np.log(w), letters / chars, counts[:, _UPPER - 1] / np.maximum(1.0, letters), counts[:, _DIGIT - 1] / chars,
            counts[:, _SPACE - 1] / chars, counts[:, _STOP - 1] / chars, counts[:, _SHOUT - 1] / chars, counts[:, _BAR - 1] / chars,
            counts[:, _SIGN - 1] / chars, np.log((chars - counts[:, _SPACE - 1]) / w + 1), rep1 / (w + 4), rep2 / (w + 4), (distinct + 4) / (w + 4),
            signed / w, shouted / w, again,
        ],
        axis=1,
    )
    return x[full], chars[full], text_of[full]


def _neighbours(x: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after (0 where none), and flags for none."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    linked = (text_of[1:] == text_of[:-1])[:, None]
    before[1:] = np.where(linked, x[:-1], 0)
    after[:-1] = np.where(linked, x[1:], 0)
    edge = np.ones((len(x), 2))
    edge[1:, 0] = ~linked[:, 0]
    edge[:-1, 1] = ~linked[:, 0]
    return np.hstack([x, before, after, edge])


def _chains(text_of: np.ndarray):
    """Groups of texts of like length: (rows x lines) index arrays padded with -1."""
    if not len(text_of):
        return
    first = np.flatnonzero(np.append(True, text_of[1:] != text_of[:-1]))
    size = np.diff(np.append(first, len(text_of)))
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        small = size[order[lo]]
        hi = lo
        while hi < len(order) and size[order[hi]] <= 1.25 * small + 2 and (hi - lo) * int(size[order[hi]]) <= 2_000_000:
            hi += 1
        hi = max(hi, lo + 1)
        rows = order[lo:hi]
        steps = np.arange(size[rows].max())
        yield np.where(steps < size[rows][:, None], first[rows][:, None] + steps, -1)
        lo = hi


def _forward_backward(score: np.ndarray, move: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good per line, expected moves (2 x 2) and the log partition sum.

    ``score`` is each line's score of good (bad scores 0); ``move[a, b]`` that of label b
    after label a (0 bad, 1 good). Works step by step on all chains of a group at once.
    """
    there = index >= 0
    emit = np.zeros((*index.shape, 2))
    emit[..., 1] = np.where(there, score[np.maximum(index, 0)], 0.0)
    rows, steps = index.shape
    alpha = np.zeros((rows, steps, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, steps):
        nxt = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + emit[:, t]
        alpha[:, t] = np.where(there[:, t, None], nxt, alpha[:, t - 1])
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta = np.zeros((rows, 2))
    good = np.full((rows, steps), 0.5)
    moves = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        good[:, t] = np.exp(np.minimum(0.0, alpha[:, t, 1] + beta[:, 1] - total))
        if t:
            ahead = emit[:, t] + beta
            pair = alpha[:, t - 1, :, None] + move + ahead[:, None, :] - total[:, None, None]
            moves += np.where(there[:, t, None, None], np.exp(np.minimum(0.0, pair)), 0.0).sum(axis=0)
            back = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            beta = np.where(there[:, t, None], back, beta)
    return good, moves, float(total.sum())


@dataclass
class QualityModel:
    """Standardisation, line weights, bias and moves between labels; ``blank``: the score of no text."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    blank: float = 0.0

    def quality(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.blank)
        x, size, text_of = line_features([t or "" for t in texts])
        if not len(x):
            return out
        score = ((_neighbours(x, text_of) - self.mean) / self.scale) @ self.weights + self.bias
        good = np.zeros(len(x))
        for index in _chains(text_of):
            p, _, _ = _forward_backward(score, self.move, index)
            good[index[index >= 0]] = p[index >= 0]
        weight = np.bincount(text_of, size, minlength=len(texts))
        mass = np.bincount(text_of, size * good, minlength=len(texts))
        return np.where(weight > 0, mass / np.maximum(weight, 1e-9), out).clip(0, 1)


def _training_lines(batches):
    """(y, text number, features of lines) of at most TRAIN_LINES neighbouring lines of each document."""
    for batch in batches:
        y, flat = [], []
        texts = batch.column(1).to_pylist()
        for lo in range(0, len(texts), 64):
            part = texts[lo : lo + 64]
            x, _, text_of = line_features(part)
            rows = _neighbours(x, text_of)
            for i, label in enumerate(batch.column(0).slice(lo, 64).to_pylist()):
                own = rows[text_of == i]
                if len(own):
                    first = (len(own) - TRAIN_LINES) // 2 if len(own) > TRAIN_LINES else 0
                    y.append(label)
                    flat.append(own[first : first + TRAIN_LINES].astype(np.float32).ravel())
        ends = np.append(0, np.cumsum([len(f) for f in flat])).astype(np.int32)
        values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(y, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float32()))], names=["y", "x"]
        )


def fit(docs: DataFrame, labels: DataFrame, trained, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", steps: int = 120) -> QualityModel | None:
    """The field fitted by gradient steps on the sample's log likelihood; None if a label is missing."""
    sample = labelled_sample(docs, labels, label, trained, PER_CLASS, id_col, text_col)
    rows = sample.mapInArrow(_training_lines, "y int, x array<float>").toArrow()
    y = np.asarray(rows.column("y").combine_chunks(), dtype=np.int64)
    if len(set(y.tolist())) < 2:
        if sample.select("__y").distinct().count() > 1:
            warnings.warn(_NO_MODEL, stacklevel=2)
        return None
    width = 3 * _WIDTH + 2
    lists = rows.column("x").combine_chunks()
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, width)
    size = np.diff(np.asarray(lists.offsets)) // width
    text_of = np.repeat(np.arange(len(y)), size)
    line_y = y[text_of].astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    # Each label counts alike, and a long document no more than a short one.
    per_text = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) / size
    weight = per_text[text_of]
    groups = list(_chains(text_of))
    w, b, move = np.zeros(width), 0.0, np.zeros((2, 2))
    m1, m2 = np.zeros(width + 5), np.zeros(width + 5)
    seen = np.zeros((2, 2))
    for index in groups:
        both = (index[:, 1:] >= 0) & (index[:, :-1] >= 0)
        label_of = y[text_of[np.maximum(index[:, 0], 0)]]
        for c in (0, 1):
            seen[c, c] += both[label_of == c].sum()
    lines = len(x)
    for step in range(1, steps + 1):
        score = x @ w + b
        good, moves = np.zeros(lines), np.zeros((2, 2))
        for index in groups:
            p, mv, _ = _forward_backward(score, move, index)
            good[index[index >= 0]] = p[index >= 0]
            moves += mv
        d = (line_y - good) * weight
        grad = np.concatenate([x.T @ d - 1e-4 * w, [d.sum()], ((seen - moves) / lines - 0.02 * move).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        change = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b, move = w + change[:width], b + change[width], move + change[width + 1 :].reshape(2, 2)
    return QualityModel(mean, scale, w, float(b), move)


def _scorer(model: QualityModel | None):
    def start():
        return lambda texts: {"score": (model.quality(texts) if model is not None else np.ones(len(texts))).tolist()}

    return start


def score(docs: DataFrame, model: QualityModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1) per row of ``docs``.

    Every line of every text counts, by its length. Null texts and texts without a
    word score 0; without a model (a label is missing) every score is 1.
    """
    return map_texts(docs, text_col, keep, [T.StructField("score", T.DoubleType())], _scorer(model))


def accept(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that score THRESHOLD or more (all without a model)."""
    return filter_texts(docs, text_col, lambda: lambda texts: [True] * len(texts) if model is None else (model.quality(texts) >= THRESHOLD).tolist())
