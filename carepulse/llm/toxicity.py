"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear SVM.

The kernel compares strings by the three-letter subsequences they share, each weighted
by ``DECAY`` per skipped character, so a few inserted characters or a changed ending
cost little. Landmarks are the strings that stand out in sentences of toxic training
documents, measured by the number of different words they follow (so copies of one
sentence count once), plus ordinary words. Strings are mapped to their normalised
kernel values with the landmarks, whitened (Nyström), and a linear SVM is fitted on
sentences, each represented by its strongest word (its own margin picks the word).

A linear function of kernel values with fixed landmarks is a linear function of the
subsequence features, so the fitted model is folded into one weight per subsequence:
scoring a word needs no landmark any more. A sentence scores as its strongest word; a
logistic curve over the strongest few, each word counted once, turns a document into a
probability, moved so that THRESHOLD falls where training documents are told apart best.

Insults of several words that are harmless alone are learned the same way from windows
of up to three neighbouring words (``fit_phrases``): the kernel of a window takes
letters on both sides of a space, a space counts as a skipped character. Telling windows
are those found after far more different words of toxic training documents than any of
their own words explains or chance would give;
the landmarks are picked among them and among the strongest windows of clean documents
until all are represented (pivoted Cholesky, no limit on their number), and a document's
strongest window is one more term of its curve. Where no window tells, nothing is added.

Learning takes a bounded sample (``PER_CLASS`` documents of each label, at most
``SENTENCES`` sentences of each, by hash, longer ones than ``SENTENCE_CHARS`` in pieces);
toxic sentences without a word like one of the ``LANDMARKS`` telling ones are not learned
from. Scoring covers every word of every text.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, filter_texts, labelled_sample, map_texts

DECAY = 0.6
MAX_GAPS = 3
PER_CLASS = 1000
SENTENCES = 32
LANDMARKS = 96
PLAIN_LANDMARKS = 32
STEMS = 2000
STEM_WORDS = 4
#: A document is judged by its so many strongest words, each counted once.
STRONGEST = 3
WORD_PIECE = 48
CACHE = 200_000
THRESHOLD = 0.3
#: Windows of words are scored so many at a time; landmarks for them are added until each has at most so much left.
PHRASE_STEP = 50_000
PHRASE_REST = 0.2
#: A window tells only if one as good comes up by chance in at most exp(-BY_CHANCE) of all fits.
BY_CHANCE = 5.0

_OFFSETS = [(a, b) for a in range(1, MAX_GAPS + 2) for b in range(1, MAX_GAPS + 2) if a + b - 2 <= MAX_GAPS]
_BASE = 64
_FEATURES = _BASE**3
_EDGE = 63
#: Digits and signs that stand for a letter.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n。！？｡؟۔।॥]+")
#: A longer sentence is learned from in pieces, cut at white space where there is some.
SENTENCE_CHARS = 2000
_NO_MODEL = "toxicity: both labels are there but {}; without a model every score is 0 and no document is dropped"
_STRIP = ".,;:!?\"'()[]{}<>«»¡¿…"


def _letter_codes() -> np.ndarray:
    codes = np.zeros(1024, dtype=np.int64)
    for cp in range(1, 1024):
        c = LOOKALIKES.get(chr(cp), chr(cp))
        if "a" <= c <= "z":
            codes[cp] = ord(c) - 96
        elif c.isalnum():
            codes[cp] = 27 + cp % 36
    codes[0] = _EDGE
    return codes


_CODES = _letter_codes()


def words_of(text: str) -> list[str]:
    """Lower-cased words, and letters spaced out one by one joined to a word."""
    low = text.lower().replace("\0", " ")
    words = low.split()
    words.extend("".join(m.group().split()) for m in _SPACED.finditer(low))
    return words


def _pieces(word: str) -> list[str]:
    """A word without outer punctuation, also without inner signs; a very long one as overlapping pieces."""
    word = word.strip(_STRIP)
    if len(word) <= WORD_PIECE:
        bare = "".join(c for c in word if c.isalnum() or c in LOOKALIKES)
        return [word, bare] if len(word) > len(bare) > 2 else [word]
    return [word[i : i + WORD_PIECE] for i in range(0, len(word) - WORD_PIECE // 2, WORD_PIECE // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, value) of every word's feature map, each pair once."""
    cps = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    code = np.where(cps < 1024, _CODES[np.minimum(cps, 1023)], 27 + cps % 36)
    edge = cps == 0
    owner = np.cumsum(edge) - 1
    ends = np.append(np.flatnonzero(edge), len(cps))
    stop = ends[owner + 1]
    keys, values = [], []
    for a, b in _OFFSETS:
        n = len(code) - a - b
        if n <= 0:
            continue
        x, y, z = code[:n], code[a : a + n], code[a + b : a + b + n]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & (np.arange(a + b, n + a + b) <= stop[:n]))
        keys.append(owner[at] * _FEATURES + (x[at] * _BASE + y[at]) * _BASE + z[at])
        values.append(np.full(len(at), DECAY ** (a + b - 2)))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key)
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    value = np.add.reduceat(value, first) if len(first) else value
    return key[first] // _FEATURES, key[first] % _FEATURES, value


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel values of every string of ``left`` with every one of ``right`` (few)."""
    r, u, v = subsequences(right)
    used, compact = np.unique(u, return_inverse=True)
    table = np.zeros((len(used) + 1, len(right)))
    np.add.at(table, (compact, r), v)
    norm = np.sqrt((table**2).sum(axis=0))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, len(left), 2_000):
        l, u, v = subsequences(left[lo : lo + 2_000])
        own = np.sqrt(np.bincount(l, v * v, minlength=min(2_000, len(left) - lo)))
        at = np.searchsorted(used, u) if len(used) else np.zeros(len(u), dtype=np.int64)
        at = np.where((at < len(used)) & (used[np.minimum(at, len(used) - 1)] == u), at, len(used)) if len(used) else at
        hit = np.flatnonzero(at < len(used))
        if len(hit):
            first = np.flatnonzero(np.append(True, l[hit][1:] != l[hit][:-1]))
            out[l[hit][first] + lo] = np.add.reduceat(table[at[hit]] * v[hit, None], first, axis=0)
        out[lo : lo + 2_000] /= np.maximum(own[:, None], 1e-9)
    out /= np.maximum(norm, 1e-9)
    return out


@dataclass
class ToxicityModel:
    """One weight per subsequence, the SVM's bias and the logistic curve."""

    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float
    phrases: tuple[np.ndarray, float] | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        pieces, owner = [], []
        for i, w in enumerate(words):
            for p in _pieces(w):
                pieces.append(p)
                owner.append(i)
        best = np.full(len(words), -np.inf)
        for lo in range(0, len(pieces), 10_000):
            part = pieces[lo : lo + 10_000]
            l, u, v = subsequences(part)
            dot = np.bincount(l, v * self.weights[u], minlength=len(part))
            norm = np.sqrt(np.bincount(l, v * v, minlength=len(part)))
            np.maximum.at(best, owner[lo : lo + 10_000], dot / np.maximum(norm, 1e-9) + self.bias)
        return best

    def probability(self, strongest: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(strongest @ self.slopes + self.offset, -30, 30)))


def _sentence_pieces(sentence: str) -> list[str]:
    out = []
    while len(sentence) > SENTENCE_CHARS:
        at = max((m.start() for m in re.finditer(r"\s", sentence[:SENTENCE_CHARS])), default=SENTENCE_CHARS)
        out.append(sentence[:at])
        sentence = sentence[at:].strip()
    return [p for p in [*out, sentence] if p]


def _training_sentences(batches):
    """(y, document, sentence) of at most SENTENCES sentences of each document, by hash."""
    for batch in batches:
        out = []
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = sorted({p for s in _SENTENCE.split(text) for p in _sentence_pieces(s.strip())}, key=lambda s: zlib.crc32(s.encode("utf-8", "replace")))
            doc = zlib.crc32(text.encode("utf-8", "replace"))
            out += [(y, doc, s) for s in parts[:SENTENCES]]
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["y", "doc", "sentence"]
        )


def _surprise(k: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Log-likelihood ratio of k of n contexts being toxic against the base rate; 0 if not above it."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    rest = n - k
    llr = k * np.log(np.maximum(k, 1e-9) / (n * rate)) + rest * np.log(np.maximum(rest, 1e-9) / (n * (1 - rate)))
    return np.where(k > n * max(rate, 0.5), llr, 0.0)


def _grams(word: str) -> set[str]:
    marked = f"\0{word}\0"
    return {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)} | {marked}


def _landmarks(words: list[str], clean: np.ndarray, toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Telling words and ordinary ones.

    Stems (short strings) that stand out are taken one by one, each only if most of its
    toxic contexts are not yet covered; a stem brings its commonest words of toxic
    documents and, as counterexamples, its commonest words of clean ones.
    """
    rate = toxic.sum() / max(1, toxic.sum() + clean.sum())
    pos: Counter = Counter()
    suspects = np.flatnonzero(toxic > clean).tolist()
    for i in suspects:
        for g in _grams(words[i]):
            pos[g] += int(toxic[i])
    total = {g: 0 for g, n in pos.items() if n >= 3}
    for i, w in enumerate(words):
        for g in _grams(w):
            if g in total:
                total[g] += int(clean[i] + toxic[i])
    names = sorted(total)
    score = _surprise([pos[g] for g in names], [total[g] for g in names], rate)
    order = sorted(np.flatnonzero(score > 10.0).tolist(), key=lambda i: (-score[i], -len(names[i]), names[i]))[:STEMS]
    found: dict[str, list[int]] = {names[i]: [] for i in order}
    for i, w in enumerate(words):
        for g in _grams(w):
            if g in found:
                found[g].append(i)
    covered: set[int] = set()
    telling: list[str] = []
    against: list[str] = []
    for i in order:
        own = [j for j in found[names[i]] if toxic[j] > clean[j]]
        fresh = [j for j in own if j not in covered]
        if toxic[fresh].sum() < 0.5 * toxic[own].sum() or len(telling) >= LANDMARKS:
            continue
        covered.update(own)
        by_count = sorted(fresh, key=lambda j: (-toxic[j], words[j]))
        telling += [words[j] for j in by_count[:STEM_WORDS]]
        known = sorted((j for j in found[names[i]] if clean[j] and toxic[j] <= clean[j]), key=lambda j: (-clean[j], words[j]))
        against += [words[j] for j in known[:STEM_WORDS]]
    telling = [w for w in dict.fromkeys(telling) if len(w) >= 3][:LANDMARKS]
    spare = sorted((words[i] for i in np.flatnonzero(clean).tolist()), key=lambda w: zlib.crc32(w.encode("utf-8", "replace")))
    ordinary = [w for w in dict.fromkeys(against[:PLAIN_LANDMARKS] + spare[:PLAIN_LANDMARKS]) if w and w not in telling]
    return telling, ordinary


def _fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) by full-batch gradient steps with momentum."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - sign * (x @ w + b)) * sign * weight
        gw, gb = 1e-3 * w - 2 * x.T @ slack, -2 * slack.sum()
        vw, vb = 0.9 * vw - 0.1 * gw, 0.9 * vb - 0.1 * gb
        w, b = w + vw, b + vb
    return w, b


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-negative slopes of a logistic fit with softened targets, each label counting alike."""
    pos, neg = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    w, b = np.ones(x.shape[1]), 0.0
    for _ in range(3000):
        d = (target - 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))) * weight
        w = np.maximum(0.0, w + 2.0 * (x.T @ d - 1e-4 * w))
        b += 2.0 * d.sum()
    return w


def _best_cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin with the fewest training documents on the wrong side (the widest such gap's middle)."""
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], y[order]
    wrong = np.append(0, np.cumsum(y == 1)) + np.append(np.cumsum((y == 0)[::-1])[::-1], 0)
    gap = np.append(np.append(0.0, np.diff(m)), 0.0)
    best = max(np.flatnonzero(wrong == wrong.min()).tolist(), key=lambda i: gap[i])
    return float((m[max(best - 1, 0)] + m[min(best, len(m) - 1)]) / 2)


def _fit_words(vocabulary: list[str], idx: list[np.ndarray], y: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float] | None:
    """One weight per subsequence and the bias for words; None where no word tells."""
    marks, ordinary = _landmarks(vocabulary, clean, toxic)
    if not marks:
        return None
    telling = len(marks)
    marks = marks + ordinary
    values = kernel(vocabulary, marks)
    lam, vec = np.linalg.eigh(kernel(marks, marks))
    whiten = vec @ np.diag(1 / np.sqrt(np.maximum(lam, 1e-3))) @ vec.T
    nearest = values[:, :telling].max(axis=1)
    margin = nearest - 2.0 * (clean > 0)
    w, b = np.zeros(len(marks)), 0.0
    for turn in range(3):
        # Each sentence stands for its strongest word; sentences of toxic documents
        # whose strongest word is seen in clean ones too say nothing and are left out.
        strongest = np.array([i[np.argmax(margin[i])] if len(i) else -1 for i in idx])
        use = (strongest >= 0) & ((y == 0) | ((clean[strongest] == 0) & (nearest[strongest] > 0.5)))
        pick, kind = strongest[use], y[use]
        (pick, kind), counts = np.unique(np.stack([pick, kind]), axis=1, return_counts=True)
        counts = np.sqrt(counts)  # rare words are to be told apart as well
        weight = counts / np.where(kind == 1, counts[kind == 1].sum(), counts[kind == 0].sum())
        if len(set(kind.tolist())) < 2:
            return None
        x = values[pick] @ whiten
        w, b = _fit_svm(x, kind, 0.5 * weight)
        margin = values @ (whiten @ w) + b
    r, u, v = subsequences(marks)
    norm = np.sqrt(np.bincount(r, v * v, minlength=len(marks)))
    weights = np.bincount(u, v * (whiten @ w)[r] / np.maximum(norm[r], 1e-9), minlength=_FEATURES)
    return weights.astype(np.float32), float(b)


def fit(docs: DataFrame, labels: DataFrame, trained, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """A model from the sampled labelled documents; None if one of the labels is missing."""
    sample = cut(labelled_sample(docs, labels, label, trained, PER_CLASS, id_col, text_col))
    rows = sample.mapInArrow(_training_sentences, "y int, doc long, sentence string").toPandas()
    if rows["y"].nunique() < 2:
        if sample.select("__y").distinct().count() > 1:
            warnings.warn(_NO_MODEL.format("the documents of one label have no sentence"), stacklevel=2)
        return None
    rows = rows.sort_values(["doc", "sentence", "y"], ignore_index=True)
    number: dict[str, int] = {"": 0}
    idx: list[np.ndarray] = []
    for text in rows["sentence"]:
        idx.append(np.array([number.setdefault(p, len(number)) for w in words_of(text) for p in _pieces(w) if p], dtype=np.int64))
    vocabulary = list(number)
    y = rows["y"].to_numpy()
    # Contexts: each pair of a word and the word before it counts once for each label.
    word = np.concatenate(idx)
    before = np.concatenate([np.append(0, i[:-1]) if len(i) else i for i in idx])
    pairs = np.unique((np.repeat(y, [len(i) for i in idx]) * len(number) + before) * len(number) + word)
    label = pairs // len(number) ** 2
    clean = np.bincount(pairs[label == 0] % len(number), minlength=len(number))
    toxic = np.bincount(pairs[label == 1] % len(number), minlength=len(number))
    del word, before, pairs, label
    words, phrases = _fit_words(vocabulary, idx, y, clean, toxic), fit_phrases(sample)
    if words is None and phrases is None:
        warnings.warn(_NO_MODEL.format("no string stands out in toxic documents"), stacklevel=2)
        return None
    weights, bias = words or (np.zeros(_FEATURES, dtype=np.float32), -1.0)
    model = ToxicityModel(weights, bias, np.ones(STRONGEST + (phrases is not None)), 0.0, phrases)
    # The curve is fitted on the sample's whole documents.
    judged = sample.mapInArrow(_strongest(model), "y int, m array<double>").toPandas()
    x, y = np.array(judged["m"].tolist()), judged["y"].to_numpy()
    model.slopes = _fit_curve(x, y)
    model.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(x @ model.slopes, y))
    return model


def phrase_triples(text: str):
    """(start, span, subsequence, value) of the letter triples of ``text``; signs and spaces are skipped characters."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    code = np.where(cps < 1024, _CODES[np.minimum(cps, 1023)], 27 + cps % 36)
    code[cps <= 32] = 0
    for a, b in _OFFSETS:
        n = len(code) - a - b
        if n > 0:
            x, y, z = code[:n], code[a : a + n], code[a + b : a + b + n]
            at = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
            yield at, a + b, (x[at] * _BASE + y[at]) * _BASE + z[at], DECAY ** (a + b - 2)


def _phrase_map(phrases: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase number, subsequence, value divided by the phrase's norm) of every occurrence."""
    text = "\n".join(phrases)
    owner = np.cumsum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32) == 10)
    rows, keys, values = [], [], []
    for at, span, u, value in phrase_triples(text):
        own = owner[at] == owner[at + span]
        rows.append(owner[at][own])
        keys.append(u[own])
        values.append(np.full(len(rows[-1]), value))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    row, key, value = map(np.concatenate, (rows, keys, values))
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(phrases)))
    return row, key, value / np.maximum(norm[row], 1e-9)


def phrase_kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Kernel values of every window of ``left`` with every one of ``right`` (few), by occurrences."""
    r, u, v = _phrase_map(right)
    used = np.unique(u)
    table = np.zeros((len(used), len(right)))
    np.add.at(table, (np.searchsorted(used, u), r), v)
    out = np.zeros((len(left), len(right)))
    for lo in range(0, len(left), 200):
        row, u, v = _phrase_map(left[lo : lo + 200])
        hit = np.isin(u, used)
        np.add.at(out, row[hit] + lo, table[np.searchsorted(used, u[hit])] * v[hit, None])
    return out


def phrase_words(text: str) -> list[str]:
    return [w for w in (w.strip(_STRIP) for w in text.lower().split()) if w]


def strongest_windows(texts: list[str | None], weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[str]]:
    """Each text's strongest window of up to 3 neighbouring words (one, for words run together): its margin and itself (bias and "" for none)."""
    best, window = np.full(len(texts), bias), [""] * len(texts)
    for i, text in enumerate(texts):
        words = phrase_words(text or "")
        top = -np.inf
        for lo in range(0, len(words), PHRASE_STEP):
            part = words[lo : lo + PHRASE_STEP + 2]
            joined = " ".join(part)
            word = np.cumsum(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32) == 32)
            m = len(part)
            dot, norm = np.zeros((3, m)), np.zeros((3, m))
            for at, span, u, value in phrase_triples(joined):
                first = word[at]
                across = word[at + span] - first
                near = across < 3
                cell = across[near] * m + first[near]
                dot += value * np.bincount(cell, weights[u[near]], minlength=3 * m).reshape(3, m)
                norm += value * value * np.bincount(cell, minlength=3 * m).reshape(3, m)
            for n in (1, 2, 3):
                if m < n:
                    continue
                k = m - n + 1
                d, q = (sum(c[a, o : o + k] for a in range(n) for o in range(n - a)) for c in (dot, norm))
                margin = d / np.sqrt(np.maximum(q, 1e-9)) + bias
                at = int(np.argmax(margin))
                if margin[at] > top:
                    top, window[i] = margin[at], " ".join(part[at : at + n])
        if top > -np.inf:
            best[i] = top
    return best, window


def _windows(text: str) -> set[tuple[str, str]]:
    """Different (window of 1 to 3 words, word before it) of a text."""
    words = ["", *phrase_words(text)]
    return {(" ".join(words[i : i + n]), words[i - 1]) for n in (1, 2, 3) for i in range(1, len(words) - n + 1)}


def _windows_of(known: frozenset | None):
    """The windows of each document, only the known ones where given."""

    def run(batches):
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = [x for x in _windows(text) if known is None or x[0] in known]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["w", "before"])

    return run


def _pivots(phrases: list[str]) -> list[int]:
    """Landmarks by pivoted Cholesky: the worst represented next, until all are represented."""
    k = phrase_kernel(phrases, phrases)
    left, rows, picked = np.diag(k).copy(), np.zeros((0, len(phrases))), []
    while len(picked) < len(phrases) and left.max() > PHRASE_REST:
        i = int(np.argmax(left))
        row = (k[i] - rows[:, i] @ rows) / np.sqrt(left[i])
        rows = np.vstack([rows, row])
        left = np.maximum(0.0, left - row * row)
        left[i] = 0.0
        picked.append(i)
    return picked


def _clean_windows(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            _, found = strongest_windows(batch.column(1).to_pylist(), weights, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([w for w in found if w], pa.string())], names=["w"])

    return run


def telling_phrases(sample: DataFrame) -> dict[str, int]:
    """Windows of 2 and 3 words that stand out in toxic documents of the sample by more than
    twice what any of their words does, with the number of different words they follow there
    (so copies of one text count once). To stand out, a window must tell more than the best
    of as many windows would by chance."""

    def counts(y: int, known: frozenset | None, least: int) -> dict[str, int]:
        found = sample.where(F.col("__y") == y).select("__y", "__text").mapInArrow(_windows_of(known), "w string, before string")
        return {r["w"]: r["count"] for r in found.distinct().groupBy("w").count().where(F.col("count") >= least).collect()}

    size = {r["__y"]: r["count"] for r in sample.groupBy("__y").count().collect()}
    toxic = counts(1, None, 3)
    clean = counts(0, frozenset(toxic), 1)
    names = sorted(toxic)
    k = np.array([toxic[w] for w in names], float)
    score = _surprise(k, k + np.array([clean.get(w, 0) for w in names], float), size.get(1, 0) / max(1, sum(size.values())))
    told = dict(zip(names, score.tolist()))
    least = np.log(max(1, len(names))) + BY_CHANCE
    return {w: toxic[w] for w in names if " " in w and told[w] > max(least, 2 * max(told.get(p, 0.0) for p in w.split(" ")))}


def fit_phrases(sample: DataFrame) -> tuple[np.ndarray, float] | None:
    """One weight per subsequence and the bias for windows of words; None where no window tells."""
    found = telling_phrases(sample)
    if not found:
        return None
    told = sorted(found)
    row, key, value = _phrase_map(told)
    weights = np.bincount(key, value, minlength=_FEATURES) / len(told)
    clean_docs = sample.where(F.col("__y") == 0).select("__y", "__text")
    against: set[str] = set()
    bias = 0.0
    for _ in range(3):
        # The clean documents' strongest windows are the counterexamples of the next fit.
        against |= {r["w"] for r in clean_docs.mapInArrow(_clean_windows(weights), "w string").distinct().collect()} - set(told)
        windows = told + sorted(against)
        kind = np.arange(len(windows)) < len(told)
        weight = np.where(kind, 0.5 / len(told), 0.5 / max(1, len(against)))
        marks = [windows[i] for i in _pivots(windows)]
        lam, vec = np.linalg.eigh(phrase_kernel(marks, marks))
        whiten = vec @ np.diag(1 / np.sqrt(np.maximum(lam, 1e-3))) @ vec.T
        w, bias = _fit_svm(phrase_kernel(windows, marks) @ whiten, kind.astype(int), weight)
        row, key, value = _phrase_map(marks)
        weights = np.bincount(key, value * (whiten @ w)[row], minlength=_FEATURES)
    return weights.astype(np.float32), float(bias)


def _strongest(model: ToxicityModel):
    def run(batches):
        top = _scorer(model)()
        for batch in batches:
            made = top(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.tolist(), pa.list_(pa.float64()))], names=["y", "m"])

    return run


def _scorer(model: ToxicityModel):
    """Per task: texts to the margins of each one's strongest words, with a bounded cache of words."""

    def start():
        cache: dict[str, float] = {}

        def top(texts):
            sets = [set(words_of(t)) if t else set() for t in texts]
            if len(cache) > CACHE:
                cache.clear()
            new = list({w for ws in sets for w in ws if w not in cache})
            cache.update(zip(new, model.margins(new).tolist()))
            out = np.full((len(texts), STRONGEST), model.bias)
            for i, ws in enumerate(sets):
                best = nlargest(STRONGEST, map(cache.__getitem__, ws))
                out[i, : len(best)] = best
            if model.phrases is not None:
                out = np.column_stack([out, strongest_windows(texts, *model.phrases)[0]])
            return out

        return top

    return start


def score(docs: DataFrame, model: ToxicityModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``score`` (0 to 1) per row of ``docs``.

    Every word of every text is scored. Null and empty texts, and texts without any
    letter, score as words that share nothing with the landmarks do; without a model
    (a label is missing, or nothing tells the labels apart) every score is 0.
    """

    def start():
        if model is None:
            return lambda texts: {"score": [0.0] * len(texts)}
        top = _scorer(model)()
        return lambda texts: {"score": model.probability(top(texts)).tolist()}

    return map_texts(docs, text_col, keep, [T.StructField("score", T.DoubleType())], start)


def accept(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that score under THRESHOLD (all without a model)."""

    def start():
        if model is None:
            return lambda texts: [True] * len(texts)
        top = _scorer(model)()
        return lambda texts: (model.probability(top(texts)) < THRESHOLD).tolist()

    return filter_texts(docs, text_col, start)
