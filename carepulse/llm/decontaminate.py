"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit check.

Texts are word sequences (lower-cased runs of letters and digits; in scripts without
spaces each character, with its marks, is a word). A benchmark item of
n words is leaked where some stretch of a document is within k = floor((1 - similarity)
* n) word edits of it. Documents are compared in item-sized windows:

1. a stretch within k edits of an item keeps all but run * k of its runs of
   run <= (n - k) / (k + 1) words, moved by at most k places against each other, so only
   windows laid over that many shared runs can match (nothing that can match is passed
   over here);
2. such a window and its item are embedded by the CGK random walk: a walk over
   the words that stays or steps at each of 3n times, as a shared random function of
   time and word says; few edits become few differing symbols;
3. in each repetition some fixed times are sampled; a window meets the item whose
   sampled symbols are equal. The number of repetitions is taken for each length n from
   a simulation with k random edits, so that the target recall is reached. Where
   ``MAX_REPEATS`` do not reach it, no window is left out here;
4. candidates are checked by exact word edit distance against the best stretch near
   the window.

The benchmark is the stated query set and goes to the tasks in blocks of bounded size
(``BLOCK_WORDS`` words, or one item), one block after the other; documents are scanned
without a shuffle, and only the numbers of leaked rows are joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_PLACE, arrow_type, cut, row_place, stored, text_slices, without_rows

SIMILARITY = 0.8
BLOCK_WORDS = 250_000
SAMPLED = 3
TARGET_RECALL = 0.98
#: Lengths that need more repetitions, or are longer, have all their windows checked.
MAX_REPEATS = 64
LONGEST_EMBEDDED = 128
#: Edited texts a length's recall is measured on.
TRIALS = 400
#: Walks (windows times repetitions) of one batch.
WALKS = 1 << 15
#: Cells of a row of the edit distances of one batch (or one stretch).
CELLS = 1 << 19
LONGEST_RUN = 4
#: Shared runs (of an item, at a place) listed at once, and places counted at once for an item that has more.
HITS = 1 << 20
#: Scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, kana, bopomofo, Han.
_UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3031, 0x3035),
    (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
_ALONE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNSPACED)
_MARKS = "".join(chr(c) for a, b in _UNSPACED[:-1] for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == "M")
#: A character of those scripts with its marks, or a run of other letters and digits.
WORD = re.compile(rf"(?![\W_])[{_ALONE}][{_MARKS}]*|[^\W_{_ALONE}]+")

#: Repetitions by (length, similarity, seed), measured once in a process.
_measured: dict[tuple[int, float, int], int | None] = {}

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * _MIX
        x = (x ^ (x >> np.uint64(30))) * _MIX2
        return x ^ (x >> np.uint64(27))


def edit_distances(items: np.ndarray, sizes: np.ndarray, texts: np.ndarray, lengths: np.ndarray, free_start: bool) -> np.ndarray:
    """Word edit distances (rows x columns): of each whole item to the stretch of its text
    that ends before column j, starting anywhere (``free_start``) or at the text's start."""
    rows, cols = texts.shape
    steps = np.arange(cols + 1)
    last = np.zeros((rows, cols + 1), dtype=np.int64) + (0 if free_start else steps)
    out = last.copy()
    for i in range(items.shape[1]):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(last[:, :-1] + (items[:, i, None] != texts), last[:, 1:] + 1)
        now = np.minimum.accumulate(now - steps, axis=1) + steps
        last = now
        done = sizes == i + 1
        out[done] = now[done]
    out[steps[None, :] > lengths[:, None]] = 1 << 30
    return out


def _within(loads: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring loads that sum to ``limit`` at most, or of one that is more."""
    total, at = np.cumsum(loads), 0
    while at < len(loads):
        to = max(at + 1, int(np.searchsorted(total, total[at] - loads[at] + limit, "right")))
        yield at, to
        at = to


@dataclass
class LeakIndex:
    """One block of benchmark items, ready to be looked for in texts."""

    ids: list
    items: list[list[str]]
    similarity: float = SIMILARITY
    seed: int = 42
    vocabulary: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for words in self.items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.size = np.array([len(w) for w in self.items], dtype=np.int64)
        self.edits = np.floor((1 - self.similarity) * self.size + 1e-9).astype(np.int64)
        self.longest = int(self.size.max()) if len(self.size) else 0
        self.first = np.cumsum(self.size) - self.size
        self.word = np.array([self.vocabulary[w] for words in self.items for w in words], dtype=np.int64)
        run = np.clip((self.size - self.edits) // (self.edits + 1), 1, LONGEST_RUN)
        # Each edit breaks at most ``run`` of the item's size - run + 1 runs.
        self.shared = np.maximum(1, self.size - run + 1 - self.edits * run)
        self.runs = {}
        for q in sorted(set(run[self.size > 0].tolist())):
            m = np.flatnonzero((run == q) & (self.size > 0))
            count = self.size[m] - q + 1
            m, j = np.repeat(m, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            keys, which = np.unique(self._run_key([self.word[self.first[m] + j + i] for i in range(q)]), return_inverse=True)
            self.runs[q] = (keys, which, m, j)
        rng = np.random.default_rng(self.seed)
        self.step = rng.integers(1, 1 << 63, size=(MAX_REPEATS, 3 * LONGEST_EMBEDDED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.blend = rng.integers(1, 1 << 63, size=(MAX_REPEATS, SAMPLED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sample = rng.random((MAX_REPEATS, SAMPLED))
        #: By length: repetitions, None where all windows are checked.
        self.repeats = {}
        for n in np.unique(self.size[self.size > 0]).tolist():
            known = (n, self.similarity, self.seed)
            if known not in _measured:
                _measured[known] = self._needed_repeats(n)
            self.repeats[n] = _measured[known]
        self.keys, self.slot = {}, np.zeros(len(self.items), dtype=np.int64)
        for n, repeats in self.repeats.items():
            if repeats:
                m = np.flatnonzero(self.size == n)
                self.slot[m] = np.arange(len(m))
                self.keys[n] = self.signatures(self._padded(m), self.size[m], repeats)

    def _padded(self, m: np.ndarray) -> np.ndarray:
        """The words of these items, one item a row."""
        span = np.arange(int(self.size[m].max()))
        return np.where(span < self.size[m][:, None], self.word[np.minimum(self.first[m][:, None] + span, len(self.word) - 1)], 0)

    @staticmethod
    def _run_key(columns: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            key = _mixed(key ^ c.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        return key

    def signatures(self, windows: np.ndarray, sizes: np.ndarray, repeats: int) -> np.ndarray:
        """Keys (windows x repeats) of the sampled symbols of each window's CGK walks.

        Only the symbols at the sampled times are kept; a batch holds at most WALKS walks."""
        out = np.zeros((len(windows), repeats), dtype=np.uint64)
        rows_at_once = max(1, WALKS // repeats)
        with np.errstate(over="ignore"):
            for lo in range(0, len(windows), rows_at_once):
                n = sizes[lo : lo + rows_at_once]
                rows = np.hstack([_mixed(windows[lo : lo + rows_at_once]), np.zeros((len(n), 1), dtype=np.uint64)])
                rows[np.arange(rows.shape[1])[None, :] >= n[:, None]] = 0
                at = np.zeros((len(rows), repeats), dtype=np.int64)
                line = np.arange(len(rows))[:, None]
                when = (self.sample[None, :repeats] * 2 * n[:, None, None]).astype(np.int64)
                key = _mixed(n)[:, None] + _mixed(np.arange(repeats))[None, :] * _MIX2
                for t in range(int(when.max()) + 1):
                    seen = rows[line, at]
                    r, c, s = np.nonzero(when == t)
                    np.add.at(key, (r, c), seen[r, c] * self.blend[c, s])
                    at = np.minimum(at + ((seen * self.step[:repeats, t]) >> np.uint64(63)).astype(np.int64), n[:, None])
                out[lo : lo + rows_at_once] = _mixed(key)
        return out

    def _needed_repeats(self, n: int) -> int | None:
        """So many that TARGET_RECALL of texts of n words with k random edits meet their
        original; None where MAX_REPEATS do not suffice. Depends on n alone, not on the block."""
        k = int(np.floor((1 - self.similarity) * n + 1e-9))
        if k == 0:
            return 1
        if n > LONGEST_EMBEDDED:
            return None
        rng = np.random.default_rng([self.seed, n])
        changed = np.zeros((TRIALS, n), dtype=np.int64)
        for row in range(TRIALS):
            words = list(range(1, n + 1))
            for _ in range(k):
                kind, at = rng.integers(3), int(rng.integers(len(words))) if words else 0
                if kind == 0 and words:
                    words[at] = 0
                elif kind == 1 and words:
                    words.pop(at)
                else:
                    words.insert(at, 0)
            words = words[:n]
            changed[row, : len(words)] = words
        own = self.signatures(np.arange(1, n + 1)[None, :], np.array([n]), MAX_REPEATS)
        same = self.signatures(changed, np.full(TRIALS, n), MAX_REPEATS) == own
        recall = np.logical_or.accumulate(same, axis=1).mean(axis=0)
        enough = np.flatnonzero(recall >= TARGET_RECALL)
        return int(enough[0]) + 1 if len(enough) else None

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, first word, word after the last) of the best
        stretch for every text and item that match."""
        if not self.longest:
            return []
        known = self.vocabulary.get
        lists = [[known(w, 0) for w in words_of(t)] if t else [] for t in texts]
        ends = np.cumsum([len(x) for x in lists])
        word = np.array([w for x in lists for w in x], dtype=np.int64)
        text_of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        begin = (ends - [len(x) for x in lists]).astype(np.int64)
        # Windows as item * stride + place; texts and items lie farther apart than any k.
        gap = 2 * self.longest + 1
        stride = len(word) + (len(lists) + 2) * gap
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for code in self._windows(word, text_of, gap, stride):
            item, place = code // stride, code % stride
            doc = np.searchsorted(begin + (np.arange(len(lists)) + 1) * gap - self.longest, place, "right") - 1
            start = place - (doc + 1) * gap
            meets = self._meets(word, ends[doc], np.maximum(start, begin[doc]), item)
            code, item, doc, start = code[meets], item[meets], doc[meets], start[meets]
            if not len(code):
                continue
            # Windows of one text and item that lie within k are one stretch to check.
            new = np.flatnonzero(np.append(True, np.diff(code) > self.edits[item[1:]]))
            stop = np.append(new[1:], len(code)) - 1
            item, doc = item[new], doc[new]
            left = np.maximum(start[new] - self.edits[item], begin[doc])
            right = np.minimum(start[stop] + self.size[item] + self.edits[item], ends[doc])
            self._check(word, begin, item, doc, left, right, best)
        return [(d, m, *v) for (d, m), v in sorted(best.items())]

    def _windows(self, word: np.ndarray, text_of: np.ndarray, gap: int, stride: int) -> Iterator[np.ndarray]:
        """Codes (item * stride + place) of the windows that share enough runs with their item.

        Items come in groups of at most HITS shared runs; one item that has more is taken
        by stretches of HITS places, so a run that is common in texts and items alike
        takes time but no more memory."""
        for q, (keys, which, item, offset) in self.runs.items():
            n = len(word) - q + 1
            if n <= 0:
                continue
            here = np.flatnonzero(np.logical_and.reduce([word[i : n + i] > 0 for i in range(q)]) & (text_of[:n] == text_of[q - 1 :]))
            at, run = [], []
            for lo in range(0, len(here), 200_000):
                some = here[lo : lo + 200_000]
                key = self._run_key([word[some + i] for i in range(q)])
                r = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                known = keys[r] == key
                at.append(some[known]), run.append(r[known])
            if not at:
                continue
            at, run = np.concatenate(at), np.concatenate(run)
            times = np.bincount(run, minlength=len(keys))
            # The places of each run, run after run, in order.
            places = (run * stride + at + (text_of[at] + 1) * gap)[np.argsort(run, kind="stable")]
            first = np.cumsum(times) - times
            # A match has ``shared`` different runs of its item.
            own = np.flatnonzero(times[which] > 0)
            own = own[np.bincount(item[own], minlength=len(self.size))[item[own]] >= self.shared[item[own]]]
            if not len(own):
                continue
            begins = np.flatnonzero(np.append(True, np.diff(item[own]) > 0))
            loads = np.add.reduceat(times[which[own]], begins)
            begins = np.append(begins, len(own))
            for a, z in _within(loads, HITS):
                e = own[begins[a] : begins[z]]
                if loads[a] <= HITS:
                    w, h = which[e], times[which[e]]
                    slot = np.repeat(first[w] - (np.cumsum(h) - h), h) + np.arange(h.sum())
                    code, count = np.unique(np.repeat(item[e] * stride - offset[e] - w * stride, h) + places[slot], return_counts=True)
                    yield self._enough(code, count, stride)
                    continue
                m, k = int(item[e[0]]), int(self.edits[item[e[0]]])
                for lo in range(0, stride, HITS):
                    # Those of the next k places count for the last ones of this stretch.
                    hi = min(lo + HITS + k, stride)
                    base = which[e] * stride
                    start = np.searchsorted(places, base + np.minimum(lo + offset[e], stride))
                    h = np.searchsorted(places, base + np.minimum(hi + offset[e], stride)) - start
                    total = np.zeros(hi - lo, dtype=np.int64)
                    for c, d in _within(h, HITS):
                        slot = np.repeat(start[c:d] - (np.cumsum(h[c:d]) - h[c:d]), h[c:d]) + np.arange(h[c:d].sum())
                        total += np.bincount(places[slot] - np.repeat(base[c:d] + offset[e[c:d]], h[c:d]) - lo, minlength=hi - lo)
                    place = np.flatnonzero(total)
                    yield self._enough(m * stride + lo + place, total[place], stride)

    def _enough(self, code: np.ndarray, count: np.ndarray, stride: int) -> np.ndarray:
        """Those of the windows that can match, by the runs they share."""
        total = np.append(0, np.cumsum(count))
        # k edits move the shared runs of a match by at most k places against each other.
        last = np.searchsorted(code, code + self.edits[code // stride], "right")
        enough = np.flatnonzero(total[last] - total[:-1] >= self.shared[code // stride])
        inside = np.zeros(len(code) + 1, dtype=np.int64)
        np.add.at(inside, enough, 1)
        np.add.at(inside, last[enough], -1)
        return code[np.cumsum(inside[:-1]) > 0]

    def _meets(self, word, end, start, item) -> np.ndarray:
        """Which windows meet their item in a repetition (all, where the item's length has none)."""
        out = np.ones(len(start), dtype=bool)
        for n, own in self.keys.items():
            rows = np.flatnonzero(self.size[item] == n)
            # A place is embedded once, for all items of this length.
            at, first, back = np.unique(start[rows], return_index=True, return_inverse=True)
            order = np.argsort(back, kind="stable")
            cuts = np.append(np.searchsorted(back[order], np.arange(0, len(at), 4096)), len(order))
            for i, lo in enumerate(range(0, len(at), 4096)):
                some = at[lo : lo + 4096]
                span = some[:, None] + np.arange(n)
                body = np.where(span < end[rows[first[lo : lo + 4096]]][:, None], word[np.minimum(span, len(word) - 1)], 0)
                keys = self.signatures(body, np.full(len(some), n), own.shape[1])
                for c in range(cuts[i], cuts[i + 1], 16384):
                    x = order[c : min(c + 16384, cuts[i + 1])]
                    out[rows[x]] = (keys[back[x] - lo] == own[self.slot[item[rows[x]]]]).any(axis=1)
        return out

    def _check(self, word, begin, item, doc, left, right, best) -> None:
        order = np.lexsort((right - left, self.size[item]))
        lo = 0
        while lo < len(order):
            some = order[lo : lo + 1024]
            cells = np.maximum.accumulate(right[some] - left[some]) * np.arange(1, len(some) + 1)
            some = some[: max(1, int(np.searchsorted(cells, CELLS, "right")))]
            lo += len(some)
            m, length = item[some], right[some] - left[some]
            cols = np.arange(int(length.max()))
            text = np.where(cols < length[:, None], word[np.minimum(left[some][:, None] + cols, len(word) - 1)], -1)
            cost = edit_distances(self._padded(m), self.size[m], text, length, True)
            stop, edits = cost.argmin(axis=1), cost.min(axis=1)
            # Of a text and item only the fewest edits count, and of those only ends so near to
            # the first one that a stretch with such an end may begin before its own.
            hit = np.flatnonzero(edits <= self.edits[m])
            ends = left[some] + stop
            hit = hit[np.lexsort((ends[hit], edits[hit], m[hit], doc[some[hit]]))]
            pair = doc[some[hit]] * len(self.items) + m[hit]
            top = hit[np.flatnonzero(np.append(True, np.diff(pair) != 0))[np.cumsum(np.append(0, np.diff(pair) != 0))]] if len(hit) else hit
            hit = hit[(edits[hit] == edits[top]) & (ends[hit] <= ends[top] + 2 * edits[top])]
            for i in hit.tolist():
                n, d = int(self.size[m[i]]), int(doc[some[i]])
                key = (d, int(m[i]))
                known = best.get(key)
                if known and (known[0] < edits[i] or known[0] == edits[i] and known[1] < ends[i] - begin[d] - n - edits[i]):
                    continue
                whole = self.word[self.first[m[i]] : self.first[m[i]] + n][::-1]
                back = text[i, max(0, stop[i] - n - int(edits[i])) : stop[i]][::-1]
                way = edit_distances(whole[None], np.array([n]), back[None], np.array([len(back)]), False)[0]
                found = int(left[some[i]] + stop[i] - begin[d])
                value = (int(edits[i]), found - int(way.argmin()), found)
                if key not in best or value < best[key]:
                    best[key] = value


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.withColumn("digest", F.sha2("text", 256))


def index_blocks(benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark's distinct texts (named by their SHA-256) as LeakIndex blocks, one after
    the other (bounded by words; copies of one text count once)."""
    texts = cut(_items(benchmark, id_col, text_col).select("digest", "text").dropDuplicates(["digest"]))
    words = texts.select("text").mapInArrow(_count_words, "words long").agg(F.sum("words")).first()[0] or 0
    blocks = max(1, -(-int(words) // BLOCK_WORDS))
    for b in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == b).orderBy("digest").collect()
        items, size = [], 0
        for r in part:
            found = words_of(r["text"])
            if items and size + len(found) > BLOCK_WORDS:
                yield LeakIndex([x[0] for x in items], [x[1] for x in items], similarity)
                items, size = [], 0
            if found:
                items.append((r["digest"], found))
                size += len(found)
        if items:
            yield LeakIndex([x[0] for x in items], [x[1] for x in items], similarity)


def _count_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["words"])


_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("item_words", T.IntegerType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType()),
    ]
)


def _search(index: LeakIndex):
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in _FOUND.fields])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                ids = part.column(0).to_pylist()
                rows = [
                    (ids[d], index.ids[m], e, int(index.size[m]), a, b) for d, m, e, a, b in index.find(part.column(1).to_pylist())
                ]
                yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r)) for r in rows], schema=arrow)

    return run


def _leaked(index: LeakIndex):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2):
                found = sorted({d for d, *_ in index.find(part.column(2).to_pylist())})
                yield part.select([0, 1]).take(pa.array(found, pa.int64()))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, end_word) per document row and
    leaked item: the best stretch (fewest edits, then the first), as word positions.

    Items without a word and null or empty texts match nothing; repeated rows and equal
    items each give their own rows (a text that many items share is searched once); null
    ids are passed on as null. Items shorter than five words (at 0.8) must occur exactly.
    Texts of any length are searched whole. An empty benchmark or table gives no rows.
    """
    inner = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    found = None
    for index in index_blocks(benchmark, similarity):
        # Written block by block, so that a task and the driver hold one index at a time.
        part = cut(inner.mapInArrow(_search(index), _FOUND))
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND)
    named = _items(benchmark, "item_id", "text").select("digest", F.col("id").alias("item_id"))
    return found.join(named, "digest").select("doc_id", "item_id", "edits", "item_words", "first_word", "end_word")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, in which no benchmark item is found.

    Rows are known by their file and place in it; ``docs`` is written only where it is
    not a plain read of Parquet files. Each block's leaked rows are written before the
    next block is made."""
    table, leaked = None, None
    for index in index_blocks(benchmark, similarity):
        if table is None:
            table = stored(docs, "decontaminate")
        texts = table.select(*row_place(table), F.col(text_col).cast("string").alias("__text"))
        part = cut(texts.mapInArrow(_leaked(index), ROW_PLACE))
        leaked = part if leaked is None else leaked.union(part)
    return docs if table is None else without_rows(table, leaked)
