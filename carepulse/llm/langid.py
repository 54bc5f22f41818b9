"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary logistic classifier over hashed
byte n-grams (one to three bytes, lower-cased) tells the languages with a 1 there from
those with a 0. A text's bits are decoded to the codeword of the smallest loss, every
bit weighted by how well its classifier did in training. Where the second codeword is
nearly as close the prediction is flagged as ambiguous.

Every language of the training documents has a codeword. Learning takes a bounded
sample by hash, ``PER_LANG`` documents of each language, or fewer of each where that is
over ``FIT_ROWS`` in all (one at least); prediction counts the n-grams of whole texts and sees the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

BINS = 4096
PER_LANG = 800
#: Documents the fit takes in all, shared equally where PER_LANG of each are more.
FIT_ROWS = 16_000
#: Ambiguous: the second codeword's share comes this near to the first one's.
AMBIGUOUS = 0.1
UNKNOWN = "und"


def gram_shares(text: str) -> np.ndarray:
    """Shares of the hashed byte n-grams (n = 1, 2, 3) of a whole text, each n by itself."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.int64)
    out = np.zeros(BINS)
    for n in (1, 2, 3):
        if len(b) >= n:
            code = np.full(len(b) - n + 1, n, dtype=np.int64)
            for i in range(n):
                code = code * 257 + b[i : len(b) - n + 1 + i]
            code = (code * 0x9E3779B1 >> 15) % BINS
            out += np.bincount(code, minlength=BINS) / len(code)
    return out


def codewords(languages: int, seed: int = 42) -> np.ndarray:
    """A code of +1/-1 (languages x bits): all distinct splits of few languages, else the
    draw of random splits whose nearest codewords are farthest apart."""
    if languages <= 2:
        return np.array([[1.0], [-1.0]])[:languages]
    if languages <= 5:
        splits = range(1, 2 ** (languages - 1))
        return np.array([[1.0 if i == 0 or not s >> (i - 1) & 1 else -1.0 for s in splits] for i in range(languages)])
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, far = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(languages, bits))
        agree = code @ code.T - 2 * bits * np.eye(languages)
        apart = (bits - agree.max()) / 2
        if apart > far and (np.abs(code.sum(axis=0)) < languages).all():
            best, far = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def decode(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, unsure = [], [], []
        for t in texts:
            if not t or not any(c.isalpha() for c in t):
                lang.append(UNKNOWN), score.append(0.0), unsure.append(True)
                continue
            margin = ((gram_shares(t) - self.mean) / self.scale) @ self.weights + self.bias
            loss = (np.logaddexp(0.0, -self.code * margin) * self.bit_weight).sum(axis=1)
            share = np.exp(loss.min() - loss)
            share /= share.sum()
            order = np.argsort(-share, kind="stable")
            lang.append(self.languages[order[0]])
            score.append(float(share[order[0]]))
            unsure.append(len(order) > 1 and bool(share[order[0]] - share[order[1]] < AMBIGUOUS))
        return lang, score, unsure


def _training_grams(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        flat = np.concatenate([gram_shares(t) for t in texts]).astype(np.float32) if texts else np.zeros(0, np.float32)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * BINS
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["y", "x"])


def _sample(docs: DataFrame, ids: DataFrame, counted: list, per: int, id_col: str, text_col: str) -> DataFrame:
    """(__y, __text): the ``per`` documents of each language whose ids' hashes are least.

    Of each language only about twice as many ids as needed, by a bound on the hash, are
    ranked, so no task gets a whole language.
    """
    spark = docs.sparkSession
    bounds = [(r["__lang"], i, min(1.0, (2 * per + 50) / r["count"])) for i, r in enumerate(counted)]
    bounds = spark.createDataFrame(bounds, "lang string, __y int, share double")
    near = ids.join(F.broadcast(bounds), F.col("__lang") == F.col("lang")).withColumn("__h", F.xxhash64("__id"))
    near = near.where((F.col("share") >= 1) | ((F.col("__h") / 2.0**64 + 0.5) < F.col("share")))
    rank = F.row_number().over(Window.partitionBy("__y").orderBy("__h", "__id"))
    chosen = near.select("__id", "__y", rank.alias("rank")).where(F.col("rank") <= per).drop("rank").dropDuplicates(["__id"])
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return texts.where("__text IS NOT NULL").join(F.broadcast(chosen), "__id").dropDuplicates(["__id"]).select("__y", "__text")


def fit(docs: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", steps: int = 150) -> LanguageModel | None:
    """The bit classifiers, fitted on the sample; None if no language is known."""
    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(lang_col).cast("string").alias("__lang")).where(F.col("__lang").isNotNull())
    ids = named.where(trained).where(F.col("__id").isNotNull()).distinct()
    counted = sorted(ids.groupBy("__lang").count().collect(), key=lambda r: r["__lang"])
    languages = [r["__lang"] for r in counted]
    if not languages:
        return None
    per = max(1, min(PER_LANG, FIT_ROWS // len(languages)))
    rows = _sample(docs, ids, counted, per, id_col, text_col).mapInArrow(_training_grams, "y int, x array<float>").toArrow()
    y = np.asarray(rows.column("y").combine_chunks(), dtype=np.int64)
    x = np.asarray(rows.column("x").combine_chunks().flatten(), dtype=np.float32).reshape(-1, BINS)
    del rows
    code = codewords(len(languages))
    if not len(y):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3)
    x = x - mean
    x /= scale
    target = (code[y] > 0).astype(np.float32)
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y] / len(set(y.tolist()))
    w, b = np.zeros((BINS, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    rate = np.float32(4.0 / BINS)
    for _ in range(steps):
        d = ((target - 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))) * weight[:, None]).astype(np.float32)
        vw = np.float32(0.9) * vw + rate * (x.T @ d - np.float32(1e-3) * w)
        vb = np.float32(0.9) * vb + rate * d.sum(axis=0)
        w, b = w + vw, b + vb
    right = (((x @ w + b) > 0) == (target > 0)).mean(axis=0)
    return LanguageModel(languages, code, mean, scale, w, b, right / right.sum() * len(right))


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` per row of ``docs``.

    Null texts, empty ones and those without a letter are ``und`` with score 0 and
    ambiguous, and so is every row if nothing was learned. Repeated rows get equal
    predictions; other columns, the given language among them, are not looked at.
    """

    def start():
        def run(texts):
            if model is None:
                return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "ambiguous": [True] * len(texts)}
            return dict(zip(("lang_pred", "score", "ambiguous"), model.decode(texts)))

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return map_texts(docs, text_col, keep, fields, start)
