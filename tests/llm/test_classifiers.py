import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepulse.llm import langid, quality, toxicity
from carepulse.llm.common import remainder
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def tox(spark, tables):
    return toxicity.fit(*tables, remainder("__id", 4) != 2)


@pytest.fixture(scope="module")
def qual(spark, tables):
    return quality.fit(*tables, remainder("__id", 3) != 1)


@pytest.fixture(scope="module")
def lang(spark, tables):
    return langid.fit(tables[0], remainder("__id", 3) != 1)


def held_out(frame, modulus, rest):
    return [r for r in frame if zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest]


def plain_kernel(s, t):
    """Gap-weighted three-letter subsequence kernel by definition, normalised."""

    def features(w):
        w = f"\0{w}\0"
        code = [toxicity._CODES[ord(c)] if ord(c) < 1024 else 27 + ord(c) % 36 for c in w]
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    skipped = k - i - 2
                    if skipped <= toxicity.MAX_GAPS and code[i] and code[j] and code[k]:
                        u = (code[i], code[j], code[k])
                        out[u] = out.get(u, 0.0) + toxicity.DECAY**skipped
        return out

    a, b = features(s), features(t)
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(u, 0.0) for u, v in a.items()) / norm if norm else 0.0


def test_kernel_against_its_definition():
    words = ["idiot", "id.i-ot", "1d10t", "stupid", "stuuupid", "aaaaaa", "a", "ab", "ñoño", "moron"]
    got = toxicity.kernel(words, words)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-6)


def test_folded_weights_equal_the_landmark_form(tox):
    words = ["idiot", "scum", "thanin", "x"]
    l, u, v = toxicity.subsequences(words)
    norm = np.sqrt(np.bincount(l, v * v, minlength=len(words)))
    want = np.bincount(l, v * tox.weights[u], minlength=len(words)) / np.maximum(norm, 1e-9) + tox.bias
    assert np.allclose(tox.margins(words), want, atol=1e-6)


def test_inserted_characters_and_look_alikes_keep_the_margin(tox):
    plain = tox.margins(["idiot"])[0]
    assert plain > tox.margins(["thanion"])[0] + 1
    for form in ("i.d.i.o.t", "IDIOT", "1d1ot", "i d i o t", "idiot!!", "id-iot"):
        assert tox.margins(toxicity.words_of(form)).max() > plain - 0.3, form


def test_toxicity_held_out(tables, tox):
    docs, labels = tables
    rows = held_out(toxicity.score(docs, tox, ["doc_id"]).join(labels, "doc_id").collect(), 4, 2)
    right = sum((r["score"] >= 0.3) == bool(r["toxic"]) for r in rows) / len(rows)
    assert right >= 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_held_out(tables, qual):
    docs, labels = tables
    rows = held_out(quality.score(docs, qual, ["doc_id"]).join(labels, "doc_id").collect(), 3, 1)
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in rows) / len(rows) >= 0.97


def test_language_held_out(tables, lang):
    rows = held_out(langid.predict(tables[0], lang, ["doc_id", "lang"]).collect(), 3, 1)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(0)
    score, move = rng.normal(size=5), rng.normal(size=(2, 2))
    index = np.array([[0, 1, 2, 3, 4], [2, 0, 1, -1, -1]])
    good, moves, total = quality._forward_backward(score, move, index)
    want_moves, want_total = np.zeros((2, 2)), 0.0
    for row in index:
        lines = row[row >= 0]
        weight, marginal, pairs = 0.0, np.zeros(len(lines)), np.zeros((2, 2))
        for code in range(2 ** len(lines)):
            y = [code >> i & 1 for i in range(len(lines))]
            e = math.exp(sum(score[i] for i, k in zip(lines, y) if k) + sum(move[a, b] for a, b in zip(y, y[1:])))
            weight += e
            marginal += e * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += e
        at = list(index.tolist()).index(row.tolist())
        assert np.allclose(good[at, : len(lines)], marginal / weight)
        want_moves += pairs / weight
        want_total += math.log(weight)
    assert np.allclose(moves, want_moves) and np.isclose(total, want_total)


def test_a_text_scores_alike_in_any_company(qual, lang):
    texts = ["One line.\nAnother line here, and words.", "A!! B!! C!!", "", "x | y | z\n\n1 2 3"]
    alone = [qual.quality([t])[0] for t in texts]
    assert np.allclose(alone, qual.quality(texts)) and np.allclose(alone[::-1], qual.quality(texts[::-1]))
    assert lang.decode(texts) == tuple(map(list, zip(*[(a[0], b[0], c[0]) for a, b, c in (lang.decode([t]) for t in texts)])))


def test_codewords_are_apart():
    for n in range(2, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        if n > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def test_edge_rows(spark, edge_docs, no_docs, tox, qual, lang):
    for frame in (toxicity.score(edge_docs, tox, ["doc_id", "n"]), quality.score(edge_docs, qual, ["doc_id", "n"]), langid.predict(edge_docs, lang, ["doc_id", "n"])):
        rows = frame.collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 and r["n"] == 1 for r in rows)
    blank = {r["doc_id"]: r for r in langid.predict(edge_docs.where("doc_id <= 4"), lang, ["doc_id"]).collect()}
    assert all(blank[i]["lang_pred"] == "und" and blank[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert all(r["score"] == 0 for r in quality.score(edge_docs.where("doc_id <= 3"), qual, ["doc_id"]).collect())
    for frame in (toxicity.score(no_docs, tox, ["doc_id"]), quality.score(no_docs, qual, ["doc_id"]), langid.predict(no_docs, lang, ["doc_id"])):
        assert frame.count() == 0
    assert toxicity.accept(edge_docs, tox).schema == edge_docs.schema
    assert quality.accept(edge_docs, None).count() == len(EDGE)


def test_without_anything_to_learn_from(spark, no_docs, edge_docs):
    labels = spark.createDataFrame([(5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    assert toxicity.fit(edge_docs, labels, every) is None and quality.fit(edge_docs, labels, every) is None
    assert langid.fit(no_docs, every) is None
    assert {r["score"] for r in toxicity.score(edge_docs, None, ["doc_id"]).collect()} == {0.0}
    assert {r["lang_pred"] for r in langid.predict(edge_docs, None, ["doc_id"]).collect()} == {"und"}


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(remainder("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, remainder("__id", 3) != 1, steps=5) for x in (labels, turned))
    assert np.allclose(a.mean, b.mean) and np.allclose(a.weights, b.weights)


def test_more_languages_than_before_are_all_told_apart(spark):
    """90 languages, each with words of its own."""
    rng = np.random.default_rng(3)
    lexicon = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=(12, 5)).ravel()) for _ in range(90)]
    words = [[x[i : i + 5] for i in range(0, 60, 5)] for x in lexicon]
    rows = [(90 * j + i, " ".join(rng.choice(words[i], 30)), f"l{i:02d}") for i in range(90) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("__id") >= 180)
    assert len(model.languages) == 90
    got = langid.predict(docs.where("doc_id < 180"), model, ["doc_id", "lang"]).collect()
    assert {r["lang"] for r in got} == set(model.languages)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_long_training_sentences_are_learned_from_in_pieces(spark):
    text = " ".join(f"word{i}" for i in range(600)) + " " + "x" * 4500
    parts = toxicity._sentence_pieces(text)
    assert all(0 < len(p) <= 2000 for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([text])], names=["y", "t"])
    (out,) = toxicity._training_sentences([batch])
    assert sorted(out.column(2).to_pylist()) == sorted(set(parts))


def test_a_fit_without_a_model_warns(spark):
    docs = spark.createDataFrame([(i, "the same words in every document") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="no document is dropped"):
        assert toxicity.fit(docs, labels, F.lit(True)) is None


def plain_phrase_kernel(s, t):
    """The kernel of windows by definition: every occurrence counts, signs and spaces are skipped characters."""

    def triples(w):
        code = [0 if ord(c) <= 32 else toxicity._CODES[ord(c)] for c in w]
        out = []
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.MAX_GAPS + 3)):
                    if code[i] and code[j] and code[k]:
                        out.append(((code[i], code[j], code[k]), toxicity.DECAY ** (k - i - 2)))
        return out

    a, b = triples(s), triples(t)
    norm = math.sqrt(sum(v * v for _, v in a) * sum(v * v for _, v in b))
    return sum(v * w for u, v in a for x, w in b if u == x) / norm if norm else 0.0


def test_windows_against_their_definition():
    windows = ["brain dead", "br.ain d3ad", "of the day", "aaa aaa", "a b", "x", "dead brain cell"]
    want = np.array([[plain_phrase_kernel(a, b) for b in windows] for a in windows])
    assert np.allclose(toxicity.phrase_kernel(windows, windows), want)
    row, key, value = toxicity._phrase_map(["brain dead"])
    weights = np.bincount(key, value, minlength=toxicity._FEATURES)
    texts = ["They say brain, dead people a b c talk", "one", "", None, "the brain is dead", "  brain  dead "]
    got, best = toxicity.strongest_windows(texts, weights, -0.5)
    for text, g, w in zip(texts, got, best):
        words = toxicity.phrase_words(text or "")
        all_windows = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        margins = [plain_phrase_kernel(x, "brain dead") - 0.5 for x in all_windows]
        assert math.isclose(g, max(margins, default=-0.5), abs_tol=1e-6) and (w in all_windows or not margins)


def test_windows_over_a_step_are_seen(monkeypatch):
    row, key, value = toxicity._phrase_map(["brain dead"])
    weights = np.bincount(key, value, minlength=toxicity._FEATURES)
    texts = ["so this one is brain dead now", "a brain dead b", "x y z"]
    whole = toxicity.strongest_windows(texts, weights, 0.0)
    monkeypatch.setattr(toxicity, "PHRASE_STEP", 2)
    assert np.allclose(toxicity.strongest_windows(texts, weights, 0.0)[0], whole[0])


@pytest.fixture(scope="module")
def phrase_docs():
    """Each word is as common in both labels; only ``brain`` right before ``dead`` tells."""
    rng = np.random.default_rng(11)
    common = ["".join(rng.choice(list("aeioulnrst"), size=rng.integers(3, 8))) for _ in range(300)]

    def text(toxic, forms):
        words = rng.choice(common, 40).tolist()
        at, other = rng.integers(0, 15), rng.integers(20, 35)
        if toxic:
            words[at : at + 2] = [str(rng.choice(forms))]
        else:
            words[at], words[other] = "brain", "dead"
        return " ".join(words)

    train = [(i, text(i % 2, ["brain dead"]), i % 2) for i in range(600)]
    test = [(i, text(i % 2, ["brain dead", "br.ain dead", "brainn dead", "brain-dead", "BRAIN d3ad"]), i % 2) for i in range(600, 800)]
    return train, test


def test_an_insult_of_several_harmless_words_is_learned(spark, phrase_docs):
    train, test = phrase_docs
    rows = spark.createDataFrame(train + test, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.col("__id") < 600)
    assert model.phrases is not None
    got = toxicity.score(rows.where("doc_id >= 600"), model, ["doc_id", "toxic"]).collect()
    assert len(got) == 200
    recall = np.mean([r["score"] >= 0.3 for r in got if r["toxic"]])
    flagged = np.mean([r["score"] >= 0.3 for r in got if not r["toxic"]])
    assert recall >= 0.95 and flagged <= 0.03, (recall, flagged)


def test_telling_windows_against_plain_counts(spark, phrase_docs):
    docs = [(y, t) for _, t, y in phrase_docs[0]]
    got = toxicity.telling_phrases(spark.createDataFrame(docs, "__y int, __text string"))
    rate = np.mean([y for y, _ in docs])
    after = {0: {}, 1: {}}
    for y, t in docs:
        words = ["", *toxicity.phrase_words(t)]
        for i in range(1, len(words)):
            for n in (1, 2, 3):
                if i + n <= len(words):
                    after[y].setdefault(" ".join(words[i : i + n]), set()).add(words[i - 1])
    seen = {w: len(x) for w, x in after[1].items() if len(x) >= 3}
    told = {w: float(toxicity._surprise([k], [k + len(after[0].get(w, ()))], rate)[0]) for w, k in seen.items()}
    least = math.log(len(seen)) + toxicity.BY_CHANCE
    want = {w: k for w, k in seen.items() if " " in w and told[w] > least and told[w] > 2 * max(told.get(p, 0) for p in w.split())}
    assert got == want and "brain dead" in got


def test_windows_of_copies_tell_nothing(spark):
    """A toxic text sent forty times is one context of each of its windows."""
    docs = [(1, "alpha beta gamma delta epsilon")] * 40 + [(0, f"word{i} other{i} third{i}") for i in range(40)]
    assert toxicity.telling_phrases(spark.createDataFrame(docs, "__y int, __text string")) == {}


def test_every_telling_window_is_represented_by_the_landmarks():
    windows = ["brain dead", "brain dead now", "waste of space", "a waste of", "brain dad", "the brain dead"]
    picked = [windows[i] for i in toxicity._pivots(windows)]
    k, cross = toxicity.phrase_kernel(picked, picked), toxicity.phrase_kernel(windows, picked)
    rest = np.diag(toxicity.phrase_kernel(windows, windows)) - np.einsum("ij,ij->i", cross @ np.linalg.inv(k), cross)
    assert rest.max() <= toxicity.PHRASE_REST + 1e-6


def test_cut_against_every_threshold():
    rng = np.random.default_rng(5)
    for _ in range(20):
        y, m = rng.integers(0, 2, 30), rng.normal(size=30)
        at = toxicity._best_cut(m, y)
        wrong = [((m >= c) != (y == 1)).sum() for c in [*m, m.max() + 1]]
        assert ((m >= at) != (y == 1)).sum() == min(wrong) or at in m


def plain_shares(text):
    b = text.lower().encode("utf-8", "replace")
    out = np.zeros(langid.BINS)
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            code = n
            for c in b[i : i + n]:
                code = code * 257 + c
            out[((code * 0x9E3779B1) >> 15) % langid.BINS] += 1 / (len(b) - n + 1)
    return out


def test_language_of_a_text_by_definition(lang):
    """Hashed gram shares, bit margins and loss-weighted decoding, each as a plain loop."""
    texts = ["Der Hund und die Katze sind in dem Haus", "the cat is on the mat", "x", "", None, "12 34", "ñandú él la casa", "é" * 50]
    names, scores, unsure = lang.decode(texts)
    for text, name, score, doubt in zip(texts, names, scores, unsure):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score, doubt) == ("und", 0.0, True)
            continue
        shares = plain_shares(text)
        assert np.allclose(shares, langid.gram_shares(text))
        z = (shares - lang.mean) / lang.scale
        margin = [float(z @ lang.weights[:, j] + lang.bias[j]) for j in range(lang.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-c * m)) * w for c, m, w in zip(row, margin, lang.bit_weight)) for row in lang.code]
        share = [math.exp(min(loss) - x) for x in loss]
        share = [x / sum(share) for x in share]
        first, second = sorted(share, reverse=True)[:2]
        assert name == lang.languages[share.index(first)] and math.isclose(score, first, rel_tol=1e-4)
        assert doubt == (first - second < langid.AMBIGUOUS) or abs(first - second - langid.AMBIGUOUS) < 1e-6


def test_language_bits_are_fitted_as_single_classifiers(spark, tables):
    """Every bit's weights equal those of its own logistic descent over all training rows."""
    docs = tables[0].where("doc_id < 60 AND lang IS NOT NULL AND text IS NOT NULL")
    model = langid.fit(docs, F.lit(True), steps=8)
    rows = docs.dropDuplicates(["doc_id"]).collect()
    y = [model.languages.index(r["lang"]) for r in rows]
    x = np.array([plain_shares(r["text"]) for r in rows])
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)
    each = [1 / y.count(k) / len(set(y)) for k in y]
    for j in range(model.code.shape[1]):
        w, b, vw, vb = np.zeros(langid.BINS), 0.0, np.zeros(langid.BINS), 0.0
        for _ in range(8):
            push = np.array([((model.code[k, j] > 0) - 1 / (1 + math.exp(-(z[i] @ w + b)))) * each[i] for i, k in enumerate(y)])
            vw = 0.9 * vw + 4 / langid.BINS * (z.T @ push - 1e-3 * w)
            vb = 0.9 * vb + 4 / langid.BINS * push.sum()
            w, b = w + vw, b + vb
        assert np.allclose(model.weights[:, j], w, atol=1e-4) and math.isclose(model.bias[j], b, abs_tol=1e-4)
