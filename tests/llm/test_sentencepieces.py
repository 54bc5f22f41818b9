import random

import numpy as np

from carepulse.llm import sentencepieces as sp
from tests.llm.conftest import EDGE

MODEL = sp.PieceModel.load()


def all_paths(seg, text):
    marked = sp.MARK + text.replace(" ", sp.MARK) if text else ""
    out = []

    def go(at, score, ids):
        if at == len(marked):
            out.append((score, tuple(ids)))
            return
        for n in range(1, min(seg.longest, len(marked) - at) + 1):
            got = seg.piece.get(marked[at : at + n])
            if got is None and n == 1:
                got = (seg.model.unknown_score, -1)
            if got:
                more = [got[1]] if got[1] >= 0 else [seg.model.bytes_at[b] for b in marked[at].encode()]
                go(at + n, score + got[0], ids + more)

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def applied(ids, changes):
    ids = list(ids)
    for at, drop, new in sorted(changes, reverse=True):
        ids[at : at + drop] = new
    return tuple(ids)


def test_n_best_against_all_segmentations():
    seg, rng = sp.Segmenter(MODEL), random.Random(5)
    texts = ["", "a", "the the", "in  on", " x", "hello wor", "ÉÈ z", "é你", "th\nre"]
    texts += ["".join(rng.choice("thernd a") for _ in range(9)) for _ in range(40)]
    for text, (score, ids, ways) in zip(texts, seg.encode(texts, 5)):
        every = all_paths(seg, text)
        assert len(ways) == min(5, len(every)), text
        assert np.allclose([w[0] for w in ways], [p[0] for p in every[: len(ways)]]) and score == ways[0][0]
        found = [applied(ids, c) for _, c in ways]
        known = dict((p, s) for s, p in every)
        assert len(set(found)) == len(found) and all(np.isclose(known[p], s) for p, (s, _) in zip(found, ways))


def test_viterbi_and_search_agree_on_the_best_path():
    seg = sp.Segmenter(MODEL)
    words = [sp.MARK + w for w in ["thering", "unknown", "antionble", "12345", "…", "naïve"]]
    seg._learn(sorted(words))
    for w in words:
        i = seg.number[w]
        (score, ids), *rest = seg.word_paths(w, 2)
        assert score == seg.best[i] and ids == seg.ids[seg.ends[i] : seg.ends[i + 1]].tolist()
        assert (rest[0][0] if rest else -np.inf) == seg.second[i]


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sp.encode(docs, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert all(r["n_pieces"] == len(r["ids"]) and r["best_score"] == r["n_best"][0]["path_score"] for r in rows)


def test_edge_rows(edge_docs, no_docs):
    rows = sp.encode(edge_docs, ["doc_id", "n"]).collect()
    assert len(rows) == len(EDGE)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["ids"] is None and by_id[1]["n_pieces"] is None and by_id[1]["round_trip"] is None
    assert by_id[2]["ids"] == [] and by_id[2]["best_score"] == 0 and len(by_id[2]["n_best"]) == 1
    assert all(r["round_trip"] for r in rows if r["ids"] is not None)
    assert sp.encode(no_docs, ["doc_id"]).count() == 0


def test_the_space_mark_itself_decodes_to_spaces():
    seg = sp.Segmenter(MODEL)
    (_, ids, _), = seg.encode(["a▁b"])
    assert seg.decode(ids.tolist()) == "a b"
