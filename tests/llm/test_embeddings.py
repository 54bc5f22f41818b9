import numpy as np
import pytest

from carepulse.llm import embeddings as em


def plain(rows, threshold=0.98):
    """By definition, over all pairs: links and components of (vec_id, label, vector) rows."""
    fine = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    v = [em.unit(np.array([r[2]], dtype=float))[0] if f else None for r, f in zip(rows, fine)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][1] == rows[j][1] and len(v[i]) == len(v[j]) and v[i] @ v[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return [(r[0], links[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def test_odd_vectors_copies_and_null_ids(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(200):
        v = base[i % 40] * (1 + i % 3) + rng.normal(size=8) * 0.02
        rows.append((i, int(i % 2), [float(x) for x in v]))
    rows += [(300 + i, 1, rows[0][2]) for i in range(30)] + [(300, 1, rows[0][2]), (None, 1, rows[1][2])]
    rows += [(400, None, rows[0][2]), (401, 1, None), (402, 1, [0.0] * 8), (403, 1, [float("nan")] * 8), (404, 1, [float("inf")] + [0.0] * 7)]
    rows += [(405, 1, [None] + [1.0] * 7), (406, 1, [1.0, 2.0]), (407, 1, []), (408, 1, [1e300] * 8), (409, 1, [1e-300] * 8)]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, label int, embedding array<double>, n int, v string")
    got = sorted(map(str, ((r["vec_id"], r["n_links"], r["component_id"]) for r in em.near_duplicates(frame).collect())))
    want = sorted(map(str, plain(rows)))
    assert got == want


def mixed(labels):
    rng = np.random.default_rng(6)
    rows = []
    for size, count in ((8, 60), (3, 40), (5, 6), (2, 1)):
        base = rng.normal(size=(max(1, count // 4), size))
        rows += [(len(rows) + i, labels[i % 2], [float(x) for x in base[i % len(base)] + rng.normal(size=size) * 0.01]) for i in range(count)]
    return rows + [(500 + i, labels[0], [1.0, 2.0]) for i in range(3)] + [(600 + i, labels[1], [0.5]) for i in range(2)]


@pytest.mark.parametrize("labels, kind", [((1, 2), "long"), (("de", "1"), "string"), ((0.25, 0.75), "double"), ((-0.0, 1.5), "double")])
def test_vectors_of_all_sizes_and_labels_of_any_type(spark, labels, kind):
    rows = mixed(labels)
    if labels[0] == 0:
        rows = [(i, 0.0 if (n % 3 == 0 and label == 0) else label, v) for n, (i, label, v) in enumerate(rows)]
    frame = spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in em.near_duplicates(frame).collect())
    assert got == sorted(plain(rows)) and sum(g[1] for g in got) > 60


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.toPandas()
    v, label = em.unit(np.stack(rows["embedding"])), rows["label"].to_numpy()
    same = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(same, False)
    got = em.near_duplicates(frame).toPandas().set_index("vec_id").loc[rows["vec_id"]]
    assert (got["n_links"].to_numpy() <= same.sum(axis=1)).all()
    assert got["n_links"].sum() >= 0.9 * same.sum()
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_a_dense_group_larger_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    near = rng.normal(size=16) + rng.normal(size=(700, 16)) * 0.004
    far = rng.normal(size=(300, 16))
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(np.vstack([near, far]))]
    got = em.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).toPandas()
    assert (got[got["vec_id"] < 700]["n_links"] >= 695).all() and (got[got["vec_id"] < 700]["component_id"] == 0).all()


def test_no_vectors(spark):
    assert em.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(1, None, [1.0]), (2, 3, None)], "vec_id long, label int, embedding array<float>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in em.near_duplicates(odd).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("rows", [10, 10_000, 10**9])
def test_planned_tables_reach_the_target(rows):
    width, per, rotations = em.plan_tables(rows, 64, 0.98)
    share = (1 - np.arccos(0.98) / np.pi) ** width
    assert 1 - (1 - share) ** (per * rotations) >= em.TARGET_RECALL


@pytest.mark.parametrize("kind", ["shifted", "one cluster", "far shifted"])
def test_recall_at_the_threshold_whatever_the_mean(kind):
    rng = np.random.default_rng(6)
    if kind == "one cluster":
        u = np.vstack([em.unit(np.eye(64)[0] + 0.05 * rng.normal(size=(3600, 64)) / 8), em.unit(rng.normal(size=(400, 64)))])
    else:
        c = 0.7 if kind == "shifted" else 0.85
        u = em.unit(np.eye(64)[0] * np.sqrt(c) + np.sqrt(1 - c) * em.unit(rng.normal(size=(4000, 64))))
    off = rng.normal(size=u.shape)
    off = em.unit(off - (off * u).sum(axis=1, keepdims=True) * u)
    v = 0.9801 * u + np.sqrt(1 - 0.9801**2) * off
    sample = np.vstack([u, v])
    codes = em.plan_codes(sample, 1_000_000, 0.98)
    (a, core), (b, core_b) = codes.keys(u), codes.keys(v)
    met = (a == b) & (a >= 0)
    met[:, codes.centred :] &= (core | core_b)[:, None]
    assert met.any(axis=1).mean() >= 0.96


@pytest.mark.parametrize("kind", ["shifted", "one cluster"])
def test_links_against_brute_force_whatever_the_mean(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "one cluster":
        base = np.vstack([em.unit(np.eye(32)[0] + 0.2 * em.unit(rng.normal(size=(700, 32)))), em.unit(rng.normal(size=(100, 32)))])
    else:
        base = em.unit(np.eye(32)[0] * np.sqrt(0.8) + np.sqrt(0.2) * em.unit(rng.normal(size=(800, 32))))
    v = np.vstack([base, em.unit(base + 0.18 * em.unit(rng.normal(size=base.shape)))])
    frame = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    got = em.near_duplicates(frame).toPandas().set_index("vec_id")["n_links"].loc[range(len(v))].to_numpy()
    want = (em.unit(v) @ em.unit(v).T >= 0.98).sum(axis=1) - 1
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()
