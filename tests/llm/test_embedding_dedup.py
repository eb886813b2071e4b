import numpy as np
import pytest
from pyspark.sql import functions as F

from civicpulse.llm.embedding_dedup import embedding_components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine=0.93):
    ok = [i for i, (_, v, lab, *_) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, i in enumerate(ok):
        a = np.array(rows[i][1], np.float32).astype(float)
        for j in ok[:p]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                b = np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows)))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted((r.id, r.n_links, r.component_id, r.kept) for r in embedding_components(df).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(40):
        base = rng.standard_normal(64)
        for k in range(6):
            v = base + rng.standard_normal(64) * (0.1 if k < 4 else 0.9)
            rows.append((c * 10 + k, v.tolist(), c % 3))
        rows.append((c * 10 + 6, rows[-2][1], c % 3))
        rows.append((c * 10 + 7, (3 * np.array(rows[-3][1])).tolist(), c % 3))
        rows.append((c * 10 + 8, rows[-4][1], (c + 1) % 3))
    one = rng.standard_normal(64).tolist()
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 64, 1), (1003, [float("nan")] * 64, 1), (1004, [None, 1.0], 1)]
    rows += [(1005, one, None), (1006, one, None), (1007, [1.0, 2.0], 1), (1008, [1.0, 2.1], 1), (1009, [float("inf"), 1.0], 1)]
    rows += [(1010, [5.0], 2), (1011, [2.0], 2), (1012, [-2.0], 2), (1013, one, 2), (1013, one, 2)]
    assert run(spark, rows) == brute(rows)


def test_a_cap_beyond_the_chunk_is_exact(spark, monkeypatch):
    from civicpulse.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "CHUNK", 64)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(64)
    rows = [(i, (base + rng.standard_normal(64) * 0.15).tolist(), 0) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        z = rng.standard_normal(64)
        z -= z @ x * x
        z /= np.linalg.norm(z)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (0.931 * x + np.sqrt(1 - 0.931**2) * z).tolist(), 0)]
    got = run(spark, rows)
    assert sum(r[1] for r in got) >= 0.99 * 1000
    assert all(r[1] <= 1 for r in got)


def test_empty_table(spark):
    assert embedding_components(spark.createDataFrame([], SCHEMA)).collect() == []


def near_pairs(n, cosine, dim=64, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize(("in_cap", "words"), [(64, 8), (4, 16), (1, 32), (0.2, 64)])
def test_recall_of_the_filters(spark, monkeypatch, in_cap, words):
    from civicpulse.llm import embedding_dedup as E

    monkeypatch.setattr(E, "SMALL", 0)
    monkeypatch.setattr(E, "IN_CAP", in_cap)
    x, y = near_pairs(500, 0.931)
    rows = [(2 * i + k, v[i].tolist(), 0) for i in range(500) for k, v in enumerate((x, y))]
    assert spark.range(1).select(E.words_of(F.lit(1000))).first()[0] == words
    got = run(spark, rows)
    assert sum(r[1] for r in got) >= 0.98 * 1000
    assert all(r[1] <= 1 for r in got)


def test_filters_equal_the_full_products():
    from civicpulse.llm import embedding_dedup as E

    x, _ = near_pairs(50, 0.5, dim=10)
    cut = E.threshold(10, 8, 0.93)
    turns, left, right = E._codebooks(10, 8)
    for v, got in zip(x, E.decode_filters(x, 8, cut), strict=True):
        score = np.concatenate([((v @ t)[:5] @ a.T)[:, None] + ((v @ t)[5:] @ b.T)[None, :] for t, a, b in zip(turns, left, right, strict=True)]).ravel()
        assert set(got.tolist()) == set(np.flatnonzero(score >= cut).tolist()) | {int(score.argmax())}


def test_compared_share_falls_as_rows_grow(spark):
    from civicpulse.llm import embedding_dedup as E

    share, caps = {}, {}
    for n in (4_000, 16_000, 64_000):
        words = spark.range(1).select(E.words_of(F.lit(n))).first()[0]
        x = np.random.default_rng(n).standard_normal((4000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = E.decode_filters(x, words, E.threshold(64, words, 0.93))
        sizes = np.bincount(np.concatenate(lists)) / len(x)
        share[n], caps[n] = float((sizes**2).sum()), np.mean([len(f) for f in lists])
    assert share[16_000] < 0.7 * share[4_000] and share[64_000] < 0.7 * share[16_000], (share, caps)
    assert max(caps.values()) < 26


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 1e200], 1), (1, [1e-200, 1.1e-200], 1), (2, [3.0, 3.0], 1), (3, [1e200, -1e200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r.id, r.n_links, r.component_id) for r in embedding_components(df).collect()) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]


def test_null_ids_and_labels_of_any_type(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (3, [1.0, 0.1], "a"), (4, [1.0, 0.1], "b")], "vec_id long, embedding array<float>, label string")
    assert sorted(((r.id or -1), r.n_links, r.component_id, r.kept) for r in embedding_components(df).collect()) == [(-1, 2, 3, False), (-1, 2, 3, False), (3, 2, 3, True), (4, 0, 4, True)]
