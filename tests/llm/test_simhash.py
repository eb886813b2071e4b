import numpy as np
import pytest
import xxhash

from civicpulse.llm.common import connected_components
from civicpulse.llm.simhash import covering_masks, keep_one_of_each, simhash64, simhash_components


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \t", "One", "a b c", "A b C d", "x y z  w Ä ä v", "to be " * 500])
def test_fingerprint_equals_definition(text):
    assert simhash64(text.encode()) == brute_fp(text)


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 4):
        masks = [m & (2**64 - 1) for m in covering_masks(radius)]
        for _ in range(500):
            diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(m & diff == 0 for m in masks)


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(0, 240, 4):
        words = list(rng.choice(vocab, int(rng.integers(30, 400))))
        texts[i] = " ".join(words)
        texts[i + 1] = texts[i]
        for k in (2, 3):
            words[int(rng.integers(len(words)))] = "changed"
            texts[i + k] = " ".join(words)
    texts |= {1000: None, 1001: "", 1002: " \n", 1003: "a b", 1004: "A  B"}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, fp int, id string")
    got = {r.id: r for r in simhash_components(df).collect()}
    fps = {i: brute_fp(t) for i, t in texts.items()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fps
    want = brute_components(fps, 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = keep_one_of_each(df.unionByName(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = np.random.default_rng(8)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(3))
    rows = [(5, a), (5, b), (3, b), (None, c), (None, c), (None, a + " " + c), (7, None), (None, "")]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(5, a), (3, b), (None, c), (None, a + " " + c), (7, None)], key=str
    )


def test_a_bucket_beyond_the_chunk_is_exact(spark, monkeypatch):
    from civicpulse.llm import simhash

    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = {base}
    for _ in range(150):
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(1, 9)), replace=False)))
    edges = simhash.link_edges(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    want = brute_components({f: f for f in fps}, 4)
    got = brute_union(fps, [(r.a, r.b) for r in edges])
    assert all((r.a ^ r.b).bit_count() <= 4 for r in edges)
    assert got == want


def brute_union(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).collect() == []


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 400)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 400)}}
