import numpy as np
from pyspark.sql import functions as F

from civicpulse.llm.near_duplicates import band_keys, drop_near_duplicates, near_components, shingle_set


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: brute_set(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            near = sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
            if i < j and near:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(0, 240, 6):
        words = list(rng.choice(vocab, int(rng.integers(20, 400))))
        for k in range(6):  # a chain: ends unlike each other, neighbours alike or not
            texts[i + k] = " ".join(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 40))):
                words[int(rng.integers(len(words)))] = "changed"
    texts |= {1000: None, 1001: "", 1002: " \n", 1003: "a b", 1004: "A  B", 1005: "a b c"}
    df = spark.createDataFrame(list(texts.items()), "_row long, text string")
    got = near_components(df.repartition(3)).groupBy("component_id").agg(F.sort_array(F.collect_list("_row")).alias("rows")).collect()
    want = brute_components(texts)
    assert sorted(r.rows for r in got) == sorted(sorted(i for i in want if want[i] == c) for c in set(want.values()))


def test_a_near_copy_beyond_four_bits_goes(spark):
    from civicpulse.llm.simhash import simhash64

    rng = np.random.default_rng(1)
    while True:
        words = list(rng.choice([f"w{i}" for i in range(300)], 100))
        a, words[40:44] = " ".join(words), ["x", "y", "z", "q"]
        b = " ".join(words)
        if (simhash64(a.encode()) ^ simhash64(b.encode())).bit_count() > 4:
            break
    df = spark.createDataFrame([(1, a, 5), (2, b, 5), (None, " ".join(reversed(words)), 7)], "doc_id long, text string, n_chars int")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, None}
    assert drop_near_duplicates(df.limit(0)).collect() == []


def test_bands_meet_at_the_similarity():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 110, np.uint64)  # 88 of 110 in common
        missed += not set(band_keys(h[:99])) & set(band_keys(h[11:]))
    assert missed == 0


def test_shingles():
    assert len(shingle_set(b"")) == 0 and len(shingle_set(b"a b")) == 1 and len(shingle_set(b"a b c d e f")) == 2
    assert (shingle_set(b"A b\nc") == shingle_set(b"a  b c")).all()


def test_a_borderline_group_is_checked_in_its_buckets(spark, monkeypatch):
    """Many texts around the similarity: chunks, slices of batches and bands change nothing in the components."""
    from civicpulse.llm import near_duplicates as N

    monkeypatch.setattr(N, "CHUNK", 16)
    monkeypatch.setattr(N, "SURE", 0.97)  # leaves nearly all to the check in the buckets
    rng = np.random.default_rng(9)
    vocab, texts = [f"w{i}" for i in range(400)], {}
    base = list(rng.choice(vocab, 120))
    for i in range(90):
        words = list(base)
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(len(words)))] = f"x{i}"
        texts[i] = " ".join(words)
    texts |= {200 + i: " ".join(rng.choice(vocab, 30)) for i in range(40)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(list(texts.items()), "_row long, text string")
        got = near_components(df.repartition(3)).groupBy("component_id").agg(F.sort_array(F.collect_list("_row")).alias("rows")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_components(texts)
    assert sorted(r.rows for r in got) == sorted(sorted(i for i in want if want[i] == c) for c in set(want.values()))
