import zlib

import numpy as np
import public_tokenizers
import pytest

from civicpulse.llm.packing import hilbert_keys, pack_documents, tail_cuts, word_encoder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "The quick brown fox's tail; it's 12 o'clock!", "", None, " \n\t ", "Ünïcode ÇA é İstanbul ΣΑΣ  x y", "a\x1cb\x0bc\x0cd\re",
    "<|endoftext|> and <|startoftext|>x", "́ mark first", "日本語 テキスト", "word " * 3000, "x" * 5000, "tab\tsep\nline" * 40,
]


def test_encoder_equals_the_whole_text():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS] + ["".join(chr(c) for c in range(1, 600)), "don't we'LL I'D 'sup 'S's ''s 3rd a_b"]
    for _ in range(2):
        for text, ids in zip(texts, word_encoder(PATH)(texts), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_cache_generations_do_not_change_ids(monkeypatch):
    from civicpulse.llm import packing

    monkeypatch.setattr(packing, "CACHE", 2)
    small = packing.WordEncoder(PATH)
    for _ in range(3):
        for text in TEXTS:
            assert small([text or ""])[0].tolist() == word_encoder(PATH)([text or ""])[0].tolist()


@pytest.mark.parametrize(("dims", "bits"), [(2, 5), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_tail_is_cut_at_powers_of_two():
    assert tail_cuts(2048, 2048) == [2048]
    assert tail_cuts(5000, 2048) == [4096, 4608, 4864, 4992, 5000]
    assert tail_cuts(0, 2048) == [0]


def test_round_trip(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, "again the same id", "k"), (None, "no id", "k"), (9, TEXTS[9], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = pack_documents(df, PATH, length=256).collect()
    enc = word_encoder(PATH)
    want = sorted(((i, tuple([*enc([t or ""])[0].tolist(), 1])) for i, t, _ in rows), key=str)
    sequences: dict = {}
    docs: dict = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.id, r.doc_tokens, r.hilbert_key), []).append((r.start, ids))
    total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or at.bit_count() == 1
        total += at
    assert total == sum(len(x) for _, x in want)
    assert sorted(sequences) == list(range(len(sequences)))
    built = []
    for (i, n, _), pieces in docs.items():
        starts = sorted(pieces)
        copies = sum(1 for s, _ in starts if s == 0)
        ids = [x for _, p in starts for x in p] if copies == 1 else None
        if ids is None:  # equal rows: pieces of the copies interleave
            assert sum(len(p) for _, p in starts) == copies * n
            built += [(i, tuple([*enc([TEXTS[9]])[0].tolist(), 1]))] * copies
        else:
            assert len(ids) == n
            built.append((i, tuple(ids)))
    assert sorted(built, key=str) == want


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("change", ["none", "case", "split", "other"])
def test_other_tokenizer_files_are_encoded_by_themselves(tmp_path, change):
    """A file that does not lower-case, or cuts words otherwise, must not be read by the word cache."""
    import json

    from tokenizers import Tokenizer

    from civicpulse.llm import packing

    path = str(public_tokenizers.path("byte_bpe_50k.json")) if change == "other" else str(tmp_path / "t.json")
    if change != "other":
        with open(PATH) as f:
            settings = json.load(f)
        if change == "case":
            settings["normalizer"]["normalizers"].pop()
        elif change == "split":
            settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"
        with open(path, "w") as f:
            json.dump(settings, f)
    assert packing.cuts_words(path) == (change == "none")
    whole, encode = Tokenizer.from_file(path), packing.word_encoder(path)
    texts = [t or "" for t in TEXTS] + ["Mixed CASE Words 123 and It's 45th"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_begin_where_the_rule_says():
    import random

    from civicpulse.llm.packing import WordEncoder

    rng, signs = random.Random(5), "abzst''remdvell  \n\x1c\x85\xa0.,'!0½éÀµß×÷ªZ9\x00\x7f"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["'", "x'", "it's", "'re'll", "''ve"]
    encode = WordEncoder(PATH)
    for group in (1, 100, 1 << 20):
        encode.GROUP = group
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_cutting_neither_sorts_ids_nor_keeps_words(spark):
    """What overran an executor's memory: sorted ids beside workers that keep the encoder's words."""
    from civicpulse.llm import packing

    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = pack_documents(df, PATH)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    word_encoder(PATH)
    assert list(packing._cut(2048, 0, False)(iter([]))) == [] and word_encoder.cache_info().currsize == 0
