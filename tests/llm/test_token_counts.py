import numpy as np
import public_tokenizers
import pytest

from civicpulse.llm.token_counts import _encoder, scan_token_files, write_token_files

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_stitched_lengths_equal_brute_force(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want, paths = [], []
    for k, n in enumerate((0, 1, 5, 60, 200)):
        ids = rng.choice([9, 1, 2, 3, 4, 5], n).astype("<u2")
        if k == 3:
            ids[10:40] = 1  # a document longer than many blocks
        if k == 4:
            ids[-1] = 9
        path = f"file://{tmp_path}/{k}.bin"
        ids.tofile(f"{tmp_path}/{k}.bin")
        paths.append((path,))
        lengths, open_ = [], 0
        for x in ids.tolist():
            open_ += 1
            if x == 9:
                lengths.append((open_, True))
                open_ = 0
        lengths += [(open_, False)] if open_ else []
        want += [(path, i, n, whole) for i, (n, whole) in enumerate(lengths)]
    got = scan_token_files(spark.createDataFrame(paths, "path string"), 9, block=block).collect()
    assert sorted((r.path, r.ordinal, r.n_tokens, r.complete) for r in got) == sorted(want)


def test_counts_equal_the_tokenizer(spark, tmp_path):
    texts = ["", None, "one two", "<|endoftext|>", "é日本\n\n", "word " * 5000, "one two"]
    df = spark.createDataFrame([(i % 6, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, path int").repartition(3)
    written = write_token_files(df, f"file://{tmp_path}/flat", PATH, 50256)
    found = scan_token_files(written.select("path").distinct(), 50256, block=100)
    got = sorted((r.id, r.n_tokens) for r in written.join(found, ["path", "ordinal"]).collect())
    encode = _encoder(PATH).encode_ordinary
    assert got == sorted((i % 6, len(encode(t or "")) + 1) for i, t in enumerate(texts))


def test_empty_table(spark, tmp_path):
    written = write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", PATH, 50256)
    assert written.collect() == []
    assert scan_token_files(written.select("path").distinct(), 50256).collect() == []
