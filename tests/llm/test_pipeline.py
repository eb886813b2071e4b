"""The pipeline against a plain restatement of its stages on a planted corpus."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from test_line_dedup import WS, brute_whole
from test_near_duplicates import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {
    "en": "the quick brown fox jumps over lazy dogs while children sing about winter nights and morning light under clouds",
    "fr": "le renard brun saute par dessus les chiens paresseux pendant que les enfants chantent sous la pluie du matin",
}
PASSAGE = "\n".join(f"shared passage line {i} says the same words in every document that holds it" for i in range(6))


def planted(tmp_path, spark):
    rng = random.Random(4)
    vocab = {k: [f"{w}{s}" for w in v.split() for s in ("", "s", "er", "ly")] for k, v in WORDS.items()}
    text = lambda lang, n=120: "\n".join(" ".join(rng.choice(vocab[lang]) for _ in range(12)) for _ in range(n // 12))
    docs, labels = [], []
    for i in range(200):
        lang = ("en", "fr")[i % 2]
        body = text(lang)
        if i % 10 == 7:  # toxic
            body = body.replace("\n", " vile wretched scoundrel\n")
        if i % 10 == 3:  # junk
            body = "\n".join(" ".join(f"{w}%%%" for w in line.split()) for line in body.split("\n"))
        docs.append([i, body, lang])
        labels.append((i, int(i % 10 != 3), int(i % 10 == 7)))
    docs[21][1] += "\n" + PASSAGE
    docs[22][1] += "\n" + PASSAGE + "\n" + text("en", 24)
    docs.append([500, docs[40][1], "en"])  # exact copy
    near = docs[41][1].replace("\n", " ").split()
    near[5] = "changed"
    docs.append([501, " ".join(near), "fr"])  # near copy on one line: only SimHash can see it
    docs.append([502, "\x01\x02\x03\x04" * 200, None])  # no language
    docs.append([503, None, "en"])
    rows = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {i: t for i, t, _ in docs}


def test_stages_and_result(spark, tmp_path):
    texts = planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(texts) - set(seen["language_id"]) <= {502, 503} and 502 not in seen["language_id"]
    # the line and near-duplicate stages against brute force on what they were given
    given = sorted(seen["language_id"].values(), key=lambda r: r.doc_id)
    cleaned = dict(zip([r.doc_id for r in given], brute_whole([(r.doc_id, r.text) for r in given], 10), strict=True))
    changed = {r.doc_id for r in given if cleaned[r.doc_id] != r.text}
    want = {i: t for i, t in cleaned.items() if i not in changed or (t or "").strip(WS)}
    assert {i: r.text for i, r in seen["line_dedup"].items()} == want
    components = brute_components(want)
    assert set(seen["simhash_dedup"]) == set(components.values())
    lines = seen["line_dedup"]
    assert 500 not in lines and PASSAGE in lines[21].text and PASSAGE not in lines[22].text
    assert lines[22].text == texts[22].replace("\n" + PASSAGE, "") and lines[22].n_chars == len(lines[22].text)
    assert all(lines[i].text == texts[i] for i in range(200) if i != 22)
    kept = seen["simhash_dedup"]
    assert 501 not in kept and set(range(200)) <= set(kept)
    mixed = seen["mixing"]
    assert not {i for i in mixed if i % 10 == 7 and i < 200} and {i for i in range(200) if i % 10 not in (3, 7)} <= set(mixed)

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(mixed)
    for r in got:
        ids = np.array([*whole.encode(mixed[r.doc_id].text or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
