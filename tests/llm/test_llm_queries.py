"""Registered queries: SQL where there is some, shapes and invariants elsewhere."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from civicpulse.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")
COLUMNS = {
    "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got, want = registry.queries()[name](spark, DIR), db.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_covers_its_whole_table(spark, name):
    got = registry.queries()[name](spark, DIR)
    assert got.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    key, table = ("vec_id", "embeddings") if name.startswith("op7") else ("doc_id", "documents")
    ids = {r[0] for r in got.select(key).where(F.col(key).isNotNull()).distinct().collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).collect()}


def test_packing_check_sums(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    pieces = registry.queries()["op3_packing"](spark, DIR).collect()
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    ends: dict = {}
    for r in pieces:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert sum(r.length for r in pieces) == sum(map(len, ids.values())) == sum(ends.values())
    assert all(e == 2048 or e.bit_count() == 1 for e in ends.values())
