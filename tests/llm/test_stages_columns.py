"""The pipeline's stages on rows with null and shared ids and with columns of any name and type."""

import random

import pytest
from pyspark.sql import functions as F

from civicpulse.llm.language_id import drop_unidentified
from civicpulse.llm.line_dedup import drop_repeated_lines, line_dedup
from civicpulse.llm.mixing import resample
from civicpulse.llm.near_duplicates import drop_near_duplicates
from civicpulse.llm.simhash import keep_one_of_each

NAMES = ("_row", "_lines", "_removed", "_clean", "_keep_id", "_keep_rank", "_copies", "_copy", "_k1", "_k2", "row", "k1", "copies", "copy", "clean", "removed", "in_0", "word", "rate", "id", "lab", "n")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [a + b for a in "the of and with from over under light water house".split() for b in ("", "s", "ed", "ing")]
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=14)) for _ in range(6))) for i in range(40)]
    rows += [(None, t) for _, t in [(0, "\n".join(" ".join(rng.choices(words, k=14)) for _ in range(6))) for _ in range(5)]]  # unlike each other
    rows += [(7, "\n".join(" ".join(rng.choices(words, k=14)) for _ in range(6)))]  # another text of a known id
    rows += [(None, None), (100, ""), (101, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.concat(F.lit(n), F.col("text")).alias(n) for n in NAMES])
    return df.withColumn("m", F.create_map(F.lit("k"), F.col("text"))).withColumn("deep", F.array(F.struct(F.col("m")))).cache()


def labels(spark):
    return spark.createDataFrame([(i, ("clean", "junk")[i % 2]) for i in range(40)], "doc_id long, domain string")


def texts(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())


def carried(df, docs):
    assert df.columns == docs.columns and df.dtypes == docs.dtypes
    return all(all(r[n] is None or r[n].startswith(n) for n in NAMES) and (r.m["k"] is None or r["_row"] == "_row" + r.m["k"]) for r in df.collect())


def test_line_stage(spark, docs):
    out = drop_repeated_lines(docs)
    assert carried(out, docs) and texts(out) == texts(docs)
    assert line_dedup(docs).columns == [c for c in docs.columns if c not in ("_clean", "_removed")] + ["_clean", "_removed"]


@pytest.mark.parametrize("stage", [keep_one_of_each, drop_near_duplicates])
def test_near_duplicate_stages(spark, docs, stage):
    out = stage(docs)
    assert carried(out, docs)
    kept = texts(out)
    assert [x for x in kept if len(x[1]) > 10] == [x for x in texts(docs) if len(x[1]) > 10]  # every own text stays
    assert len(kept) == 47  # the three empty ones are one group


def test_language_stage(spark, docs):
    out = drop_unidentified(docs)
    assert carried(out, docs) and {t for t in texts(out) if len(t[1]) > 10} == {t for t in texts(docs) if len(t[1]) > 10}


def test_mixing_stage(spark, docs):
    out = resample(docs, labels(spark), {"clean": 0.5, "junk": 0.5})
    assert carried(out, docs) and out.count() >= 40


def test_empty_tables(spark, docs):
    for stage in (drop_repeated_lines, keep_one_of_each, drop_near_duplicates, drop_unidentified):
        assert stage(docs.limit(0)).collect() == []
    assert resample(docs.limit(0), labels(spark)).collect() == []
