"""Language ID by Bayesian evidence fusion.

Evidence on a row: the likelihood of its text under byte-bigram models, the
language its markup declares, the suffix of its address, and a prior of its host
smoothed towards its domain (where it has one) and the domain's towards the corpus.
The three tables besides the text model are grouped aggregations of the text-only
decision over all rows; a row's own vote is taken out of its host's and domain's
counts.

The bigram models are fitted on a bounded sample of labelled documents: per language
at most ``TRAIN_ROWS`` distinct texts, those least by hash, so that neither a frequent
language nor a text with many copies crowds out others.  A document's ``lang`` is what
it declares; where it was a training label it is held out of the evidence on its row.

Defined cases: a text that is null or has at most ``MIN_BYTES`` bytes says nothing and
the other evidence decides; missing markup, suffix or host say nothing; declared
languages that no model knows are evidence like any other value; without labelled
rows nothing can be recognised (language null, not kept); text that fits no model
(it falls short of the training mean by ``MARGIN`` nats a byte and ``SLACK`` nats
besides) is ``und``; repeated rows are judged each; very long texts are read whole, a
megabyte at a time, and markup is stripped in time linear in the page; more than
``MAX_MODELS`` languages in the labels raise an error (their tables would not fit a
worker), none is dropped; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, put_back, read_table, row_hashes, set_apart, text_or_empty

TRAIN_ROWS = 2000  # bound of the labelled sample: distinct texts of a language
MAX_MODELS = 512  # a model is a table of 256 KB on every worker
TEMPER = 0.2  # bigrams of a text are not independent
MARGIN = 1.5
SLACK = 300.0  # nats that a text of any length may fall short by: names and codes weigh on short texts
STRENGTH = 10.0  # documents a parent's prior counts for
MIN_POSTERIOR = 0.5
MIN_BYTES = 3  # shorter texts say nothing
_SLICE = 1 << 20

_OPEN = re.compile(rb"(?i)<(?:(script|style)\b|!--)")
_CLOSE = {b"script": re.compile(rb"(?i)</script\s*>"), b"style": re.compile(rb"(?i)</style\s*>"), None: re.compile(rb"-->")}
_ENTITIES = ((b"&lt;", b"<"), (b"&gt;", b">"), (b"&quot;", b'"'), (b"&nbsp;", b" "), (b"&#39;", b"'"), (b"&amp;", b"&"))


def _without_hidden(html: bytes) -> bytes:
    """Scripts, styles and comments as one space each; those that never end are left."""
    out, done, at, endless = [], 0, 0, set()
    while len(endless) < len(_CLOSE) and (m := _OPEN.search(html, at)):
        kind = m[1].lower() if m[1] else None
        end = None if kind in endless else _CLOSE[kind].search(html, m.end())
        if end is None:
            endless.add(kind)  # nor does any later one of its kind end
            at = m.start() + 1
            continue
        out += [html[done : m.start()], b" "]
        done = at = end.end()
    return b"".join([*out, html[done:]])


def _without_tags(html: bytes) -> bytes:
    out, done = [], 0
    while (start := html.find(b"<", done)) >= 0 and (end := html.find(b">", start)) >= 0:
        out += [html[done:start], b" "]
        done = end + 1
    return b"".join([*out, html[done:]])


def visible(html: bytes) -> bytes:
    """Text of a page without scripts, styles, comments and tags; common entities resolved."""
    text = _without_tags(_without_hidden(html))
    if b"&" in text:
        for entity, plain in _ENTITIES:
            text = text.replace(entity, plain)
    return text


def _pairs(data: bytes) -> Iterator[np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(b) - 1, 0), _SLICE):
        part = b[at : at + _SLICE + 1].astype(np.uint16)
        yield (part[:-1] << 8) | part[1:]


def _label_hash(text: Column, lang: Column) -> Column:
    return F.xxhash64(text, lang)


def sample_edges(labelled: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, int]:
    """Per language the greatest hash of ``labelled(text, lang)`` that is in the sample."""
    says = labelled.where(F.col("lang").isNotNull() & (F.octet_length(text_or_empty()) > MIN_BYTES))
    keys = says.select("lang", _label_hash(F.col("text"), F.col("lang")).alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    edges = keys.withColumn("place", place).where(F.col("place") <= rows).groupBy("lang").agg(F.max("h").alias("h"))
    found = {r["lang"]: r["h"] for r in edges.limit(MAX_MODELS + 1).collect()}
    if len(found) > MAX_MODELS:
        raise ValueError(f"The labels name more than {MAX_MODELS} languages.")
    return found


def _in_sample(text: Column, lang: Column, edges: dict[str, int]) -> Column:
    if not edges:
        return F.lit(False)
    edge = F.element_at(F.create_map(*[F.lit(x) for pair in edges.items() for x in pair]), lang)
    return F.coalesce((_label_hash(text, lang) <= edge) & (F.octet_length(F.coalesce(text, F.lit(""))) > MIN_BYTES), F.lit(False))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, edges: dict[str, int] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities ``(65536, languages)`` and mean log-likelihoods.

    ``labelled(text, lang)``: the sample is counted where it lies; what reaches the
    driver is one count per language and byte pair.
    """
    edges = sample_edges(labelled, rows) if edges is None else edges
    if not edges:
        return [], np.zeros((65536, 0), np.float32), np.zeros(0)
    sample = labelled.where(_in_sample(F.col("text"), F.col("lang"), edges)).select("text", "lang").dropDuplicates()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for text, lang in zip(texts, batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, np.zeros(65536, np.int64))
                for pairs in _pairs(text.as_py()):
                    own += np.bincount(pairs, minlength=65536)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["lang", "pair", "n"]
            )

    counts = sample.select(text_or_empty().alias("text"), "lang").mapInArrow(count, "lang string, pair long, n long")
    got = counts.groupBy("lang", "pair").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(edges)
    table = np.zeros((65536, len(langs)))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[own["pair"].to_numpy(), k] = own["n"].to_numpy()
    smooth = table + 0.05
    logp = np.log(smooth.reshape(256, 256, -1) / smooth.reshape(256, 256, -1).sum(axis=1, keepdims=True)).reshape(65536, -1)
    mean = (table * logp).sum(axis=0) / np.maximum(table.sum(axis=0), 1)
    return langs, logp.astype(np.float32), mean


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows(text, is_html, ...)`` plus tempered log-likelihoods ``ll`` and ``fits``."""
    langs, logp, mean = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, html = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()
            out, fits = np.zeros((batch.num_rows, len(langs))), np.ones(batch.num_rows, bool)
            for k, (text, page) in enumerate(zip(texts, html, strict=True)):
                data = visible(text.as_py()).strip() if page else text.as_py()
                total = np.zeros(len(langs))
                for pairs in _pairs(data):
                    total += logp[pairs].sum(axis=0, dtype=np.float64)
                if len(data) > MIN_BYTES and len(langs):
                    short = (mean - MARGIN) * (len(data) - 1) - total
                    fits[k] = short.min() < SLACK
                    out[k] = TEMPER * total if len(data) > MIN_BYTES else 0.0
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(langs)), pa.array(out.ravel(), pa.float64())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists, pa.array(fits)], names=[*keep, "ll", "fits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select("text", "is_html", *keep).mapInArrow(work, f"{schema}, ll array<double>, fits boolean")


def _counts(votes: DataFrame, key: list[str], langs: int, name: str) -> DataFrame:
    per = [F.sum(F.when(F.col("vote") == k, 1).otherwise(0)).alias(f"c{k}") for k in range(langs)]
    table = votes.where(F.col(key[0]).isNotNull() & F.col("vote").isNotNull()).groupBy(*key).agg(*per)
    counted = table.select(*key, F.array(*[F.col(f"c{k}") for k in range(langs)]).alias(name))
    return materialise(counted, "evidence")


def _without_own(counts: Column, k: int) -> Column:
    """Votes for ``k`` without the row's own; none where the key is missing."""
    return F.when(counts.isNull(), 0).otherwise(counts[k] - F.when(F.col("vote") == k, 1).otherwise(0))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """Language of ``rows(text, is_html, markup, suffix, host, domain, ...)``.

    Returns the ``keep`` columns with ``language``, ``posterior``,
    ``text_language`` and ``kept``.
    """
    langs = model[0]
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(*keep, none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), F.lit(False).alias("kept"))
    sides = ["markup", "suffix", "host", "domain"]
    base = text_evidence(rows, model, [*keep, *sides])
    best = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    said = F.array_max("ll") > F.array_min("ll") if n > 1 else F.array_max("ll") < 0
    base = materialise(base.withColumn("vote", F.when(said & F.col("fits"), best)), "language")

    totals = base.agg(*[F.sum(F.when(F.col("vote") == k, 1).otherwise(0)).alias(f"c{k}") for k in range(n)]).first()
    seen = [(totals[k] or 0) + 1.0 for k in range(n)]
    world = [x / sum(seen) for x in seen]
    out = base
    for side in ("markup", "suffix"):
        table = _counts(base, [side], n, f"{side}_counts").withColumnRenamed(side, f"_{side}")
        out = out.join(table, F.col(side) == F.col(f"_{side}"), "left")
    hosts = _counts(base, ["host"], n, "host_counts").withColumnRenamed("host", "_host")
    domains = _counts(base, ["domain"], n, "domain_counts").withColumnRenamed("domain", "_domain")
    out = out.join(hosts, F.col("host") == F.col("_host"), "left").join(domains, F.col("domain") == F.col("_domain"), "left")

    def add(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, columns)

    own = {s: [_without_own(F.col(f"{s}_counts"), k) for k in range(n)] for s in ("host", "domain")}
    scores = []
    for k in range(n):
        upper = (own["domain"][k] + STRENGTH * world[k]) / (add(own["domain"]) + STRENGTH)
        prior = (own["host"][k] + STRENGTH * upper) / (add(own["host"]) + STRENGTH)
        score = F.col("ll")[k] + F.log(prior)
        for side in ("markup", "suffix"):
            # P(value | language), a value seen with no votes being no evidence
            value = (_without_own(F.col(f"{side}_counts"), k) + 0.5) / (seen[k] + 0.5 * n)
            score = score + F.when(F.col(f"{side}_counts").isNotNull(), F.log(value)).otherwise(0.0)
        scores.append(score)
    out = out.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    out = out.withColumn("posterior", 1 / F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    names = F.array(*map(F.lit, langs))
    language = names[F.array_position("scores", F.col("top")).cast("int") - 1]
    kept = F.col("fits") & (F.col("posterior") >= MIN_POSTERIOR)
    return out.select(
        *keep, F.when(kept, language).otherwise("und").alias("language"), "posterior",
        F.when(F.col("vote").isNotNull(), names[F.col("vote")]).alias("text_language"), kept.alias("kept"),
    )


def _document_evidence(edges: dict[str, int] | None = None) -> list[Column]:
    declared = F.nullif(F.lower(F.trim(F.col("lang").cast("string"))), F.lit(""))
    trained = _in_sample(F.col("text"), F.col("lang").cast("string"), edges or {})
    none = F.lit(None).cast("string")
    return [
        text_or_empty("text").alias("text"), F.lit(False).alias("is_html"), F.when(~trained, declared).alias("markup"),
        none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain"),
    ]


def document_rows(docs: DataFrame, edges: dict[str, int] | None = None) -> DataFrame:
    """Documents as evidence: the source is the host, ``lang`` is declared where the sample
    up to ``edges`` did not train on it."""
    return docs.select("doc_id", *_document_evidence(edges))


def page_rows(pages: DataFrame) -> DataFrame:
    """Raw pages as evidence: ``lang`` of the html element, suffix, host and domain of the address."""
    lang = F.regexp_extract(F.col("html"), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select(
        "page_id", text_or_empty("html").alias("text"), F.lit(True).alias("is_html"),
        F.nullif(F.lower(lang), F.lit("")).alias("markup"),
        F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
    )


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, columns unchanged.

    Rows equal in every column share their verdict, so the rejected ones are named
    by two hashes over all columns; that table is small where documents are sound.
    """
    rows, names = set_apart(docs)
    k1, k2 = row_hashes(rows)
    rows = rows.withColumns({"k1": k1, "k2": k2})
    known = rows.select("k1", "k2", *[F.col(names[c]).alias(c) for c in ("text", "lang", "source")])
    labelled = known.select("text", F.col("lang").cast("string").alias("lang"))
    edges = sample_edges(labelled)
    found = identify(known.select(*_document_evidence(edges), "k1", "k2"), train(labelled, edges=edges), ["k1", "k2"])
    rejected = materialise(found.where(~F.col("kept")).select("k1", "k2").distinct(), "rejected")
    return put_back(rows.join(rejected, ["k1", "k2"], "left_anti"), names)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents and of all pages (``doc_id`` or ``page_id`` is set)."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    labelled = docs.select("text", "lang")
    edges = sample_edges(labelled)
    rows = document_rows(docs, edges).withColumn("page_id", none).unionByName(page_rows(pages).withColumn("doc_id", none))
    found = identify(rows, train(labelled, edges=edges), ["doc_id", "page_id"])
    return found.withColumn("posterior", F.round("posterior", 6))
