"""SimHash near-dedup by covering locality-sensitive hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of
its word shingles.  Fingerprints that differ in at most ``radius`` bits are
linked.  Candidate search is by a covering family: bit ``i`` gets a vector
``m(i)`` of ``radius + 1`` bits and every non-zero ``v`` of as many bits gives a
table whose mask keeps the bits with ``<m(i), v> = 1``.  A pair that differs in
``radius`` bits or fewer asks ``v`` to be orthogonal to at most ``radius``
vectors, which some non-zero ``v`` is: the pair collides in that table.  So no
link is lost, whatever the data.

Defined cases: a null text counts as empty; a text without words has the
fingerprint zero and is linked like any other; with fewer words than a shingle
the whole word sequence is hashed; very long texts are hashed whole, a block of
shingles at a time; equal fingerprints are one node of the graph
(copies are never expanded into pairs); rows with a null id are fingerprinted
but never name a component; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, group_bounds, materialise, put_back, read_table, set_apart, text_or_empty, whole_groups

_CHUNK = 1 << 16  # shingles hashed at a time
CHUNK = 1 << 15  # fingerprints of a bucket that one task compares


def simhash64(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of one text given as UTF-8; A-Z are lower-cased, others kept."""
    import xxhash

    words = data.lower().split()  # bytes: ASCII case and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n]
    stops = ends[shingle - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), stops[at : at + _CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[i:j], seed) for i, j in spans], np.dtype("<u8"))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are 1 in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK], np.dtype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row ``(id, fp)`` per document; ``fp`` holds the 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([simhash64(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(work, "id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of the covering family, one per non-zero vector of ``radius + 1`` bits."""
    vectors = (1 << (radius + 1)) - 1
    own = [1 + i % vectors for i in range(bits)]  # every non-zero vector equally often
    masks = [sum(1 << i for i in range(bits) if (own[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among the distinct fingerprints of a bucket.

    A breadth-first search that compares each reached fingerprint with those not
    yet reached: at most one edge per fingerprint leaves, never all pairs.
    """
    rest = np.unique(fps).view(np.uint64)  # bitwise_count of a signed number counts its absolute value
    edges: list[tuple[int, int]] = []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                edges.extend((int(x.view(np.int64)), y) for y in found.view(np.int64).tolist())
                queue.extend(found)
    return edges


def link_edges(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``(a, b)`` that span the links among distinct fingerprints ``fp``.

    A bucket of more than ``CHUNK`` fingerprints is dealt as pairs of chunks to as
    many tasks, which together compare what one task would.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    # every fingerprint becomes as many rows as there are masks: spread them first
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = spread.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp"
    )
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    large = materialise(large.select(F.col("key").alias("_key"), F.ceil(F.col("n") / CHUNK).cast("int").alias("_chunks")), "large")
    dealt = keyed.join(large, F.col("key") == F.col("_key"), "left").withColumn("chunks", F.coalesce("_chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select("key", "fp", "chunk", "chunks", other)
    part = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    dealt = dealt.select("key", part.alias("part"), "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "part")):
            fps, out = table.column("fp").to_numpy(), []
            for i, j in group_bounds(table, ("key", "part")):
                out += bucket_edges(fps[i:j], radius)
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(work, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """One row ``(id, fp, component_id, kept)`` per document.

    ``component_id`` is the least id reachable by links, ``kept`` marks the
    documents whose id it is.
    """
    members = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = members.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(link_edges(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted, "simhash")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    out = members.join(named, "fp")
    return out.select("id", "fp", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates.

    Rows are told apart by a key of their own: ids may be null or repeat.
    """
    rows, names = numbered(docs)
    groups = simhash_components(rows, "row", names["text"], shingle=shingle, radius=radius).select(F.col("id").alias("row"), "component_id")
    return put_back(one_row_of_each(rows, groups, names), names)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` set apart and stored with ``row``, a number for every row."""
    rows, names = set_apart(docs)
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "docs"), names


def one_row_of_each(rows: DataFrame, groups: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row of each ``component_id`` of ``groups(row, component_id)``: the least id, then the longest text."""
    own = F.col(names["doc_id"])
    slim = rows.select("row", own.alias("doc_id"), F.length(names["text"]).alias("length")).join(groups, "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", -F.coalesce("length", F.lit(-1)), "row")).alias("first")
    kept = slim.groupBy("component_id").agg(first).select(F.col("first")["row"].alias("row"))
    return rows.join(kept, "row", "left_semi")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, 4 differing bits."""
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "kept",
    )
