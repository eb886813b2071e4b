"""Embedding near-dedup with spherical-cap filters from random product codes.

Vectors are compared within a label only.  Each of several random rotations
splits the space in two blocks with a codebook each; the sums of a word of either
block are the filter directions.  A vector is list-decoded to all directions whose
inner product passes the threshold, and to the best one of all, so that no vector
is without a filter.  Vectors meet in the caps they share.  The first pass carries
a 128-bit sign sketch and keeps the vectors that have a likely partner in some
cap; only these fetch their components for the exact check in double precision.

The codebooks grow with the label: the number of directions is chosen so that a cap
holds about ``IN_CAP`` vectors whatever the label's size (a vector stays in about
a dozen to two dozen caps), so the share of pairs that are compared falls as the rows
grow.  The threshold is the highest at which a simulated pair at exactly the wanted
cosine shares a cap with a chance of ``RECALL``; nearer pairs are missed less still.
A label of at most ``SMALL`` vectors is one cap.

Equal vectors of a label are one node with a count, never pairs.  A link is
credited in the least cap its two ends share, so every cap can count its links
and hand out spanning edges without emitting pairs.  A cap of more vectors than
``CHUNK`` is dealt as pairs of chunks to as many tasks.

Defined cases: a vector that is null, empty or zero, or has null or non-finite
components, and a null label link with nothing (no links, own component, kept);
vectors of different lengths never link; components of any size are scaled before
they are squared; rows that repeat are copies of each other; a null id names no
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, group_bounds, materialise, read_table, whole_groups

CODES = 32  # rotations
IN_CAP = 64  # vectors of a cap, about
SMALL = 1024
RECALL = 0.995
CHUNK = 2048
SKETCH_BITS, SKETCH_SIGMAS = 128, 4.5
#: labels of more than ``SMALL`` rows whose sizes are broadcast; more are joined
BROADCAST_LABELS = 1_000_000
_TRIALS, _NEAR_WORDS = 1000, 48


@lru_cache(maxsize=4)
def _codebooks(dim: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations and both blocks' words: the same on every worker."""
    rng = np.random.default_rng(20240607 + dim)
    half = dim // 2

    def book(size: int) -> np.ndarray:
        w = rng.standard_normal((CODES, words, size))
        return w / np.maximum(np.linalg.norm(w, axis=2, keepdims=True), 1e-12) / np.sqrt(2)

    turns = np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(CODES)])
    return turns, book(half), book(dim - half)


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(77 + dim).standard_normal((dim, SKETCH_BITS))


def words_of(n: Column) -> Column:
    """Words of a block for a label of ``n`` rows: 0 (one cap) or a power of two from 8 to 4096."""
    size = F.pow(2.0, F.ceil(F.log2(F.sqrt(n * 14 / (CODES * IN_CAP)))))
    return F.when(n <= SMALL, 0).otherwise(F.least(F.greatest(size, F.lit(8.0)), F.lit(4096.0))).cast("int")


@lru_cache(maxsize=64)
def threshold(dim: int, words: int, cosine: float) -> float:
    """The highest cut at which a pair at ``cosine`` shares a cap with a chance of ``RECALL``."""
    rng = np.random.default_rng(99)
    x = rng.standard_normal((_TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((_TRIALS, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    pair = np.stack([x, cosine * x + np.sqrt(max(1 - cosine * cosine, 0.0)) * z])
    turns, left, right = _codebooks(dim, words)
    half, best = dim // 2, np.full(_TRIALS, -np.inf)
    for c in range(CODES):
        y = pair @ turns[c]
        a, b = y[..., :half] @ left[c].T, y[..., half:] @ right[c].T
        if words > _NEAR_WORDS:  # only words near both ends can make the best direction
            a, b = (np.take_along_axis(v, np.argpartition(-v.sum(axis=0), _NEAR_WORDS, axis=1)[None, :, :_NEAR_WORDS], 2) for v in (a, b))
        for i in range(0, _TRIALS, 100):
            both = a[:, i : i + 100, :, None] + b[:, i : i + 100, None, :]
            best[i : i + 100] = np.maximum(best[i : i + 100], both.min(axis=0).reshape(both.shape[1], -1).max(axis=1))
    return float(np.quantile(best, 1 - RECALL))


def decode_filters(x: np.ndarray, words: int, cut: float) -> list[np.ndarray]:
    """Sorted filter numbers of each row of ``x`` (unit vectors)."""
    n, dim = x.shape
    if not words:
        return [np.zeros(1, np.int32)] * n
    turns, left, right = _codebooks(dim, words)
    half, rows, caps = dim // 2, [], []
    top, top_cap = np.full(n, -np.inf), np.zeros(n, np.int64)
    for c in range(CODES):
        y = x @ turns[c]
        a, b = y[:, :half] @ left[c].T, y[:, half:] @ right[c].T
        a_max, b_max = a.max(axis=1), b.max(axis=1)
        better = a_max + b_max > top
        top = np.maximum(top, a_max + b_max)
        top_cap[better] = (c * words * words + a.argmax(axis=1) * words + b.argmax(axis=1))[better]
        # only words that can still reach the cut with the best of the other block
        ia, wa = np.nonzero(a >= cut - b_max[:, None])
        ib, wb = np.nonzero(b >= cut - a_max[:, None])
        many = np.bincount(ib, minlength=n)
        first = np.r_[0, np.cumsum(many)[:-1]]
        each = np.repeat(np.arange(len(ia)), many[ia])
        other = np.arange(len(each)) - np.repeat(np.cumsum(many[ia]) - many[ia], many[ia]) + first[ia[each]]
        over = a[ia[each], wa[each]] + b[ib[other], wb[other]] >= cut
        rows.append(ia[each][over])
        caps.append(c * words * words + wa[each][over] * words + wb[other][over])
    i, f = np.r_[np.concatenate(rows), np.arange(n)], np.r_[np.concatenate(caps), top_cap]
    order = np.lexsort((f, i))
    i, f = i[order], f[order]
    new = np.r_[True, (np.diff(i) != 0) | (np.diff(f) != 0)]
    i, f = i[new], f[new]
    return np.split(f.astype(np.int32), np.cumsum(np.bincount(i, minlength=n))[:-1])


def sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of random projections, as two longs a row."""
    bits = np.packbits((x @ _planes(x.shape[1])) >= 0, axis=1).view(np.int64)
    return np.ascontiguousarray(bits[:, 0]), np.ascontiguousarray(bits[:, 1])


def sketch_slack(cosine: float) -> int:
    """Bits that a pair at ``cosine`` may differ in."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(SKETCH_BITS * p + SKETCH_SIGMAS * np.sqrt(SKETCH_BITS * p * (1 - p))))


def _unit(values: pa.Array, size: int) -> np.ndarray:
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _add_filters(nodes: DataFrame, cuts: dict[tuple[int, int], float]) -> DataFrame:
    """Columns of ``nodes(lab, words, h1, h2, n, least, vec)`` plus ``filters`` and a sketch ``s1, s2``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            sizes, words = np.diff(vec.offsets.to_numpy()), batch.column("words").to_numpy()
            for size, w in sorted(set(zip(sizes.tolist(), words.tolist(), strict=True))):
                at = np.flatnonzero((sizes == size) & (words == w))
                for i in range(0, len(at), 1024):
                    part = batch.take(pa.array(at[i : i + 1024]))
                    x = _unit(part.column("vec").flatten(), size)
                    lists = decode_filters(x, w, cuts.get((size, w), 0.0))
                    offsets = np.r_[0, np.cumsum([len(f) for f in lists])].astype(np.int32)
                    filters = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), pa.int32()))
                    s1, s2 = sketches(x)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, filters, pa.array(s1), pa.array(s2)], names=[*part.schema.names, "filters", "s1", "s2"]
                    )

    kind = nodes.schema["vec"].dataType.simpleString()
    return nodes.mapInArrow(work, f"lab long, words int, h1 long, h2 long, n long, least long, vec {kind}, filters array<int>, s1 long, s2 long")


_KEYS = ("lab", "f", "part")


def _likely(slack: int):
    """Rows that have a partner of a near sketch in their cap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _KEYS):
            s1, s2 = (table.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
            keep = np.zeros(table.num_rows, bool)
            for i, j in group_bounds(table, _KEYS):
                a, b = s1[i:j], s2[i:j]
                for k in range(0, j - i, 512):
                    differ = np.bitwise_count(a[k : k + 512, None] ^ a[None, :]) + np.bitwise_count(b[k : k + 512, None] ^ b[None, :])
                    keep[i + k : min(i + k + 512, j)] = (differ <= slack).sum(axis=1) > 1
            yield from table.filter(pa.array(keep)).drop_columns(["s1", "s2"]).combine_chunks().to_batches()

    return work


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    rest, edges = np.flatnonzero(linked.any(axis=1)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = linked[x, rest]
            edges.extend((int(x), int(y)) for y in rest[near])
            queue.extend(rest[near])
            rest = rest[~near]
    return edges


def _verify(cosine: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _KEYS):
            table = table.combine_chunks()
            v, n, chunk, f = (table.column(c).to_numpy() for c in ("v", "n", "chunk", "f"))
            vec, own = table.column("vec").combine_chunks(), table.column("filters").combine_chunks()
            at, own_at = vec.offsets.to_numpy(), own.offsets.to_numpy()
            values, filters = vec.values, own.values.to_numpy()
            a, b, links = [], [], []
            for i, j in group_bounds(table, _KEYS):
                size = int(at[i + 1] - at[i])
                x = _unit(values.slice(at[i], at[j] - at[i]), size)
                linked = (x @ x.T) >= cosine
                np.fill_diagonal(linked, False)
                if chunk[i:j].min() != chunk[i:j].max():
                    linked &= chunk[i:j, None] != chunk[None, i:j]
                if not linked.any():
                    continue
                # another cap, of a lesser number, that both ends share counts the link
                lists = filters[own_at[i] : own_at[j]]
                rows = np.repeat(np.arange(j - i), np.diff(own_at[i : j + 1]))
                less = lists < f[i]
                number, word = np.unique(lists[less], return_inverse=True)
                if len(number):
                    has = np.zeros((j - i, len(number)), np.float32)
                    has[rows[less], word] = 1
                    linked &= (has @ has.T) == 0
                count = linked @ n[i:j]
                for k in np.flatnonzero(count).tolist():
                    a.append(v[i + k]), b.append(None), links.append(int(count[k]))
                for p, q in _spanning(linked):
                    a.append(v[i + p]), b.append(v[i + q]), links.append(None)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"]
                )

    return work


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93
) -> DataFrame:
    """One row ``(id, n_links, component_id, kept)`` per vector."""
    element = vectors.schema[vec_col].dataType.elementType
    emb = F.col(vec_col).cast("array<float>" if isinstance(element, T.FloatType) else "array<double>")
    finite = F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("vec", lambda e: e != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), emb.alias("vec"))
    rows = rows.withColumn("sound", F.coalesce(finite & F.col("label").isNotNull() & (F.size("vec") > 0), F.lit(False)))
    rows = rows.select(
        "id", "sound", "vec", F.when(F.col("sound"), F.xxhash64("label", F.size("vec"))).alias("lab"),
        F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit(1), "label", "vec").alias("h2"),
    )
    members = materialise(rows.select("id", "sound", "h1", "h2", "lab", F.size("vec").alias("size")), "vectors")
    sizes = members.where("sound").groupBy("lab").agg(F.count("*").alias("_n"), F.first("size").alias("size")).where(F.col("_n") > SMALL)
    sizes = materialise(sizes.select(F.col("lab").alias("_lab"), words_of(F.col("_n")).alias("words"), "size"), "sizes")
    tiers = [(r["size"], r["words"]) for r in sizes.select("size", "words").distinct().collect()]  # one per length and power of two
    cuts = {(size, words): threshold(size, words, cosine) for size, words in tiers}
    if sizes.count() <= BROADCAST_LABELS:
        sizes = F.broadcast(sizes)
    nodes = rows.where("sound").groupBy("lab", "h1", "h2").agg(
        F.count("*").alias("n"), F.min("id").alias("least"), F.first("vec").alias("vec")
    )
    nodes = nodes.join(sizes.select("_lab", "words"), F.col("lab") == F.col("_lab"), "left")
    nodes = nodes.select("lab", F.coalesce("words", F.lit(0)).alias("words"), "h1", "h2", "n", "least", "vec")
    found = materialise(_add_filters(nodes, cuts).drop("words").withColumn("v", F.monotonically_increasing_id()), "filters")

    caps = found.select("v", "lab", "s1", "s2", F.explode("filters").alias("f"))
    in_caps = caps.groupBy("lab", "f").agg(F.count("*").alias("in_cap")).where(F.col("in_cap") > CHUNK)
    large = in_caps.select(F.col("lab").alias("_lab"), F.col("f").alias("_f"), F.ceil(F.col("in_cap") / CHUNK).cast("int").alias("_chunks"))
    large = materialise(large, "caps")
    dealt = caps.join(large, (F.col("lab") == F.col("_lab")) & (F.col("f") == F.col("_f")), "left")
    dealt = dealt.withColumn("chunks", F.coalesce("_chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select("v", "lab", "f", "s1", "s2", "chunk", "chunks", other)
    part = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    dealt = dealt.select("v", "lab", "f", part.alias("part"), "chunk", "s1", "s2")
    likely = (
        dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
        .mapInArrow(_likely(sketch_slack(cosine)), "v long, lab long, f int, part int, chunk int")
    )
    likely = materialise(likely, "likely")
    fetched = likely.join(found.select("v", "n", "vec", "filters"), "v")
    links = (
        fetched.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
        .select("v", "lab", "f", "part", "chunk", "n", "vec", "filters")
        .mapInArrow(_verify(cosine), "a long, b long, links long")
    )
    links = materialise(links, "links")

    roots = connected_components(links.where("b is not null").select("a", "b"))
    counts = links.where("links is not null").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    named = found.select("v", "h1", "h2", "n", "least").join(roots.withColumnRenamed("node", "v"), "v", "left")
    named = named.withColumn("root", F.coalesce("root", "v")).join(counts, "v", "left")
    named = materialise(named, "named")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(groups, "root").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    out = members.select("id", "sound", "h1", "h2").join(named, F.col("sound") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of all embeddings within their labels."""
    return embedding_components(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
