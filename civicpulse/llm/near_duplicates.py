"""SimHash near-dedup for documents at a Jaccard similarity of 0.8 on five-word shingles.

A pair at 0.8 differs in about 10 of 64 SimHash bits, and a covering family that
guarantees such a radius has more tables than a document has words.  So the covering
search of :mod:`simhash` finds the links within its radius first, and what may be left
is found by banded MinHash values: 25 bands of 5 rows miss a pair at 0.8 with a chance
of 5e-5, more similar ones less often.  Every link, by whichever way it was found, is
checked on the whole sets of shingles (64-bit hashes) before it counts.

Equal sets are one node, so copies are never expanded into pairs.  In the buckets of
the bands only nodes of different components meet.  A bucket first gives a spanning
forest of the pairs whose MinHash values agree like those of near-duplicates; these are
checked and merged.  Of what is left the nodes with a partner of another component whose
values agree in at least ``AGREE`` of the rows (0.8 less 3.3 standard deviations) fetch
their sets into the bucket and are checked there, pair by pair, each pair in the first
band it shares and only while the bucket does not know the two as one; links leave a
bucket as a forest, pairs never do.  Values are compared in blocks; a bucket of more than
``CHUNK`` nodes is dealt as pairs of chunks to as many tasks.

Defined cases: A-Z are lower-cased; with fewer words than a shingle the whole word
sequence is the only shingle; texts without words (or null) are copies of each
other; very long texts are hashed whole, a block of shingles at a time; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_scratch, give_back, group_bounds, materialise, put_back, text_or_empty, whole_groups
from .simhash import link_edges, majority_bits, numbered, one_row_of_each

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 4  # of the covering search
BANDS, BAND_ROWS = 25, 5
AGREE = 0.68
SURE = 0.78  # agreement of the pairs that are tried first
CHUNK = 4096
_CHUNK = 1 << 13  # shingles mixed at a time
_MASKS, _FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), np.uint64)
_FACTORS = _FACTORS << np.uint64(1) | np.uint64(1)


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of one text given as UTF-8, repeats included."""
    import xxhash

    words = data.lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts))


def shingle_set(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text given as UTF-8."""
    return np.unique(shingle_hashes(data, shingle))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        mixed = (hashes[at : at + _CHUNK] ^ _MASKS) * _FACTORS
        least = np.minimum(least, mixed.min(axis=1))
    return least


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band of the MinHash values of a set, as signed longs; none for an empty set."""
    return _keys_of(min_hashes(hashes)) if len(hashes) else []


def _keys_of(least: np.ndarray) -> list[int]:
    import xxhash

    keys = np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)
    return keys.view(np.int64).tolist()


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """``(_row, h1, h2, n, fp, bands, sig)`` of ``rows(_row, text)``: two hashes of the set, its size,
    its SimHash, its band keys and a byte of each MinHash value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            h1, h2, n, fps, bands, sigs = [], [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                every = shingle_hashes(text.as_py(), shingle)
                own = np.unique(every)
                a, b = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
                least = min_hashes(own)
                h1.append(a), h2.append(b), n.append(len(own)), fps.append(majority_bits(every))
                bands.append(_keys_of(least) if len(own) else [])
                sigs.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
            columns = [pa.array(x, pa.int64()) for x in (h1, h2, n)]
            columns += [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_row", "h1", "h2", "n", "fp", "bands", "sig"])
            del columns, bands, sigs
            give_back()

    return rows.select("_row", text_or_empty().alias("text")).mapInArrow(
        work, "_row long, h1 long, h2 long, n long, fp long, bands array<long>, sig binary"
    )


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)`` of ``rows(_row, text)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "shingles"])
            del own
            give_back()

    return rows.select("_row", text_or_empty().alias("text")).mapInArrow(work, "node long, shingles array<long>")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows(key, ...)`` with ``part`` and ``chunk``: buckets of more than ``CHUNK`` nodes as pairs of chunks."""
    large = rows.groupBy("key").agg(F.count("*").alias("_k")).where(F.col("_k") > CHUNK)
    large = materialise(large.select(F.col("key").alias("_key"), F.ceil(F.col("_k") / CHUNK).cast("int").alias("_chunks")), "large")
    dealt = rows.join(large, F.col("key") == F.col("_key"), "left").withColumn("chunks", F.coalesce("_chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select(*rows.columns, "chunk", "chunks", other)
    part = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    return dealt.select(*rows.columns, part.alias("part"))


def _near(i: np.ndarray, j: np.ndarray, sig: np.ndarray, n: np.ndarray, root: np.ndarray, similarity: float, agree: float) -> np.ndarray:
    """Matrix of the pairs of rows ``i`` and ``j`` of different components whose MinHash values agree."""
    ok = root[i][:, None] != root[j][None, :]
    small, big = np.minimum(n[i][:, None], n[j][None, :]), np.maximum(n[i][:, None], n[j][None, :])
    ok &= small >= similarity * big - 1e-9
    p, q = np.nonzero(ok)
    for at in range(0, len(p), 1 << 17):
        s = slice(at, at + (1 << 17))
        ok[p[s], q[s]] = (sig[i[p[s]]] == sig[j[q[s]]]).mean(axis=1) >= agree
    return ok


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
    return node, root, n, np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def bucket_forest(rows: DataFrame, similarity: float, agree: float) -> DataFrame:
    """Distinct pairs ``(a, b)`` that span, in each bucket of ``rows(key, node, root, n, sig)``, the nodes of
    different components that agree in the share ``agree`` of their MinHash values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "part")):
            node, root, n, sig = _columns(table)
            a, b = [], []
            for start, stop in group_bounds(table, ("key", "part")):
                if root[start:stop].min() == root[start:stop].max():
                    continue
                rest = np.arange(start, stop)
                while len(rest) > 1:
                    queue, rest = [rest[0]], rest[1:]
                    while queue and len(rest):
                        x = queue.pop()
                        reached = _near(np.array([x]), rest, sig, n, root, similarity, agree)[0]
                        a += [int(node[x])] * int(reached.sum())
                        b += node[rest[reached]].tolist()
                        queue.extend(rest[reached].tolist())
                        rest = rest[~reached]
            if a:
                x, y = np.array(a), np.array(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    dealt = _dealt(rows).select("key", "part", "node", "root", "n", "sig")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(work, "a long, b long").distinct()


def bucket_links(rows: DataFrame, sets: DataFrame, similarity: float, agree: float) -> DataFrame:
    """Links ``(a, b)`` between different components of ``rows(key, node, root, n, sig, bands)``, checked in the buckets.

    ``sets(node, shingles)`` are fetched by the nodes that have a likely partner only.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "part")):
            node, root, n, sig = _columns(table)
            keep = np.zeros(table.num_rows, bool)
            for start, stop in group_bounds(table, ("key", "part")):
                if root[start:stop].min() == root[start:stop].max():
                    continue
                every = np.arange(start, stop)
                for at in range(0, len(every), 512):
                    keep[every[at : at + 512]] = _near(every[at : at + 512], every, sig, n, root, similarity, agree).any(axis=1)
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "part")):
            table = table.combine_chunks()
            node, root, n, sig = _columns(table)
            key = table.column("key").to_numpy()
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, BANDS)
            shingles = table.column("shingles").combine_chunks()
            ends, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            a, b = [], []
            for start, stop in group_bounds(table, ("key", "part")):
                every = np.arange(start, stop)
                own = dict(enumerate(root[start:stop].tolist()))
                parent = {r: r for r in own.values()}

                def find(r: int, parent: dict[int, int] = parent) -> int:
                    while parent[r] != r:
                        parent[r] = parent[parent[r]]
                        r = parent[r]
                    return r

                band = int(np.flatnonzero(bands[start] == key[start])[0])
                for at in range(0, len(every), 512):
                    p, q = np.nonzero(_near(every[at : at + 512], every, sig, n, root, similarity, agree))
                    p = p + at
                    up = p < q
                    p, q = p[up], q[up]
                    first = (bands[every[p]][:, :band] == bands[every[q]][:, :band]).any(axis=1)
                    for i, j in zip(p[~first].tolist(), q[~first].tolist(), strict=True):
                        x, y = find(own[i]), find(own[j])
                        if x == y:
                            continue
                        one, two = (values[ends[start + k] : ends[start + k + 1]] for k in (i, j))
                        common = len(np.intersect1d(one, two, assume_unique=True))
                        if common >= similarity * (len(one) + len(two) - common) - 1e-9:
                            parent[x] = y
                            a.append(int(node[start + i]))
                            b.append(int(node[start + j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            give_back()

    kept = "key long, part int, node long, root long, n long, sig binary, bands array<long>"
    dealt = _dealt(rows).select("key", "part", "node", "root", "n", "sig", "bands")
    found = dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(likely, kept)
    found = materialise(found, "likely").join(sets, "node").select("key", "part", "node", "root", "n", "sig", "bands", "shingles")
    return found.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(check, "a long, b long")


def near_components(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(_row, component_id)`` of ``rows(_row, text)``; ``_row`` is unique and ``rows`` a stored table."""
    known = materialise(sketches(rows, shingle), "sketches")
    nodes = known.groupBy("h1", "h2").agg(
        F.min("_row").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    nodes = materialise(nodes, "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("_k")).where("_k > 1").drop("_k")
    keyed = materialise(keyed.join(shared, "key"), "bands")
    # nodes of one fingerprint, and fingerprints within the radius by their least nodes
    prints = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    prints = materialise(prints, "prints")
    same = nodes.select("fp", F.col("node").alias("b")).join(prints, "fp").where("least != b").select(F.col("least").alias("a"), "b")
    links = link_edges(prints.select("fp"), RADIUS)
    ends = prints.select(F.col("fp").alias("a"), F.col("least").alias("na")), prints.select(F.col("fp").alias("b"), F.col("least").alias("nb"))
    links = links.join(ends[0], "a").join(ends[1], "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    covered = materialise(same.unionByName(links).distinct(), "pairs")

    at_hand = keyed.select(F.col("node").alias("_row")).unionByName(covered.select(F.col("a").alias("_row")))
    at_hand = at_hand.unionByName(covered.select(F.col("b").alias("_row"))).distinct()
    sets = materialise(shingle_sets(rows.join(at_hand, "_row", "left_semi"), shingle), "shingles")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("_sa", "_sb"))
        alike = common >= similarity * (F.size("_sa") + F.size("_sb") - common) - 1e-9
        return materialise(both.select("a", "b", alike.alias("linked")), "edges")

    edges = linked(covered).where("linked").select("a", "b")
    roots = connected_components(edges)
    values = nodes.select("node", "n", "sig", "bands")

    def unmerged() -> DataFrame:
        placed = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low != _high").select("key")
        return materialise(placed.join(mixed, "key").join(values, "node"), "placed")

    forest = bucket_forest(unmerged().select("key", "node", "root", "n", "sig"), similarity, SURE)
    more = linked(forest.join(covered, ["a", "b"], "left_anti")).where("linked").select("a", "b")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        roots = connected_components(edges)
    more = materialise(bucket_links(unmerged(), sets, similarity, AGREE), "edges")
    if not more.isEmpty():
        roots = connected_components(edges.unionByName(more))
    named = nodes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("component_id"))
    named = materialise(known.select("_row", "h1", "h2").join(named, ["h1", "h2"]).select("_row", "component_id"), "near")
    for table in (known, nodes, keyed, prints, covered, sets):
        drop_scratch(table)
    return named


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates; columns unchanged."""
    rows, names = numbered(docs)
    groups = near_components(rows.select(F.col("row").alias("_row"), F.col(names["text"]).alias("text")), shingle, similarity)
    return put_back(one_row_of_each(rows, groups.withColumnRenamed("_row", "row"), names), names)
