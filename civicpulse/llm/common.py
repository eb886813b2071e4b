"""Shared plumbing: shared-folder tables that cut lineage, readers, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one of the parquet tables below ``sf_dir`` (file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where a session on one machine (tests) has none a local one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share.")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "civicpulse-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: tables of this process that are still there
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Tables written inside pass ``rows`` rows at a time from reader to worker, if the session has no smaller batches.

    Readers, Arrow's buffers and workers each hold a whole batch: with the usual 10000
    rows of long texts that is a good part of an executor's memory.
    """
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in before.items():
            if not 0 < int(value) <= rows:
                spark.conf.set(name, rows)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and (unlike a checkpointed RDD)
    keeps column pruning for the readers that follow.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def clear_scratch(spark: SparkSession) -> int:
    """Delete every table this process wrote to the shared folder; results must be stored before."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def drop_scratch(df: DataFrame | None) -> None:
    """Delete the files behind a table of :func:`materialise` that is not read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def set_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed so that no working column can clash, and the new names by old."""
    names = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def put_back(rows: DataFrame, names: dict[str, str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns that :func:`set_apart` renamed, under their old names; ``changed`` replaces some."""
    changed = changed or {}
    return rows.select(*[changed.get(c, F.col(inner)).alias(c) for c, inner in names.items()])


def _holds(kind: T.DataType, *sorts: type) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, *sorts) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, *sorts)
    return isinstance(kind, sorts)


def row_hashes(rows: DataFrame) -> tuple[Column, Column]:
    """Two hashes over all columns; maps and variants, which cannot be hashed, by their JSON."""
    columns = [F.to_json(F.struct(f.name)) if _holds(f.dataType, T.MapType, T.VariantType) else F.col(f.name) for f in rows.schema]
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def prefix_sums(df: DataFrame, keys: list[str], weight: str, out: str, merge: bool = False) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one in key order.

    Rows are dealt by range of their keys and summed within a range; only one sum
    per range reaches the driver, so no task and no driver holds the whole order.
    Rows of equal keys are ordered arbitrarily; make the keys unique.  With ``merge``
    Spark may merge small neighbouring ranges, which writes fewer files.
    """
    parts = [] if merge else [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))]
    dealt = df.repartitionByRange(*parts, *keys).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    total, pairs = 0, []
    for row in dealt.groupBy("_range").agg(F.sum(weight).alias("n")).orderBy("_range").collect():
        pairs += [F.lit(row["_range"]), F.lit(total)]
        total += row["n"]
    base = F.element_at(F.create_map(*pairs), F.col("_range")) if pairs else F.lit(0)
    running = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = base + F.coalesce(F.sum(weight).over(running), F.lit(0))
    return dealt.withColumn(out, before.cast("long")).drop("_range")


def give_back() -> None:
    """Return memory that a worker has freed to the machine: Arrow and the C library keep it otherwise.

    Workers live as long as their executor, and what they keep adds to its limit.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of whole groups from a stream that is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = table.num_rows - int(last.sum())
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: tuple[str, ...]) -> list[tuple[int, int]]:
    """Starts and ends of the groups of two rows or more."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        new[1:] |= np.diff(table.column(k).to_numpy()) != 0
    starts = np.flatnonzero(new)
    stops = np.r_[starts[1:], len(new)]
    several = stops - starts > 1
    return list(zip(starts[several].tolist(), stops[several].tolist(), strict=True))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: rows ``(node, root)``, root the least node.

    Alternating large-star / small-star rounds.  Every step is a grouped minimum
    (combined map-side) and an equi-join that AQE can split, so a hub that links
    a third of all nodes does not land in one task.  Nodes without an edge to
    another node are absent; no edges give no rows.  Null ends are ignored.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct()
    )
    e = materialise(e, "cc")
    e = _stars(e)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return materialise(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")


def _stars(e: DataFrame) -> DataFrame:
    """Every node ``u`` with the least node ``v`` of its component, of stored edges ``u > v``."""
    before = None
    while True:
        # large star: every neighbour above u is hung below the least neighbour of u
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: u and its smaller neighbours are hung below the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = (
            moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = materialise(small, "cc")
        state = small.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        drop_scratch(e)
        e = small
        if before == tuple(state):
            return e
        before = tuple(state)
