"""Token counts by separator scan over flat, unindexed token files.

A token file is a bare array of little-endian ids in which each document ends
with one end id.  Files are read in blocks by as many tasks as there are blocks;
in each block one vectorised comparison finds the end ids and gives the lengths
between them, the tokens before the first and those after the last.  A prefix
scan over the block summaries of a file carries what is open at the end of a
block into the next ones and numbers the documents.

Defined cases: an empty file has no documents; consecutive end ids are documents
of one token; tokens after the last end id of a file are an open document,
reported with ``complete`` false; a null or empty text is written as the end id
alone; very long texts are encoded whole and may reach over many blocks; repeated
rows are counted each; an empty table writes and gives nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, read_table, text_or_empty

BLOCK = 1 << 20  # tokens


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Byte-level BPE from a rank file; every text is ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, dtype: str = "<u2",
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat file per partition; rows ``(path, ordinal, id)`` say what was written.

    A task names its file at random: what a lost or repeated attempt leaves is
    named by no row and so never read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        path, out, ordinal = f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system, place = _filesystem(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
            for text in batch.column(1):
                out.write(np.array([*encode(text.as_py()), end_id], dtype).tobytes())
            n = batch.num_rows
            ordinals = pa.array(np.arange(ordinal, ordinal + n))
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), ordinals, batch.column(0)], names=["path", "ordinal", "id"])
            ordinal += n
        if out is not None:
            out.close()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return materialise(slim.mapInArrow(work, "path string, ordinal long, id long"), "manifest")


def _sizes(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            sizes = []
            for p in paths:
                system, place = _filesystem(p)
                sizes.append(system.get_file_info(place).size // width)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "tokens"])

    return work


def _scan(end_id: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, begin, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = _filesystem(path)
                with system.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(size * width, begin * width), dtype)
                ends = np.flatnonzero(ids == end_id)
                head = int(ends[0]) + 1 if len(ends) else 0
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block]), pa.array([begin]), pa.array([len(ends)]), pa.array([head]), pa.array([tail]),
                     pa.array([np.diff(ends)], pa.list_(pa.int64()))],
                    names=["path", "block", "begin", "n_ends", "head", "tail", "inner"],
                )

    return work


def scan_token_files(files: DataFrame, end_id: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Documents of the flat files in ``files(path)``: ``(path, ordinal, n_tokens, complete)``."""
    width = np.dtype(dtype).itemsize
    sized = files.select("path").mapInArrow(_sizes(width), "path string, tokens long").where("tokens > 0")
    blocks = sized.select("path", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block))).alias("block"))
    begin = F.col("block") * block
    blocks = blocks.select("path", "block", begin.alias("begin"), F.least(F.lit(block), F.col("tokens") - begin).alias("size"))
    blocks = blocks.repartition("path", "block")
    found = blocks.mapInArrow(
        _scan(end_id, dtype), "path string, block long, begin long, n_ends long, head long, tail long, inner array<bigint>"
    )
    found = materialise(found, "blocks")

    # prefix scan: documents before a block, and tokens open at its begin
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("path", "block", "n_ends", "head", "tail")
    scan = scan.withColumn("open_sum", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    at_last_end = F.last(F.when(F.col("n_ends") > 0, F.col("open_sum")), ignorenulls=True).over(before)
    scan = scan.withColumn("carried", F.col("open_sum") - F.coalesce(at_last_end, F.lit(0)))
    scan = scan.withColumn("ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    last = Window.partitionBy("path").orderBy(F.desc("block"))
    scan = scan.withColumn("is_last", F.row_number().over(last) == 1)

    stitched = found.select("path", "block", "inner").join(scan, ["path", "block"])
    closed = F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(
        F.array().cast("array<bigint>")
    )
    left = F.col("tail") + F.when(F.col("n_ends") > 0, F.lit(0)).otherwise(F.col("carried"))
    rows = F.transform(closed, lambda n, k: F.struct((F.col("ordinal") + k).alias("ordinal"), n.alias("n_tokens"), F.lit(True).alias("complete")))
    rest = F.array(F.struct((F.col("ordinal") + F.col("n_ends")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("complete")))
    rows = F.when(F.col("is_last") & (left > 0), F.concat(rows, rest)).otherwise(rows)
    return stitched.select("path", F.inline(rows))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, counted in flat files of byte-level BPE ids."""
    import public_tokenizers

    end_id = 50256
    folder = new_path(spark, "tokens")
    written = write_token_files(
        read_table(spark, sf_dir, "documents"), folder, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), end_id
    )
    found = scan_token_files(written.select("path").distinct(), end_id)
    out = written.join(found, ["path", "ordinal"])
    return out.select(F.col("id").alias("doc_id"), "n_tokens", (F.col("n_tokens") - 1).alias("n_text_tokens"))
