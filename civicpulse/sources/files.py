"""Small files on any file system Spark knows: text written whole, existence, checksums."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUFFER = 1 << 20


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share.")
        base = "file:///tmp/civicpulse-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    files, place = _hadoop(spark, base)
    return f"{files.makeQualified(place).toString().rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: for what is read several times and cheap to keep."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str | Path):
    """File system and path; a ``Path`` is a local one, text without an address is on the default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path.absolute().as_uri() if isinstance(path, Path) else path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str | Path) -> bool:
    files, place = _hadoop(spark, path)
    return files.exists(place)


@contextmanager
def open_text(spark: SparkSession, path: str | Path) -> Iterator:
    """A file-like object to write text to; parents are made, an old file is replaced."""
    files, place = _hadoop(spark, path)
    out, held = files.create(place, True), []

    class Writer:
        size = 0

        def write(self, text: str) -> None:
            held.append(text)
            self.size += len(text)
            if self.size >= _BUFFER:
                self.flush()

        def flush(self) -> None:
            out.write(bytearray("".join(held), "utf-8"))
            held.clear()
            self.size = 0

    writer = Writer()
    try:
        yield writer
        writer.flush()
    finally:
        out.close()


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    with open_text(spark, path) as f:
        f.write(text)


def read_text(spark: SparkSession, path: str | Path) -> str:
    return spark.read.text(str(path), wholetext=True).first()[0]


def folder_sha256(spark: SparkSession, path: str | Path) -> str:
    """SHA-256 over the sorted SHA-256 sums of a folder's data files, each summed where it lies."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(path)).select(F.sha2("content", 256).alias("h"))
    return hashlib.sha256("".join(sorted(r["h"] for r in parts.collect())).encode()).hexdigest()
