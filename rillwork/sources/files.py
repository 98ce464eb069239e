"""File listings with checksums, hashed where the files lie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 8 * 1024 * 1024


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, relative_path, size)`` of every file below a folder, content not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(path))
    root = path.rstrip("/") + "/"
    return files.select("path", F.element_at(F.split("path", root.split("://")[-1], 2), -1).alias("relative_path"),
                        F.col("length").alias("size"))


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Listing plus SHA-256, each file streamed in chunks through the file system of its path."""
    files = listing(spark, path, pattern)
    return files.repartition("path").mapInPandas(
        _hash_paths, "path string, relative_path string, size bigint, checksum string")


def _uri(path: str) -> str:
    """Path as its file system's own scheme: ``file:/x`` is ``file:///x``, ``s3a`` is ``s3``."""
    scheme, sep, rest = path.partition(":")
    if sep and not rest.startswith("//"):
        rest = "//" + rest
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}{sep}{quote(rest, safe='/:@')}"


def _hash_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        sums = []
        for path in batch["path"]:
            system, name = fs.FileSystem.from_uri(_uri(path))
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
            sums.append(digest.hexdigest())
        yield batch.assign(checksum=sums)
