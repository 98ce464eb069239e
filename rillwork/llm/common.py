"""What the training-data operators share: tables, words, stored steps, links to groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.session import checkpointed

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Orders rows without an id after all others.
LAST_ID = (1 << 63) - 1

#: Rows of whole texts that a Python worker is handed at once where ``small_batches`` holds.
BATCH = 1024

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``checkpointed``, letting go of the shuffle files once the table is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        return checkpointed(df)
    finally:
        spark.conf.set(_CLEAN, before)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand ``BATCH`` rows at most to Python at once; a smaller number chosen by the caller stays."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(_BATCH, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_kept: dict = {}


def kept(kind: Hashable, make: Callable):
    """What a Python worker remembers from task to task, of one kind at a time.

    Workers outlive the stages they serve, so what several operators remember would add up.
    """
    if kind not in _kept:
        _kept.clear()
        give_back()
        _kept[kind] = make()
    return _kept[kind]


def give_back() -> None:
    """Hand memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def partitions_for(rows: int, each: int) -> int:
    return max(1, -(-int(rows) // each))


def id_or_last(col: Column | str) -> Column:
    return F.coalesce(F.col(col).cast("long") if isinstance(col, str) else col, F.lit(LAST_ID))


def smallest_reachable(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node reaches over undirected links.

    ``nodes`` has ``node``; ``links`` has ``a, b``. Only nodes with a link take part in
    the rounds; the others are their own root. Each round hooks every node's root to the
    smallest root beside it and then halves the paths to the roots, so the rounds grow
    with the logarithm of a group's width. Hot roots are combined before they are shuffled.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    linked = both.groupBy("a").agg(F.min("b").alias("b"))
    parent = stored(linked.select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        seen = (both.join(parent.select(F.col("node").alias("b"), "root"), "b")
                .groupBy("a").agg(F.min("root").alias("near")))
        offered = parent.join(seen, parent["node"] == seen["a"]).select(
            "node", "root", F.least("root", "near").alias("near"))
        # a node passes the better root on to its old root, then takes its root's root
        hooked = offered.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        joined = (offered.join(hooked, "node", "left")
                  .select("node", F.col("root").alias("old"), F.least("near", F.coalesce("hook", "near")).alias("root")))
        up = joined.select(F.col("node").alias("root"), F.col("root").alias("up"))
        following = stored(joined.join(up, "root", "left").select(
            "node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        drop_stored(parent)
        parent = following
        if parent.where("old <> root").isEmpty():
            break
        parent = parent.select("node", "root")
    drop_stored(both)
    return nodes.join(parent.select("node", "root"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
