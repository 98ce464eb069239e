"""Near-duplicates by SimHash, linked through the code words of a covering code.

The anchors are pairs of words of the perfect binary Golay code over two runs of 23
fingerprint bits: every 23-bit value lies within 3 bits of exactly one word. A fingerprint
has one home anchor; it is also replicated to every anchor within the covering radius plus
the threshold, counted per run so that both runs together exceed the radius by at most the
threshold. Two fingerprints within the threshold therefore always meet at the home of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import LAST_ID, id_or_last, smallest_reachable, stored
from rillwork.operators.scale import lookup_join

#: Bits of a code word, its check bits, the covering radius, and the code's generator
#: polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b101011100011

SEED, SHINGLE = 42, 3


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of lower-cased words' shingles; a bit is set if over half have it."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, only the six ASCII blanks part
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    k = min(shingle, len(words))
    digest, stops = xxhash.xxh64_intdigest, (ends[k - 1:] - 1).tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Each text's fingerprint as a signed 64-bit number; null or blank texts give 0."""
    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        found = [simhash((t or "").encode("utf-8", "surrogatepass"), shingle) for t in texts]
        return pd.Series(np.array(found, dtype="<u8").view("<i8"))

    return digest(text.cast("string"))


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainder of each value by the generator polynomial."""
    rest = values.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return rest


def error_patterns(threshold: int) -> list[list[tuple[int, int]]]:
    """For each remainder the patterns that lead to a code word, as (pattern, bits beyond the radius)."""
    table: list[list[tuple[int, int]]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(RADIUS + threshold + 1):
        own = np.array([sum(1 << i for i in c) for c in combinations(range(LENGTH), weight)], dtype=np.int64)
        for pattern, rest in zip(own.tolist(), _syndromes(own).tolist()):
            table[rest].append((pattern, max(0, weight - RADIUS)))
    return table


def _anchored(fps: DataFrame, threshold: int, home: bool) -> DataFrame:
    """``anchor, fp``: the home anchor, or every anchor within radius plus threshold."""
    low = (1 << LENGTH) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = error_patterns(0 if home else threshold)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(i, 2000).to_numpy(zero_copy_only=False)
                runs = [fp & low, fp >> LENGTH & low]
                rests = [_syndromes(r).tolist() for r in runs]
                anchors, owner = [], []
                for k, (a, b, x, y) in enumerate(zip(rests[0], rests[1], runs[0].tolist(), runs[1].tolist())):
                    own = [(x ^ p) | (y ^ q) << LENGTH for p, m in table[a] for q, n in table[b] if m + n <= threshold]
                    anchors += own
                    owner += [k] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors, pa.int64()), pa.array(fp[np.array(owner, dtype=np.int64)], pa.int64())], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(place, "anchor long, fp long")


def linked_fingerprints(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints ``a < b`` that differ in at most ``threshold`` bits."""
    home = _anchored(fps, threshold, True).withColumnRenamed("fp", "a")
    near = _anchored(fps, threshold, False).withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Spark sizes the replicas as one for each fingerprint, where there are 61, so unhinted it broadcasts them
    met = home.alias("h").join(near.alias("n").hint("merge"), (F.col("h.anchor") == F.col("n.anchor")) & close)
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2,
                    shingle: int = SHINGLE, with_rows: bool = False, with_root: bool = False) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id reachable over links, itself included.

    Equal fingerprints are one node, so copies are never paired. All null and blank texts
    share fingerprint 0 and are linked like any other. A null id keeps a null id and counts
    as the largest; a group of such rows only has a null component. Repeated rows repeat.
    ``with_rows`` adds the input row as struct ``row``, so extra columns are safe, and
    ``with_root`` the smallest fingerprint of the group as ``root``.
    """
    own = [F.struct("*").alias("row")] if with_rows else []
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp"), *own))
    nodes = stored(rows.groupBy("fp").agg(F.min(id_or_last("doc_id")).alias("first")))
    links = linked_fingerprints(nodes, threshold)
    roots = smallest_reachable(nodes.select(F.col("fp").alias("node")), links)
    grouped = stored(roots.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "first"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    extra = (["row"] if with_rows else []) + (["root"] if with_root else [])
    named = stored(grouped.join(least, "root").select("fp", "component_id", *(["root"] if with_root else [])))
    return lookup_join(rows, named, "fp").select(
        "doc_id", "fp", F.when(F.col("component_id") < LAST_ID, F.col("component_id")).alias("component_id"), *extra)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the row with the smallest id, null last.

    Rows that repeat the staying id are dropped as well, so exactly one row of a group stays:
    the one whose text has the smallest hash. Groups are told apart by their root, not by
    an id, since ids may be null or repeat.
    """
    marked = near_duplicates(docs, id_col, text_col, threshold, with_rows=True, with_root=True)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = stored(marked.where(first).select("root", F.sha2(F.col("row")[text_col].cast("binary"), 256).alias("hash"), "row"))
    repeats = kept.groupBy("root").count().where("count > 1").select("root")
    if repeats.isEmpty():
        return kept.select("row.*")
    several = kept.join(repeats, "root", "left_semi")
    # rows alike in id and text are settled by a number of their own
    numbered = stored(several.withColumn("n", F.monotonically_increasing_id()))
    chosen = numbered.groupBy("root").agg(F.min(F.struct("hash", "n"))["n"].alias("n"))
    one = numbered.join(chosen, ["root", "n"], "left_semi")
    return kept.join(repeats, "root", "left_anti").select("row.*").unionByName(one.select("row.*"))


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
