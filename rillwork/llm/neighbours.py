"""Nearest neighbours by cosine: a forest of random-projection trees and exact reranking.

Trees are fitted on a bounded sample and every vector is put into one leaf per tree. A
query walks all trees through one priority queue, always opening the leaf with the least
projected distance to the borders crossed, until its visited leaves make up the stated
share of the forest. The candidates of each leaf are then scored exactly, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import drop_stored, stored

#: Trees; share of all leaves that a query opens; vectors the trees are fitted on (at most);
#: vectors a leaf aims at; levels at most; rows of a block of candidates or queries.
TREES, SHARE, SAMPLE, LEAF, DEPTH, BLOCK = 4, 0.3, 16_384, 1024, 10, 8192


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Per tree a direction for each level and the medians that split each node of it."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        ways = _unit(rng.normal(size=(max(depth, 1), sample.shape[1])))[:depth]
        at, cuts = np.zeros(len(sample), dtype=np.int64), []
        for level, way in enumerate(ways):
            along = sample @ way
            own = pd.Series(along).groupby(at).median()
            cut = np.zeros(1 << level)
            cut[own.index.to_numpy()] = own.to_numpy()
            cuts.append(cut)
            at = 2 * at + (along > cut[at])
        forest.append((ways, cuts))
    return forest


def leaves_of(units: np.ndarray, tree: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
    at = np.zeros(len(units), dtype=np.int64)
    for way, cut in zip(*tree):
        at = 2 * at + (units @ way > cut[at])
    return at


def search_order(unit: np.ndarray, forest: list, share: float) -> list[tuple[int, int]]:
    """The ``(tree, leaf)`` that one query opens, nearest first, over all trees at once."""
    depth = len(forest[0][1])
    along = [(ways @ unit).tolist() if depth else [] for ways, _ in forest]
    queue = [(0.0, t, 0, 0) for t in range(len(forest))]
    wanted, opened = max(len(forest), int(np.ceil(share * len(forest) * (1 << depth)))), []
    while queue and len(opened) < wanted:
        cost, tree, level, node = heapq.heappop(queue)
        if level == depth:
            opened.append((tree, node))
            continue
        margin = along[tree][level] - float(forest[tree][1][level][node])
        side = 2 * node + (margin > 0)
        heapq.heappush(queue, (cost, tree, level + 1, side))
        heapq.heappush(queue, (cost + margin * margin, tree, level + 1, side ^ 1))
    return opened


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            trees: int = TREES, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row.

    ``queries`` marks the query rows; candidates are all rows with another id. Scores are
    cosines in double precision of the original vectors; ties go to the smaller id, and
    repeated rows of one id count once. Vectors that are null, zero, hold null or
    non-finite components, have no id, or have another length than the commonest take no
    part; fewer than ``k`` candidates give fewer rows. Leaves with many rows and queries
    are cut into blocks, each of which returns its best ``k``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("q")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return empty
    width, total = common["n"], common["count"]
    rows = rows.where(F.size("v") == width)
    picked = rows.select("v").orderBy(F.xxhash64("vec_id", F.lit(3))).limit(sample).toPandas()
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, total / LEAF))))))
    forest = spark.sparkContext.broadcast(fit_forest(_unit(np.stack(picked["v"].to_numpy())), depth, trees))
    blocks = max(1, -(-total // (BLOCK << depth)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                units = _unit(np.stack(df["v"].to_numpy()))
                for t, tree in enumerate(forest.value):
                    yield pd.DataFrame({"tree": t, "leaf": leaves_of(units, tree), "vec_id": df["vec_id"].to_numpy(), "v": df["v"].to_numpy()})

    def open_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                units = _unit(np.stack(df["v"].to_numpy()))
                for i in range(len(df)):
                    own = search_order(units[i], forest.value, share)
                    yield pd.DataFrame({"tree": [t for t, _ in own], "leaf": [n for _, n in own],
                                        "vec_id": df["vec_id"].iat[i], "v": [df["v"].iat[i]] * len(own)})

    schema = "tree int, leaf long, vec_id long, v array<double>"
    placed = stored(rows.select("vec_id", "v").mapInPandas(place, schema))
    asked = stored(rows.where("q").select("vec_id", "v").mapInPandas(open_leaves, schema))
    # at most trees * 2 ** DEPTH rows each
    sizes = placed.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    loads = asked.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("loads"))
    cells = F.broadcast(sizes.join(loads, ["tree", "leaf"]))
    some = lambda n, own: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(own)
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    left = placed.join(cells, ["tree", "leaf"]).select("tree", "leaf", deal("parts", 1).alias("part"), some("loads", "load"), "vec_id", "v")
    right = asked.join(cells, ["tree", "leaf"]).select("tree", "leaf", some("parts", "part"), deal("loads", 2).alias("load"), "vec_id", "v")

    def rerank(found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asking):
            ids, own = np.unique(found["vec_id"].to_numpy(), return_index=True)
            units = _unit(np.stack(found["v"].to_numpy()[own]))
            who, own = np.unique(asking["vec_id"].to_numpy(), return_index=True)
            wanted = _unit(np.stack(asking["v"].to_numpy()[own]))
            for i in range(0, len(who), 256):
                scores = wanted[i:i + 256] @ units.T
                scores[who[i:i + 256, None] == ids] = -np.inf
                # ids ascend, so a stable sort leaves ties in order of id
                keep = min(k, len(ids))
                edge = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
                for q, row, low in zip(who[i:i + 256], scores, edge):
                    top = np.flatnonzero((row >= low) & (row > -np.inf))
                    top = top[np.argsort(-row[top], kind="stable")][:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": row[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    by = ["tree", "leaf", "part", "load"]
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # each query has at most k rows from every leaf it opened, whatever the number of vectors
    best = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("top"))
    ranked = best.select("query_id", F.posexplode("top").alias("i", "t"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.minus")).alias("score"))
