"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import WORD, drop_stored, stored
from rillwork.operators.scale import row_numbers
from rillwork.session import broadcast_if_small

#: Bits of the row hash, and bits that one histogram settles.
BITS, STEP = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size`` to ``target`` by water filling.

    Sources by code point, null last, take the weights in turn and divide ``share`` times
    all sizes; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight, until none is above.
    """
    ranked = row_numbers(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    turn = (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    ranked = stored(ranked.select("source", "source_size", weight.alias("_w")))
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:  # the level only rises, and each rise fills at least one more source
        full = F.col("_w") * F.lit(level) >= cap
        got = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("kept"),
                         F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        if not got["all"] or not got["w"]:
            break
        following = (share * got["all"] - (got["kept"] or 0.0)) / got["w"]
        if following <= level:
            break
        level = following
    return ranked.select("source", "source_size", F.least(F.col("_w") * F.lit(level), cap).alias("target"))


def hash_thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target, source_size, repeats, at, left``: all rows are taken ``repeats`` times,
    those with a hash below ``at`` once more, and ``left`` words are due from those at ``at``.

    A histogram over the top hash bits finds the bucket in which a source's budget runs
    out; only the rows of that bucket go to the next histogram, which settles the next
    bits. It ends with a single hash.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = targets.select("source", "target", "source_size", base.alias("repeats"),
                           (F.col("target") - base * F.col("source_size")).alias("left"),
                           F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("at_size"))
    state, live = stored(state), rows.where("size > 0").select("source", "hash", "size")
    for shift in range(BITS - STEP, -1, -STEP):
        sums = live.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        upto = sums.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "_s")
        over = F.col("upto") > F.col("left")
        edge = state.join(upto, F.col("source").eqNullSafe(F.col("_s"))).groupBy("source").agg(
            F.min(F.when(over, F.col("bucket"))).alias("bucket"),
            F.min_by("n", F.when(over, F.col("bucket"))).alias("n"),
            F.max(F.when(~over, F.col("upto"))).alias("used")).withColumnRenamed("source", "_s")
        moved = stored(state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "target", "source_size", "repeats",
            (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            F.coalesce(F.col("bucket") * F.lit(1 << shift), "at").alias("at"),
            F.coalesce("n", "at_size").alias("at_size")))
        aside = broadcast_if_small(moved.select(F.col("source").alias("_s"), "at"))
        inside = stored(live.join(aside, F.col("source").eqNullSafe(F.col("_s")) & (
            F.shiftright("hash", shift) == F.shiftright("at", shift)), "left_semi"))
        drop_stored(state, *([live] if shift < BITS - STEP else []))
        state, live = moved, inside
    return state.select("source", "target", "source_size", "repeats", "at", "left")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                seed: int = 11, with_rows: bool = False) -> DataFrame:
    """How often the mix takes each row: ``doc_id, source, size, source_size, target, copies, taken``.

    A row's size is its number of words; it is taken whole, ``copies`` times, and
    ``taken = copies * size``. A source misses its target by at most half the size of the
    row at its threshold. Hashes of id and text decide, so reruns agree; of rows equal in
    both, however many, as many are taken once more as come nearest to the target. Null or blank texts have size 0; their copies
    follow the same rule. A null source is a source of its own, last in order. An empty
    table gives an empty mix. ``with_rows`` adds the whole input row as struct ``row``,
    so extra columns of any name are safe.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 64 - BITS)
    own = [F.struct("*").alias("row")] if with_rows else []
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                              hashed.alias("hash"), F.monotonically_increasing_id().alias("place"), *own))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = hash_thresholds(rows, share_targets(sizes, weights, share, most))
    plan = broadcast_if_small(plan.withColumnRenamed("source", "_s"))
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    edge = (F.col("hash") == F.col("at")) & (F.col("size") > 0)
    # equal rows at the threshold are numbered by where they lie, over any number of tasks
    numbered = row_numbers(met.where(edge), ["source"], ["place"], "_rn")
    more = F.col("_rn") * 2 * F.col("size") <= 2 * F.col("left") + F.col("size")
    out = [F.col(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    held = ["row"] if with_rows else []

    def taken(df: DataFrame, once_more: Column) -> DataFrame:
        copies = F.col("repeats") + once_more.cast("int")
        return df.select(*out, copies.alias("copies"), (copies * F.col("size")).alias("taken"), *held)

    return taken(met.where(~edge), F.col("hash") < F.col("at")).unionByName(taken(numbered, more))
