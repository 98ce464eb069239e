"""Building blocks that stay balanced when one group holds most of the rows.

* ``running_sum`` / ``row_numbers`` – ordered prefix sums inside groups, where a
  group may span any number of tasks;
* ``exact_percentiles`` – exact linear percentiles without gathering a group;
* ``lookup_join`` – attach a unique-keyed table to rows whose key may be hot;
* ``fold_states`` – run a finite state machine along each key's events.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.session import checkpointed


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                weight: Column, name: str) -> DataFrame:
    """Inclusive prefix sum of ``weight`` per group along ``order``.

    Rows are range-partitioned on (group, order), so a large group is spread over
    many tasks. Each task sums its own run; a run that continues a group from an
    earlier task is shifted by what came before. Only groups crossing a task edge
    need that shift, at most two rows per task, so the shifts are broadcast.
    ``order`` should end in a unique column: equal rows land in one task.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(g) for g in group]
    # no fixed number of tasks: adaptive execution merges neighbouring small ranges
    laid = df.withColumn("_w", weight).repartitionByRange(*keys, *order_cols)
    laid = checkpointed(laid.withColumn("_task", F.spark_partition_id()))
    run = Window.partitionBy("_task", *group).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, 0)
    local = laid.withColumn("_run", F.sum("_w").over(run))
    sums = laid.groupBy("_task", *group).agg(F.sum("_w").alias("_t"))
    edges = laid.groupBy("_task").agg(
        F.min(F.struct(*keys)).alias("_lo"), F.max(F.struct(*keys)).alias("_hi")) if group else None
    if edges is not None:
        rims = (edges.select("_task", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_g"))
                .select("_task", *[F.col(f"_g.{g}").alias(g) for g in group]))
        on = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_task", *group)]
        sums = sums.alias("s").join(F.broadcast(rims.alias("r")), reduce(lambda a, b: a & b, on),
                                    "left_semi")
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = sums.withColumn("_shift", F.coalesce(F.sum("_t").over(before), F.lit(0))).where(
        "_shift <> 0").drop("_t")
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_task", *group)]
    out = local.alias("l").join(F.broadcast(shift.alias("b")), reduce(lambda a, b: a & b, cond), "left")
    kept = [F.col(f"l.{c}") for c in df.columns]
    return out.select(*kept, (F.col("_run") + F.coalesce(F.col("_shift"), F.lit(0))).alias(name))


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                name: str = "rn") -> DataFrame:
    """1-based position inside each group; like ``row_number`` but safe for huge groups."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), name)


def exact_percentiles(df: DataFrame, value: str, fractions: Sequence[float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated percentiles per key as columns ``p0, p1, ...``.

    Equal values are counted together before anything is ordered, and the order
    statistics are read off a distributed prefix count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_c"))
    ranked = running_sum(counted, list(keys), [value], F.col("_c"), "_upto")
    if keys:
        sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        ranked = ranked.join(sizes, list(keys))
    else:
        ranked = ranked.withColumn("_n", counted.agg(F.sum("_c")).scalar())
    v, upto, n = F.col(value), F.col("_upto"), F.col("_n")
    picks = []
    for i, f in enumerate(fractions):
        at = F.lit(float(f)) * (n - 1)
        picks += [F.min(F.when(upto > F.floor(at), v)).alias(f"_lo{i}"),
                  F.min(F.when(upto > F.ceil(at), v)).alias(f"_hi{i}"),
                  F.first(at - F.floor(at)).alias(f"_f{i}")]
    stats = ranked.groupBy(*keys).agg(*picks) if keys else ranked.agg(*picks)
    out = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"p{i}")
           for i in range(len(fractions))]
    return stats.select(*keys, *out)


#: A key is hot when it holds more than this share of the rows; at most
#: 1 / HOT_SHARE keys can, which is the proven size of what is broadcast.
HOT_SHARE = 0.001


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join rows to a table unique on ``key`` when the key may be hot among the rows.

    Hot keys (at most 1/HOT_SHARE of them) meet a broadcast slice of the table
    where the rows lie; the rest shuffle evenly. ``rows`` should be a scan or a
    checkpoint, since it is read twice.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_c"))
    total = rows.agg((F.count("*") * HOT_SHARE + 1000).alias("_t")).scalar()
    hot = counts.where(F.col("_c") > total).select(key)
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi")
    hot_table = table.join(F.broadcast(hot), key, "left_semi")
    cold_rows = rows.join(F.broadcast(hot), key, "left_anti")
    return cold_rows.join(table, key, how).unionByName(
        hot_rows.join(F.broadcast(hot_table), key, how))


def fold_states(events: DataFrame, key: str, order: Sequence[str], target: str,
                states: Sequence[str], allowed: dict[str, frozenset[str]], start: str,
                chunk: int = 256, entries: DataFrame | None = None) -> DataFrame:
    """State before and after each event of a key, and whether the move was allowed.

    Keys begin in ``start``, or in the ``state`` that ``entries(key, state)`` names for them.

    A refused move leaves the state as it was, so the state is a fold over the
    events, not a lag. An event is a map from state to state and maps compose, so
    events are cut into chunks of bounded size, each chunk is reduced to its map
    over all states, entry states are read off the composed maps (again in
    bounded chunks), and every chunk is replayed from its entry state. No task
    sees more than ``chunk`` events of a key at once.
    """
    code = {s: i for i, s in enumerate(states)}
    k = len(states)
    lawful = F.array(*[F.lit(b in allowed.get(a, frozenset())) for a in states for b in states])
    to_code = F.create_map(*[x for s in states for x in (F.lit(s), F.lit(code[s]))])
    names = F.array(*[F.lit(s) for s in states])

    def step(state: Column, want: Column) -> Column:
        ok = want.isNotNull() & F.element_at(lawful, state * k + F.coalesce(want, F.lit(0)) + 1)
        return F.when(ok, want).otherwise(state)

    numbered = row_numbers(events.withColumn("_want", to_code[F.col(target)]), [key], order, "_rn")
    numbered = checkpointed(numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk)))
    lists = numbered.groupBy(key, "_chunk").agg(F.array_sort(F.collect_list(
        F.struct("_rn", "_want"))).alias("_ev"))
    all_states = F.array(*[F.lit(i) for i in range(k)])
    maps = lists.select(key, F.col("_chunk").alias("_i"), F.transform(
        all_states, lambda s0: F.aggregate("_ev", s0, lambda s, e: step(s, e["_want"]))).alias("_map"))
    begin = entries.select(key, to_code[F.col("state")].alias("_begin")) if entries is not None else None
    entry = _entry_states(checkpointed(maps), key, code[start], k, chunk, begin)
    replay = lists.join(entry, (lists[key] == entry["_key"]) & (lists["_chunk"] == entry["_i"]))
    path = F.aggregate("_ev", F.array(F.col("_entry")), lambda acc, e: F.concat(
        acc, F.array(step(F.element_at(acc, -1), e["_want"]))))
    # the walk is computed per chunk, before its events are unfolded into rows
    walked = replay.select("_key", "_ev", path.alias("_path"))
    unfolded = F.transform("_ev", lambda e, i: F.struct(
        e["_rn"].alias("_r"), F.get("_path", i).alias("_from"), F.get("_path", i + 1).alias("_to")))
    steps = walked.select("_key", F.explode(unfolded).alias("_s")).select("_key", "_s.*")
    joined = numbered.join(steps, (numbered[key] == steps["_key"]) & (numbered["_rn"] == steps["_r"]))
    accepted = F.col("_want").isNotNull() & F.element_at(
        lawful, F.col("_from") * k + F.coalesce(F.col("_want"), F.lit(0)) + 1)
    return joined.select(*[numbered[c] for c in events.columns],
                         F.element_at(names, F.col("_from") + 1).alias("state_before"),
                         F.element_at(names, F.col("_to") + 1).alias("state_after"),
                         accepted.alias("accepted"))


def _entry_states(maps: DataFrame, key: str, start: int, k: int, chunk: int, begin: DataFrame | None = None) -> DataFrame:
    """``(_key, _i, _entry)``: the state in force when chunk ``_i`` of a key begins."""
    longest = maps.agg(F.max("_i")).first()[0] or 0
    if longest < chunk:
        blocks = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_map"))).alias("_b"))
        own = F.lit(start)
        if begin is not None:
            blocks, own = blocks.join(begin, key, "left"), F.coalesce("_begin", own)
        blocks = blocks.select(F.col(key).alias("_key"), "_b", own.alias("_entry0"))
    else:
        blocked = maps.withColumn("_blk", F.floor(F.col("_i") / chunk))
        lists = blocked.groupBy(key, "_blk").agg(
            F.array_sort(F.collect_list(F.struct("_i", "_map"))).alias("_b"))
        all_states = F.array(*[F.lit(i) for i in range(k)])
        outer = lists.select(key, F.col("_blk").alias("_i"), F.transform(
            all_states, lambda s0: F.aggregate("_b", s0, lambda s, m: F.element_at(m["_map"], s + 1))
        ).alias("_map"))
        upper = _entry_states(checkpointed(outer), key, start, k, chunk, begin)
        blocks = lists.join(upper, (lists[key] == upper["_key"]) & (lists["_blk"] == upper["_i"]))
        blocks = blocks.select("_key", "_b", F.col("_entry").alias("_entry0"))
    path = F.aggregate("_b", F.array(F.col("_entry0")), lambda acc, m: F.concat(
        acc, F.array(F.element_at(m["_map"], F.element_at(acc, -1) + 1))))
    walked = blocks.select("_key", "_b", path.alias("_path"))
    unfolded = F.transform("_b", lambda m, i: F.struct(m["_i"].alias("_i"), F.get("_path", i).alias("_entry")))
    return walked.select("_key", F.explode(unfolded).alias("_s")).select("_key", "_s.*")
