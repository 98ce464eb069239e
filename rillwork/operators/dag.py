"""Values handed down a directed network in few rounds, with tables no larger than its edges.

A node's value is gathered from the edges that enter it; an edge turns the value at its
start into what it hands on. Each round does two things at once:

* nodes whose entering edges are all settled get their value (leaves and what hung on them);
* nodes with one open entering edge are passed over: their leaving edges start from the
  nearest node upstream that is not such a node, found by pointer doubling, and hand on the
  composed function. So a chain of any length, with any settled side branches, takes one round.

A tree of n edges takes about log n rounds. In densely braided ground nodes settle level by
level; once at most ``CORE`` edges are left and a round no longer takes a tenth of them, or
at most ``TAIL`` are left, one task settles the rest. No pair of nodes is formed that an
edge did not join before, so every table stays within the number of edges and nodes.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.operators.scale import lookup_join
from rillwork.session import checkpointed

#: Edges that one task settles: always, and where rounds take less than a tenth of what is left.
TAIL, CORE = 2_000, 200_000

FAR = 1 << 30


class Sum:
    """Adds up what comes in; an edge adds ``d``."""

    params, state = ("d",), ("x",)

    def first(self, w: Column) -> list[Column]:
        return [w.cast("double")]

    def gathered(self) -> list[Column]:
        return [F.sum("x").alias("x")]

    def value(self, x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    def settled(self, value: Column, uid: Column) -> list[Column]:
        return [value]

    def apply(self, f: list[Column], x: Column) -> Column:
        return x + f[0]

    def compose(self, outer: list[Column], inner: list[Column]) -> list[Column]:
        return [outer[0] + inner[0]]

    def through(self, state: list[Column]) -> list[Column]:
        return [F.coalesce(state[0], F.lit(0.0))]

    def plain(self, incoming: list[float]) -> float:
        return float(sum(incoming))

    def plain_apply(self, f: tuple, x: float) -> float:
        return x + f[0]


class Least(Sum):
    """The least of what comes in; an edge adds ``d`` and hands on ``c`` at most."""

    params = ("c", "d")

    def first(self, w: Column) -> list[Column]:
        return [F.lit(float("inf")), w.cast("double")]

    def gathered(self) -> list[Column]:
        return [F.min("x").alias("x")]

    def value(self, x: Column) -> Column:
        return F.coalesce(x, F.lit(float("inf")))

    def apply(self, f, x):
        return F.least(f[0], x + f[1])

    def compose(self, outer, inner):
        return [F.least(outer[0], inner[0] + outer[1]), inner[1] + outer[1]]

    def through(self, state):
        return [F.coalesce(state[0], F.lit(float("inf"))), F.lit(0.0)]

    def plain(self, incoming):
        return float(min(incoming, default=math.inf))

    def plain_apply(self, f, x):
        return min(f[0], x + f[1])


class Strahler:
    """The highest order that comes in, one more where two edges bring it; sources have 1.

    What a chain with settled side branches makes of the order ``x`` at its head is always
    ``max(low + (x >= a), x)``. ``lo`` and ``hi`` are edge numbers: they differ where the
    highest order came twice.
    """

    params, state = ("low", "a"), ("x", "lo", "hi")

    def first(self, w):
        return [F.lit(0.0), F.lit(float(FAR))]

    def gathered(self):
        top = F.max(F.when(F.col("x").isNotNull(), F.struct("x", "hi")))
        bottom = F.max(F.when(F.col("x").isNotNull(), F.struct("x", (-F.col("lo")).alias("lo"))))
        return [top["x"].alias("x"), (-bottom["lo"]).alias("lo"), top["hi"].alias("hi")]

    def value(self, x, lo, hi):
        return F.coalesce(x + (lo != hi).cast("double"), F.lit(1.0))

    def settled(self, value, uid):
        return [value, uid, uid]

    def apply(self, f, x):
        return F.greatest(f[0] + (x >= f[1]).cast("double"), x)

    def compose(self, outer, inner):
        (l2, a2), (l1, a1) = outer, inner
        far = F.lit(float(FAR))
        kept, over = (l1, a1), (l2, a2)
        plain_inner = [F.when(a2 >= far, F.greatest(l1, l2)).when(l1 >= a2, F.greatest(l2 + 1, l1)).otherwise(over[0]),
                       F.when((a2 >= far) | (l1 >= a2), far).otherwise(over[1])]
        flat_outer = [F.when(l2 > l1, l2).otherwise(kept[0]), F.when(l2 > l1, far).otherwise(kept[1])]
        both = [F.when(l1 >= a2, F.when(l2 >= l1, l2 + 1).otherwise(kept[0])).otherwise(l2),
                F.when(l1 >= a2, F.when(l2 >= l1, far).otherwise(kept[1])).when(l1 + 1 >= a2, a1).otherwise(a2)]
        return [F.when(a1 >= far, p).when(a2 >= far, f).otherwise(b) for p, f, b in zip(plain_inner, flat_outer, both)]

    def through(self, state):
        x, lo, hi = state
        far = F.lit(float(FAR))
        return [F.when(x.isNull(), 0.0).when(lo != hi, x + 1).otherwise(x), F.when(x.isNull() | (lo != hi), far).otherwise(x)]

    def plain(self, incoming):
        top = max(incoming, default=0.0)
        return 1.0 if not incoming else top + (incoming.count(top) > 1)

    def plain_apply(self, f, x):
        return max(f[0] + (x >= f[1]), x)


def node_values(edges: DataFrame, kind, starts: DataFrame) -> DataFrame:
    """``(node, value)`` of every node that no cycle leads to.

    ``edges(uid, u, v, w)`` run from ``u`` to ``v``; ``starts(node, x)`` holds every node once
    and what it begins with (null: nothing).
    """
    names = list(kind.params)
    cols = [F.col(n) for n in names]
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("x", "double"), ("lo", "bigint"), ("hi", "bigint")) if n in kind.state]
    node_type = edges.schema["u"].dataType
    own = [F.col("x").cast("double").alias("x")] + [F.lit(None).cast("bigint").alias(n) for n in kind.state[1:]]
    live = edges.select("uid", "u", "v", *[c.cast("double").alias(n) for c, n in zip(kind.first(F.col("w")), names)], *blank)
    live = checkpointed(live.unionByName(starts.select(
        F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast(node_type).alias("u"), F.col("node").alias("v"),
        *[F.lit(None).cast("double").alias(n) for n in names], *own)))
    size, passed, stuck = live.where("u IS NOT NULL").count(), [], False
    known: DataFrame | None = None
    while True:
        stalled = passed and size > 0.9 * passed[-1][1] and size <= CORE
        if size <= TAIL or stalled or stuck:
            if size <= CORE:
                last = _settle_in_one_task(live, kind, names, node_type)
                known = last if known is None else known.unionByName(last)
            break
        gathered = live.groupBy(F.col("v").alias("node")).agg(
            F.count("u").alias("open"), F.max("u").alias("ptr"), *[F.max(c).alias(n) for c, n in zip(cols, names)], *kind.gathered())
        gathered = checkpointed(gathered)
        state = [F.col(n) for n in kind.state]
        ready = gathered.where("open = 0").select("node", kind.value(*state).alias("value"))
        single = gathered.where("open = 1").select("node", "ptr", *[
            c.alias(n) for c, n in zip(kind.compose(kind.through(state), cols), names)])
        single, rings = _heads(single, kind, names)
        heads = single.join(ready.withColumnRenamed("node", "ptr"), "ptr", "left").select(
            "node", "ptr", *names, F.when(F.col("value").isNotNull(), kind.apply(cols, F.col("value"))).alias("value"))
        heads = checkpointed(heads)
        done = checkpointed(ready.unionByName(heads.where("value IS NOT NULL").select("node", "value")))
        waiting = heads.where("value IS NULL").select("node", "ptr", *names)
        known = done if known is None else known.unionByName(done)
        # what is left: nodes with several open edges, their gathered state, and their open edges
        open_nodes = gathered.where("open > 1").select(F.col("node").alias("v"))
        if rings is not None:
            open_nodes = open_nodes.unionByName(rings.select(F.col("node").alias("v")))
        table = done.select(F.col("node").alias("u"), "value", *[F.lit(None).cast("double").alias(f"_{n}") for n in names],
                            F.lit(None).cast(node_type).alias("_ptr")).unionByName(
            waiting.select(F.col("node").alias("u"), F.lit(None).cast("double").alias("value"), *[F.col(n).alias(f"_{n}") for n in names],
                           F.col("ptr").alias("_ptr")))
        kept = live.where("u IS NOT NULL").join(open_nodes, "v", "left_semi")
        met = lookup_join(checkpointed(kept), table, "u")
        result = kind.settled(kind.apply(cols, F.col("value")), F.col("uid"))
        fixed = F.col("value").isNotNull()
        composed = kind.compose(cols, [F.col(f"_{n}") for n in names])
        moved = met.select(
            "uid", F.when(~fixed, F.coalesce("_ptr", "u")).alias("u"), "v",
            *[F.when(~fixed, F.when(F.col("_ptr").isNull(), c).otherwise(g)).alias(n) for c, g, n in zip(cols, composed, names)],
            *[F.when(fixed, r).alias(n) for r, n in zip(result, kind.state)])
        states = gathered.join(open_nodes.withColumnRenamed("v", "node"), "node", "left_semi").select(
            F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast(node_type).alias("u"), F.col("node").alias("v"),
            *[F.lit(None).cast("double").alias(n) for n in names], *kind.state)
        passed.append((waiting, size))
        live = checkpointed(moved.unionByName(states))
        before, size = size, live.where("u IS NOT NULL").count()
        stuck = size == before and done.isEmpty() and waiting.isEmpty()
    for waiting, _ in reversed(passed) if known is not None else ():
        at = waiting.withColumnRenamed("node", "_n").join(known.withColumnRenamed("node", "ptr"), "ptr").select(
            F.col("_n").alias("node"), kind.apply(cols, F.col("value")).alias("value"))
        known = known.unionByName(checkpointed(at))
    return starts.select("node", F.lit(0.0).alias("value")).limit(0) if known is None else known


def _heads(single: DataFrame, kind, names: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Nodes with one open edge and the first node upstream that is not one, with the composed function.

    Second come nodes that find none, since they lie on a ring or hang on one.
    """
    walk = checkpointed(single.withColumn("end", F.lit(False)))
    total = walk.count()
    for _ in range(math.ceil(math.log2(max(total, 2))) + 2):
        if walk.where("NOT end").isEmpty():
            return walk.drop("end"), None
        ahead = walk.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("end").alias("_end"), *[F.col(n).alias(f"_{n}") for n in names])
        met = lookup_join(walk.where("NOT end"), ahead, "ptr")
        composed = kind.compose([F.col(n) for n in names], [F.col(f"_{n}") for n in names])
        moved = met.select("node", F.coalesce("_ptr", "ptr").alias("ptr"), *[
            F.when(F.col("_ptr").isNull(), F.col(n)).otherwise(c).alias(n) for n, c in zip(names, composed)],
            (F.col("_ptr").isNull() | F.col("_end")).alias("end"))
        walk = checkpointed(walk.where("end").select("node", "ptr", *names, "end").unionByName(moved))
    return walk.where("end").drop("end"), walk.where("NOT end").select("node")


def _settle_in_one_task(live: DataFrame, kind, names: list[str], node_type) -> DataFrame:
    """Values of what is left, at most ``CORE`` edges; nodes behind a cycle are left out."""
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        incoming, leaving, open_ = defaultdict(list), defaultdict(list), defaultdict(int)
        seen = dict.fromkeys(pdf["v"])
        for fixed, u, v, x, again, *f in zip(pdf["fixed"], pdf["u"], pdf["v"], pdf["x"], pdf["again"], *[pdf[n] for n in names]):
            if not fixed:
                leaving[u].append((v, f))
                open_[v] += 1
            elif not pd.isna(x):
                incoming[v] += [x, x] if again else [x]
        queue, rows = deque(v for v in seen if not open_[v]), []
        while queue:
            node = queue.popleft()
            value = kind.plain(incoming.pop(node, []))
            rows.append((node, value))
            for v, f in leaving.pop(node, ()):
                incoming[v].append(kind.plain_apply(f, value))
                open_[v] -= 1
                if not open_[v]:
                    queue.append(v)
        return pd.DataFrame(rows, columns=["node", "value"])

    # no nulls in ids, which would become floats
    again = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) if "lo" in kind.state else F.lit(False)
    plain = live.select(F.col("u").isNull().alias("fixed"), F.coalesce("u", "v").alias("u"), "v", "x", again.alias("again"), *names)
    one = plain.groupBy().applyInPandas(settle, f"node {node_type.simpleString()}, value double")
    return checkpointed(one)


# --- cycles -------------------------------------------------------------------------------------

def _chains(edges: DataFrame, inner: DataFrame, here: str, there: str) -> DataFrame:
    """``(node, end, low)`` of inner nodes: the first other node in one direction; ``end`` null on a ring.

    ``low`` is the least node passed, of the whole ring where there is no end.
    """
    walk = edges.select(F.col(here).alias("node"), F.col(there).alias("ptr")).join(inner, "node", "left_semi")
    inside = inner.select(F.col("node").alias("ptr"), F.lit(True).alias("_in"))
    walk = walk.join(inside, "ptr", "left").select("node", "ptr", F.least("node", F.when(F.col("_in"), F.col("ptr"))).alias("low"), F.col("_in").isNull().alias("end"))
    walk = checkpointed(walk)
    total = walk.count()
    for _ in range(math.ceil(math.log2(max(total, 2))) + 2):
        if walk.where("NOT end").isEmpty():
            break
        ahead = walk.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"), F.col("end").alias("_end"))
        moved = walk.where("NOT end").join(ahead, "ptr").select("node", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"), F.col("_end").alias("end"))
        walk = checkpointed(walk.where("end").select("node", "ptr", "low", "end").unionByName(moved))
    return walk.select("node", F.when(F.col("end"), F.col("ptr")).alias("end"), "low")


def strong_groups(edges: DataFrame) -> DataFrame:
    """``(node, group)``: nodes that reach each other share the least of them; ``edges(u, v)``.

    Chains of nodes with one edge in and one out are contracted first. What is left, if at
    most ``CORE`` edges, is grouped in one task, else by rounds of labels: the least node
    that reaches a node forward, then back from the nodes that kept their own label.
    """
    edges = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    degree = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                            F.struct(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    degree = checkpointed(degree.groupBy("e.node").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i")))
    inner = degree.where("o = 1 AND i = 1").select("node")
    up = _chains(edges, inner, "v", "u")
    down = _chains(edges, inner, "u", "v").select("node", F.col("end").alias("tail"))
    both = checkpointed(up.join(down, "node"))
    rings = both.where("end IS NULL").select("node", F.col("low").alias("group"))
    outer = degree.where("NOT (o = 1 AND i = 1)").select("node")
    direct = edges.join(outer.withColumnRenamed("node", "u"), "u", "left_semi").join(outer.withColumnRenamed("node", "v"), "v", "left_semi")
    short = checkpointed(direct.select("u", "v").union(both.where("end IS NOT NULL").select("end", "tail")).where("u <> v").distinct())
    own = _grouped_in_one_task(short) if short.count() <= CORE else _grouped_by_rounds(short)
    groups = outer.join(own, "node", "left").select("node", F.coalesce("group", "node").alias("group"))
    groups = checkpointed(groups)
    at = groups.select(F.col("node").alias("end"), F.col("group").alias("_a"))
    to = groups.select(F.col("node").alias("tail"), F.col("group").alias("_b"))
    held = both.where("end IS NOT NULL").join(at, "end").join(to, "tail").select(
        "node", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("node")).alias("group"))
    every = checkpointed(groups.unionByName(held).unionByName(rings))
    # the least node may be one inside a chain
    least = every.groupBy("group").agg(F.min("node").alias("_least"))
    return every.join(least, "group").select("node", F.col("_least").alias("group"))


def _grouped_in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(list)
        for u, v in zip(pdf["u"], pdf["v"]):
            after[u].append(v)
        number, low, on, stack, rows = {}, {}, set(), [], []
        for root in list(after):
            if root in number:
                continue
            work = [(root, iter(after[root]))]
            number[root] = low[root] = len(number)
            stack.append(root)
            on.add(root)
            while work:
                node, ways = work[-1]
                for to in ways:
                    if to not in number:
                        number[to] = low[to] = len(number)
                        stack.append(to)
                        on.add(to)
                        work.append((to, iter(after.get(to, ()))))
                        break
                    if to in on:
                        low[node] = min(low[node], number[to])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == number[node]:
                        own = []
                        while not own or own[-1] != node:
                            own.append(stack.pop())
                            on.discard(own[-1])
                        rows += [(n, min(own)) for n in own]
        return pd.DataFrame(rows, columns=["node", "group"])

    return edges.groupBy().applyInPandas(group, f"node {kind}, group {kind}")


def _grouped_by_rounds(edges: DataFrame) -> DataFrame:
    groups, left = None, edges
    while not left.isEmpty():
        label = left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
        label = checkpointed(label)
        while True:
            seen = left.join(label.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("_l"))
            moved = checkpointed(label.join(seen, "node", "left").select("node", F.least("label", "_l").alias("label"), (F.col("_l") < F.col("label")).alias("new")))
            label = moved.select("node", "label")
            if moved.where("new").isEmpty():
                break
        found = checkpointed(label.where("node = label"))
        frontier = found
        back = left.join(label.select(F.col("node").alias("u"), F.col("label").alias("_u")), "u").join(
            label.select(F.col("node").alias("v"), F.col("label").alias("_v")), "v").where("_u = _v").select("u", "v", F.col("_u").alias("label"))
        back = checkpointed(back)
        while not frontier.isEmpty():
            before = back.join(frontier.select(F.col("node").alias("v")), "v").select(F.col("u").alias("node"), "label").distinct()
            frontier = checkpointed(before.join(found, "node", "left_anti"))
            found = checkpointed(found.unionByName(frontier))
        groups = found if groups is None else groups.unionByName(found)
        gone = found.select("node")
        left = checkpointed(left.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti"))
    return groups.select("node", F.col("label").alias("group"))
