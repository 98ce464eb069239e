"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups.

Slot pivot: the children of a parent are spread into columns by conditional aggregates,
one column for each slot. Concatenated columns hash to the parent; the columns without a
child's own one are its siblings, of which its proof consists. One aggregation spreads
``fanout ** levels`` descendants and hashes that many levels, so a tree takes few shuffles,
each of which moves a fixed share of the rows of the one before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import id_or_last, stored
from rillwork.operators.scale import lookup_join, row_numbers

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A step of a proof: the siblings left and right of a node.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts as 64 lower-case hex digits; a null part adds nothing."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[framed(c) for c in fields])


def _pass(nodes: DataFrame, fanout: int, levels: int, payload: Sequence[str]) -> DataFrame:
    """One slot pivot of ``(key, idx, n, hash)``: a row ``(key, block, n, s0.., l1_0.., steps)``.

    ``s<j>`` is the descendant in slot ``j`` with what it carries, ``l<i>_<j>`` the ``j``-th
    node ``i`` levels above. ``steps`` is the number of levels that the block has: all of
    them, or fewer where the block is all that is left of its group.
    """
    width = fanout ** levels
    held = F.struct("hash", *payload)
    block = nodes.groupBy("key", F.floor(F.col("idx") / width).alias("block")).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("idx") % width == j, held)).alias(f"s{j}") for j in range(width)])
    block = block.withColumns({f"l0_{j}": F.col(f"s{j}.hash") for j in range(width)})
    for i in range(1, levels + 1):
        below = width // fanout ** (i - 1)
        groups = [[F.col(f"l{i - 1}_{j + k}") for k in range(fanout)] for j in range(0, below, fanout)]
        block = block.select("*", *[F.when(g[0].isNotNull(), digest(*g)).alias(f"l{i}_{j}") for j, g in enumerate(groups)])
    steps = reduce(lambda a, b: a + b, [(F.col("n") > fanout ** i).cast("int") for i in range(levels)])
    return block.withColumn("steps", steps)


def build(nodes: DataFrame, fanout: int, levels: int, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``(key, idx, n, hash)`` and what else is to be carried by the lowest nodes.

    Nodes of a key have the places ``idx`` from 0 to ``n - 1``; ``key`` is never null.
    Returns the blocks of each pass, which ``proofs`` needs, and ``(key, pass, hash)`` of
    every root. A single node is its own root.
    """
    width, passes, roots = fanout ** levels, [], None
    while True:
        blocks = stored(_pass(nodes, fanout, levels, payload if not passes else ()))
        top = F.coalesce(*[F.when(F.col("steps") == i, F.col(f"l{i}_0")) for i in range(levels + 1)])
        done = blocks.where(F.col("n") <= width).select("key", F.lit(len(passes)).alias("pass"), top.alias("hash"))
        roots = done if roots is None else roots.union(done)
        passes.append(blocks)
        rest = blocks.where(F.col("n") > width)
        if rest.isEmpty():
            return passes, roots
        nodes = rest.select("key", F.col("block").alias("idx"), F.ceil(F.col("n") / width).alias("n"),
                            F.col(f"l{levels}_0").alias("hash"))


def proofs(passes: list[DataFrame], starts: DataFrame, fanout: int, levels: int, payload: Sequence[str] = ()) -> DataFrame:
    """The lowest nodes with their proofs, handed down from the roots block by block.

    ``starts`` has ``key, pass``, the ``path`` of each root to whatever lies above it, and
    columns to hand down. Returns ``key, hash``, the payload, those columns, and ``path``
    from the node upwards. Keys of a join are unique on both sides.
    """
    carried = [c for c in starts.columns if c not in ("key", "pass", "path")]
    width, above = fanout ** levels, None
    for number in reversed(range(len(passes))):
        here = starts.where(F.col("pass") == number).select("key", F.lit(0).cast("long").alias("block"), "path", *carried)
        above = here if above is None else here.unionByName(above)
        blocks = passes[number].join(above, ["key", "block"])

        def steps(slot: int) -> Column:
            out = []
            for i in range(levels):
                at = slot // fanout ** i
                first = at - at % fanout
                side = lambda own: F.concat(F.lit(""), *[F.coalesce(f"l{i}_{j}", F.lit("")) for j in own])
                out.append(F.struct(side(range(first, at)).alias("left"), side(range(at + 1, first + fanout)).alias("right")))
            return F.concat(F.slice(F.array(*out), F.lit(1), F.col("steps")), F.col("path"))

        children = F.array(*[F.when(F.col(f"s{j}").isNotNull(), F.struct(
            (F.col("block") * width + j).alias("idx"), F.col(f"s{j}").alias("node"), steps(j).alias("path")))
            for j in range(width)])
        opened = blocks.select("key", *carried, F.explode(F.array_compact(children)).alias("_c"))
        own = ["hash", *payload] if number == 0 else []
        above = opened.select("key", F.col("_c.idx").alias("block"), F.col("_c.path").alias("path"), *carried,
                              *[F.col(f"_c.node.{c}").alias(c) for c in own])
    return above.drop("block")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def proof_hash(path: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf upwards, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def dataset_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
                     extra: dict[str, Column] | None = None, fanout: int = 2, levels: int = 4) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` and the ``extra`` columns of every row.

    Leaves of a group ascend by id, rows of one id by leaf, rows without an id come last;
    groups ascend bytewise, that of null first. Every ``fanout`` consecutive nodes become
    their parent (the last run may be shorter) until one is left. ``path`` holds a step for
    each level up to ``root``; equal rows are leaves of their own. An empty table gives no
    rows. Only the named columns are read, and a row's fields are hashed where it lies.

    Places are counted over ranges of (group, id), so a hot group spreads over tasks.
    """
    extra = extra or {}
    names = [f"_x{i}" for i in range(len(extra))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), id_or_last(id_col).alias("_order"),
                       F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0")).alias("key"),
                       leaf_hash([F.col(f) for f in fields]).alias("hash"), *[c.alias(n) for c, n in zip(extra.values(), names)])
    placed = stored(row_numbers(rows, ["key"], ["_order", "hash"], "_rn"))
    sized = lookup_join(placed, placed.groupBy("key").agg(F.count("*").alias("n")), "key", "inner")
    payload = ["doc_id", *names]
    passes, roots = build(sized.select("key", (F.col("_rn") - 1).alias("idx"), "n", "hash", *payload), fanout, levels, payload)

    roots = stored(roots.withColumnRenamed("key", "group"))
    top = row_numbers(roots.withColumn("key", F.lit("")), [], ["group"], "_rn").select(
        "key", (F.col("_rn") - 1).alias("idx"), F.lit(roots.count()).cast("long").alias("n"), "hash", "group", "pass")
    above, root = build(top, fanout, levels, ["group", "pass"])
    starts = root.select("key", "pass", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    subroots = proofs(above, starts, fanout, levels, ["group", "pass"]).select(
        F.col("group").alias("key"), "pass", "path", F.col("hash").alias("subroot"), "root")
    found = proofs(passes, subroots, fanout, levels, payload)
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path",
                        *[F.col(n).alias(own) for n, own in zip(names, extra)])
