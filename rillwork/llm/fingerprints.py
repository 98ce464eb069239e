"""Merkle trees over sections and paragraphs, in Spark's own functions only.

A leaf is a clause of a paragraph; a paragraph's hash covers its leaves, a section's hash
its paragraphs, the root all sections. Cuts keep every character, so texts are equal when
their roots are. Differing branches locate an edit: only sections whose hashes differ are
opened, and of those only the differing paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import id_or_last

#: Cuts after a blank line, after a line, after a clause.
SECTION, PARAGRAPH, CLAUSE = r"(?<=\n\n)", r"(?<=\n)", r"(?<=\p{Punct}[ \n])"

#: Rows that one window sorts, and how many such blocks there are at most.
BLOCK, MOST_BLOCKS = 3000, 1 << 16


def _pieces(text: Column, rule: str) -> Column:
    return F.filter(F.split(text, rule, -1), lambda x: x != "")


def merkle_tree(text: Column) -> Column:
    """Array of sections ``(hash, paragraphs)``; a paragraph is ``(hash, leaves)``.

    A null or empty text has no section.
    """
    def paragraph(p: Column) -> Column:
        return F.transform(_pieces(p, CLAUSE), lambda c: F.xxhash64(c))

    def section(leaves: Column) -> Column:
        return F.transform(leaves, lambda x: F.struct(F.xxhash64(x).alias("hash"), x.alias("leaves")))

    bare = F.transform(_pieces(F.coalesce(text, F.lit("")), SECTION),
                       lambda s: section(F.transform(_pieces(s, PARAGRAPH), paragraph)))
    return F.transform(bare, lambda p: F.struct(F.xxhash64(p["hash"]).alias("hash"), p.alias("paragraphs")))


def root_text(tree: Column) -> Column:
    """The fingerprint: 64 hex digits over the hashes of all sections."""
    return F.sha2(F.array_join(F.transform(tree["hash"], lambda h: F.hex(h)), "/"), 256)


def leaf_set(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(F.transform(tree["paragraphs"], lambda p: p["leaves"]))))


def likeness(x: Column, y: Column) -> Column:
    """Share, 0 to 1, of the leaves of two trees (as ``leaf_set``) that the other has too."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(2 * both / (F.size(x) + F.size(y)))


def differing_branches(a: Column, b: Column) -> Column:
    """Numbers ``(section, paragraph)``, from 0, of ``a``'s paragraphs that ``b`` lacks."""
    theirs = F.flatten(F.transform(b["paragraphs"], lambda p: p["hash"]))

    def opened(s: Column, i: Column) -> Column:
        marked = F.transform(s["paragraphs"], lambda p, j: F.struct(
            i.alias("section"), j.alias("paragraph"), F.array_contains(theirs, p["hash"]).alias("known")))
        return F.when(F.array_contains(b["hash"], s["hash"]), F.filter(marked, lambda m: F.lit(False))).otherwise(
            F.filter(marked, lambda m: ~m["known"]))

    found = F.flatten(F.transform(a, opened))
    return F.transform(found, lambda m: F.struct(m["section"].alias("section"), m["paragraph"].alias("paragraph")))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, tree, fingerprint`` of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), merkle_tree(text).alias("tree")).withColumn(
        "fingerprint", root_text(F.col("tree")))


def _block_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below ``key``; two short searches, however many cuts."""
    below = lambda own: F.size(F.filter(own, lambda c: c <= key))
    if not cuts:
        return F.lit(0)
    if len(cuts) <= 256:
        return below(F.lit(cuts))
    groups = [cuts[i:i + 256] for i in range(0, len(cuts), 256)]
    group = below(F.lit([g[0] for g in groups]))
    return F.when(group == 0, 0).otherwise(
        (group - 1) * 256 + below(F.element_at(F.array(*[F.lit(g) for g in groups]), F.greatest(group, F.lit(1)))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, text, next_text`` by ascending id; after the last row comes the first.

    Rows are dealt by ranges of ids into blocks of about ``block`` rows, and each block
    also gets the first row of the following one, so no task sorts all rows and texts are
    shuffled once. Rows of one id are ordered by text; rows without an id come last.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"),
                       id_or_last(id_col).alias("_key"))
    keys = docs.select(id_or_last(id_col).alias("_key"))
    n = max(1, min(MOST_BLOCKS, -(-keys.count() // block)))
    cuts = keys.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    at = _block_of(F.col("_key"), sorted(set(cuts or [])))
    # at most MOST_BLOCKS + 1 rows: the smallest key of each block and the block before it
    first = keys.groupBy(at.alias("_block")).agg(F.min("_key").alias("_first"))
    line = Window.partitionBy(F.lit(0)).orderBy("_block")
    ends = first.select("_block", "_first", F.lag("_block").over(line).alias("_before"),
                        F.max("_block").over(Window.partitionBy(F.lit(0))).alias("_last"))
    ends = ends.select(F.col("_first"), F.coalesce("_before", "_last").alias("_before"))
    met = rows.withColumn("_block", at).join(F.broadcast(ends), F.col("_key") == F.col("_first"), "left")
    own, halo = F.struct(F.col("_block").alias("b"), F.lit(0).alias("halo")), F.struct(F.col("_before").alias("b"), F.lit(1).alias("halo"))
    dealt = met.select("doc_id", "text", "_key", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(
        F.array(own, halo))).alias("_at"))
    line = Window.partitionBy("_at.b").orderBy("_at.halo", "_key", "text")
    return dealt.select("doc_id", "text", "_at", F.lead("text").over(line).alias("next_text")).where(
        "_at.halo = 0").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next text, and how alike they are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first
    as many of the next text. Null texts count as empty, whose trees are alike; a table of
    one row is its own next; an empty table gives no rows; other columns are not read.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    pairs = pairs.withColumn("edited_text", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), half)))
    trees = pairs.select("doc_id", "n_chars", "text", "edited_text", merkle_tree(F.col("text")).alias("tree"),
                         merkle_tree(F.col("edited_text")).alias("edited_tree"), merkle_tree(F.col("next_text")).alias("next_tree"))
    sets = trees.select("*", leaf_set(F.col("tree")).alias("own"), leaf_set(F.col("edited_tree")).alias("edited"),
                        leaf_set(F.col("next_tree")).alias("next"))
    return sets.select("doc_id", "n_chars", "edited_text", "tree", "edited_tree", root_text(F.col("tree")).alias("fingerprint"),
                       root_text(F.col("edited_tree")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("edited")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next")).alias("near_next"))
