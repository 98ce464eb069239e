"""Catalog of works: filters, versions, archiving, public listing, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.operators.scale import row_numbers
from rillwork.operators.ledger import violations

ARTWORK_KEY = ("region", "county", "style", "endpoint", "size")


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def entry_id(region: Column, county: Column, style: Column, endpoint: Column, size: Column) -> Column:
    """Deterministic id from what identifies a work; absent parts are left out."""
    blank = lambda c: F.when(c != "", c)
    return F.concat_ws("-", slug(region), slug(blank(county)), style,
                       F.replace(endpoint, F.lit("_"), F.lit("-")), blank(size))


def listed(entries: DataFrame, status: str | None = None, region: str | None = None,
           section: str | None = None, tag: str | None = None) -> DataFrame:
    out = entries
    for name, wanted in (("status", status), ("region", region), ("section", section)):
        if wanted is not None:
            out = out.where(F.col(name) == wanted)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    return out.orderBy("entry_id", F.col("version").desc())


def entry_problems(entries: DataFrame, regions: tuple[str, ...] = X.STATES) -> DataFrame:
    keyed = entries.withColumn("_id", F.concat_ws("#", "entry_id", F.col("version").cast("string")))
    out = violations(keyed, "_id", {
        "region": F.col("region").isin(*regions), "style": F.col("style").isin(*X.ORDER_STYLES),
        "endpoint": F.col("endpoint").isin(*X.ENDPOINTS), "status": F.col("status").isin(*X.CATALOG_STATUSES)})
    return out.withColumnRenamed("_id", "entry")


def duplicate_versions(entries: DataFrame) -> DataFrame:
    return entries.groupBy("entry_id", "version").agg(F.count("*").alias("copies")).where("copies > 1")


def latest_published(entries: DataFrame) -> DataFrame:
    """Highest published version per work (null county and size are values too)."""
    rest = [c for c in entries.columns if c not in ARTWORK_KEY]
    best = entries.where("status = 'published'").groupBy(*ARTWORK_KEY).agg(
        F.max_by(F.struct(*rest), F.struct("version", "entry_id")).alias("_e"))
    return best.select(*ARTWORK_KEY, *[F.col(f"_e.{c}").alias(c) for c in rest])


def _same_work(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in ARTWORK_KEY])


def next_versions(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Next free version for each new work."""
    top = entries.groupBy(*ARTWORK_KEY).agg(F.max("version").alias("_top"))
    joined = new.alias("n").join(top.alias("t"), _same_work("n", "t"), "left")
    return joined.select("n.*", (F.coalesce("_top", F.lit(0)) + 1).alias("next_version"))


def ingest(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog after adding ``new``: earlier published versions of the same work are archived."""
    works = new.select(*ARTWORK_KEY).distinct()
    touched = entries.alias("e").join(works.withColumn("_hit", F.lit(True)).alias("w"), _same_work("e", "w"), "left")
    status = F.when(F.col("_hit") & (F.col("e.status") == "published"), "archived").otherwise(F.col("e.status"))
    old = touched.select(*[status.alias("status") if c == "status" else F.col(f"e.{c}") for c in entries.columns])
    return old.unionByName(new.select(*entries.columns))


def public_gallery(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """Latest published works in display order: section rank, then place inside the section.

    Rows, not nested lists: a section may hold most of the catalog.
    """
    chosen = latest_published(entries).withColumn("section_id", F.coalesce(F.nullif("section", F.lit("")), F.lit("uncategorized")))
    named = chosen.join(sections.select("section_id", "display_name", F.col("sort_order").alias("_rank"),
                                        F.col("description").alias("section_description")), "section_id", "left")
    title = F.initcap(F.replace("section_id", F.lit("-"), F.lit(" ")))
    out = named.select(
        "section_id", F.coalesce("display_name", title).alias("display_name"),
        F.coalesce("_rank", F.lit(999)).alias("section_rank"),
        F.coalesce("section_description", F.lit("")).alias("section_description"),
        "entry_id", "version", "sort_order")
    return row_numbers(out, ["section_id"], ["sort_order", "entry_id", "version"], "place")


def seed_drafts(selections: DataFrame, entries: DataFrame) -> DataFrame:
    """Selections not yet in the catalog become version-1 drafts titled by the text before the dash."""
    title = F.trim(F.element_at(F.split("rationale", "—"), 1))
    return selections.join(entries.select(F.col("entry_id").alias("item_id")), "item_id", "left_anti").select(
        F.col("item_id").alias("entry_id"), F.lit(1).alias("version"), F.lit("draft").alias("status"),
        title.alias("title"), F.col("rationale").alias("description"))
