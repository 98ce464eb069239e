"""Operator views and rules over the ledger tables.

Every function maps ledger DataFrames to one DataFrame; ``now`` is always passed
in so a view gives the same rows whenever it is run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.operators.scale import row_numbers


def _with_place(rows: DataFrame, places: DataFrame) -> DataFrame:
    names = places.select("place_id", "region", "county", "display_name")
    return rows.join(names, "place_id", "left")


def active_work(requests: DataFrame, orders: DataFrame, places: DataFrame, now: Column) -> DataFrame:
    r = requests.where(~F.col("status").isin("fulfilled", "paid")).withColumnRenamed("place_id", "_rp")
    o = orders.select("request_id", "order_id", "style", F.col("place_id").alias("_op"))
    joined = r.join(o, "request_id", "left").withColumn("place_id", F.coalesce("_op", "_rp"))
    return _with_place(joined, places).select(
        "request_id", "product", "status", "order_id", "style", "region", "county", "display_name",
        "created_at", "updated_at", (now - F.col("created_at")).alias("age"))


def completed_work(requests: DataFrame, orders: DataFrame, places: DataFrame, assets: DataFrame,
                   deliveries: DataFrame) -> DataFrame:
    """Fulfilled orders with asset and delivery counts, each counted before it joins."""
    r = requests.where(F.col("status").isin("fulfilled", "paid")).withColumnRenamed("place_id", "_rp")
    o = orders.select("request_id", "order_id", "style", F.col("place_id").alias("_op"))
    joined = r.join(o, "request_id").withColumn("place_id", F.coalesce("_op", "_rp"))
    made = assets.where("order_id IS NOT NULL").groupBy("order_id").agg(F.count("*").alias("asset_count"))
    sent = deliveries.groupBy("order_id").agg(F.count("*").alias("delivery_count"))
    out = _with_place(joined, places).join(made, "order_id", "left").join(sent, "order_id", "left")
    return out.select(
        "request_id", "product", "order_id", "style", "region", "county", "display_name",
        F.col("updated_at").alias("fulfilled_at"),
        F.coalesce("asset_count", F.lit(0)).alias("asset_count"),
        F.coalesce("delivery_count", F.lit(0)).alias("delivery_count"))


def delivery_expiry(deliveries: DataFrame, now: Column, within: str = "30 days") -> DataFrame:
    revoked, expires = F.col("access_revoked_at"), F.col("access_expires_at")
    status = (F.when(revoked.isNotNull(), "revoked").when(expires <= now, "expired")
              .otherwise("expiring_soon"))
    return deliveries.where((expires <= now + F.expr(f"INTERVAL {within}")) | revoked.isNotNull()).select(
        "delivery_id", "order_id", "delivered_at", "access_expires_at", "access_revoked_at", "reason",
        "fee_waived", status.alias("expiry_status"), (expires - now).alias("time_remaining"))


def delivery_access(deliveries: DataFrame, now: Column) -> DataFrame:
    state = (F.when(F.col("access_revoked_at").isNotNull(), "revoked")
             .when(now >= F.col("access_expires_at"), "expired").otherwise("active"))
    return deliveries.withColumn("access", state)


def rights_gaps(assets: DataFrame) -> DataFrame:
    return assets.where((F.col("rights_status") != "cleared") | F.col("source_attribution").isNull()).select(
        "asset_id", "order_id", "role", "visibility", "rights_status", "source_attribution",
        "media_type", "created_at")


def render_failures(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'failed'").select(
        "job_id", "order_id", "status", "error_message", "started_at", "completed_at",
        "recipe_digest", "code_revision", "created_at")


def library_candidates(assets: DataFrame) -> DataFrame:
    ready = ((F.col("visibility") == "internal") & (F.col("rights_status") == "cleared")
             & F.col("source_attribution").isNotNull() & F.col("checksum_sha256").isNotNull()
             & F.col("deleted_at").isNull())
    return assets.where(ready).select(
        "asset_id", "order_id", "role", "storage_key", "checksum_sha256", "media_type", "visibility",
        "rights_status", "source_attribution", "created_at")


def analysis_evidence(runs: DataFrame, places: DataFrame, metrics: DataFrame) -> DataFrame:
    counted = metrics.groupBy("run_id").agg(F.count("*").alias("metric_count"))
    out = _with_place(runs, places).join(counted, "run_id", "left")
    return out.select(
        "run_id", "place_id", "region", "county", "display_name", "metric_version", "validation_status",
        "start_year", "end_year", "reviewer", "created_at",
        F.coalesce("metric_count", F.lit(0)).alias("metric_count"))


def orphans(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("render_job_id").isNull() | F.col("order_id").isNull()).select(
        "asset_id", "order_id", "render_job_id", "role", "storage_key", "checksum_sha256",
        "media_type", "created_at")


def children_in_order(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str],
                      position: str = "position") -> DataFrame:
    """Parents with their children as numbered rows, oldest first.

    Children stay rows: a parent with a very large history is numbered across
    tasks instead of being gathered into one list. Childless parents keep one row
    with null child columns.
    """
    numbered = row_numbers(children, [key], list(order), position)
    return parents.join(numbered, key, "left")


def runs_of_place(runs: DataFrame, metrics: DataFrame, place_id: str) -> DataFrame:
    chosen = runs.where(F.col("place_id") == place_id)
    mine = metrics.join(chosen.select("run_id"), "run_id", "left_semi").withColumnRenamed(
        "created_at", "metric_created_at")
    return children_in_order(chosen, mine, "run_id", ["metric_created_at", "metric_id"], "metric_no")


def newest_first(requests: DataFrame) -> DataFrame:
    return requests.orderBy(F.col("created_at").desc(), F.col("request_id").desc())


# --- rules as violation tables ---------------------------------------------------------

def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: ``(key, rule)``; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def id_and_enum_rules() -> dict[str, Column]:
    return {
        "request_id": F.col("request_id").rlike(X.REQUEST_ID),
        "order_id": F.col("order_id").rlike(X.ORDER_ID),
        "asset_id": F.col("asset_id").rlike(X.ASSET_ID),
        "delivery_id": F.col("delivery_id").rlike(X.DELIVERY_ID),
        "role": F.col("role").isin(*X.ASSET_ROLES),
        "visibility": F.col("visibility").isin(*X.VISIBILITY),
        "rights_status": F.col("rights_status").isin(*X.RIGHTS),
    }


def lineage_problems(lineage: DataFrame) -> DataFrame:
    """Self edges and repeated parent/child pairs."""
    own = lineage.where("parent_id = child_id").select("parent_id", "child_id", F.lit("self edge").alias("problem"))
    twice = lineage.groupBy("parent_id", "child_id").agg(F.count("*").alias("c")).where("c > 1").select(
        "parent_id", "child_id", F.lit("repeated pair").alias("problem"))
    return own.unionByName(twice)


def merged_payload(payload: Column, changes: dict[str, Column]) -> Column:
    """Shallow merge of a JSON object: later keys win."""
    kind = "map<string,variant>"
    base = F.coalesce(F.from_json(payload, kind), F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<variant>")))
    names = list(changes)
    kept = F.map_filter(base, lambda k, v: ~k.isin(*names))
    extra = F.create_map(*[x for n in names for x in (F.lit(n), changes[n].cast("variant"))])
    return F.to_json(F.map_concat(kept, extra))


# --- upserts and sequences ----------------------------------------------------------------

def import_actions(incoming: DataFrame, existing: DataFrame, key: str, dry_run: bool = True) -> DataFrame:
    """What an idempotent import would do with every incoming row."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    fresh = "would_create" if dry_run else "created"
    return incoming.join(known, key, "left").withColumn(
        "action", F.when(F.col("_known"), "skipped").otherwise(fresh)).drop("_known")


def manifest_assets(deliverables: DataFrame, visibility: str = "internal",
                    rights: str = "pending") -> DataFrame:
    """Asset rows from manifest deliverables ``(order_id, seq, kind, fmt, filename, sha256, ...)``."""
    if visibility == "approved_public" and rights != "cleared":
        raise ValueError("approved_public needs cleared rights")
    from rillwork.operators.classify import lookup
    role = F.coalesce(lookup(X.KIND_ROLE, F.col("kind")), F.lit("final"))
    media = F.coalesce(lookup(X.MEDIA_TYPE, F.lower("fmt")), F.lit("application/octet-stream"))
    return deliverables.select(
        F.concat(F.lit("AST-"), "order_id", F.lit("-"), role, F.lit("-r"), F.col("seq").cast("string")).alias("asset_id"),
        "order_id", role.alias("role"), F.col("filename").alias("storage_key"),
        F.col("sha256").alias("checksum_sha256"), media.alias("media_type"),
        F.lit(visibility).alias("visibility"), F.lit(rights).alias("rights_status"))


def next_request_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new(day, pos)`` gets the next free number after the ids of its day."""
    pat = r"^REQ-(\d{8})-(\d+)$"
    used = existing.where(F.col("request_id").rlike(pat)).groupBy(
        F.regexp_extract("request_id", pat, 1).alias("day")).agg(
        F.max(F.regexp_extract("request_id", pat, 2).cast("bigint")).alias("_last"))
    numbered = row_numbers(new, ["day"], ["pos"], "_rn").join(used, "day", "left")
    seq = F.col("_rn") + F.coalesce("_last", F.lit(0))
    return numbered.select(*new.columns, F.concat(
        F.lit("REQ-"), "day", F.lit("-"), F.format_string("%04d", seq)).alias("request_id"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
