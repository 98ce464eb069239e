"""Ledger views, catalog, manifests and analytics over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.operators import catalog as C
from rillwork.operators import ledger as L
from rillwork.operators import manifests as M
from rillwork.operators import orders as O
from rillwork.plans import standins as T
from rillwork.plans.ledger_roles import NOW, ctes, pick, role
from rillwork.plans.registry import query
from rillwork.plans.standins import R
from rillwork.session import work_folder


def _now():
    return F.lit("1998-06-15 00:00:00").cast("timestamp")


@query("active_work", "JN-11", sql=ctes("places", "requests", "orders_t") + f"""
SELECT r.request_id, r.product, r.status, o.order_id, o.style, p.region, p.county, p.display_name, r.created_at, r.updated_at,
 date_diff('day', r.created_at, {NOW}) AS age_days
FROM requests r LEFT JOIN orders_t o ON o.request_id = r.request_id
LEFT JOIN places p ON p.place_id = coalesce(o.place_id, r.place_id) WHERE r.status NOT IN ('fulfilled', 'paid')""")
def _(spark, sf):
    out = L.active_work(role(spark, sf, "requests"), role(spark, sf, "orders_t"), role(spark, sf, "places"), _now())
    return out.withColumn("age_days", F.extract(F.lit("DAY"), "age").cast("int")).drop("age")


@query("completed_work", "JN-12", sql=ctes("places", "requests", "orders_t", "assets", "deliveries") + """
SELECT r.request_id, r.product, o.order_id, o.style, p.region, p.county, p.display_name, r.updated_at AS fulfilled_at,
 (SELECT count(*) FROM assets a WHERE a.order_id = o.order_id) AS asset_count,
 (SELECT count(*) FROM deliveries d WHERE d.order_id = o.order_id) AS delivery_count
FROM requests r JOIN orders_t o ON o.request_id = r.request_id
LEFT JOIN places p ON p.place_id = coalesce(o.place_id, r.place_id) WHERE r.status IN ('fulfilled', 'paid')""")
def _(spark, sf):
    return L.completed_work(*[role(spark, sf, n) for n in ("requests", "orders_t", "places", "assets", "deliveries")])


@query("delivery_expiry", "PRJ-21", sql=ctes("deliveries") + f"""
SELECT delivery_id, order_id, delivered_at, access_expires_at, access_revoked_at, reason, fee_waived,
 CASE WHEN access_revoked_at IS NOT NULL THEN 'revoked' WHEN access_expires_at <= {NOW} THEN 'expired' ELSE 'expiring_soon' END AS expiry_status,
 date_diff('day', {NOW}, access_expires_at) AS days_remaining
FROM deliveries WHERE access_expires_at <= {NOW} + INTERVAL 30 DAY OR access_revoked_at IS NOT NULL""")
def _(spark, sf):
    out = L.delivery_expiry(role(spark, sf, "deliveries"), _now())
    return out.withColumn("days_remaining", F.extract(F.lit("DAY"), "time_remaining").cast("int")).drop("time_remaining")


@query("delivery_access", "PRJ-13", sql=ctes("deliveries") + f"""
SELECT delivery_id, CASE WHEN access_revoked_at IS NOT NULL THEN 'revoked' WHEN {NOW} >= access_expires_at THEN 'expired'
 ELSE 'active' END AS access FROM deliveries""")
def _(spark, sf):
    return L.delivery_access(role(spark, sf, "deliveries"), _now()).select("delivery_id", "access")


@query("rights_gaps", "PRJ-18", sql=ctes("assets") + """
SELECT asset_id, order_id, role, visibility, rights_status, source_attribution, media_type, created_at FROM assets
WHERE rights_status <> 'cleared' OR source_attribution IS NULL""")
def _(spark, sf):
    return L.rights_gaps(role(spark, sf, "assets"))


@query("render_failures", "PRJ-17", sql=ctes("render_jobs") + " SELECT * FROM render_jobs WHERE status = 'failed'")
def _(spark, sf):
    return L.render_failures(role(spark, sf, "render_jobs"))


@query("library_candidates", "PRJ-19", sql=ctes("assets") + """
SELECT asset_id, order_id, role, storage_key, checksum_sha256, media_type, visibility, rights_status, source_attribution, created_at
FROM assets WHERE visibility = 'internal' AND rights_status = 'cleared' AND source_attribution IS NOT NULL
 AND checksum_sha256 IS NOT NULL AND deleted_at IS NULL""")
def _(spark, sf):
    return L.library_candidates(role(spark, sf, "assets"))


@query("analysis_evidence", "JN-13", sql=ctes("places", "runs", "metrics") + """
SELECT r.run_id, r.place_id, p.region, p.county, p.display_name, metric_version, validation_status, start_year, end_year, reviewer,
 created_at, (SELECT count(*) FROM metrics m WHERE m.run_id = r.run_id) AS metric_count
FROM runs r LEFT JOIN places p ON p.place_id = r.place_id""")
def _(spark, sf):
    return L.analysis_evidence(role(spark, sf, "runs"), role(spark, sf, "places"), role(spark, sf, "metrics"))


@query("orphans", "PRJ-20", sql=ctes("assets") + """
SELECT asset_id, order_id, render_job_id, role, storage_key, checksum_sha256, media_type, created_at FROM assets
WHERE render_job_id IS NULL OR order_id IS NULL""")
def _(spark, sf):
    return L.orphans(role(spark, sf, "assets"))


@query("runs_with_metrics", "JN-14", sql=ctes("runs", "metrics") + """
SELECT r.run_id, r.validation_status, m.metric_id, m.name,
 CASE WHEN m.metric_id IS NOT NULL THEN row_number() OVER (PARTITION BY r.run_id ORDER BY m.created_at, m.metric_id) END AS metric_no
FROM runs r LEFT JOIN metrics m ON m.run_id = r.run_id WHERE r.place_id = 'PLC-7'""")
def _(spark, sf):
    out = L.runs_of_place(role(spark, sf, "runs"), role(spark, sf, "metrics"), "PLC-7")
    return out.select("run_id", "validation_status", "metric_id", "name", "metric_no")


@query("requests_with_events", "JN-15", sql=ctes("orders_t", "assets") + """
SELECT o.order_id, o.style, a.asset_id, a.role,
 CASE WHEN a.asset_id IS NOT NULL THEN row_number() OVER (PARTITION BY o.order_id ORDER BY a.created_at, a.asset_id, a.role) END AS asset_no
FROM orders_t o LEFT JOIN assets a ON a.order_id = o.order_id""")
def _(spark, sf):
    assets = role(spark, sf, "assets").where("order_id IS NOT NULL").select("order_id", "asset_id", "role", "created_at")
    out = L.children_in_order(role(spark, sf, "orders_t"), assets, "order_id", ["created_at", "asset_id", "role"], "asset_no")
    return out.select("order_id", "style", "asset_id", "role", "asset_no")


@query("newest_first", "SRT-06", "SRC-15", sql=ctes("requests") + " SELECT request_id, status, created_at FROM requests")
def _(spark, sf):
    return L.newest_first(role(spark, sf, "requests")).select("request_id", "status", "created_at")


_IDS = f"""SELECT concat('REQ-', strftime(o_orderdate, '%Y%m%d'), '-', lpad(CAST(o_orderkey % 12000 AS VARCHAR), 4, '0')) AS request_id,
 concat('ORD-', strftime(o_orderdate, '%Y%m%d'), '-', CAST(o_orderkey % 10000 AS VARCHAR)) AS order_id, o_orderkey AS k FROM orders"""


@query("id_and_enum_violations", "PRJ-12", sql=f"""WITH i AS ({_IDS}), a AS (
 SELECT k, request_id, order_id, concat('AST-', order_id, '-final-r1') AS asset_id, concat('DLV-', order_id, '-2') AS delivery_id,
  {pick(X.ASSET_ROLES + ('sketch',), 'k')} AS role, {pick(X.VISIBILITY + ('secret',), 'k')} AS visibility,
  {pick(X.RIGHTS + ('lost',), 'k')} AS rights_status FROM i)
SELECT k, 'request_id' AS rule FROM a WHERE NOT regexp_full_match(request_id, 'REQ-\\d{{8}}-\\d{{4}}')
UNION ALL SELECT k, 'order_id' FROM a WHERE NOT regexp_full_match(order_id, 'ORD-\\d{{8}}-\\d{{4}}')
UNION ALL SELECT k, 'asset_id' FROM a WHERE NOT regexp_full_match(asset_id, 'AST-ORD-\\d{{8}}-\\d{{4}}-[a-z][a-z_]*-r\\d+')
UNION ALL SELECT k, 'delivery_id' FROM a WHERE NOT regexp_full_match(delivery_id, 'DLV-ORD-\\d{{8}}-\\d{{4}}-\\d+')
UNION ALL SELECT k, 'role' FROM a WHERE role = 'sketch' UNION ALL SELECT k, 'visibility' FROM a WHERE visibility = 'secret'
UNION ALL SELECT k, 'rights_status' FROM a WHERE rights_status = 'lost'""")
def _(spark, sf):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    rows = T.table(spark, sf, "orders").select(
        k.alias("k"),
        F.concat(F.lit("REQ-"), day, F.lit("-"), F.when(k % 12000 > 9999, F.substring((k % 12000).cast("string"), 1, 4)).otherwise(
            F.lpad((k % 12000).cast("string"), 4, "0"))).alias("request_id"),
        F.concat(F.lit("ORD-"), day, F.lit("-"), (k % 10000).cast("string")).alias("order_id"),
        F.expr(pick(X.ASSET_ROLES + ("sketch",), "o_orderkey")).alias("role"),
        F.expr(pick(X.VISIBILITY + ("secret",), "o_orderkey")).alias("visibility"),
        F.expr(pick(X.RIGHTS + ("lost",), "o_orderkey")).alias("rights_status"))
    rows = rows.withColumn("asset_id", F.concat(F.lit("AST-"), "order_id", F.lit("-final-r1"))).withColumn(
        "delivery_id", F.concat(F.lit("DLV-"), "order_id", F.lit("-2")))
    return L.violations(rows, "k", L.id_and_enum_rules())


@query("lineage_problems", "NET-14", sql="""WITH e AS (SELECT l_partkey AS parent_id, l_suppkey AS child_id FROM lineitem)
SELECT parent_id, child_id, 'self edge' AS problem FROM e WHERE parent_id = child_id
UNION ALL SELECT parent_id, child_id, 'repeated pair' FROM e GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return L.lineage_problems(T.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("parent_id"), F.col("l_suppkey").alias("child_id")))


@query("payload_merge", "FN-15", sql="""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id AS job_id FROM events""")
def _(spark, sf):
    merged = L.merged_payload(F.col("props"), {"job_id": F.col("user_id")})
    got = F.from_json(merged, "k int, job_id bigint")
    return T.table(spark, sf, "events").select("event_id", got.alias("j")).select("event_id", "j.k", "j.job_id")


@query("import_actions", "SRC-19", sql=ctes("requests") + """, done AS (SELECT request_id FROM requests WHERE pos % 4 = 0)
SELECT CASE WHEN d.request_id IS NULL THEN 'would_create' ELSE 'skipped' END AS action, count(*) AS n
FROM requests r LEFT JOIN done d ON d.request_id = r.request_id GROUP BY 1""")
def _(spark, sf):
    req = role(spark, sf, "requests")
    return L.import_actions(req, req.where("pos % 4 = 0"), "request_id").groupBy("action").agg(F.count("*").alias("n"))


@query("manifest_assets", "SRC-19", sql="""SELECT concat('AST-ORD-', l_orderkey, '-', CASE l_returnflag WHEN 'A' THEN 'print' WHEN 'R' THEN 'vector' ELSE 'final' END,
 '-r', l_linenumber) AS asset_id, CASE l_linestatus WHEN 'O' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    d = T.table(spark, sf, "lineitem").select(
        F.concat(F.lit("ORD-"), "l_orderkey").alias("order_id"), F.col("l_linenumber").alias("seq"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'print' WHEN 'R' THEN 'vector' ELSE 'sheet' END").alias("kind"),
        F.expr("CASE l_linestatus WHEN 'O' THEN 'PNG' ELSE 'psd' END").alias("fmt"),
        F.lit("f").alias("filename"), F.lit("c").alias("sha256"))
    return L.manifest_assets(d).groupBy("asset_id", "media_type").agg(F.count("*").alias("n"))


@query("request_sequence", "WIN-16", sql="""WITH n AS (SELECT strftime(o_orderdate, '%Y%m%d') AS day, o_orderkey AS pos FROM orders WHERE o_orderkey % 2 = 1),
 u AS (SELECT strftime(o_orderdate, '%Y%m%d') AS day, max(o_orderkey % 9000) AS last FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT pos, concat('REQ-', n.day, '-', lpad(CAST(row_number() OVER (PARTITION BY n.day ORDER BY pos) + coalesce(last, 0) AS VARCHAR), 4, '0')) AS request_id
FROM n LEFT JOIN u ON n.day = u.day""")
def _(spark, sf):
    orders = T.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.col("o_orderkey").alias("pos"))
    used = orders.where("pos % 2 = 0").select(F.concat(F.lit("REQ-"), "day", F.lit("-"), F.format_string("%04d", F.col("pos") % 9000)).alias("request_id"))
    return L.next_request_ids(used, orders.where("pos % 2 = 1")).select("pos", "request_id")


# --- catalog -------------------------------------------------------------------------

@query("catalog_listing", "PRJ-22", "SRC-16", sql=ctes("entries") + """
SELECT entry_id, version, region, section FROM entries WHERE status = 'published' AND section = 'featured' AND list_contains(string_split(title, ' '), 'red')""")
def _(spark, sf):
    e = role(spark, sf, "entries").withColumn("tags", F.split("title", " "))
    return C.listed(e, status="published", section="featured", tag="red").select("entry_id", "version", "region", "section")


@query("catalog_violations", "PRJ-23", sql=ctes("entries") + """
SELECT concat(entry_id, '#', version) AS entry, 'region' AS rule FROM entries WHERE region NOT IN ('Brand#1', 'Brand#2', 'Brand#3')
UNION ALL SELECT concat(entry_id, '#', version), 'status' FROM entries WHERE status NOT IN ('draft', 'review', 'published', 'archived', 'rejected')""")
def _(spark, sf):
    return C.entry_problems(role(spark, sf, "entries"), ("Brand#1", "Brand#2", "Brand#3"))


@query("catalog_duplicates", "SRC-16", sql=ctes("entries") + """
SELECT entry_id, version % 10 AS version, count(*) AS copies FROM entries GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return C.duplicate_versions(role(spark, sf, "entries").withColumn("version", F.col("version") % 10))


@query("latest_published", "WIN-14", sql=ctes("entries") + """
SELECT region, county, style, endpoint, size, entry_id, version FROM (SELECT *, row_number() OVER (
 PARTITION BY region, county, style, endpoint, size ORDER BY version DESC, entry_id DESC) AS k FROM entries WHERE status = 'published') WHERE k = 1""")
def _(spark, sf):
    return C.latest_published(role(spark, sf, "entries")).select(*C.ARTWORK_KEY, "entry_id", "version")


@query("next_versions", "WIN-14", sql=ctes("entries") + """
SELECT n.entry_id, n.version, (SELECT coalesce(max(e.version), 0) + 1 FROM entries e WHERE e.status <> 'draft' AND e.region = n.region AND e.style = n.style
 AND e.endpoint = n.endpoint AND e.county IS NOT DISTINCT FROM n.county AND e.size IS NOT DISTINCT FROM n.size) AS next_version
FROM entries n WHERE n.status = 'draft'""")
def _(spark, sf):
    e = role(spark, sf, "entries")
    return C.next_versions(e.where("status <> 'draft'"), e.where("status = 'draft'")).select("entry_id", "version", "next_version")


@query("catalog_ingest", "WIN-15", "SRC-22", sql=ctes("entries") + """, n AS (SELECT * FROM entries WHERE status = 'draft'), o AS (SELECT * FROM entries WHERE status <> 'draft')
SELECT o.entry_id, o.version, CASE WHEN o.status = 'published' AND EXISTS (SELECT 1 FROM n WHERE n.region = o.region AND n.style = o.style AND n.endpoint = o.endpoint
 AND n.county IS NOT DISTINCT FROM o.county AND n.size IS NOT DISTINCT FROM o.size) THEN 'archived' ELSE o.status END AS status FROM o
UNION ALL SELECT entry_id, version, status FROM n""")
def _(spark, sf):
    e = role(spark, sf, "entries")
    return C.ingest(e.where("status <> 'draft'"), e.where("status = 'draft'")).select("entry_id", "version", "status")


_SECTIONS = ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in X.DEFAULT_SECTIONS)


@query("public_gallery", "AGG-39", sql=ctes("entries") + f""", s AS (SELECT * FROM (VALUES {_SECTIONS}) v(section_id, display_name, sort_order, description)),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region, county, style, endpoint, size ORDER BY version DESC, entry_id DESC) AS k
   FROM entries WHERE status = 'published') WHERE k = 1),
 c AS (SELECT coalesce(section, 'uncategorized') AS section_id, entry_id, version, sort_order FROM b)
SELECT c.section_id, coalesce(s.display_name, CASE c.section_id WHEN 'staff-picks' THEN 'Staff Picks' ELSE 'Uncategorized' END) AS display_name,
 coalesce(s.sort_order, 999) AS section_rank, coalesce(s.description, '') AS section_description, entry_id, version, c.sort_order,
 row_number() OVER (PARTITION BY c.section_id ORDER BY c.sort_order, entry_id, version) AS place FROM c LEFT JOIN s ON s.section_id = c.section_id""")
def _(spark, sf):
    sections = spark.createDataFrame(list(X.DEFAULT_SECTIONS), "section_id string, display_name string, sort_order int, description string")
    return C.public_gallery(role(spark, sf, "entries"), sections)


@query("catalog_seed", "SRC-21", sql=ctes("entries") + """, sel AS (SELECT concat('work-', o_orderkey) AS item_id, concat(' Order ', o_orderkey, ' — ', o_orderpriority) AS rationale FROM orders)
SELECT item_id AS entry_id, 1 AS version, 'draft' AS status, trim(split_part(rationale, '—', 1)) AS title FROM sel WHERE item_id NOT IN (SELECT entry_id FROM entries)""")
def _(spark, sf):
    sel = T.table(spark, sf, "orders").select(
        F.concat(F.lit("work-"), "o_orderkey").alias("item_id"),
        F.concat(F.lit(" Order "), "o_orderkey", F.lit(" — "), "o_orderpriority").alias("rationale"))
    return C.seed_drafts(sel, role(spark, sf, "entries")).select("entry_id", "version", "status", "title")


@query("entry_ids", "FN-14", sql=ctes("entries") + """
SELECT version, concat_ws('-', lower(region), lower(county), style, replace(endpoint, '_', '-'), size) AS entry_id,
 CASE WHEN county IS NULL THEN NULL ELSE concat(upper(county[1]), lower(county[2:]), ' County Watersheds') END AS title,
 concat_ws('_', concat('ORD-', version), concat_ws('-', lower(region), lower(county)), style, size) AS stem FROM entries""")
def _(spark, sf):
    e = role(spark, sf, "entries")
    ids = C.entry_id(*[F.col(c) for c in C.ARTWORK_KEY])
    stem = O.file_stem(F.concat(F.lit("ORD-"), "version"), F.col("region"), F.col("county"), F.col("style"), F.col("size"))
    return e.select("version", ids.alias("entry_id"), O.default_title(F.col("county")).alias("title"), stem.alias("stem"))


# --- manifests -------------------------------------------------------------------------

@query("required_files", "SRC-03", sql="""WITH ds AS (SELECT * FROM (VALUES ('hr', 4, 'https://data.example/hr/H_{code}.zip'), ('wbd', 2, 'https://data.example/wbd/W_{code}.zip')) v(dataset_id, d, t)),
 h AS (SELECT DISTINCT lpad(CAST(c_custkey % 400 AS VARCHAR), 4, '0') AS huc4 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT DISTINCT dataset_id, substr(huc4, 1, d) AS huc4, replace(t, '{code}', substr(huc4, 1, d)) AS url,
 concat(dataset_id, '/', substr(huc4, 1, d), '/', split_part(replace(t, '{code}', substr(huc4, 1, d)), '/', 5)) AS key FROM h, ds""")
def _(spark, sf):
    rows = [("hr", 1, "https://data.example/hr/H_{code}.zip", True, 4), ("wbd", 2, "https://data.example/wbd/W_{code}.zip", True, 2),
            ("old", 3, "https://data.example/old/{code}.zip", False, 4)]
    datasets = spark.createDataFrame(rows, "dataset_id string, priority int, url_template string, required boolean, code_digits int")
    cover = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("region"),
                                                  F.lpad((F.col("c_custkey") % 400).cast("string"), 4, "0").alias("huc4"))
    regions = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "region string")
    return M.required_files(regions, cover, datasets).select("dataset_id", "huc4", "url", "key")


@query("acquisition_work_list", "SRC-04", sql=ctes("old_files") + """
SELECT key FROM (SELECT *, key[5:8] AS huc4 FROM old_files) f WHERE huc4 NOT IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') FROM supplier WHERE s_suppkey < 20)
 AND relative_path NOT IN (SELECT concat('f/', o_orderkey) FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, sf):
    files = role(spark, sf, "old_files").withColumn("dataset_id", F.lit("nhd")).withColumn("huc4", F.substring("key", 5, 4))
    extracted = T.table(spark, sf, "supplier").where("s_suppkey < 20").select(
        F.lit("nhd").alias("dataset_id"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("huc4"))
    done = T.table(spark, sf, "orders").select(F.concat(F.lit("f/"), "o_orderkey").alias("relative_path"),
                                               (F.col("o_orderstatus") == "F").alias("verified"))
    cached = files.select("key", "relative_path").join(done, "relative_path")
    return M.work_list(files, extracted, cached).select("key")


@query("manifest_build", "SRC-05", sql="""SELECT concat(source, '/', lang, '/', doc_id) AS key, sha256(text) AS checksum, strlen(text) AS size FROM documents""")
def _(spark, sf):
    docs = T.table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("key"), "text")
    hashed = docs.select("key", F.sha2("text", 256).alias("checksum"), F.octet_length("text").alias("size"), F.col("key").alias("relative_path"))
    return M.build_manifest(docs.select("key"), hashed).select("key", "checksum", "size")


@query("manifest_diff", "JN-16", sql=ctes("old_files", "new_files") + """
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.checksum <> n.checksum THEN 'changed' ELSE 'unchanged' END AS change
FROM old_files o FULL JOIN new_files n ON o.key = n.key""")
def _(spark, sf):
    return M.diff_manifests(role(spark, sf, "old_files"), role(spark, sf, "new_files"))


@query("manifest_verify", "JN-17", sql=ctes("old_files", "new_files") + """
SELECT o.key, o.size, CASE WHEN n.key IS NULL THEN 'missing' WHEN o.checksum <> n.checksum OR o.size <> n.size THEN 'mismatched' ELSE 'ok' END AS state
FROM old_files o LEFT JOIN new_files n ON o.relative_path = n.relative_path""")
def _(spark, sf):
    return M.verify_manifest(role(spark, sf, "old_files"), role(spark, sf, "new_files"))


@query("package_readiness", "JN-18", sql=ctes("old_files", "new_files") + """, r AS (SELECT key FROM old_files UNION SELECT key FROM new_files),
 s AS (SELECT r.key, CASE WHEN n.key IS NULL OR o.key IS NULL THEN 'missing' WHEN o.checksum <> n.checksum OR o.size <> n.size THEN 'corrupt' ELSE 'present' END AS w, coalesce(o.size, 0) AS b
  FROM r LEFT JOIN old_files o ON o.key = r.key LEFT JOIN new_files n ON n.relative_path = o.relative_path)
SELECT count(*) FILTER (w = 'present') AS present, count(*) FILTER (w = 'corrupt') AS corrupt, count(*) FILTER (w = 'missing') AS missing,
 CAST(sum(b) AS BIGINT) AS total_bytes, count(*) FILTER (w <> 'present') = 0 AS ready FROM s""")
def _(spark, sf):
    old, new = role(spark, sf, "old_files"), role(spark, sf, "new_files")
    required = old.select("key").union(new.select("key")).distinct()
    return M.package_summary(M.package_plan(required, old, new), tiles=12, tile_budget=100)


@query("migration_plan", "JN-19", sql=ctes("old_files", "new_files") + """
SELECT o.relative_path, o.size, CASE WHEN n.size = o.size THEN 'skip' ELSE 'move' END AS action FROM old_files o LEFT JOIN new_files n ON n.relative_path = o.relative_path""")
def _(spark, sf):
    return M.migration_plan(role(spark, sf, "old_files"), role(spark, sf, "new_files"))


@query("checksum_coverage", "JN-20", sql=ctes("old_files", "new_files") + """
SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
FROM old_files o FULL JOIN new_files n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL""")
def _(spark, sf):
    return M.checksum_coverage(role(spark, sf, "old_files"), role(spark, sf, "new_files"), ["key"])


@query("fingerprint_stability", "AGG-42", sql="""SELECT l_returnflag AS dataset, 2 AS runs, 1 AS versions, 'match' AS verdict FROM lineitem GROUP BY 1""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "dataset")
    first = M.fingerprint(li, ["dataset"])
    again = M.fingerprint(li.repartition(13, "l_partkey"), ["dataset"])
    return M.golden_check(first.unionByName(again), first)


@query("golden_change", "AGG-42", sql="""WITH e AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem),
s AS (SELECT l_suppkey AS dataset, bool_or(l_orderkey = lo) AS torn, bool_or(l_orderkey = hi) AS moved FROM lineitem, e GROUP BY 1)
SELECT dataset, 2 AS runs, CASE WHEN torn THEN 2 ELSE 1 END AS versions, CASE WHEN torn THEN 'unstable' WHEN moved THEN 'changed' ELSE 'match' END AS verdict FROM s""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "dataset")
    once = M.fingerprint(li, ["dataset"])
    golden = M.record_golden(once.unionByName(M.fingerprint(li.repartition(13, "l_partkey"), ["dataset"])),
                             f"{work_folder(spark)}/golden-{uuid.uuid4().hex}")
    low, high = li.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()

    def raised(rows, key):
        return rows.withColumn("l_quantity", F.col("l_quantity") + (F.col("l_orderkey") == key).cast("int"))

    later = raised(li, high)
    runs = [M.fingerprint(rows, ["dataset"]) for rows in (later, raised(later, low))]
    return M.golden_check(runs[0].unionByName(runs[1]), golden)


# --- orders ------------------------------------------------------------------------------

_PAY = f"""SELECT CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE concat('ORD-', o_orderkey) END AS order_id,
 CASE WHEN o_orderkey % 4 = 0 THEN 'Atlantis' ELSE 'Oregon' END AS region, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Clark' END AS county,
 {pick(X.ORDER_STYLES + ('chalk',), 'o_orderkey')} AS style, {pick(tuple(X.SIZES) + ('1x1',), 'o_orderkey')} AS size,
 CASE WHEN o_orderkey % 7 = 0 THEN 'bmp' ELSE 'png' END AS fmt, o_orderpriority AS title, o_orderkey AS k FROM {{t}}"""


@query("order_rules", "PRJ-14", sql=f"""WITH p AS ({_PAY.format(t='orders')})
SELECT k, 'order_id' AS rule FROM p WHERE trim(order_id) = '' UNION ALL SELECT k, 'region' FROM p WHERE region = 'Atlantis'
UNION ALL SELECT k, 'county' FROM p WHERE county = '' UNION ALL SELECT k, 'style' FROM p WHERE style = 'chalk'
UNION ALL SELECT k, 'size' FROM p WHERE size = '1x1' UNION ALL SELECT k, 'format' FROM p WHERE fmt = 'bmp'""")
def _(spark, sf):
    T.table(spark, sf, "orders").createOrReplaceTempView("rw_orders")
    p = spark.sql(_PAY.format(t="rw_orders")).withColumn("formats", F.array("fmt")).withColumn(
        "add_ons", F.array(F.lit("svg"))).withColumn("subtitle", F.col("title")).withColumn("buyer_ref", F.col("title"))
    return O.order_problems(p).select("k", F.explode("problems").alias("rule"))


@query("text_cleaning", "PRJ-14", sql="""SELECT doc_id, NULLIF(substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 1, 60), '') AS title FROM documents""")
def _(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", O.clean_text(F.col("text"), X.TITLE_MAX).alias("title"))


@query("endpoint_rules", "PRJ-14", sql=f"""WITH e AS (SELECT p_partkey AS k, {pick(tuple(X.ENDPOINTS) + ('hologram',), 'p_partkey')} AS endpoint,
 CASE WHEN p_size % 3 = 0 THEN 'gif' ELSE 'png' END AS fmt, CASE WHEN p_size % 2 = 0 THEN '18x24' END AS size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE '1708' END AS huc,
 CASE WHEN p_size % 4 = 0 THEN NULL ELSE 2015 END AS year FROM part)
SELECT k, 'endpoint' AS rule FROM e WHERE endpoint = 'hologram'
UNION ALL SELECT k, 'format' FROM e WHERE (endpoint = 'animation' AND fmt <> 'gif') OR (endpoint IN ('digital_image', 'print_image', 'report') AND fmt = 'gif')
UNION ALL SELECT k, 'size' FROM e WHERE endpoint = 'print_image' AND size IS NULL
UNION ALL SELECT k, 'huc' FROM e WHERE endpoint = 'report' AND huc IS NULL UNION ALL SELECT k, 'period' FROM e WHERE endpoint = 'animation' AND year IS NULL""")
def _(spark, sf):
    e = T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("request_id"), F.lit("Oregon").alias("region"),
        F.lit("neon-basin").alias("style"), F.expr(pick(tuple(X.ENDPOINTS) + ("hologram",), "p_partkey")).alias("endpoint"),
        F.array(F.expr("CASE WHEN p_size % 3 = 0 THEN 'gif' ELSE 'png' END")).alias("formats"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN '18x24' END").alias("size"), F.expr("CASE WHEN p_size % 5 <> 0 THEN '1708' END").alias("huc"),
        F.expr("CASE WHEN p_size % 4 <> 0 THEN 2015 END").alias("year"), F.lit(None).cast("array<int>").alias("months"))
    return O.endpoint_problems(e).select("k", F.explode("problems").alias("rule"))


@query("rights_gate", "PRJ-15", sql=ctes("orders_t") + " SELECT order_id, style FROM orders_t WHERE style IN ('cream-basin', 'museum-divide')")
def _(spark, sf):
    styles = spark.createDataFrame([(s, s in ("cream-basin", "museum-divide")) for s in X.ORDER_STYLES], "style string, uses_restricted boolean")
    return O.unsellable(role(spark, sf, "orders_t"), styles).select("order_id", "style")


@query("address_rules", "PRJ-16", sql="""WITH a AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'Main St' END AS street,
 CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '97201' WHEN 2 THEN '97201-1234' ELSE '9720' END AS zip FROM customer)
SELECT k, 'street' AS rule FROM a WHERE trim(street) = '' UNION ALL SELECT k, 'zip' FROM a WHERE zip = ''
UNION ALL SELECT k, 'zip_format' FROM a WHERE zip <> '' AND NOT regexp_full_match(zip, '\\d{5}(-\\d{4})?')""")
def _(spark, sf):
    a = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'Main St' END").alias("street"),
        F.lit("Vancouver").alias("city"), F.lit("WA").alias("state"), F.lit("").alias("line2"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '97201' WHEN 2 THEN '97201-1234' ELSE '9720' END").alias("zip"))
    return O.address_problems(a).select("k", F.explode("problems").alias("rule"))


@query("print_cost", "FN-18", sql=f"""WITH e AS (SELECT p_partkey AS k, {pick(tuple(X.SIZES) + ('9x9',), 'p_partkey')} AS size, {pick(tuple(X.PAPER_SURCHARGE) + ('velvet',), 'p_size')} AS paper FROM part)
SELECT k, CASE size WHEN '12x16' THEN 2500 WHEN '18x24' THEN 3500 WHEN '24x36' THEN 5500 ELSE 3500 END + CASE paper WHEN 'glossy' THEN 500 WHEN 'canvas' THEN 1500 ELSE 0 END AS cents FROM e""")
def _(spark, sf):
    e = T.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(pick(tuple(X.SIZES) + ("9x9",), "p_partkey")).alias("size"),
                                          F.expr(pick(tuple(X.PAPER_SURCHARGE) + ("velvet",), "p_size")).alias("paper"))
    return e.select("k", O.print_cost(F.col("size"), F.col("paper")).alias("cents"))


@query("deliverable_plan", "FN-18", sql=f"""WITH o AS (SELECT concat('ORD-', o_orderkey) AS order_id, {pick(X.ORDER_STYLES, 'o_orderkey')} AS style, {pick(tuple(X.SIZES), 'o_orderkey')} AS size, o_orderkey AS k FROM orders),
 s AS (SELECT *, concat(order_id, '_oregon-clark_', style, '_', size) AS stem, CASE size WHEN '12x16' THEN 3600 WHEN '18x24' THEN 5400 ELSE 7200 END AS w, CASE size WHEN '12x16' THEN 4800 WHEN '18x24' THEN 7200 ELSE 10800 END AS h FROM o)
SELECT order_id, 'print' AS kind, concat(stem, '.png') AS filename, w AS width_px, h AS height_px FROM s
UNION ALL SELECT order_id, 'print', concat(stem, '.pdf'), w, h FROM s WHERE k % 2 = 0
UNION ALL SELECT order_id, 'vector', concat(stem, '.svg'), NULL, NULL FROM s WHERE k % 3 = 0""")
def _(spark, sf):
    k = F.col("o_orderkey")
    o = T.table(spark, sf, "orders").select(
        F.concat(F.lit("ORD-"), k).alias("order_id"), F.lit("Oregon").alias("region"), F.lit("Clark").alias("county"),
        F.expr(pick(X.ORDER_STYLES, "o_orderkey")).alias("style"), F.expr(pick(tuple(X.SIZES), "o_orderkey")).alias("size"),
        F.when(k % 2 == 0, F.array(F.lit("png"), F.lit("pdf"))).otherwise(F.array(F.lit("png"))).alias("formats"),
        F.when(k % 3 == 0, F.array(F.lit("svg"))).otherwise(F.array().cast("array<string>")).alias("add_ons"))
    return O.deliverables(o).select("order_id", "kind", "filename", "width_px", "height_px")


@query("endpoint_plan", "FN-18", sql=f"""WITH o AS (SELECT concat('R-', p_partkey) AS request_id, {pick(tuple(X.ENDPOINTS), 'p_partkey')} AS endpoint FROM part),
 f AS (SELECT * FROM (VALUES ('digital_image','svg','digital'),('digital_image','png','digital'),('animation','gif','motion'),('print_image','png','print'),('print_image','pdf','print'),
  ('report','html','report'),('report','png','report'),('report','pdf','report')) v(endpoint, fmt, suffix))
SELECT request_id, o.endpoint, concat(request_id, '_oregon-clark_neon-basin_', suffix, '.', fmt) AS filename, CASE WHEN o.endpoint = 'print_image' THEN 5400 END AS width_px FROM o JOIN f ON f.endpoint = o.endpoint""")
def _(spark, sf):
    o = T.table(spark, sf, "part").select(
        F.concat(F.lit("R-"), "p_partkey").alias("request_id"), F.lit("Oregon").alias("region"), F.lit("Clark").alias("county"),
        F.lit("neon-basin").alias("style"), F.lit("18x24").alias("size"), F.expr(pick(tuple(X.ENDPOINTS), "p_partkey")).alias("endpoint"),
        F.array(*[F.lit(f) for f in ("svg", "png", "gif", "pdf", "html")]).alias("formats"))
    return O.endpoint_files(o).select("request_id", "endpoint", "filename", "width_px")


@query("attribution_line", "AGG-41", sql="""WITH s AS (SELECT DISTINCT s_nationkey AS k, concat('Source ', s_suppkey % 7) AS name, CASE WHEN s_suppkey % 2 = 0 THEN '2' END AS version FROM supplier)
SELECT k, string_agg(CASE WHEN version IS NULL THEN name ELSE concat(name, ' v', version) END, ' · ' ORDER BY name, version IS NOT NULL) AS credit FROM s GROUP BY 1""")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("Source "), F.col("s_suppkey") % 7).alias("name"),
                                              F.when(F.col("s_suppkey") % 2 == 0, "2").alias("version"))
    return O.attribution_line(s, ["k"])


@query("combined_manifest", "AGG-40", sql=f"""WITH r AS (SELECT p_partkey // 4 AS k, p_brand AS region, {pick(tuple(X.ENDPOINTS), 'p_partkey')} AS endpoint, CASE WHEN p_size > 30 THEN 'x' ELSE 'y' END AS style FROM part),
 g AS (SELECT k FROM r GROUP BY k HAVING count(DISTINCT style) = 1 AND count(DISTINCT endpoint) = count(*))
SELECT k, any_value(style) AS style, count(*) AS endpoints FROM r WHERE k IN (SELECT k FROM g) GROUP BY k""")
def _(spark, sf):
    r = T.table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 4).alias("k"), F.lit("Oregon").alias("region"), F.lit("Clark").alias("county"),
        F.expr(pick(tuple(X.ENDPOINTS), "p_partkey")).alias("endpoint"), F.expr("CASE WHEN p_size > 30 THEN 'x' ELSE 'y' END").alias("style"),
        F.col("p_name").alias("manifest"))
    return O.combined_manifest(r, "k").select("k", "style", F.size("endpoints").alias("endpoints"))


_ANALYTICS = ctes("places", "requests", "work_events") + """, o AS (SELECT r.*, p.region, p.county FROM requests r LEFT JOIN places p ON p.place_id = r.place_id),
 f AS (SELECT request_id, max(CASE WHEN event = 'proof_ready' THEN 1 ELSE 0 END) AS p, max(CASE WHEN event = 'approved' THEN 1 ELSE 0 END) AS a, max(CASE WHEN event = 'paid' THEN 1 ELSE 0 END) AS d FROM work_events GROUP BY 1)"""


@query("product_analytics", "AGG-38", sql=_ANALYTICS + """
SELECT 'orders_by_product' AS metric, product AS key, CAST(count(*) AS DOUBLE) AS value FROM o GROUP BY product
UNION ALL SELECT 'orders_by_region', region, count(*) FROM o GROUP BY region UNION ALL SELECT 'top_counties', county, count(*) FROM o GROUP BY county
UNION ALL SELECT 'proof_acceptance_rate', '', round(sum(a) / sum(p), 6) FROM f UNION ALL SELECT 'payment_conversion_rate', '', round(sum(d) / sum(a), 6) FROM f
UNION ALL SELECT 'average_render_time_s', '', round(avg(duration_s), 6) FROM work_events WHERE event = 'render_completed'
UNION ALL SELECT 'total_orders', '', count(*) FROM o""")
def _(spark, sf):
    places = role(spark, sf, "places")
    orders = role(spark, sf, "requests").join(places.select("place_id", "region", "county"), "place_id", "left")
    return O.product_analytics(orders, role(spark, sf, "work_events")).select("metric", "key", R(F.col("value")).alias("value"))


@query("top_counties", "SRT-07", sql=_ANALYTICS + """
SELECT county, n, rank FROM (SELECT county, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(pos)) AS rank FROM o GROUP BY county) WHERE rank <= 10""")
def _(spark, sf):
    places = role(spark, sf, "places")
    orders = role(spark, sf, "requests").join(places.select("place_id", "region", "county"), "place_id", "left")
    top = (orders.groupBy("county").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
           .orderBy(F.col("n").desc(), "first").limit(10))
    # ten rows are left: numbering them in one task is the top-k report itself
    from pyspark.sql import Window
    return top.select("county", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "first")).alias("rank"))
