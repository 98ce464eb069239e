"""Ledger, catalog and manifest roles played by the given tables, in Spark and in SQL.

One SQL text per role is written so that both engines accept it, which keeps the
two sides of the check on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillwork import fixed_values as X
from rillwork.plans import standins as T


def pick(values, expr: str) -> str:
    """SQL picking one of a short list by an integer expression."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({expr} AS INTEGER) % {len(values)} {arms} END"


ROLES = {
    "places": """SELECT concat('PLC-', n_nationkey) AS place_id, r_name AS region, n_name AS county,
        concat(n_name, ', ', r_name) AS display_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "requests": f"""SELECT concat('REQ-', o_orderkey) AS request_id, o_orderpriority AS product,
        {pick(X.ORDER_STATUSES, 'o_orderkey')} AS status, concat('PLC-', c_nationkey) AS place_id,
        o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS updated_at, o_orderkey AS pos
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "orders_t": f"""SELECT concat('ORD-', o_orderkey) AS order_id, concat('REQ-', o_orderkey) AS request_id,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('PLC-', o_custkey % 25) END AS place_id,
        {pick(X.ORDER_STYLES, 'o_orderkey')} AS style FROM orders WHERE o_orderkey % 3 <> 0""",
    "assets": f"""SELECT concat('AST-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS asset_id,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('ORD-', l_orderkey) END AS order_id,
        CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('JOB-', l_orderkey) END AS render_job_id,
        {pick(X.ASSET_ROLES, 'l_linenumber')} AS role, concat('runs/', l_partkey, '.png') AS storage_key,
        CASE WHEN l_discount = 0 THEN NULL ELSE md5(CAST(l_partkey AS STRING)) END AS checksum_sha256,
        'image/png' AS media_type, CASE WHEN l_linestatus = 'O' THEN 'internal' ELSE 'approved_public' END AS visibility,
        CASE l_returnflag WHEN 'A' THEN 'cleared' WHEN 'N' THEN 'pending' ELSE 'restricted' END AS rights_status,
        CASE WHEN l_tax = 0 THEN NULL ELSE 'public survey data' END AS source_attribution,
        CASE WHEN l_quantity > 49 THEN l_shipdate END AS deleted_at, l_shipdate AS created_at FROM lineitem""",
    "deliveries": """SELECT concat('DLV-', o_orderkey) AS delivery_id, concat('ORD-', o_orderkey) AS order_id,
        o_orderdate AS delivered_at, o_orderdate + INTERVAL 45 DAY AS access_expires_at,
        CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS access_revoked_at,
        o_orderpriority AS reason, o_orderkey % 2 = 0 AS fee_waived FROM orders WHERE o_orderkey % 4 = 0""",
    "render_jobs": f"""SELECT concat('JOB-', o_orderkey) AS job_id, concat('ORD-', o_orderkey) AS order_id,
        {pick(('pending', 'running', 'succeeded', 'failed', 'cancelled'), 'o_orderkey')} AS status,
        CASE WHEN o_orderkey % 5 = 3 THEN 'renderer stopped' END AS error_message, o_orderdate AS started_at,
        o_orderdate + INTERVAL 1 DAY AS completed_at, md5(CAST(o_custkey AS STRING)) AS recipe_digest,
        'r1' AS code_revision, o_orderdate AS created_at FROM orders""",
    "runs": """SELECT concat('RUN-', p_partkey) AS run_id, concat('PLC-', p_partkey % 25) AS place_id, 'v1' AS metric_version,
        CASE WHEN p_size > 25 THEN 'validated' ELSE 'draft' END AS validation_status, 1950 + p_size AS start_year,
        2000 + p_size AS end_year, p_brand AS reviewer, p_partkey AS created_at FROM part""",
    "metrics": """SELECT concat('MET-', l_orderkey, '-', l_linenumber, '-', l_suppkey) AS metric_id, concat('RUN-', l_partkey) AS run_id,
        l_returnflag AS name, l_shipdate AS created_at FROM lineitem""",
    "entries": f"""SELECT p_brand AS region, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS county,
        {pick(X.ORDER_STYLES, 'p_size')} AS style, {pick(tuple(X.ENDPOINTS), 'p_partkey')} AS endpoint,
        CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '12x16' WHEN 2 THEN '18x24' ELSE '24x36' END AS size,
        concat('work-', p_partkey % 500) AS entry_id, CAST(p_partkey AS INTEGER) AS version,
        {pick(X.CATALOG_STATUSES, 'p_partkey')} AS status,
        CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'featured' WHEN 2 THEN 'by-region' WHEN 3 THEN 'seasonal'
             WHEN 4 THEN 'staff-picks' ELSE 'limited-edition' END AS section,
        p_size AS sort_order, p_name AS title FROM part""",
    "old_files": """SELECT concat('nhd/', lpad(CAST(o_custkey % 100 AS STRING), 4, '0'), '/', o_orderkey, '.zip') AS key,
        md5(CAST(o_custkey AS STRING)) AS checksum, o_custkey AS size, concat('f/', o_orderkey) AS relative_path
        FROM orders WHERE o_orderkey % 10 <> 0""",
    "new_files": """SELECT concat('nhd/', lpad(CAST(o_custkey % 100 AS STRING), 4, '0'), '/', o_orderkey, '.zip') AS key,
        md5(CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING)) AS checksum,
        CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size, concat('f/', o_orderkey) AS relative_path
        FROM orders WHERE o_orderkey % 10 <> 1""",
    "work_events": """SELECT concat('REQ-', l_orderkey) AS request_id,
        CASE l_linenumber % 5 WHEN 0 THEN 'proof_ready' WHEN 1 THEN 'approved' WHEN 2 THEN 'paid'
             WHEN 3 THEN 'render_completed' ELSE 'note' END AS event,
        CASE WHEN l_linenumber % 5 = 3 AND l_tax > 0 THEN l_quantity END AS duration_s FROM lineitem""",
}

NOW = "TIMESTAMP '1998-06-15 00:00:00'"


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The role as a DataFrame: given tables become views of this session only."""
    for t in ("nation", "region", "orders", "customer", "lineitem", "part", "supplier"):
        if t in ROLES[name].split():
            T.table(spark, sf_dir, t).createOrReplaceTempView(f"rw_{t}")
    words = ROLES[name]
    for t in ("nation", "region", "orders", "customer", "lineitem", "part", "supplier"):
        words = words.replace(f"FROM {t} ", f"FROM rw_{t} ").replace(f"JOIN {t} ", f"JOIN rw_{t} ")
        if words.endswith(f"FROM {t}"):
            words = words[: -len(t)] + f"rw_{t}"
    return spark.sql(words)


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({ROLES[n].replace('AS STRING', 'AS VARCHAR')})" for n in names)
