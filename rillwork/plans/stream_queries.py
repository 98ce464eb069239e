"""Streams over the given tables, run until all that is available is read, with batch answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.operators.scale import fold_states
from rillwork.plans import standins as T
from rillwork.plans.registry import query
from rillwork.plans.standins import R
from rillwork.session import work_folder
from rillwork.streaming import aggregates as A
from rillwork.streaming import lifecycle as L

_ORDER_STEP = {"signup": "accepted", "view": "rendering", "click": "proof_ready", "purchase": "approved", "error": "revision_requested"}
_CATALOG_STEP = {"signup": "review", "view": "published", "click": "archived", "purchase": "review", "error": "rejected"}


def _case(steps: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in steps.items()) + " END"


def _steps(df, steps):
    return df.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", F.expr(_case(steps)).alias("target"))


def _machine_sql(steps: dict[str, str], moves: dict, start: str) -> str:
    legal = ", ".join(f"('{a}', '{b}')" for a, to in moves.items() for b in sorted(to))
    return f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, {_case(steps)} AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 legal AS (SELECT * FROM (VALUES {legal}) v(a, b)),
 r AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS before, '{start}' AS after, false AS ok FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, e.event_id, r.after, CASE WHEN l.a IS NULL THEN r.after ELSE e.target END, l.a IS NOT NULL
   FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1 LEFT JOIN legal l ON l.a = r.after AND l.b = e.target)
SELECT key, event_id, before AS state_before, after AS state_after, ok AS accepted FROM r WHERE k > 0"""


_COLS = ("key", "event_id", "state_before", "state_after", "accepted")


@query("order_lifecycle_stream", "STR-01", sql=_machine_sql(_ORDER_STEP, X.ORDER_TRANSITIONS, "submitted"))
def _(spark, sf):
    stream = _steps(A.table_stream(spark, sf, "events"), _ORDER_STEP)
    return L.run_machine(stream, X.ORDER_STATUSES, X.ORDER_TRANSITIONS, "submitted", A.time_span(spark, sf, "events", "ts")).select(*_COLS)


@query("order_lifecycle_batch", "STR-01", sql=_machine_sql(_ORDER_STEP, X.ORDER_TRANSITIONS, "submitted"))
def _(spark, sf):
    out = fold_states(_steps(T.table(spark, sf, "events"), _ORDER_STEP), "key", ["ts", "event_id"], "target", X.ORDER_STATUSES, X.ORDER_TRANSITIONS, "submitted")
    return out.select(*_COLS)


@query("catalog_lifecycle", "STR-02", sql=_machine_sql(_CATALOG_STEP, X.CATALOG_TRANSITIONS, "draft"))
def _(spark, sf):
    out = fold_states(_steps(T.table(spark, sf, "events"), _CATALOG_STEP), "key", ["ts", "event_id"], "target", X.CATALOG_STATUSES, X.CATALOG_TRANSITIONS, "draft")
    return out.select(*_COLS)


@query("catalog_lifecycle_stream", "STR-02", sql=_machine_sql(_CATALOG_STEP, X.CATALOG_TRANSITIONS, "draft"))
def _(spark, sf):
    stream = _steps(A.table_stream(spark, sf, "events"), _CATALOG_STEP)
    return L.run_machine(stream, X.CATALOG_STATUSES, X.CATALOG_TRANSITIONS, "draft", A.time_span(spark, sf, "events", "ts")).select(*_COLS)


@query("payment_events", "STR-03", sql="SELECT CAST(user_id AS VARCHAR) AS key, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def _(spark, sf):
    # every notice is delivered twice
    stream = A.table_stream(spark, sf, "events").where("event_type = 'purchase'").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    notices = stream.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", F.lit("paid").alias("target"))
    return L.run_payments(notices, X.ORDER_STATUSES, X.ORDER_TRANSITIONS, A.time_span(spark, sf, "events", "ts")).where("accepted").select("key", "event_id")


@query("audit_log", "STR-04", sql="SELECT 'request' AS entity_type, event_type AS event_name, count(*) AS n FROM events GROUP BY 2")
def _(spark, sf):
    base = f"{work_folder(spark)}/audit-{uuid.uuid4().hex}"
    stream = A.table_stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_type").alias("event_name"), "value")
    sink = L.audit_sink(f"{base}/facts", f"{base}/events", "request", ("signup", "view", "click", "purchase", "error"))
    run = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    return spark.read.option("basePath", f"{base}/events").parquet(f"{base}/events").groupBy("entity_type", "event_name").agg(F.count("*").alias("n"))


@query("gauge_stream", "STR-05", sql="SELECT user_id % 10 AS site, date_trunc('month', ts)::TIMESTAMP AS month, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    readings = A.table_stream(spark, sf, "events").select((F.col("user_id") % 10).alias("site"), "ts", "value")
    return A.drained(A.gauge_running(readings), "update", ("site", "month")).withColumn("mean", R(F.col("mean")))


# a revocation before, at or after the end of the grant
_REVOKED_AFTER = "CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 45 WHEN o_orderkey % 13 = 0 THEN 60 END"


@query("delivery_expiry_stream", "STR-06", sql=f"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderdate AS ts, {_REVOKED_AFTER} AS d FROM orders),
 n AS (SELECT max(greatest(ts, ts + coalesce(d, 0) * INTERVAL 1 DAY)) AS newest FROM o)
SELECT key, CAST(ts + d * INTERVAL 1 DAY AS TIMESTAMP) AS at, 'revoked' AS access FROM o WHERE d IS NOT NULL
UNION ALL SELECT key, CAST(ts + INTERVAL 45 DAY AS TIMESTAMP), 'expired' FROM o, n WHERE coalesce(d, 60) > 45 AND ts + INTERVAL 45 DAY <= newest""")
def _(spark, sf):
    day = F.expr(_REVOKED_AFTER)
    change = lambda ts, kind: F.struct(ts.alias("ts"), F.lit(kind).alias("kind"))
    when = F.col("o_orderdate")
    changes = F.array_compact(F.array(change(when, "granted"), F.when(day.isNotNull(), change(when + F.make_dt_interval(day), "revoked"))))
    stream = A.table_stream(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.explode(changes).alias("c"),
                                                        (when + F.expr("INTERVAL 45 DAYS")).alias("expires_at"))
    return L.run_expiry(stream.select("key", "c.ts", "c.kind", "expires_at"), "3000 days").select("key", "at", "access")


@query("gauge_days", "STR-05", sql="""WITH d AS (SELECT user_id % 10 AS site, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2)
SELECT site, day, round(total, 4) AS total, n FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def _(spark, sf):
    # the files need not be in time order, so no watermark may pass before all are read
    readings = A.table_stream(spark, sf, "events", None).select((F.col("user_id") % 10).alias("site"), "ts", "value")
    return A.drained(A.gauge_daily(readings, "2 days")).withColumn("total", R(F.col("total"), 4))


@query("gauge_month_means", "STR-05", sql="""WITH d AS (SELECT l_suppkey % 10 AS site, date_trunc('day', l_shipdate) AS day, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2),
 m AS (SELECT site, CAST(date_trunc('month', day) AS DATE) AS month, avg(mean) AS mean, count(*) AS days, sum(n)::BIGINT AS readings FROM d GROUP BY 1, 2),
 late AS (SELECT max(epoch(l_shipdate)) AS newest, max(l_shipdate) AS newest_day FROM lineitem),
 clock AS (SELECT ((year(newest_day) - 1970) * 12 + month(newest_day) - 1) * 31 + day(newest_day) - 1 + (newest - epoch(date_trunc('day', newest_day))) / 86400.0 - 5 AS upto FROM late)
SELECT site, month, round(mean, 6) AS mean, days, readings FROM m, clock WHERE ((year(month) - 1970) * 12 + month(month)) * 31 <= upto""")
def _(spark, sf):
    # one file a trigger; the watermark closes a month once a later trigger or the last one has passed it
    readings = A.table_stream(spark, sf, "lineitem", 1).select((F.col("l_suppkey") % 10).alias("site"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"))
    return A.drained(A.gauge_monthly(readings)).withColumn("mean", R(F.col("mean")))


@query("event_rate", "STR-07", sql="""WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP - back * INTERVAL 1 DAY AS start, event_type AS event, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS back) GROUP BY 1, 2)
SELECT start, event, n FROM w WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(spark, sf):
    events = A.table_stream(spark, sf, "events", None).select("ts", F.col("event_type").alias("event"))
    return A.drained(A.event_rate(events))


@query("live_counters", "STR-07", sql="SELECT concat('P', user_id % 4) AS product, event_type AS event, count(*) AS n, round(sum(value), 4) AS duration_s FROM events GROUP BY 1, 2")
def _(spark, sf):
    stream = A.table_stream(spark, sf, "events").select(F.concat(F.lit("P"), F.col("user_id") % 4).alias("product"), F.col("event_type").alias("event"), F.col("value").alias("duration_s"))
    return A.drained(A.product_counters(stream), "update", ("product", "event")).withColumn("duration_s", R(F.col("duration_s"), 4))
