"""Order intake rules, planned files, prices, product analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.operators.classify import lookup


def clean_text(c: Column, cap: int) -> Column:
    """Whitespace collapsed and trimmed, blank becomes null, cut at ``cap`` characters."""
    text = F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(text != "", F.substring(text, 1, cap))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _all_in(items: Column, allowed) -> Column:
    return F.forall(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isin(*allowed))


def order_problems(payloads: DataFrame, regions=X.STATES, styles=X.ORDER_STYLES) -> DataFrame:
    """Adds ``problems``: every rule the payload breaks, and the cleaned text fields."""
    has_format = F.coalesce(F.size("formats"), F.lit(0)) > 0
    rules = [
        (_blank(F.col("order_id")), "order_id"),
        (~F.coalesce(F.col("region").isin(*regions), F.lit(False)), "region"),
        (_blank(F.col("county")), "county"),
        (~F.coalesce(F.col("style").isin(*styles), F.lit(False)), "style"),
        (~F.coalesce(F.col("size").isin(*X.SIZES), F.lit(False)), "size"),
        (~has_format, "no_format"),
        (~_all_in(F.col("formats"), X.PRINT_FORMATS), "format"),
        (~_all_in(F.col("add_ons"), X.ADD_ONS), "add_on"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    return (payloads.withColumn("problems", found)
            .withColumn("title", clean_text(F.col("title"), X.TITLE_MAX))
            .withColumn("subtitle", clean_text(F.col("subtitle"), X.SUBTITLE_MAX))
            .withColumn("buyer_ref", clean_text(F.col("buyer_ref"), X.BUYER_REF_MAX)))


def endpoint_problems(requests: DataFrame, regions=X.STATES, styles=X.ORDER_STYLES) -> DataFrame:
    """Rules per endpoint: its own formats, print needs a size, report a basin, animation a period."""
    e = F.col("endpoint")
    formats = F.coalesce(F.col("formats"), F.array().cast("array<string>"))
    own = F.lit(False)
    for name, (_, fmts) in X.ENDPOINTS.items():
        own = own | ((e == name) & _all_in(formats, [a for a, _ in fmts]))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [
        (_blank(F.col("request_id")), "request_id"),
        (no(F.col("region").isin("CONUS", *regions)), "region"),
        (no(e.isin(*X.ENDPOINTS)), "endpoint"),
        (no(F.col("style").isin(*styles)), "style"),
        (e.isin(*X.ENDPOINTS) & no(own), "format"),
        ((e == "print_image") & no(F.col("size").isin(*X.SIZES)), "size"),
        ((e == "report") & _blank(F.col("huc")), "huc"),
        ((e == "animation") & F.col("year").isNull() & (F.coalesce(F.size("months"), F.lit(0)) <= 0), "period"),
    ]
    return requests.withColumn("problems", F.array_compact(F.array(
        *[F.when(bad, F.lit(name)) for bad, name in rules])))


def unsellable(orders: DataFrame, styles: DataFrame) -> DataFrame:
    """Orders whose style derives from restricted climate data; must be empty to sell."""
    return orders.join(styles.where("uses_restricted"), "style", "left_semi")


def address_problems(addresses: DataFrame) -> DataFrame:
    parts = ("name", "street", "city", "state", "zip")
    rules = [F.when(_blank(F.col(p)), F.lit(p)) for p in parts]
    bad_zip = ~_blank(F.col("zip")) & ~F.trim("zip").rlike(X.ZIP_CODE)
    return addresses.withColumn("problems", F.array_compact(F.array(
        *rules, F.when(bad_zip, F.lit("zip_format"))))).withColumn("line2", F.nullif(F.trim("line2"), F.lit("")))


def print_cost(size: Column, paper: Column) -> Column:
    return (F.coalesce(lookup(X.PRINT_COST, size), F.lit(X.PRINT_COST_DEFAULT))
            + F.coalesce(lookup(X.PAPER_SURCHARGE, paper), F.lit(0)))


def default_title(county: Column) -> Column:
    full = F.when(F.lower(county).endswith("county"), county).otherwise(F.concat(county, F.lit(" County")))
    return F.initcap(F.concat(full, F.lit(" Watersheds")))


def file_stem(order_id: Column, region: Column, county: Column, style: Column, last: Column) -> Column:
    place = F.concat_ws("-", F.lower(region), F.nullif(F.replace(F.lower(county), F.lit(" "), F.lit("-")), F.lit("")))
    return F.concat_ws("_", order_id, place, style, last)


def deliverables(orders: DataFrame) -> DataFrame:
    """One row per planned file: prints in every asked format, then vector and license."""
    stem = file_stem(F.col("order_id"), F.col("region"), F.col("county"), F.col("style"), F.col("size"))
    px = lambda axis: lookup({k: v[axis] * v[2] for k, v in X.SIZES.items()}, F.col("size"))
    item = lambda kind, fmt, tail, w, h: F.struct(
        F.lit(kind).alias("kind"), F.lit(fmt).alias("fmt"), F.concat(stem, F.lit(tail)).alias("filename"),
        w.cast("int").alias("width_px"), h.cast("int").alias("height_px"))
    none = F.lit(None)
    picks = [F.when(F.array_contains("formats", f), item("print", f, f".{f}", px(0), px(1))) for f in X.PRINT_FORMATS]
    picks.append(F.when(F.array_contains("add_ons", "svg"), item("vector", "svg", ".svg", none, none)))
    picks.append(F.when(F.array_contains("add_ons", "commercial_license"),
                        item("license", "txt", "_license.txt", none, none)))
    return orders.select("order_id", F.posexplode(F.array_compact(F.array(*picks))).alias("_p", "_d")).select(
        "order_id", (F.col("_p") + 1).alias("seq"), "_d.*")


def endpoint_files(requests: DataFrame) -> DataFrame:
    """One row per file an endpoint request yields, in the endpoint's own format order."""
    rows = []
    for name, (suffix, fmts) in X.ENDPOINTS.items():
        stem = file_stem(F.col("request_id"), F.col("region"), F.col("county"), F.col("style"), F.lit(suffix))
        printed = F.lit(name == "print_image")
        px = lambda axis: F.when(printed, lookup({k: v[axis] * v[2] for k, v in X.SIZES.items()}, F.col("size")))
        items = [F.when(F.array_contains("formats", f), F.struct(
            F.lit(kind).alias("kind"), F.lit(f).alias("fmt"), F.concat(stem, F.lit(f".{f}")).alias("filename"),
            px(0).cast("int").alias("width_px"), px(1).cast("int").alias("height_px"))) for f, kind in fmts]
        rows.append(F.when(F.col("endpoint") == name, F.array_compact(F.array(*items))))
    return requests.select("request_id", "endpoint", F.posexplode(F.coalesce(*rows)).alias("_p", "_d")).select(
        "request_id", "endpoint", (F.col("_p") + 1).alias("seq"), "_d.*")


def attribution_line(sources: DataFrame, keys: list[str], sep: str = " · ") -> DataFrame:
    """Name-sorted credit line per key over its distinct sources."""
    label = F.when(F.col("version").isNotNull(), F.concat("name", F.lit(" v"), "version")).otherwise(F.col("name"))
    named = sources.select(*keys, "name", label.alias("_l")).distinct()
    return named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("name", "_l"))), lambda s: s["_l"]), sep).alias("credit"))


def identity_conflicts(results: DataFrame, key: str) -> DataFrame:
    """Result sets that cannot be combined: mixed region/county/style, or an endpoint twice."""
    return results.groupBy(key).agg(
        F.count_distinct(F.struct("region", "county", "style")).alias("identities"),
        (F.count("endpoint") - F.count_distinct("endpoint")).alias("repeated_endpoints"),
    ).where("identities <> 1 OR repeated_endpoints > 0")


def combined_manifest(results: DataFrame, key: str) -> DataFrame:
    """Map endpoint -> manifest per result set; at most one entry per endpoint exists."""
    sound = results.join(identity_conflicts(results, key), key, "left_anti")
    return sound.groupBy(key, "region", "county", "style").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("endpoint", "manifest")))).alias("endpoints"))


def product_analytics(orders: DataFrame, events: DataFrame) -> DataFrame:
    """``(metric, key, value, rank)`` from ``orders(request_id, product, region, county, pos)``
    and flat ``events(request_id, event, duration_s)``.

    Flags per request come from conditional maxima, so a request with a very long
    event history is combined on the map side.
    """
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    def counts(metric: str, col: str) -> DataFrame:
        return orders.groupBy(unknown(F.col(col)).alias("key")).agg(
            F.count("*").cast("double").alias("value"), F.min("pos").alias("first_pos")).select(
            F.lit(metric).alias("metric"), "key", "value", "first_pos")
    flag = lambda name: F.max((F.col("event") == name).cast("int"))
    per = events.groupBy("request_id").agg(flag("proof_ready").alias("p"), flag("approved").alias("a"),
                                           flag("paid").alias("d"))
    rate = lambda up, down: F.coalesce(F.try_divide(F.sum(up), F.sum(down)), F.lit(0.0))
    rates = per.agg(rate("a", "p").alias("proof_acceptance_rate"), rate("d", "a").alias("payment_conversion_rate"))
    timing = events.where("event = 'render_completed' AND duration_s IS NOT NULL").agg(
        F.coalesce(F.avg("duration_s"), F.lit(0.0)).alias("average_render_time_s"))
    total = orders.agg(F.count("*").cast("double").alias("total_orders"))
    def single(df: DataFrame) -> DataFrame:
        packed = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        return df.select(F.explode(packed).alias("m")).select(
            "m.metric", F.lit("").alias("key"), "m.value", F.lit(None).cast("bigint").alias("first_pos"))
    out = counts("orders_by_product", "product").unionByName(counts("orders_by_region", "region"))
    out = out.unionByName(counts("top_counties", "county"))
    for part in (rates, timing, total):
        out = out.unionByName(single(part))
    return out
