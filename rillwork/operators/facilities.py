"""Water-facility records: source contracts, identity matching, measurements, evidence, claims.

The match score weights and thresholds are this library's own choice (see README);
the published rules fix only what counts as a sure, an ambiguous and a distinct pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.operators.classify import lookup
from rillwork.operators.spatial import skew_join
from rillwork.session import checkpointed

HIGH_CONFIDENCE, REVIEW_CONFIDENCE = 0.85, 0.6
NAME_WEIGHT, ADDRESS_WEIGHT, DISTANCE_WEIGHT = 0.5, 0.2, 0.3
SITE_RADIUS_M = 500.0


# --- sources ------------------------------------------------------------------------

def normalize_registry(rows: DataFrame) -> DataFrame:
    """Facility-registry rows to the common contract; the source row is kept as JSON."""
    return rows.select(
        F.lit("EPA_FRS").alias("authority"), F.col("REGISTRY_ID").alias("external_id"), F.trim("PRIMARY_NAME").alias("name"),
        F.trim("CITY_NAME").alias("address"), F.upper(F.trim("STATE_CODE")).alias("jurisdiction"),
        F.col("LATITUDE83").try_cast("double").alias("lat"), F.col("LONGITUDE83").try_cast("double").alias("lon"),
        F.col("NAICS_CODES").alias("naics"), F.to_json(F.struct(*rows.columns)).alias("raw_row"))


def normalize_discharge(rows: DataFrame) -> DataFrame:
    """Permit discharges as measurements; a discharge is never read as a withdrawal."""
    return rows.select(F.col("permit_id").alias("facility_id"), F.lit("discharged").alias("measure_type"), F.lit("reported").alias("quantity_status"),
                       F.col("value").cast("decimal(20,6)").alias("canonical_value"), "period_start", "period_end")


def keyed_source(rows: DataFrame, method: str, key: str) -> DataFrame:
    """Adapter rows keyed by access method and id, raw row kept."""
    prefix = {"api": "API:", "bulk_file": "BULK:", "arcgis_service": "ARCGIS:"}[method]
    return rows.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("source_key"), F.to_json(F.struct(*rows.columns)).alias("raw_row"))


def registry_partition(registry: DataFrame, jurisdiction: str | None = None) -> DataFrame:
    out = registry if jurisdiction is None else registry.where(F.col("jurisdiction") == jurisdiction)
    return out.withColumn("standing", F.when(F.coalesce("verified", F.lit(False)), "verified").otherwise("unverified"))


# --- identity --------------------------------------------------------------------------

def match_by_authority(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Same authority and id is the same facility, confidence 1."""
    ids = known.where("external_id IS NOT NULL AND external_id <> ''").groupBy("authority", "external_id").agg(F.min("facility_id").alias("facility_id"))
    return candidates.join(ids, ["authority", "external_id"]).withColumn("confidence", F.lit(1.0))


def plain_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r"\s+", " "))


def _words(c: Column) -> Column:
    return F.array_distinct(F.split(plain_name(c), " "))


def jaccard(a: Column, b: Column) -> Column:
    wa, wb = _words(a), _words(b)
    return F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def match_by_likeness(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Best-scoring known facility per candidate with a decision: linked, review or distinct.

    Pairs are formed within a jurisdiction between tiles about as wide as the
    search radius, so only nearby sites meet. Two equally good sites go to review.
    """
    # earth-centred positions: one tile size is right at every latitude
    def placed(df: DataFrame) -> DataFrame:
        lat, lon = F.radians(F.col("lat")), F.radians(F.col("lon"))
        cell = lambda v: F.floor(v * 6371008.8 / SITE_RADIUS_M)
        return df.withColumns({"ti": cell(F.cos(lat) * F.cos(lon)), "tj": cell(F.cos(lat) * F.sin(lon)), "tk": cell(F.sin(lat))})
    steps = (-1, 0, 1)
    reach = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(h).alias("h")) for i in steps for j in steps for h in steps])
    asked = placed(candidates).withColumn("_o", F.explode(reach)).select(
        "candidate_id", F.col("name").alias("c_name"), F.col("address").alias("c_address"), "jurisdiction", F.col("lat").alias("c_lat"),
        F.col("lon").alias("c_lon"), (F.col("ti") + F.col("_o.i")).alias("ti"), (F.col("tj") + F.col("_o.j")).alias("tj"), (F.col("tk") + F.col("_o.h")).alias("tk"))
    k = placed(known).select("facility_id", F.col("name").alias("k_name"), F.col("address").alias("k_address"), "jurisdiction",
                             F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon"), "ti", "tj", "tk")
    met = skew_join(asked, k, ["jurisdiction", "ti", "tj", "tk"])
    gap = haversine_m(F.col("c_lat"), F.col("c_lon"), F.col("k_lat"), F.col("k_lon"))
    near = F.greatest(F.lit(0.0), 1 - gap / SITE_RADIUS_M)
    score = NAME_WEIGHT * jaccard(F.col("c_name"), F.col("k_name")) + ADDRESS_WEIGHT * jaccard(F.col("c_address"), F.col("k_address")) + DISTANCE_WEIGHT * near
    scored = met.withColumn("distance_m", gap).where(F.col("distance_m") <= SITE_RADIUS_M).select(
        "candidate_id", "facility_id", F.round(score, 6).alias("score"), "distance_m")
    top = scored.groupBy("candidate_id").agg(F.max("score").alias("best"))
    ties = scored.join(top, "candidate_id").where(F.col("score") == F.col("best")).groupBy("candidate_id").agg(
        F.first("best").alias("score"), F.min("facility_id").alias("facility_id"), F.count("*").alias("equals"))
    out = candidates.select("candidate_id").join(ties, "candidate_id", "left")
    decision = (F.when((F.col("score") >= HIGH_CONFIDENCE) & (F.col("equals") == 1), "linked")
                .when(F.col("score") >= REVIEW_CONFIDENCE, "review").otherwise("distinct"))
    return out.select("candidate_id", "facility_id", F.coalesce("score", F.lit(0.0)).alias("confidence"), decision.alias("decision"))


# --- measurements, evidence, claims -----------------------------------------------------------

def aggregate_measurements(rows: DataFrame, measure_type: str, quantity_status: str | None = None, start=None, end=None,
                           by_facility: bool = False) -> DataFrame:
    """Total and count of one measure type; statuses stay apart, an absent value is not zero."""
    if measure_type not in X.MEASURE_TYPES:
        raise ValueError(f"unknown measure type {measure_type!r}")
    if quantity_status is not None and quantity_status not in X.QUANTITY_STATUSES:
        raise ValueError(f"unknown quantity status {quantity_status!r}")
    chosen = rows.where(F.col("measure_type") == measure_type)
    if quantity_status is not None:
        chosen = chosen.where(F.col("quantity_status") == quantity_status)
    if start is not None:
        chosen = chosen.where(F.col("period_start") >= F.lit(start))
    if end is not None:
        chosen = chosen.where(F.col("period_end") <= F.lit(end))
    keys = ["facility_id", "quantity_status"] if by_facility else ["quantity_status"]
    return chosen.groupBy(*keys).agg(F.sum("canonical_value").alias("total_value"), F.count("canonical_value").alias("count"),
                                     F.count_if(F.col("canonical_value").isNull()).alias("unavailable"))


def best_evidence(facilities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Strongest evidence per facility; an industry code alone leaves a mere candidate."""
    ranked = evidence.withColumn("rank", lookup(X.EVIDENCE_RANK, F.col("kind"))).where("rank IS NOT NULL")
    best = ranked.groupBy("facility_id").agg(F.min(F.struct("rank", "evidence_id", "kind")).alias("b"))
    return facilities.select("facility_id").join(best, "facility_id", "left").select(
        "facility_id", F.col("b.evidence_id").alias("evidence_id"), F.col("b.kind").alias("kind"), F.col("b.rank").alias("rank"),
        F.when(F.col("b").isNull(), "candidate").otherwise("water_relevant").alias("standing"))


def public_claims(claims: DataFrame) -> DataFrame:
    """Reviewed publishable claims; generalized ones lose their exact position."""
    shown = claims.where((F.col("review") == "approved") & F.col("eligibility").isin(*X.CLAIM_PUBLIC))
    exact = F.col("eligibility") == "publishable_precise"
    return shown.withColumn("lat", F.when(exact, F.col("lat"))).withColumn("lon", F.when(exact, F.col("lon")))


#: Widths of the bins that alert periods are entered in, in days: a period touches two bins of its width at most.
BIN_DAYS = tuple(4 ** n for n in range(10))


def attach_alerts(results: DataFrame, alerts: DataFrame, key: str) -> DataFrame:
    """Results with each active alert whose authority and period cover them; none gives one empty row.

    A period is entered in bins as wide as itself or up to four times as wide; a result
    looks into one bin of every width in use. Hot bins are salted.
    """
    a = alerts.where("active").select("alert_id", "authority", F.col("valid_from").cast("timestamp").alias("_f"), F.col("valid_to").cast("timestamp").alias("_t"))
    a = a.where("_f <= _t")
    day = 86_400_000_000
    days = (F.unix_micros("_t") - F.unix_micros("_f")) / day
    width = F.coalesce(*[F.when(days <= w, F.lit(w)) for w in BIN_DAYS], F.lit(BIN_DAYS[-1])).cast("bigint")
    at = lambda c: F.floor(F.unix_micros(c) / (F.col("_w") * day))
    a = checkpointed(a.withColumn("_w", width))
    used = sorted(r[0] for r in a.select("_w").distinct().collect())  # of the ten widths
    a = a.withColumn("_bin", F.explode(F.sequence(at(F.col("_f")), at(F.col("_t")))))
    r = results.select(key, "authority", F.col("as_of").cast("timestamp").alias("_at"), F.explode(
        F.array(*[F.lit(w).cast("bigint") for w in used]) if used else F.array().cast("array<bigint>")).alias("_w"))
    r = r.withColumn("_bin", at(F.col("_at")))
    hits = skew_join(r, a, ["authority", "_w", "_bin"]).where(F.col("_at").between(F.col("_f"), F.col("_t"))).select(key, "alert_id").distinct()
    return results.join(hits, key, "left")


def operator_times(events: DataFrame) -> DataFrame:
    """Per-request times and counts rolled up: hours from acceptance to proof, revisions, failures."""
    first = lambda name: F.min(F.when(F.col("event") == name, F.col("at")))
    per = events.groupBy("request_id").agg(first("accepted").alias("a"), first("proof_ready").alias("p"),
                                           F.count_if(F.col("event") == "revision_requested").alias("revisions"),
                                           F.count_if(F.col("event") == "render_failed").alias("failures"))
    hours = per.withColumn("h", (F.unix_timestamp("p") - F.unix_timestamp("a")) / 3600)
    from rillwork.operators.scale import exact_percentiles
    quantiles = exact_percentiles(hours.where("h >= 0"), "h", [0.5, 0.9])
    rates = per.agg(F.count("*").alias("requests"), F.avg("revisions").alias("revisions_per_request"),
                    F.avg((F.col("failures") > 0).cast("int")).alias("failure_rate"))
    packed = quantiles.select(F.struct(F.col("p0").alias("m"), F.col("p1").alias("n"))).scalar()
    return rates.withColumn("_q", packed).select("requests", "revisions_per_request", "failure_rate",
                                                 F.col("_q.m").alias("median_hours"), F.col("_q.n").alias("p90_hours"))
