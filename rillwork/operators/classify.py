"""Feature classification by source type code, one lookup per family.

Every candidate stays: rows that fall outside a family get class ``excluded``
with a reason. ``attributes`` is ``map<string,string>`` with lower-case keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork import fixed_values as X


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null when the key is absent or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def as_code(c: Column) -> Column:
    """Integer code held as text; fractions and other text are null."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def first_present(attributes: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(attributes, F.lit(n.lower())) for n in names])


def source_id(attributes: Column) -> Column:
    return F.coalesce(first_present(attributes, "Permanent_Identifier", "NHDPlusID", "ReachCode"),
                      F.lit(""))


def channel_class(ftype: Column) -> Column:
    """Flow-channel class; missing or unknown codes count as streams."""
    return F.coalesce(lookup(X.CHANNEL_CLASS, ftype), F.lit("stream"))


def channel_dash(ftype: Column, dashes: dict[str, str] | None = None) -> Column:
    """Dash pattern of engineered channels; null for all others."""
    return lookup(dashes if dashes is not None else X.CHANNEL_DASHES, channel_class(ftype))


def with_codes(features: DataFrame) -> DataFrame:
    """Adds ftype, fcode, name and source_id read from the attribute map."""
    a = F.col("attributes")
    return (features.withColumn("ftype", as_code(first_present(a, "FType")))
            .withColumn("fcode", as_code(first_present(a, "FCode")))
            .withColumn("name", first_present(a, "GNIS_Name", "Name"))
            .withColumn("source_id", source_id(a)))


def _classified(features: DataFrame, classes: dict, labels: dict, policy: str, scope: str,
                refine=None) -> DataFrame:
    code = F.col("ftype")
    found = F.coalesce(lookup(classes, code), F.lit("excluded"))
    cls = F.when(code.isNull(), "excluded").otherwise(refine(found) if refine else found)
    label = F.coalesce(lookup(labels, code), F.lit("unknown"))
    out = features.withColumn("class", cls)
    described = F.format_string("FType %d (%s)", code, label)
    reason = (F.when(code.isNull(), "excluded: source FType missing; cannot classify by type/code")
              .when(F.col("class") == "excluded", F.concat(
                  F.lit("excluded: "), described, F.lit(f" is not an included {scope} under policy {policy}")))
              .otherwise(F.concat(F.lit("classified as "), F.col("class"), F.lit(": "), described)))
    flags = F.array_compact(F.array(F.when(code.isNull(), F.lit("missing_ftype"))))
    return out.withColumn("inclusion_reason", reason).withColumn("qa_flags", flags)


def classify_waterbodies(features: DataFrame) -> DataFrame:
    """Open-water classes; a bay whose name says inlet becomes an inlet."""
    def bay_or_inlet(found: Column) -> Column:
        inlet = F.coalesce(F.lower("name").contains("inlet"), F.lit(False))
        return F.when((found == "bay") & inlet, "inlet").otherwise(found)
    return _classified(features, X.WATERBODY_CLASS, X.WATERBODY_LABEL, X.WATERBODY_POLICY, "water class", bay_or_inlet)


def classify_areal(features: DataFrame) -> DataFrame:
    return _classified(features, X.AREAL_CLASS, X.AREAL_LABEL, X.AREAL_POLICY, "areal natural feature")


def classify_points(features: DataFrame) -> DataFrame:
    return _classified(features, X.POINT_CLASS, X.POINT_LABEL, X.POINT_POLICY, "natural point feature")


def classify_structures(features: DataFrame) -> DataFrame:
    return _classified(features, X.STRUCTURE_CLASS, X.STRUCTURE_LABEL, X.STRUCTURE_POLICY, "hydro structure")


def minimum_order(segments: DataFrame, n: int = 1) -> DataFrame:
    """Segments of at least order ``n``; watersheds left empty vanish with their segments."""
    return segments if n <= 1 else segments.where(F.col("stream_order") >= n)
