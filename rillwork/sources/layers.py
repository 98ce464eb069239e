"""Staged feature layers: allow-listed scans with disjoint attribute sets per family.

Features are staged as Parquet partitioned by ``dataset_id, huc4, layer``; the
layer filter prunes partitions and only the family's attributes are read.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork import fixed_values as X

#: Attributes each family carries, canonical casing.
FAMILY_ATTRIBUTES = {
    "flowline": ("NHDPlusID", "ReachCode", "FType", "GNIS_Name", "LengthKM"),
    "waterbody": ("Permanent_Identifier", "NHDPlusID", "ReachCode", "FType", "FCode", "GNIS_Name", "AreaSqKm"),
    "point": ("Permanent_Identifier", "NHDPlusID", "ReachCode", "FType", "FCode", "GNIS_Name"),
    "line": ("Permanent_Identifier", "NHDPlusID", "ReachCode", "FType", "FCode", "GNIS_Name", "LengthKM"),
}
FAMILY_LAYERS = {"flowline": X.FLOWLINE_LAYERS, "waterbody": X.WATERBODY_LAYERS,
                 "point": X.POINT_LAYERS, "line": X.LINE_LAYERS}


def select_layers(features: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Rows of the allow-listed layers, whatever the casing of the layer name."""
    return features.where(F.lower("layer").isin(*[x.lower() for x in layers]))


def canonical_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Source columns found case-insensitively and renamed; absent ones become null."""
    have = {c.lower(): c for c in df.columns}
    picks = [F.col(f"`{have[w.lower()]}`").alias(w) if w.lower() in have
             else F.lit(None).cast("string").alias(w) for w in wanted]
    taken = {w.lower() for w in wanted}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken], *picks)


def family(features: DataFrame, name: str) -> DataFrame:
    """One family's layers with its attributes gathered in a lower-case keyed map."""
    wanted = FAMILY_ATTRIBUTES[name]
    rows = canonical_columns(select_layers(features, FAMILY_LAYERS[name]), wanted)
    pairs = [x for w in wanted for x in (F.lit(w.lower()), F.col(w).cast("string"))]
    filled = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return rows.withColumn("attributes", filled).drop(*wanted)


def scan(spark: SparkSession, path: str, dataset_id: str, huc4: str, name: str) -> DataFrame | None:
    """A family's staged features for one basin; None when nothing is staged there."""
    if "://" not in path and not os.path.isdir(path):
        print(f"rillwork: nothing staged at {path}")
        return None
    rows = spark.read.parquet(path).where((F.col("dataset_id") == dataset_id) & (F.col("huc4") == huc4))
    return family(rows, name)


def stage(features: DataFrame, path: str) -> None:
    """Writes features for partition pruning by dataset, basin and layer."""
    features.write.mode("overwrite").partitionBy("dataset_id", "huc4", "layer").parquet(path)


def union_basins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Basins concatenated; where an id occurs in several, the later basin wins."""
    tagged = [p.withColumn("_load", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_load")]
    best = out.groupBy(key).agg(F.max_by(F.struct(*rest), "_load").alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
