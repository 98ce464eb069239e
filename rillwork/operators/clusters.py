"""Basin types: k-means over standardised features."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basin_clusters(features: DataFrame, columns: list[str], k: int = 4, seed: int = 0) -> DataFrame:
    """Mean features and size of each basin type, largest type first.

    Labels depend on the initialiser, so types are identified by their profile.
    """
    rows = features.dropna(subset=columns)
    few = rows.limit(k).count()
    if few == 0:
        raise ValueError("no basins to cluster")
    vector = VectorAssembler(inputCols=columns, outputCol="_raw").transform(rows)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(vector).transform(vector)
    model = KMeans(k=min(k, few), seed=seed, maxIter=50).setPredictionCol("cluster").fit(scaled)
    tagged = model.transform(scaled)
    return tagged.groupBy("cluster").agg(
        F.count("*").alias("n_basins"), *[F.round(F.avg(c), 4).alias(c) for c in columns])
