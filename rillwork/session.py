"""Session settings, lineage cuts and size-checked broadcasts.

Everything here is safe to call on a session somebody else built: settings a
caller already chose are left alone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is ever broadcast, in rows; beyond it a shuffle join runs.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "rillwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect (UTC, AQE with skew splitting)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, below the checkpoint folder the cluster names.

    A local folder is made up only in local mode. The folder goes when the JVM ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = spark.conf.get("spark.checkpoint.dir", None) or (named.get() if named.isDefined() else None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set; iterative jobs need a shared folder on a cluster")
            base = tempfile.mkdtemp(prefix="rillwork-")
        _folders[app] = f"{base.rstrip('/')}/rillwork-{app}-{uuid.uuid4().hex[:8]}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(_folders[app])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _folders[app]


_folders: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from that table.

    It cuts the lineage like a reliable checkpoint and survives the loss of
    executors, but computes the rows once, and the plan that follows knows the
    table's size and columns.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only when a bounded count proves the side is small.

    ``limit + 1`` rows at most are counted, so the check stays cheap on a large
    side; a larger side is returned unhinted and the join shuffles.
    """
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df
