"""File manifests and planning as joins between listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def required_files(regions: DataFrame, region_huc4: DataFrame, datasets: DataFrame) -> DataFrame:
    """Archives needed for the regions: one row per dataset and distribution unit.

    ``datasets(dataset_id, priority, url_template, required, code_digits)`` is the
    short list of published sources. A unit shared by regions is listed once.
    """
    wanted = datasets.where("required").select("dataset_id", "priority", "url_template", "code_digits")
    packed = wanted.agg(F.array_sort(F.collect_list(F.struct(
        "priority", "dataset_id", "url_template", "code_digits"))).alias("d"))
    units = region_huc4.join(regions.select("region"), "region", "left_semi").select("huc4").distinct()
    rows = units.withColumn("_d", F.explode(packed.scalar()))
    code = F.expr("substring(huc4, 1, _d.code_digits)")
    url = F.replace(F.col("_d.url_template"), F.lit("{code}"), code)
    files = rows.select(F.col("_d.dataset_id").alias("dataset_id"), code.alias("huc4"), url.alias("url"),
                        F.substring_index(url, "/", -1).alias("filename")).distinct()
    return files.withColumn("key", F.concat_ws("/", "dataset_id", "huc4", "filename"))


def unknown_regions(regions: DataFrame, region_huc4: DataFrame) -> DataFrame:
    return regions.join(region_huc4, "region", "left_anti")


def work_list(required: DataFrame, extracted: DataFrame, cached: DataFrame) -> DataFrame:
    """Required files neither extracted already nor cached and verified."""
    return (required.join(extracted.select("dataset_id", "huc4"), ["dataset_id", "huc4"], "left_anti")
            .join(cached.where("verified").select("key"), "key", "left_anti"))


def build_manifest(descriptors: DataFrame, hashed: DataFrame, strict: bool = False) -> DataFrame:
    """One row per cached file with its checksum and size, in key order."""
    out = descriptors.join(hashed.select("key", "checksum", "size", "relative_path"), "key", "left")
    if strict:
        missing = out.where("checksum IS NULL").select("key").limit(5).collect()
        if missing:
            raise ValueError(f"no cached metadata for {[r[0] for r in missing]}")
    return out.where("checksum IS NOT NULL").orderBy("key")


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("key", F.col("checksum").alias("_a"))
    b = new.select("key", F.col("checksum").alias("_b"))
    kind = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
            .when(F.col("_a") != F.col("_b"), "changed").otherwise("unchanged"))
    return a.join(b, "key", "full_outer").select("key", kind.alias("change"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """missing / mismatched (hash or size) / ok for every manifest entry."""
    f = files.select("relative_path", F.col("checksum").alias("_c"), F.col("size").alias("_s"))
    state = (F.when(F.col("_c").isNull(), "missing")
             .when((F.col("_c") != F.col("checksum")) | (F.col("_s") != F.col("size")), "mismatched")
             .otherwise("ok"))
    return manifest.join(f, "relative_path", "left").select("key", "size", state.alias("state"))


def package_plan(required: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each required key as present, corrupt or missing, with the recorded bytes."""
    checked = verify_manifest(manifest, files)
    state = (F.when(F.col("state") == "ok", "present").when(F.col("state") == "mismatched", "corrupt")
             .otherwise("missing"))
    return required.select("key").join(checked, "key", "left").select(
        "key", state.alias("readiness"), F.coalesce("size", F.lit(0)).alias("bytes"))


def package_summary(plan: DataFrame, tiles: int | None = None, tile_budget: int = 0) -> DataFrame:
    fits = tiles is None or tile_budget == 0 or tiles <= tile_budget
    return plan.agg(
        F.count_if(F.col("readiness") == "present").alias("present"),
        F.count_if(F.col("readiness") == "corrupt").alias("corrupt"),
        F.count_if(F.col("readiness") == "missing").alias("missing"),
        F.sum("bytes").alias("total_bytes"),
        (F.count_if(F.col("readiness") != "present").__eq__(0) & F.lit(fits)).alias("ready"))


def migration_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files to move; one already at the target with the same size is skipped."""
    there = target.select("relative_path", F.col("size").alias("_there"))
    done = F.coalesce(F.col("_there") == F.col("size"), F.lit(False))
    return source.join(there, "relative_path", "left").select(
        "relative_path", "size", F.when(done, "skip").otherwise("move").alias("action"))


def checksum_coverage(planned: DataFrame, provided: DataFrame, keys: list[str]) -> DataFrame:
    """Differences between planned files and provided checksums; empty means exact cover."""
    a = planned.select(*keys).distinct().withColumn("_p", F.lit(True))
    b = provided.select(*keys).distinct().withColumn("_q", F.lit(True))
    both = a.join(b, keys, "full_outer").where("_p IS NULL OR _q IS NULL")
    return both.select(*keys, F.when(F.col("_q").isNull(), "missing").otherwise("unexpected").alias("problem"))


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free fingerprint of each dataset; NaN payloads and row order do not matter."""
    data = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*data).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def record_golden(runs: DataFrame, folder: str) -> DataFrame:
    """Write the fingerprint of every dataset to ``folder`` and return the stored table.

    ``runs`` is ``dataset, fingerprint``, a row for each run. Datasets with fewer than two
    runs, or whose runs differ, are an error with examples, and nothing is written. A
    folder that exists already is an error as well.
    """
    per = runs.groupBy("dataset").agg(F.count("*").alias("runs"), F.count_distinct("fingerprint").alias("versions"),
                                      F.min("fingerprint").alias("fingerprint"))
    unstable = per.where("runs < 2 OR versions <> 1").limit(5).collect()
    if unstable:
        raise ValueError(f"datasets without two equal runs: {[r['dataset'] for r in unstable]}")
    per.select("dataset", "fingerprint").write.parquet(folder)
    return read_golden(runs.sparkSession, folder)


def read_golden(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("dataset", "fingerprint")


def golden_check(runs: DataFrame, golden: DataFrame) -> DataFrame:
    """stable: at least two runs agree; verdict also compares the recorded golden, if any."""
    per = runs.groupBy("dataset").agg(F.count("*").alias("runs"),
                                      F.count_distinct("fingerprint").alias("versions"),
                                      F.min("fingerprint").alias("fingerprint"))
    joined = per.join(golden.select("dataset", F.col("fingerprint").alias("_g")), "dataset", "left")
    stable = (F.col("runs") >= 2) & (F.col("versions") == 1)
    verdict = (F.when(~stable, "unstable").when(F.col("_g").isNull(), "no golden")
               .when(F.col("_g") == F.col("fingerprint"), "match").otherwise("changed"))
    return joined.select("dataset", "runs", "versions", verdict.alias("verdict"))
