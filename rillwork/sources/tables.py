"""Published text tables and JSON stores as DataFrames.

The parsers take ``lines(file, value)`` (one row per text line) so any reader can
feed them; ``read_lines`` is the plain text-file reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import vectors as V

DISCHARGE_SUFFIX = "_00060_00003"
PDO_FILLS = (99.99, -9.9)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number, for small files whose line order matters."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def _data_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))


_FORMAT_ROW = r"^\d+[a-z](\t\d+[a-z])*$"


def daily_flows(lines: DataFrame) -> DataFrame:
    """Gauge daily values ``(file, year, month, cfs)`` from tab-separated tables.

    The header row names the columns; the discharge column is the one with the
    mean-discharge suffix. Rows with a blank or non-numeric value or a short date
    are dropped.
    """
    rows = _data_lines(lines)
    header = F.split("value", "\t")
    heads = rows.where(F.col("value").contains(DISCHARGE_SUFFIX)).groupBy("file").agg(F.min("value").alias("value"))
    found = F.filter(header, lambda c: c.endswith(DISCHARGE_SUFFIX))
    heads = heads.select(
        "file", F.array_position(header, F.element_at(found, 1)).cast("int").alias("_v"),
        F.nullif(F.array_position(header, "datetime").cast("int"), F.lit(0)).alias("_d"))
    cells = F.split("value", "\t")
    data = rows.where(~F.col("value").contains(DISCHARGE_SUFFIX) & ~F.col("value").rlike(_FORMAT_ROW))
    data = data.join(heads, "file").where(F.col("_v") > 0)
    day = F.try_element_at(cells, F.coalesce("_d", F.lit(3)))
    raw = F.trim(F.try_element_at(cells, F.col("_v")))
    out = data.select("file", F.substring(day, 1, 4).try_cast("int").alias("year"),
                      F.substring(day, 6, 2).try_cast("int").alias("month"), raw.try_cast("double").alias("cfs"))
    return out.where("year IS NOT NULL AND month BETWEEN 1 AND 12 AND cfs IS NOT NULL")


def gauge_months(lines: DataFrame) -> DataFrame:
    """Monthly means per gauge and year in twelve slots; a month without days stays null."""
    return V.month_slots(daily_flows(lines), ["file", "year"], "month", "cfs", F.avg, "q")


def gauge_sites(lines: DataFrame) -> DataFrame:
    """``(file, lat, lon, datum)`` from the first row with a readable position."""
    rows = _data_lines(lines)
    head = rows.where(F.col("value").contains("dec_lat_va")).groupBy("file").agg(
        F.split(F.min_by("value", "line_no"), "\t").alias("_h"))
    cells = F.split("value", "\t")
    at = lambda name: F.trim(F.try_element_at(cells, F.nullif(F.array_position("_h", name).cast("int"), F.lit(0))))
    read = rows.where(~F.col("value").contains("dec_lat_va")).join(head, "file").select(
        "file", "line_no", at("dec_lat_va").try_cast("double").alias("lat"),
        at("dec_long_va").try_cast("double").alias("lon"),
        F.coalesce(F.nullif(at("dec_coord_datum_cd"), F.lit("")), F.lit("NAD83")).alias("datum"))
    good = read.where("lat IS NOT NULL AND lon IS NOT NULL")
    return good.groupBy("file").agg(F.min_by(F.struct("lat", "lon", "datum"), "line_no").alias("s")).select("file", "s.*")


def oni_index(lines: DataFrame) -> DataFrame:
    """Mean seasonal anomaly per year from ``SEAS YR TOTAL ANOM`` rows."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.size(c) == 4) & (F.element_at(c, 1) != "SEAS")).select(
        F.element_at(c, 2).try_cast("int").alias("year"), F.element_at(c, 4).try_cast("double").alias("v"))
    return rows.where("year IS NOT NULL AND v IS NOT NULL").groupBy("year").agg(F.avg("v").alias("value"))


def pdo_index(lines: DataFrame) -> DataFrame:
    """Mean valid month per year from ``Year Jan..Dec`` rows; fill values do not count."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.element_at(c, 1).rlike(r"^-?\d+$")).select(
        F.element_at(c, 1).cast("int").alias("year"), F.explode(F.slice(c, 2, 12)).alias("v"))
    v = F.col("v").try_cast("double")
    rows = rows.select("year", v.alias("v")).where("v IS NOT NULL")
    for fill in PDO_FILLS:
        rows = rows.where(F.abs(F.col("v") - fill) >= 1e-6)
    return rows.groupBy("year").agg(F.avg("v").alias("value"))


FEATURE_COLLECTION = ("features array<struct<properties:struct<category:string,name:string>,"
                      "geometry:struct<coordinates:array<double>>>>")


def facility_points(collections: DataFrame, styles: DataFrame) -> DataFrame:
    """Point features whose category has a style: ``(category, lon, lat, name)``."""
    points = collections.select(F.explode("features").alias("f")).select(
        F.col("f.properties.category").alias("category"), F.element_at("f.geometry.coordinates", 1).alias("lon"),
        F.element_at("f.geometry.coordinates", 2).alias("lat"), F.col("f.properties.name").alias("name"))
    return points.join(styles.select("category"), "category", "left_semi")


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_COLLECTION).option("multiLine", True).json(path)


REQUEST = ("request_id string, status string, email string, product string, created_at string, updated_at string, "
           "events array<struct<timestamp:string,event:string,detail:map<string,string>>>")


def parse_requests(texts: DataFrame) -> DataFrame:
    """Requests from JSON texts (column ``value``); unreadable ones are skipped, newest first."""
    parsed = texts.select(F.from_json("value", REQUEST + ", _corrupt_record string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    sound = parsed.where("_corrupt_record IS NULL AND request_id IS NOT NULL").drop("_corrupt_record")
    return sound.orderBy(F.col("request_id").desc())


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", "REQ-*.json").text(folder, wholetext=True)
    return parse_requests(texts)


CATALOG_ENTRY = ("entry_id string, version int, region string, county string, style string, endpoint string, "
                 "size string, rendered_at string, render_hash string, sources array<string>, status string, "
                 "title string, description string, tags array<string>, section string, sort_order int, "
                 "deliverables array<string>, thumbnail string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries from a folder of JSON lines; a repeated (entry, version) is an error."""
    entries = spark.read.schema(CATALOG_ENTRY).json(path)
    twice = entries.groupBy("entry_id", "version").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"catalog holds duplicate versions: {[tuple(r)[:2] for r in twice]}")
    return entries


def write_catalog(entries: DataFrame, path: str) -> None:
    """Deterministic store: sorted by entry, newest version first, across and inside files."""
    order = [F.col("entry_id"), F.col("version").desc()]
    entries.orderBy(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)
