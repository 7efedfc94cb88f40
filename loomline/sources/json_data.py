"""JSON datasets, payload checks, reports and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_datasets(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """dataset, description, ordinal and the row's fields, from files {"datasets": [{"name", "description", "rows"}]}.

    The position of a row in its list becomes `ordinal`. Files that are no JSON or lack a part raise on use.
    """
    schema = f"datasets array<struct<name string, description string, rows array<struct<{row_schema}>>>>"
    files = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    sets = files.select(F.inline("datasets"))
    sound = sets.select(
        F.coalesce("name", F.raise_error(F.lit("dataset without name")).cast("string")).alias("dataset"),
        "description",
        F.coalesce("rows", F.raise_error(F.lit("dataset without rows")).cast(sets.schema["rows"].dataType)).alias("rows"),
    )
    return sound.select("dataset", "description", F.posexplode("rows").alias("ordinal", "row")).select("dataset", "description", "ordinal", "row.*")


def payload_problem(payload: Column) -> Column:
    """What is wrong with a JSON payload: null if it is an object with datasets that all have name, description and a list of rows."""
    kind = lambda p: F.schema_of_variant(F.try_variant_get(payload_v, p, "variant"))
    payload_v = F.try_parse_json(payload)
    sets = F.from_json(payload, "datasets array<struct<name string, description string, rows string>>")["datasets"]
    bad = F.array_position(F.transform(sets, lambda d: d["name"].isNull() | d["description"].isNull() | ~F.coalesce(d["rows"].startswith("["), F.lit(False))), True)
    return (
        F.when(payload_v.isNull(), "not JSON")
        .when(~F.schema_of_variant(payload_v).startswith("OBJECT"), "not an object")
        .when(~F.coalesce(kind("$.datasets").startswith("ARRAY"), F.lit(False)), "no list of datasets")
        .when(bad > 0, F.concat(F.lit("dataset "), (bad - 1).cast("string"), F.lit(" lacks a part")))
    )


def row_problem(required: list[str]) -> Column:
    """The required fields that a row lacks, joined; empty if none."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])


def write_report(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    """JSON lines; with sorted keys if asked for. Nulls are written out."""
    names = sorted(df.columns) if sort_keys else df.columns
    df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def recent_logs(spark: SparkSession, folder: str, limit: int = 20) -> DataFrame:
    """The newest `limit` JSON logs under a folder, one row each; those that cannot be parsed are left out after the limit."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    newest = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed")).orderBy(F.desc("changed"), F.desc("path")).limit(limit)
    return newest.withColumn("log", F.try_parse_json("value")).where("log IS NOT NULL").select("path", "changed", "log")


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON or Markdown report under a folder with its text and whether it parses (Markdown always does)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,md}").text(folder)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.col("value").alias("text"), (path.endswith(".md") | F.try_parse_json("value").isNotNull()).alias("parses"))
