"""Line-delimited results and tasks, the administrative table, stores and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.functions import jsonx


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object a line. Rows as VARIANT v with their text, and the lines that are no object;
    blank lines are neither."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), jsonx.strict_variant("value").alias("v"))
    good = F.coalesce(jsonx.variant_kind(F.col("v")) == "object", F.lit(False))
    return rows.where(good), rows.where(~good).select("line")


def read_admin(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Name and six-digit code of a tab-separated file with a header; rows of other shapes are rejects."""
    lines = spark.read.text(path).where(~F.col("value").startswith("name\t"))
    parts = F.split("value", "\t", -1)
    good = (F.size(parts) == 3) & F.get(parts, F.lit(1)).rlike(r"^\d{6}\z")
    return lines.where(good).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("code")), lines.where(~good).select("value")


def write_examples(df: DataFrame, path: str) -> None:
    """Examples (tool, example, evec), a folder for each tool."""
    df.write.mode("overwrite").partitionBy("tool").parquet(path)


def read_examples(spark: SparkSession, path: str, tools: list[str] | None = None) -> DataFrame:
    """The stored examples; with tools only their folders are read."""
    rows = spark.read.parquet(path)
    return rows if tools is None else rows.where(F.col("tool").isin(*tools))


def append_results(df: DataFrame, path: str, resume: bool) -> None:
    """Result rows as JSON lines; without resume they replace what was there."""
    df.write.mode("append" if resume else "overwrite").json(path)


def write_scores(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of scores below the folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def append_missed(df: DataFrame, path: str) -> None:
    """Missed calls (tool, params, simulated_result, timestamp), a folder for each tool."""
    df.write.mode("append").partitionBy("tool").parquet(path)


def read_missed(spark: SparkSession, path: str, tool: str | None = None) -> DataFrame:
    """The missed calls, of one tool if it is given."""
    rows = spark.read.parquet(path)
    return rows if tool is None else rows.where(F.col("tool") == tool)


def clear_missed(spark: SparkSession, path: str, tool: str) -> None:
    """One tool's missed calls go, the others' stay."""
    schema = spark.read.parquet(path).drop("tool").schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/tool={tool}")
