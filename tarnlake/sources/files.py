"""Inbox readers: CSV and Parquet as text rows of the lake's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every column text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def new_files(spark: SparkSession, folder: str, done: DataFrame, most_bytes: int) -> DataFrame:
    """path, length, fingerprint of files whose content isn't in ``done`` (fingerprint)."""
    found = spark.read.format("binaryFile").load(folder).filter(F.col("length") <= most_bytes)
    return found.select("path", "length", F.sha2("content", 256).alias("fingerprint")).join(done.select("fingerprint"), "fingerprint", "left_anti")


def as_records(df: DataFrame, source: str, entity: str, key: list[str], fetched_at: str, updated_at: str | None = None) -> DataFrame:
    """Contract rows of a flat table: composite key ``a|b``, payload JSON, all columns text."""
    k = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    now = F.lit(fetched_at).cast("timestamp")
    meta = {
        "_record_id": F.concat(F.lit(f"{source}:{entity}:"), k),
        "_source": F.lit(source),
        "_entity": F.lit(entity),
        "_source_key": k,
        "_source_updated_at": F.col(updated_at).cast("timestamp") if updated_at else now,
        "_fetched_at": now,
        "_deleted": F.lit(False),
        "_payload": F.to_json(F.struct(*df.columns)),
    }
    return df.select(*[c.alias(n) for n, c in meta.items()], *[F.col(c).cast("string").alias(c) for c in df.columns])


def slices(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Half-open windows that cover [start, end)."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    every = F.expr(f"interval {int(days)} days")
    one = spark.range(1).select(F.explode(F.sequence(s, e, every)).alias("since")).filter(F.col("since") < e)
    return one.select("since", F.least(F.col("since") + every, e).alias("until"))
