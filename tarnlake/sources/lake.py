"""The raw lake: versioned, tombstoned records in Parquet partitions by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators.joins import best_by

META = {
    "_record_id": "string",
    "_source": "string",
    "_entity": "string",
    "_source_key": "string",
    "_source_updated_at": "timestamp",
    "_fetched_at": "timestamp",
    "_deleted": "boolean",
    "_payload": "string",
}


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The lake's rows with ``columns`` as text; columns that no file has are null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    df = df.withColumn("_file", F.col("_metadata.file_path"))
    return df.select(*META, "_file", *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns])


def latest(versions: DataFrame, deleted_ids: DataFrame | None = None, key: str = "_record_id", deleted: str = "_deleted", order: tuple[str, ...] = ("_source_updated_at", "_fetched_at", "_file")) -> DataFrame:
    """The newest version of each record, then without tombstones and requested deletions.

    A tombstone hides older live versions: it is dropped only after the choice.
    """
    newest = best_by(versions, [key], *[F.col(c).desc_nulls_last() for c in order])
    live = newest.filter(~F.coalesce(F.col(deleted), F.lit(False)))
    return live if deleted_ids is None else live.join(deleted_ids.select(key), key, "left_anti")


def typed(df: DataFrame, columns: dict[str, Column], prefix: tuple[str, str] = ("_nn_", "_cf_")) -> DataFrame:
    """Typed columns, each with a flag for a value present and one for a failed cast."""
    out = df
    for name, expr in columns.items():
        raw = F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) != ""
        out = out.withColumn(f"{prefix[0]}{name}", raw).withColumn(f"{prefix[1]}{name}", raw & expr.isNull())
    return out.withColumns({n: e for n, e in columns.items()})


def cast_statistics(df: DataFrame, table: str, names: list[str]) -> DataFrame:
    """table_name, column_name, n_rows, n_present, n_failed in one pass."""
    aggs = [F.struct(F.lit(n).alias("column_name"), F.count_if(F.col(f"_nn_{n}")).alias("n_present"), F.count_if(F.col(f"_cf_{n}")).alias("n_failed")) for n in names]
    one = df.agg(F.count("*").alias("n_rows"), F.array(*aggs).alias("s"))
    return one.select(F.lit(table).alias("table_name"), "n_rows", F.explode("s").alias("s")).select("table_name", "s.column_name", "n_rows", "s.n_present", "s.n_failed")


def reconcile(versions: DataFrame, keys: DataFrame, key: str = "_source_key", most_share: float = 0.2) -> DataFrame:
    """Live records whose source key is gone, as tombstones; over ``most_share`` is an error.

    The valve stops a broken key listing from deleting a table.
    """
    live = latest(versions)
    gone = live.join(keys.select(key).distinct(), key, "left_anti")
    n_live, n_gone = live.count(), gone.count()
    if n_live and n_gone > most_share * n_live:
        raise ValueError(f"{n_gone} of {n_live} live records are missing at the source")
    return gone.withColumn("_deleted", F.lit(True)).withColumn("_payload", F.lit(None).cast("string"))


def violations(df: DataFrame) -> dict[str, int]:
    """Rows that break each rule of the contract, counted in one pass."""
    missing = [c for c in META if c not in df.columns]
    if missing:
        return {f"missing:{c}": 1 for c in missing}
    rules = {f"null:{c}": F.col(c).isNull() for c in META if c != "_payload"}
    rules["payload_of_live"] = F.col("_payload").isNull() & ~F.col("_deleted")
    rules["payload_of_tombstone"] = F.col("_payload").isNotNull() & F.col("_deleted")
    found = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).head().asDict()
    types = {f"type:{f.name}": 1 for f in df.schema if f.name not in META and f.name != "dt" and not isinstance(f.dataType, T.StringType)}
    return {n: k for n, k in found.items() if k} | types


def append(df: DataFrame, path: str) -> None:
    """Append valid rows, partitioned by day of fetching; nothing is written otherwise."""
    bad = violations(df)
    if bad:
        raise ValueError(f"lake contract broken: {bad}")
    df.withColumn("dt", F.to_date("_fetched_at")).write.mode("append").partitionBy("dt").parquet(path)


def purge(df: DataFrame, ids: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """What stays after deleting records by id and partitions before a day."""
    out = df if before is None else df.filter(F.col("dt") >= F.lit(before).cast("date"))
    return out if ids is None else out.join(ids.select("_record_id").distinct(), "_record_id", "left_anti")
