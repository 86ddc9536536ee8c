"""Recorded execution: a guarded query with an id, a row cap, a hash of its rows and a kept sample; and its re-run."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import aggregates as A
from tarnlake.plans import guard
from tarnlake.store import new_path, written

EVIDENCE = "query_id string, sql string, params string, row_count long, result_hash string, sample array<string>, capped boolean, recorded_at double"
_PATHS: dict[str, str] = {}


def normal_sql(sql: str) -> str:
    """Comments off, white space collapsed outside of quotes."""
    parts = re.split(r"('(?:[^']|'')*')", re.sub(r"--[^\n]*", "", sql))
    return "".join(p if k % 2 else re.sub(r"\s+", " ", p) for k, p in enumerate(parts)).strip().rstrip(";").strip()


def query_id(sql: str, params: dict | None, build: str) -> str:
    """``q_`` and 16 hex digits of the normal text, the sorted parameters and the build."""
    text = json.dumps({"build": build, "params": params or {}, "sql": normal_sql(sql)}, sort_keys=True, default=str)
    return "q_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def evidence(spark: SparkSession) -> DataFrame:
    """What this session has recorded."""
    path = _PATHS.get(spark.sparkContext.applicationId)
    return spark.read.schema(EVIDENCE).parquet(path) if path else spark.createDataFrame([], EVIDENCE)


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], params: dict | None = None, build: str = "current", cap: int = 1_000_000, sample: int = 50, seconds: float | None = None) -> dict:
    """Runs a guarded query and keeps the evidence: id, number and hash of rows, the ``sample`` rows of least hash.

    A query of the same id must give the same hash.  After ``seconds`` its jobs are cancelled.
    """
    guard.check(spark, sql, tables, args=params)
    tag = f"recorded-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = None
    if seconds is not None:
        import threading

        timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
        timer.start()
    try:
        rows = written(spark.sql(normal_sql(sql), args=params or {}).limit(cap + 1), "recorded")  # executed once
        over = rows.count() > cap
        kept = rows.limit(cap) if over else rows
        h = A.row_set_hash(kept).head()
        line = F.to_json(F.struct(*kept.columns))
        least = [r["line"] for r in kept.select(line.alias("line")).withColumn("k", F.sha2("line", 256)).orderBy("k").limit(sample).collect()]
    finally:
        if timer:
            timer.cancel()
        spark.removeTag(tag)
    q = query_id(sql, params, build)
    known = evidence(spark).filter(F.col("query_id") == q).select("result_hash").head()
    if known and known[0] != h["rows_sha256"]:
        raise ValueError(f"{q} gave other rows before")
    entry = {"query_id": q, "sql": normal_sql(sql), "params": json.dumps(params or {}, sort_keys=True, default=str), "row_count": h["n"], "result_hash": h["rows_sha256"], "sample": least, "capped": over, "recorded_at": time.time()}
    if not known:
        path = _PATHS.setdefault(spark.sparkContext.applicationId, new_path(spark, "evidence"))
        spark.createDataFrame([tuple(entry.values())], EVIDENCE).write.mode("append").parquet(path)
    return entry


def close(a: object, b: object, absolute: float = 1e-9, relative: float = 1e-6) -> bool:
    """Equal, or numbers that differ by no more than the tolerances."""
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= absolute + relative * max(abs(a), abs(b))
    return a == b


def same_rows(a: list[tuple], b: list[tuple]) -> bool:
    """Whether two small row sets are the same in any order, numbers within the tolerances."""
    if len(a) != len(b):
        return False
    left = list(b)
    for x in a:
        at = next((k for k, y in enumerate(left) if len(x) == len(y) and all(close(u, v) for u, v in zip(x, y, strict=True))), None)
        if at is None:
            return False
        left.pop(at)
    return True


def verify(spark: SparkSession, entry: dict, tables: dict[str, DataFrame], cap: int = 1_000_000) -> bool:
    """Whether a recorded query gives the same rows again."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    rows = spark.sql(entry["sql"], args=json.loads(entry["params"])).limit(cap)
    h = A.row_set_hash(rows).head()
    return h["n"] == entry["row_count"] and h["rows_sha256"] == entry["result_hash"]


# -- numbers in text --------------------------------------------------------------------
_NUMBER = re.compile(r"(?<![\w.])(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|k\b|K\b|M\b|million\b|thousand\b)?")
SCALE = {"%": 0.01, "k": 1e3, "K": 1e3, "thousand": 1e3, "M": 1e6, "million": 1e6, "": 1.0}


def numbers(text: str) -> list[tuple[float, float]]:
    """Value and half a unit of the last digit shown of each number in a text, with its scale."""
    out = []
    for m in _NUMBER.finditer(text):
        raw, scale = m[1].replace(",", ""), SCALE[m[2] or ""]
        digits = len(raw.partition(".")[2])
        out.append((float(raw) * scale, 0.5 * 10.0**-digits * scale))
    return out


def uncited(text: str) -> list[str]:
    """Numbers that no marker [[n1]], [[n2]] ... follows."""
    return [m[0].strip() for m in _NUMBER.finditer(re.sub(r"\[\[n[0-9]+\]\]", lambda x: "\0" * len(x[0]), text)) if not text[m.end() :].lstrip().startswith("[[n")]


def supported(value: float, half_unit: float, known: list[float]) -> bool:
    """Whether a shown number is a rounding of one of the known ones."""
    return any(abs(value - k) <= half_unit * (1 + 1e-9) for k in known)
