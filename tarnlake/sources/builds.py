"""Builds as folders with a pointer to the promoted one; caches of answers; purges that rewrite; what is where."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.joins import best_by
from tarnlake.sources.lake import META


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _under(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


# -- builds -----------------------------------------------------------------------------
def write_build(tables: dict[str, DataFrame], root: str, build_id: str, watermarks: dict[str, str] | None = None) -> dict[str, int]:
    """Every table under root/build_id, then a row of facts about the build; it is complete only with that row."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{build_id}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{root}/{build_id}/{name}").count()
        spark = df.sparkSession
    spark.createDataFrame([(build_id, "complete", json.dumps(watermarks or {}), json.dumps(counts))], "build_id string, status string, watermarks string, row_counts string").coalesce(1).write.parquet(f"{root}/{build_id}/_build")
    return counts


def list_builds(spark: SparkSession, root: str) -> list[str]:
    """Complete builds, oldest first by id."""
    return [b for b in _under(spark, root) if "_build" in _under(spark, f"{root}/{b}")]


def promote(spark: SparkSession, root: str, build_id: str) -> None:
    """Point CURRENT to a complete build: the new pointer is written apart and moved over the old one."""
    if build_id not in list_builds(spark, root):
        raise ValueError(f"no complete build {build_id}")
    fs, new = _fs(spark, f"{root}/.CURRENT-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(build_id.encode()))
    out.close()
    _, at = _fs(spark, f"{root}/CURRENT")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, at, options)


def current(spark: SparkSession, root: str) -> str | None:
    fs, p = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(p):
        return None
    return spark.read.text(f"{root}/CURRENT").head()[0]


def retain(spark: SparkSession, root: str, keep_last: int) -> list[str]:
    """Delete all but the last complete builds and the current one; returns what went."""
    done = list_builds(spark, root)
    stay = {*done[-keep_last:], current(spark, root)} if keep_last else {current(spark, root)}
    gone = [b for b in _under(spark, root) if b not in stay]
    for b in gone:
        fs, p = _fs(spark, f"{root}/{b}")
        fs.delete(p, True)
    return gone


# -- caches and purges --------------------------------------------------------------------
def append_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("append").partitionBy("decider", "decider_version").parquet(path)


def compact_answers(spark: SparkSession, path: str, to: str) -> None:
    """The latest answer of each (content, question, fingerprint) of a decider's version, into a new folder."""
    a = spark.read.parquet(path)
    best = best_by(a, ["content_hash", "question", "fingerprint", "decider", "decider_version"], F.desc("decided_at"), F.asc("answer"))
    best.write.partitionBy("decider", "decider_version").parquet(to)


def purge_lake(spark: SparkSession, path: str, to: str, ids: DataFrame | None = None, before: str | None = None) -> int:
    """The lake without some records and without the days before one, into a new folder; how many rows went."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    kept = df if before is None else df.filter(F.col("dt") >= F.lit(before).cast("date"))
    if ids is not None:
        kept = kept.join(ids.select("_record_id").distinct(), "_record_id", "left_anti").select(*df.columns)
    kept.write.partitionBy("dt").parquet(to)
    return df.count() - spark.read.parquet(to).count()


def forget(tables: dict[str, DataFrame], record_id: str, key: str = "record_id") -> dict[str, DataFrame]:
    """Every table without one record: rows of it, and its id inside lists."""
    out = {}
    for name, df in tables.items():
        x = df.filter(~F.col(key).eqNullSafe(record_id)) if key in df.columns else df
        for f in df.schema:
            if f.dataType.simpleString() == "array<string>":
                x = x.withColumn(f.name, F.array_remove(f.name, record_id))
        out[name] = x
    return out


# -- what is where ------------------------------------------------------------------------
def inventory(spark: SparkSession, root: str) -> DataFrame:
    """source, entity, columns (its own, sorted) of a lake root/source/entity; folders without a readable file are left out."""
    rows = []
    for source in _under(spark, root):
        for entity in _under(spark, f"{root}/{source}"):
            if any(d.startswith("dt=") for d in _under(spark, f"{root}/{source}/{entity}")):
                names = spark.read.option("mergeSchema", "true").parquet(f"{root}/{source}/{entity}").columns
                rows.append((source, entity, sorted(c for c in names if c not in META and c != "dt")))
    return spark.createDataFrame(rows, "source string, entity string, columns array<string>")


def describe(tables: dict[str, DataFrame], sample: int = 5) -> list[dict]:
    """Name, columns with types, number of rows and a few rows of each table."""
    return [{"table": n, "columns": dict(df.dtypes), "rows": df.count(), "sample": [r.asDict() for r in df.limit(sample).collect()]} for n, df in sorted(tables.items())]


def disabled_metrics(needs: dict[str, list[str]], df: DataFrame) -> list[str]:
    """Metrics whose columns are missing or null throughout."""
    wanted = sorted({c for cs in needs.values() for c in cs if c in df.columns})
    filled = df.agg(*[F.count(c).alias(c) for c in wanted]).head().asDict() if wanted else {}
    return sorted(m for m, cs in needs.items() if any(not filled.get(c) for c in cs))


# -- reports ------------------------------------------------------------------------------
def write_report(df: DataFrame, path: str, kind: str, most_rows: int = 10_000) -> None:
    """A ranked table as one CSV or JSON file folder; more than ``most_rows`` are an error."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError("too long for a report")
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def bar_chart(rows: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """An SVG of horizontal bars, one for each (name, value)."""
    from xml.sax.saxutils import escape

    most = max((abs(v) for _, v in rows), default=0) or 1
    bars = [f'<text x="4" y="{44 + 22 * k}">{escape(n)}</text><rect x="200" y="{32 + 22 * k}" width="{(width - 280) * abs(v) / most:.1f}" height="14"/><text x="{206 + (width - 280) * abs(v) / most:.1f}" y="{44 + 22 * k}">{v:,.2f}</text>' for k, (n, v) in enumerate(rows)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 22 * len(rows)}" font-size="12"><text x="4" y="18" font-weight="bold">{escape(title)}</text>{"".join(bars)}</svg>'
