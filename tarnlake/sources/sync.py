"""Incremental pulls: watermarks, overlap, resumable slices, when to commit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.joins import best_by


@dataclass(frozen=True)
class Stream:
    overlap_minutes: int = 60
    settle_minutes: int = 5
    ordered: bool = True


def span(mark: datetime | None, now: datetime, s: Stream) -> tuple[datetime, datetime] | None:
    """The time to read: from the mark less the overlap to now less the settling time; None without a mark (backfill first)."""
    if mark is None:
        return None
    since, until = mark - timedelta(minutes=s.overlap_minutes), now - timedelta(minutes=s.settle_minutes)
    return (since, until) if since < until else None


def next_mark(mark: datetime | None, batches: list[datetime], until: datetime, s: Stream, finished: bool) -> datetime | None:
    """The mark after some committed batches (the latest update time of each): it never goes back nor beyond ``until``.

    An ordered stream moves on with each batch, another one only at its end.
    """
    reached = (max(batches) if batches else mark) if s.ordered and not finished else until if finished else mark
    if reached is None:
        return mark
    reached = min(reached, until)
    return reached if mark is None else max(mark, reached)


def due(rows: int, opened_at: datetime, now: datetime, columns: set[str], seen: set[str] | None, most_rows: int = 131_072, most_minutes: int = 10) -> bool:
    """Whether a batch is to be committed: full, old, or its columns have changed."""
    return rows >= most_rows or now - opened_at >= timedelta(minutes=most_minutes) or seen is not None and columns != seen


def slices(spark: SparkSession, since: str, until: str, days: int) -> DataFrame:
    """start, end (timestamps) of the slices of a half-open range, the last one cut."""
    begin, end = (F.lit(x).cast("timestamp") for x in (since, until))
    step = F.make_dt_interval(days=F.lit(days))
    s = spark.range(1).select(F.explode(F.sequence(begin, end, step)).alias("start")).filter(F.col("start") < end)
    return s.select("start", F.least(F.col("start") + step, end).alias("end"))


def open_slices(all_slices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Slices whose last ledger entry (start, status, at) isn't 'done': a run that broke off goes on there."""
    last = best_by(ledger, ["start"], F.desc("at")).filter("status = 'done'").select("start")
    return all_slices.join(last, "start", "left_anti")


def whole_days(since: datetime, until: datetime) -> tuple[datetime, datetime]:
    """The whole UTC days inside a range."""
    up = since.astimezone(UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    if up < since.astimezone(UTC):
        up += timedelta(days=1)
    return up, until.astimezone(UTC).replace(hour=0, minute=0, second=0, microsecond=0)
