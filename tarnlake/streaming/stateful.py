"""State with event time: timelines of categories, with timers that close intervals and let idle keys go.

They run with RocksDB as state store (``stateful_conf``) and go on from a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: What the session needs before a stateful query starts.
stateful_conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Of transitions at one instant the furthest category holds.
RANKS = {"done": 2, "in_progress": 1}
DAY_MS = 86_400_000


def _rank(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, F.lit(r)) for c, r in RANKS.items()], F.lit(0))


def _ms(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


def _ts(ms: int | None) -> pd.Timestamp | None:
    return None if ms is None else pd.Timestamp(ms, unit="ms")


def _intervals(key: str, value: object, rows: list[tuple]) -> pd.DataFrame:
    times = {c: pd.Series([_ts(r[k]) for r in rows], dtype="datetime64[ns]") for k, c in enumerate(("since", "until"))}
    return pd.DataFrame({key: pd.Series([value] * len(rows), dtype=object), **times, "category": pd.Series([r[2] for r in rows], dtype=object)})


class Timeline(StatefulProcessor):
    """Transitions wait until the watermark has passed them; then they close the interval before, in order."""

    def __init__(self, key: str, keep_ms: int):
        self.key, self.keep_ms = key, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rank int, category string")
        self.open = handle.getValueState("open", "since long, category string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for b in rows:
            for at, rank, category in zip(b["at"], b["rank"], b["category"], strict=True):
                ms = _ms(at)
                if ms <= mark:
                    continue  # too late: its place in the timeline has been given out
                held = self.waiting.getValue((ms,)) if self.waiting.containsKey((ms,)) else None
                if held is None or (rank, category) > (held[0], held[1]):
                    self.waiting.updateValue((ms,), (int(rank), category))
                if held is None:
                    self.handle.registerTimer(ms)
        yield _intervals(self.key, None, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= mark)
        last = self.open.get() if self.open.exists() else None
        for ms in due:
            category = self.waiting.getValue((ms,))[1]
            self.waiting.removeKey((ms,))
            if last is not None:
                out.append((last[0], ms if ms - last[0] <= self.keep_ms else None, last[1]))
            last = (ms, category)
        if last is not None and last[0] + self.keep_ms <= mark:
            out.append((last[0], None, last[1]))  # nothing for so long: the key is let go
            last = None
        if last is None:
            self.open.clear()
        else:
            self.open.update(last)
            if due:
                self.handle.registerTimer(last[0] + self.keep_ms)
        yield _intervals(self.key, key[0], out)

    def close(self) -> None:
        pass


def timelines(transitions: DataFrame, key: str, at: str, category: str, lateness: str = "1 hour", keep_days: float = 365.0) -> DataFrame:
    """key, since, until, category: the intervals between transitions, as the watermark passes them.

    Transitions may come ``lateness`` late in any order; later ones are dropped.  Of those at
    one instant (milliseconds) the highest of RANKS holds, then the last by name.  A key
    without a transition for ``keep_days`` leaves its last interval open (until is null) and
    the state.  A table instead of a stream gives the intervals of all its transitions.
    """
    kind = dict(transitions.dtypes)[key]
    rows = transitions.select(key, F.date_trunc("millisecond", at).alias("at"), _rank(F.col(category)).alias("rank"), F.col(category).alias("category")).filter(f"{key} is not null and at is not null and category is not null")
    keep_ms = int(keep_days * DAY_MS)
    if not rows.isStreaming:
        w = Window.partitionBy(key, "at").orderBy(F.desc("rank"), F.desc("category"))
        one = rows.withColumn("n", F.row_number().over(w)).filter("n = 1")
        then = F.lead("at").over(Window.partitionBy(key).orderBy("at"))
        within = F.unix_millis(then) - F.unix_millis("at") <= keep_ms
        return one.select(key, F.col("at").alias("since"), F.when(within, then).alias("until"), "category")
    schema = T.StructType([T.StructField(key, T._parse_datatype_string(kind)), T.StructField("since", T.TimestampType()), T.StructField("until", T.TimestampType()), T.StructField("category", T.StringType())])
    return rows.withWatermark("at", lateness).groupBy(key).transformWithStateInPandas(Timeline(key, keep_ms), schema, "Append", "EventTime")


def category_at(intervals: DataFrame, asked: DataFrame, key: str, at: str) -> DataFrame:
    """``asked`` (key, at, ...) with the category at that time, from intervals of a table."""
    from tarnlake.operators.joins import best_by

    known = intervals.select(F.col(key).alias("__k"), "since", "until", "category")
    both = asked.withColumn("__row", F.monotonically_increasing_id()).join(known, (F.col(key) == F.col("__k")) & (F.col("since") <= F.col(at)) & (F.col("until").isNull() | (F.col("until") > F.col(at))), "left")
    return best_by(both, ["__row"], F.desc_nulls_last("since")).drop("__k", "since", "until", "__row")
