"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Sources share a number of words by weight; a source takes at most ``most`` times its own
size, and what it can't take is shared again by weight among the others.  Every document
of a source expects the same number of copies, target / size of the source.  The documents
of a source stand in a row, by size; the expected copies are summed along it, one offset
in [0, 1) is added, and a document is taken once for every whole number that its stretch
of the sum crosses.  So a document's copies are its expected ones rounded down or up, and
since neighbours are alike in size, the words taken miss the target by no more than about
the size of the largest document.

Places in the row come from a sort by range, numbered within a task and shifted by the
counts of the tasks before it: a source with a third of all rows is spread like any other.
Copies are counted in whole numbers (a copy is SCALE parts), so no rounding adds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, written

SCALE = 1 << 30
WORDS = r"[^\x20\x09-\x0D]+"
_SOURCE = ["no_source", "name"]


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool = False) -> DataFrame:
    """A row for each document: row_id (any distinct numbers), id, source (a name, or none), size in words;
    with ``whole`` also row, the document as it is."""
    return docs.select(
        *([F.struct(*docs.columns).alias("row")] if whole else []),
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def placed(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with place (1, 2, ... within its group), from a sort by range."""
    keys = [F.col(c) for c in group] + order
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)) if group else F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each task and group that meet: as many as tasks and groups together
    shift = written(parts.select(*group, "part", "in_part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")), f"{name}-shifts")
    return attach(rows, shift, [*group, "part"], "in_part").withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift", "in_part")


def targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """no_source, name, source_size, target: what each source gives to the mix, in words.

    ``docs``: as ``sizes`` gives them.  Sources in the order of their names' code points,
    the null source last, weigh ``weights``, repeating.  All targets add up to ``share`` of
    all sizes, unless ``most`` forbids it.
    """
    by_source = docs.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    ranked = placed(by_source, [], [F.col(c) for c in _SOURCE], "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    exact = lambda c: c.cast("decimal(19,0)")
    s = written(ranked.select(*_SOURCE, "source_size", weight.cast("long").alias("weight")), "weighted")
    num, den = share
    total, open_weight = s.agg(F.coalesce(F.sum(exact(F.col("source_size"))), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).head()
    total, left = int(total), num * int(total)  # left: what the open sources share, times den

    def full(left: int, open_weight: int) -> Column:
        return exact(F.col("weight")) * F.lit(left).cast("decimal(19,0)") > exact(F.col("source_size")) * F.lit(den * most * open_weight).cast("decimal(19,0)")

    # What an open source gets grows from round to round, so one number says which are full.
    is_full = F.lit(False)
    while open_weight:
        was, is_full = is_full, full(left, open_weight)
        taken, now = s.agg(F.coalesce(F.sum(F.when(is_full, exact(F.col("source_size")))), F.lit(0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0))).head()
        if now == open_weight:
            is_full = was
            break
        left, open_weight = num * total - den * most * int(taken), int(now)
    if not open_weight:
        is_full = F.lit(True)
    part = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(1, den * open_weight)))
    return s.select(*_SOURCE, "source_size", F.when(is_full, F.col("source_size").cast("double") * most).otherwise(part).alias("target"))


def _offset(seed: int) -> Column:
    """A number of 28 bits from the source's name."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("int").cast("string"), F.lit(":"), F.col("name")))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("long")


def takes(docs: DataFrame, seed: int = 0, **shares) -> DataFrame:
    """row_id, id, size, source_size, target, copies of each row that ``sizes`` gives."""
    goal = targets(docs, **shares)
    # A row of an id is like another of the same id and size: which of them is taken makes no difference.
    order = [F.col("size"), F.md5(F.col("id").cast("string")), F.col("id"), F.col("row_id")]
    rows = placed(docs.select("row_id", "id", *_SOURCE, "size"), _SOURCE, order, "placed")
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * float(SCALE))).otherwise(F.lit(0))
    facts = goal.select(*_SOURCE, "source_size", "target", step.cast("decimal(11,0)").alias("step"), (_offset(seed) * (SCALE >> 28)).alias("offset"))
    counts = docs.groupBy(*_SOURCE).agg(F.count("*").alias("rows"))
    rows = attach(rows, written(facts.join(counts, _SOURCE), "goals"), _SOURCE, "rows")
    crossed = lambda k: f"((CAST({k} AS decimal(19,0)) * step + offset) div {SCALE})"
    return rows.withColumn("copies", F.expr(f"{crossed('place')} - {crossed('place - 1')}")).select("row_id", "id", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **shares) -> DataFrame:
    """id_col, size, source_size, target, taken (words that the mix takes, repeats counted), copies.

    A null or empty text has size 0; null ids and sources are allowed (no source is a source
    of its own, the last); repeated rows stay, an empty table gives an empty one; other
    columns are ignored.  The same rows give the same result, however they are dealt.
    """
    rows = written(sizes(docs, id_col, text_col, source_col), "sizes")
    out = takes(rows, seed, **shares)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **shares) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken; nulls as in ``mixture``."""
    whole = written(sizes(docs, id_col, text_col, source_col, whole=True), "whole")
    out = takes(whole.drop("row"), seed, **shares).filter("copies > 0").select("row_id", "copies")
    return whole.select("row_id", "row").join(out, "row_id").select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy")).drop("__copy")
