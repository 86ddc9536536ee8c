"""Quotation linking: which message a message answers, and what it says itself.

A line's quote level is the number of ``>`` marks in front of it.  Lines are normalised
(marks off, lower case, white space collapsed) and hashed; lines without text are left
out.  A quoted passage is a run of lines of one level.  The whole passage is looked for
in the own lines of all messages, and so is each of its lines: only where an own line
begins a passage that is quoted somewhere its run is hashed.  Each passage and line finds
the nearest earlier message of the conversation that has it, by one window over the
hash's places in the conversation, or else the first place in another conversation; so a
common line adds no rows.  A passage that is found votes as a whole, of others each line
votes; a vote counts the less, the more messages have its text.  A message answers the
one with the most votes of its lowest level that has any; without, the turn before it.
Links to conversations of higher number could form a cycle, whose first message then
loses its link.  Threads follow the quotation links by pointer doubling, so no
conversation is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

MARKS = r"^([ \t]*>)+"


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\s]+", " "))


def _lines() -> Column:
    """level, hash of every line with text, in order."""
    line = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[ \t]", ""))
    rows = F.filter(F.transform(line, lambda x: F.struct(level(x).alias("level"), _normal(x).alias("norm"))), lambda x: x["norm"] != "")
    return F.transform(rows, lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["norm"], F.lit(1)).alias("hash")))


def _passages(m: DataFrame) -> DataFrame:
    """mid, conv, turn, level, run, whole, first, n, key: the quoted passages and each of their lines."""
    lines = m.filter(F.exists("ls", lambda x: x["level"] > 0)).select("mid", "conv", "turn", F.posexplode("ls").alias("pos", "l")).select("mid", "conv", "turn", "pos", "l.level", "l.hash").filter("level > 0")
    lines = lines.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("mid", "level").orderBy("pos")))
    runs = lines.groupBy("mid", "conv", "turn", "level", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("hs"))

    def piece(whole: bool, hs: Column) -> Column:
        return F.struct(F.lit(whole).alias("whole"), hs[0].alias("first"), F.size(hs).alias("n"), F.xxhash64(hs).alias("key"))

    pieces = F.concat(F.array(piece(True, F.col("hs"))), F.transform("hs", lambda h: piece(False, F.array(h))))
    return runs.select("mid", "conv", "turn", "level", "run", F.explode(pieces).alias("p")).select("mid", "conv", "turn", "level", "run", "p.*")


def _places(m: DataFrame, passages: DataFrame) -> DataFrame:
    """key, conv, turn: the messages whose own lines hold a passage."""
    own = m.filter("conv is not null and turn is not null").select("mid", "conv", "turn", F.transform(F.filter("ls", lambda x: x["level"] == 0), lambda x: x["hash"]).alias("own"))
    begun = own.select("mid", F.size("own").alias("size"), F.posexplode("own").alias("pos", "first")).join(passages.select("first", "n").distinct(), "first")
    begun = begun.filter("pos + n <= size").groupBy("mid").agg(F.collect_list(F.struct("pos", "n")).alias("begun"))
    key = F.transform("begun", lambda x: F.xxhash64(F.slice("own", x["pos"] + 1, x["n"])))
    runs = own.join(begun, "mid").select(F.explode(F.array_distinct(key)).alias("key"), "conv", "turn")
    return runs.join(passages.select("key").distinct(), "key", "left_semi").distinct()


def _origins(asked: DataFrame, places: DataFrame) -> DataFrame:
    """key, conv, turn, o, n_places: the nearest earlier place in the conversation, or else the first in another one."""
    both = asked.select("key", "conv", "turn", F.lit(0).alias("side"), F.lit(None).cast("long").alias("at")).unionByName(places.select("key", "conv", "turn", F.lit(1).alias("side"), F.col("turn").alias("at")))
    so_far = Window.partitionBy("key", "conv").orderBy("turn", "side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("at", ignorenulls=True).over(so_far)).filter("side = 0").drop("side", "at")
    firsts = places.groupBy("key", "conv").agg(F.min("turn").alias("turn"))
    firsts = firsts.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("conv"))).filter("k <= 2")  # one of two is another conversation
    firsts = firsts.groupBy("key").agg(F.min(F.struct("conv", "turn")).alias("g"), F.max(F.struct("conv", "turn")).alias("g2"))
    out = near.join(firsts, "key", "left").join(places.groupBy("key").agg(F.count("*").alias("n_places")), "key", "left")
    here = F.struct("conv", F.col("near").alias("turn"))
    o = F.when(F.col("near").isNotNull(), here).when(F.col("g.conv") != F.col("conv"), F.col("g")).when(F.col("g2.conv") != F.col("conv"), F.col("g2"))
    return out.select("key", "conv", "turn", o.alias("o"), "n_places")


def _cycle_heads(up: DataFrame) -> DataFrame:
    """conv, turn of the first message of each cycle of links (conv, turn) -> o."""
    place = F.struct("conv", "turn")
    if up.filter(F.col("o") > place).isEmpty():  # links to earlier places alone form none
        return up.filter("false").select("conv", "turn")
    ways = written(up.select(place.alias("p"), F.col("o").alias("r"), F.col("o").alias("least")), "cycles")
    for _ in range(ways.count().bit_length()):  # then every way has gone round its cycle, or ended
        on = ways.select(F.col("p").alias("r"), F.col("r").alias("r2"), F.col("least").alias("least2"))
        ways = written(ways.join(on, "r", "left").select("p", F.col("r2").alias("r"), F.least("least", "least2").alias("least")), "cycles")
    return ways.filter("r is not null and least = p").select("p.conv", "p.turn")


def quotation_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rounds: int = 64) -> DataFrame:
    """One row for each message: conv_id, turn, role, body (the text without quoted
    lines), n_quoted and n_linked (quoted lines, and those found in another message),
    reply_conv and reply_turn with link 'quote' or 'turn' (null: it answers nothing),
    thread_conv, thread_turn and depth along quotation links.  In the order (thread,
    depth, conversation, turn) every message follows the one it quotes.

    Within a conversation only earlier turns are originals; in other conversations any
    message is, as ids say nothing about time, and where links would form a cycle its
    first message in (conversation, turn) order is linked to none.  A null text
    is empty; conversations and turns are read as long, and rows where one is null are
    linked to nothing.  Repeated rows
    stay, and stand for one message as originals.  Other columns are ignored.
    """
    m = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    m = written(m.withColumn("mid", F.monotonically_increasing_id()).withColumn("ls", _lines()), "messages")
    passages = written(_passages(m), "passages")
    asked = passages.filter("conv is not null and turn is not null").select("key", "conv", "turn").distinct()
    found = passages.join(_origins(asked, written(_places(m, passages), "places")), ["key", "conv", "turn"], "left")
    found = written(found.select("mid", "conv", "level", "run", "whole", "n", "o", "n_places"), "found")
    counts = found.filter("not whole").groupBy("mid").agg(F.count("*").alias("n_quoted"), F.count("o").alias("n_linked"))
    known = F.max(F.col("whole") & F.col("o").isNotNull()).over(Window.partitionBy("mid", "level", "run"))
    votes = found.withColumn("known", known).filter("o is not null and whole = known")
    votes = votes.groupBy("mid", "conv", "level", "o").agg(F.round(F.sum(F.col("n") / F.col("n_places")), 9).alias("weight"))
    votes = votes.groupBy("mid").agg(F.max_by("o", F.struct(-F.col("level"), "weight", F.col("o.conv") == F.col("conv"), "o")).alias("o"))
    keys = m.filter("conv is not null and turn is not null").select("conv", "turn").distinct()
    before = keys.select("conv", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows"))
    linked = m.join(counts, "mid", "left").join(votes, "mid", "left").join(before, ["conv", "turn"], "left")
    linked = written(linked.drop("ls"), "linked")
    up = linked.filter("o is not null").groupBy("conv", "turn").agg(F.max("o").alias("o"))
    heads = _cycle_heads(up).withColumn("head", F.lit(True))
    linked = linked.join(heads, ["conv", "turn"], "left").withColumn("o", F.when(F.col("head").isNull(), F.col("o"))).drop("head")

    # Threads: each message's way up doubles in a round, until all ways end at a root.
    up = up.join(heads, ["conv", "turn"], "left_anti")
    ways = written(up.select("conv", "turn", F.col("o.conv").alias("r_conv"), F.col("o.turn").alias("r_turn"), F.lit(1).cast("long").alias("depth")), "ways")
    for _ in range(most_rounds):
        on = ways.select(F.col("conv").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("r_conv").alias("n_conv"), F.col("r_turn").alias("n_turn"), F.col("depth").alias("n_depth"))
        longer = ways.join(on, ["r_conv", "r_turn"], "left")
        ways = written(longer.select("conv", "turn", F.coalesce("n_conv", "r_conv").alias("r_conv"), F.coalesce("n_turn", "r_turn").alias("r_turn"), (F.col("depth") + F.coalesce("n_depth", F.lit(0))).alias("depth"), F.col("n_depth").isNotNull().alias("grew")), "ways")
        if ways.filter("grew").isEmpty():
            break
        ways = ways.drop("grew")
    else:
        raise RuntimeError("threads did not settle")
    out = linked.join(ways.select("conv", "turn", "r_conv", "r_turn", "depth"), ["conv", "turn"], "left")
    body = F.btrim(F.regexp_replace(F.regexp_replace("text", r"(?m)^([ \t]*>)+.*$", ""), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))
    follows = F.coalesce("follows", F.lit(False))
    return out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        body.alias("body"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.when(F.col("o").isNotNull(), F.col("o.conv")).when(follows, F.col("conv")).alias("reply_conv"),
        F.when(F.col("o").isNotNull(), F.col("o.turn")).when(follows, F.col("turn") - 1).alias("reply_turn"),
        F.when(F.col("o").isNotNull(), F.lit("quote")).when(follows, F.lit("turn")).alias("link"),
        F.coalesce("r_conv", "conv").alias("thread_conv"),
        F.coalesce("r_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def reply_order(links: DataFrame) -> DataFrame:
    """The rows of ``quotation_links`` as conversations: threads one after another, and in a
    thread every message after the one it quotes.

    A sort by range: a thread that very many messages belong to is over several tasks.
    """
    return links.orderBy("thread_conv", "thread_turn", "depth", "conv_id", "turn")
