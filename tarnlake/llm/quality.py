"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule is a ratio that grows as a text gets worse; a document is rejected where
a ratio exceeds its cutoff.  Cutoffs are chosen for each stratum and rule from
labelled documents:

* the cutoffs of a rule's grid (fixed beforehand, lax to strict) are tested in that
  order.  With n good labelled documents in the stratum of which k would be
  rejected, a cutoff passes if P(Binomial(n, alpha / rules) <= k) <= delta /
  (rules x strata): the exact binomial bound.  Testing a rule's grid stops at the
  first failure (fixed-sequence testing needs no correction within a grid); the
  Bonferroni divisor covers all rules and strata.  So with probability 1 - delta no
  stratum loses more than alpha of its good documents to the rules.
* of the cutoffs that passed, the one with the largest (share of bad rejected - share
  of good rejected) is taken, the laxest if several tie, and only if that gain is at
  least ``min_gain``; else the rule is off in that stratum.  Too few labels to
  certify anything therefore mean that nothing more is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rule: (its ratio, its grid from lax to strict).
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02),
    "duplicate_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeated_word_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "mean_word_length": (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
}
#: At most so many strata are joined by broadcast: a row is under 200 bytes.
BROADCAST_STRATA = 10_000


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", whole: bool = False) -> DataFrame:
    """One row for each document: id, row_key (hash of id and text), stratum, the counts
    and the rules' ratios; with ``whole`` also row, the document as it is.

    A null or empty text has no words, lines or symbols.  The test for repeated
    windows sorts (64-bit hash, position) within the row, so it is n log n in the
    text's words and needs no shuffle.
    """
    blank = " \t\n\x0b\f\r"
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    own = ["row"] if whole else []
    t = docs.select(*([F.struct(*docs.columns).alias("row")] if whole else []), F.col(id_col).alias("id"), key.alias("row_key"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("trimmed", F.btrim("text", F.lit(blank)))
    t = t.select(
        *own,
        "id",
        "row_key",
        "stratum",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(blank)) != "").alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    t = t.select(
        *own,
        "id",
        "row_key",
        "stratum",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
    )
    # Most texts repeat no window: only the others are sorted.
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(None)).otherwise(F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    t = t.withColumn("at", F.sort_array(F.transform(F.filter("s", lambda x, j: same(x, F.get("s", j - 1)) | same(x, F.get("s", j + 1))), lambda x: x["i"])))
    # Windows overlap: count the words that each adds to those before it.
    covered = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
    t = t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return t.select(
        *own, "id", "row_key", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("n_dup_lines", "n_lines").alias("duplicate_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeated_word_ratio"),
        per("word_chars", "n_words").alias("mean_word_length"),
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms."""
    first = F.struct((n * F.log(F.lit(1 - p))).alias("log"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    return F.when(k < 1, first["sum"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), first, step, lambda a: a["sum"]))


def thresholds(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = 0.05, delta: float = 0.05, min_gain: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff of the rules that are on.

    ``labels``: 1 is good, 0 bad; other values and nulls are ignored, of repeated
    labels of an id the smallest holds.  Documents that fail the base rules count in
    neither class.
    """
    lab = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"))
    rules = list(GRIDS)
    levels = [(r, j, c) for r, grid in GRIDS.items() for j, c in enumerate(grid)]
    seen = feats.filter(~F.col("base_failed")).join(lab, "id")
    # One pass: a count for each rule and cutoff, partial before the shuffle by stratum.
    counts = [F.count_if((F.col("good") == g) & (F.col(r) > c)).alias(f"r{g}_{r}_{j}") for r, j, c in levels for g in (0, 1)]
    wide = written(seen.groupBy("stratum").agg(F.count_if(F.col("good") == 1).alias("n1"), F.count_if(F.col("good") == 0).alias("n0"), *counts), "strata")
    long = wide.select("stratum", "n1", "n0", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(j).alias("level"), F.lit(float(c)).alias("cutoff"), F.col(f"r1_{r}_{j}").alias("k1"), F.col(f"r0_{r}_{j}").alias("k0")) for r, j, c in levels])).alias("x")).select("stratum", "n1", "n0", "x.*")
    strata = wide.count()
    share = alpha / len(rules)
    p = F.when(F.col("k1") > F.col("n1") * share, F.lit(1.0)).otherwise(binomial_cdf(F.col("k1"), F.col("n1"), share))
    tested = long.withColumn("ok", (F.col("n1") > 0) & (p <= delta / (len(rules) * max(1, strata))))
    gain = F.coalesce(F.col("k0") / F.nullif(F.col("n0"), F.lit(0)), F.lit(0.0)) - F.coalesce(F.col("k1") / F.nullif(F.col("n1"), F.lit(0)), F.lit(0.0))
    levels_of = F.sort_array(F.collect_list(F.struct("level", "cutoff", "ok", gain.alias("gain"))))  # a grid: ten at most
    grids = tested.groupBy("stratum", "rule").agg(levels_of.alias("g"))
    # up to the first failure; a strictly better gain replaces a laxer cutoff
    best = F.aggregate(
        "g",
        F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cutoff"), F.lit(float(min_gain) - 1e-12).alias("gain")),
        lambda a, x: F.when(a["on"] & x["ok"] & (x["gain"] > a["gain"]), F.struct(F.lit(True).alias("on"), x["cutoff"].alias("cutoff"), x["gain"].alias("gain"))).otherwise(F.struct((a["on"] & x["ok"]).alias("on"), a["cutoff"].alias("cutoff"), a["gain"].alias("gain"))),
        lambda a: a["cutoff"],
    )
    return grids.select("stratum", "rule", best.alias("cutoff")).filter(F.col("cutoff").isNotNull())


def _cutoffs(feats: DataFrame, labels: DataFrame, id_col: str, **risk) -> tuple[DataFrame, bool]:
    """stratum, cut (rule to cutoff), and whether the strata are few enough for a broadcast."""
    cut = thresholds(feats, labels, id_col=id_col, **risk).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))  # four rules
    cut = written(cut, "cutoffs")
    return cut, cut.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA


def _judged(feats: DataFrame, cut: DataFrame, few: bool) -> DataFrame:
    out = feats.join(F.broadcast(cut) if few else cut, "stratum", "left")
    fired = F.filter(F.array(*[F.when(F.col(r) > F.coalesce(F.col("cut")[r], F.lit(float("inf"))), F.lit(r)) for r in GRIDS]), lambda x: x.isNotNull())
    return out.withColumn("fired", fired).withColumn("kept", ~F.col("base_failed") & (F.size("fired") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """id_col, the base counts, base_failed, kept and the names of the rules that fired.

    Null ids, strata and texts are allowed (a null stratum is the stratum ''), repeated
    rows stay, an empty table gives an empty one.  Only the named columns are read.
    """
    feats = written(features(docs, id_col, text_col, stratum_col), "features")
    out = _judged(feats, *_cutoffs(feats, labels, id_col, **risk))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("fired", ",").alias("fired"))


def passed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns; nulls as in ``quality_rules``."""
    whole = written(features(docs, id_col, text_col, stratum_col, whole=True), "features")
    feats = whole.drop("row")
    cut, few = _cutoffs(feats, labels, id_col, **risk)
    if few:  # the verdict comes to the row: no text is shuffled
        return _judged(whole, cut, few).filter("kept").select("row.*")
    kept = _judged(feats, cut, few).filter("kept").select("row_key").distinct()
    return whole.join(kept, "row_key", "left_semi").select("row.*")
