"""Text ranking and normal forms: BM25, diverse re-ranking, fuzzy names, NFKC."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tarnlake.operators.joins import top_n


@pandas_udf(T.StringType())
def normal_text(texts: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, at most 4,000 characters."""
    return texts.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip()[:4000])


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score, rank of the k best documents for the query's words.

    Only rows that hold a query word are shuffled; length and document counts are one
    aggregate over the table.
    """
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]+"), 0)
    d = docs.select(F.col(id_col).alias("id"), words.alias("w")).withColumn("len", F.size("w"))
    q = sorted(set(query))
    tf = d.select("id", "len", *[(F.size("w") - F.size(F.array_remove("w", t))).alias(f"tf_{i}") for i, t in enumerate(q)])
    s = tf.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(q))]).head()
    score = F.lit(0.0)
    for i in range(len(q)):
        idf = float(np.log(1 + (s["n"] - s[f"df_{i}"] + 0.5) / (s[f"df_{i}"] + 0.5)))
        f = F.col(f"tf_{i}").cast("double")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / float(s["mean"] or 1)))
    hits = tf.filter(" OR ".join(f"tf_{i} > 0" for i in range(len(q)))).select("id", F.round(score, 9).alias("score"))
    return top_n(hits.withColumn("g", F.lit(0)), ["g"], k, F.desc("score"), F.asc("id")).drop("g")


def token_set_ratio(a: str, b: str) -> float:
    """Share of the longer name's words that both have, 0 to 100, order and repeats apart."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return 100.0 * len(x & y) / max(len(x), len(y)) if x and y else 0.0


def diverse(ids: list, scores: np.ndarray, vectors: np.ndarray, k: int, weight: float = 0.7) -> list:
    """Maximal marginal relevance over a bounded candidate list."""
    left, chosen = list(range(len(ids))), []
    sim = vectors @ vectors.T
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * max((sim[i, j] for j in chosen), default=0.0), -i))
        chosen.append(best)
        left.remove(best)
    return [ids[i] for i in chosen]


def allocate(counts: dict[str, int], total: int, least: int) -> dict[str, int]:
    """Sample sizes by the square root of stratum sizes, at least ``least`` or all of a stratum."""
    weight = {s: n**0.5 for s, n in counts.items()}
    whole = sum(weight.values()) or 1.0
    return {s: min(n, max(least, int(total * weight[s] / whole))) for s, n in counts.items()}


def stratified_sample(df: DataFrame, id_col: str, stratum_col: str, total: int, least: int, salt: str) -> DataFrame:
    """Rows by stratum, the least salted hashes first; strata are few (one count each)."""
    counts = {r[0]: r[1] for r in df.filter(F.col(stratum_col).isNotNull()).groupBy(stratum_col).count().collect()}
    size = allocate(counts, total, least)
    if not size:
        return df.limit(0)
    want = F.element_at(F.create_map(*[F.lit(x) for kv in size.items() for x in kv]), F.col(stratum_col))
    h = F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256)
    ranked = top_n(df.filter(F.col(stratum_col).isNotNull()).withColumn("sample_key", h), [stratum_col], max(size.values()), F.asc("sample_key"), F.asc(id_col))
    return ranked.filter(F.col("rank") <= want)
