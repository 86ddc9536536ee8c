"""Pluggable batch classifiers and encoders: a model behind one function for a batch of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: A batch of texts and the options to the probability of each option, one row for each text.
Decide = Callable[[list[str], list[str]], np.ndarray]
#: A batch of texts to one vector each.
Encode = Callable[[list[str]], np.ndarray]


def decider(load: Callable[[], Decide], options: list[str]):
    """A column function: text to (answer, probability, distribution).  ``load`` runs once for each task.

    Null texts get null; ties go to the first option.
    """
    kind = T.StructType([T.StructField("answer", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("distribution", T.ArrayType(T.DoubleType()))])

    @pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decide = load()
        for texts in batches:
            known = texts.notna().to_numpy()
            p = np.zeros((len(texts), len(options)))
            if known.any():
                p[known] = decide(texts[known].tolist(), options)
            best = p.argmax(axis=1)
            out = pd.DataFrame({"answer": [options[k] if ok else None for k, ok in zip(best, known, strict=True)], "probability": np.where(known, p.max(axis=1, initial=0.0), np.nan), "distribution": [list(r) if ok else None for r, ok in zip(p, known, strict=True)]})
            yield out.astype({"probability": "object"}).where(pd.Series(known, index=out.index), None)

    return run


def keyword_decider(words: dict[str, list[str]]) -> Callable[[], Decide]:
    """A decider by words of each option: shares of hits, the same without any."""

    def load() -> Decide:
        def decide(texts: list[str], options: list[str]) -> np.ndarray:
            hits = np.array([[sum(t.lower().count(w) for w in words.get(o, ())) for o in options] for t in texts], float) + 0.1
            return hits / hits.sum(axis=1, keepdims=True)

        return decide

    return load


def encoder(load: Callable[[], Encode]):
    """A column function: text to a vector of unit length; null texts get null."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            out = [None] * len(texts)
            at = np.flatnonzero(texts.notna().to_numpy())
            if len(at):
                v = encode(texts.iloc[at].tolist())
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for k, row in zip(at, v, strict=True):
                    out[k] = row.astype(np.float32)
            yield pd.Series(out, index=texts.index, dtype=object)

    return run


def hash_encoder(dims: int = 64) -> Callable[[], Encode]:
    """Vectors from hashed words: the same text always gets the same vector."""

    def load() -> Encode:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for k, t in enumerate(texts):
                for w in t.lower().split():
                    h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                    out[k, int.from_bytes(h[:4], "little") % dims] += 1 if h[4] % 2 else -1
            return out

        return encode

    return load


def decide_table(df: DataFrame, text_col: str, load: Callable[[], Decide], options: list[str]) -> DataFrame:
    """``df`` with answer, probability, distribution; equal texts are decided once."""
    texts = df.select(text_col).filter(F.col(text_col).isNotNull()).distinct()
    once = texts.withColumn("__d", decider(load, options)(F.col(text_col))).select(text_col, "__d.*")
    return df.join(once, text_col, "left")
