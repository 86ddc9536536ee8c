"""Token counts by prefix dynamic programming.

A byte-pair encoding is the only token sequence in which every adjacent pair is
stable, that is, encodes to itself when taken alone.  So the last token of a
prefix is the one vocabulary suffix that is stable after the last token of the
shorter prefix in front of it, and

    count[i] = count[i - len(last[i])] + 1

gives the exact token count of *every* prefix in one left-to-right pass.  No
piece of the vocabulary holds the space mark after another character, so words
with the marks before them encode independently: the table is made once for
each distinct word and a document's counts are running sums over its words.

Truncation and budget questions are answered from the stored counts
(``PrefixTable.count_at``, ``longest_prefix``) without encoding anything again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import small_batches
from .common import tokenizer_file

SPACE = "▁"
NORMAL = 1  # a piece type of the model file: ordinary text


class PrefixCounter:
    """Prefix tables of words under a score-ranked BPE with byte fallback."""

    def __init__(self, path: str, cache_words: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or train.model_type != train.BPE or not train.byte_fallback:
            raise ValueError("needs a BPE model with identity normalisation and byte fallback")
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("user-defined or unused pieces aren't supported")
        self.dummy = norm.add_dummy_prefix
        self.rank = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece spans words")
        self.names = [""]  # by token number; 0 begins a word
        # What a piece ends with: a piece's number, or 0 for an ending that is no piece itself.
        self.endings: dict[str, int] = {}
        for piece in self.rank:
            for j in range(1, len(piece)):
                self.endings.setdefault(piece[j:], 0)
            self.endings[piece] = len(self.names)
            self.names.append(piece)
        self.n_pieces = len(self.names)
        self.unknown: dict[str, int] = {}
        self.stable: dict[int, bool] = {}
        self.words: dict[str, bytes | np.ndarray] = {}
        self.cache_words = cache_words

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        a, b = self.names[left], self.names[right]
        if len(self.stable) > 3_000_000:
            self.stable.clear()
        known = self.stable[left << 24 | right] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def spelled(self, char: str) -> int:
        """Number of a character outside the vocabulary, which is spelled in bytes and never merges."""
        n = self.unknown.get(char)
        if n is None:
            n = self.unknown[char] = len(self.names)
            self.names.append(char)
        return n

    def fill(self, words: list[str]) -> None:
        """Tables of new words.  In sorted order a word takes over what it has in common with the one before."""
        endings, stable = self.endings, self.stable
        last, counts, before = [0], [0], ""
        for word in sorted(words):
            n, k = len(word), 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                k += 1
            del last[k + 1 :], counts[k + 1 :]
            for i in range(k + 1, n + 1):
                j, found = i - 1, 0
                while j >= 0:
                    token = endings.get(word[j:i])
                    if token is None:
                        break
                    if token:
                        ok = stable.get(last[j] << 24 | token)
                        if self.is_stable(last[j], token) if ok is None else ok:
                            found = token
                            break
                    j -= 1
                if found:
                    last.append(found)
                    counts.append(counts[j] + 1)
                elif word[i - 1] in self.rank:  # can't happen while the theorem holds
                    raise AssertionError(f"no stable token ends prefix {i} of {word[:40]!r}")
                else:
                    last.append(self.spelled(word[i - 1]))
                    counts.append(counts[i - 1] + len(word[i - 1].encode("utf-8", "surrogatepass")))
            before = word
            self.words[word] = bytes(counts[1:]) if counts[n] < 200 and max(counts) < 256 else np.array(counts[1:], dtype=np.uint32)

    def table(self, word: str) -> bytes | np.ndarray:
        """Token count of each non-empty prefix of ``word``; bytes where they fit."""
        if word not in self.words:
            self.fill([word])
        return self.words[word]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The texts' units, all of them in the tables then."""
        if len(self.words) > self.cache_words:
            self.words.clear()
        units = [self.units(t) for t in texts]
        self.fill(list({u for us in units for u in us if u not in self.words}))
        return units

    def units(self, text: str) -> list[str]:
        """Independent stretches of the marked text: marks, then what follows them."""
        if not text:
            return []
        if self.dummy and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            return [SPACE + w for w in text.split(" ")]
        marked = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)

    def count(self, text: str) -> int:
        return sum(self.table(u)[-1] for u in self.units(text))

    def prefix_table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Counts at every prefix of one text, as running sums over word tables."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.n_chars, self.dummy = len(text), counter.dummy and bool(text)
        units = counter.units(text)
        self.tables = [counter.table(u) for u in units]
        self.ends = np.cumsum([len(u) for u in units], dtype=np.int64) if units else np.zeros(0, np.int64)
        self.sums = np.cumsum([t[-1] for t in self.tables], dtype=np.int64) if units else np.zeros(0, np.int64)

    @property
    def total(self) -> int:
        return int(self.sums[-1]) if len(self.sums) else 0

    def count_at(self, chars: int) -> int:
        """Exact token count of the first ``chars`` characters."""
        if chars <= 0 or not self.tables:
            return 0
        marked = min(chars, self.n_chars) + self.dummy
        k = int(np.searchsorted(self.ends, marked, side="left"))
        before, at = (int(self.sums[k - 1]), int(self.ends[k - 1])) if k else (0, 0)
        return before + int(self.tables[k][marked - at - 1])

    def counts(self) -> np.ndarray:
        """The count at every prefix, 1 to n_chars."""
        if not self.tables:
            return np.zeros(0, np.int64)
        flat = np.concatenate([np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t for t in self.tables]).astype(np.int64)
        lengths = np.diff(self.ends, prepend=0)
        flat += np.repeat(self.sums - np.array([t[-1] for t in self.tables], dtype=np.int64), lengths)
        return flat[1:] if self.dummy else flat

    def longest_prefix(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        if self.total <= budget:
            return self.n_chars
        k = int(np.searchsorted(self.sums, budget, side="right"))
        # A longer word can take fewer tokens than its beginning, so look at all of the word that crosses.
        while k >= 0:
            before, at = (int(self.sums[k - 1]), int(self.ends[k - 1])) if k else (0, 0)
            t = self.tables[k]
            c = (np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t).astype(np.int64) + before
            fits = np.flatnonzero(c <= budget)
            if len(fits):
                return max(0, at + int(fits[-1]) + 1 - self.dummy)
            if k and before <= budget:
                return max(0, at - self.dummy)
            k -= 1
        return 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One per Python worker, so that its word tables serve all its tasks."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """Exact token counts of whole texts, and what fits into ``limit`` tokens.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit, fit_chars (longest prefix
    of at most ``limit`` tokens); with ``prefixes`` also prefix_counts, the count at
    every prefix.  A null text is the empty text: no bytes, no tokens.  Null and
    repeated ids stay as they are, one row out for each row in.  Other columns are
    ignored, whatever their names.
    """
    path = tokenizer_file(model)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = src.schema["id"].dataType
    fields = [T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())]
    if prefixes:
        fields.append(T.StructField("prefix_counts", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            totals, fits, every = [], [], []
            for part in small_batches(v.as_py() for v in b.column("text")):
                for text, units in zip(part, c.learn(part), strict=True):
                    n = sum([c.words[u][-1] for u in units])
                    t = c.prefix_table(text) if prefixes or n > limit else None
                    totals.append(int(n))
                    fits.append(len(text) if t is None else t.longest_prefix(limit))
                    if prefixes:
                        every.append(t.counts().tolist())
            columns = [b.column("id"), b.column("n_bytes"), pa.array(totals, pa.int64()), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(every, pa.list_(pa.int64()))] * prefixes, names=[f.name for f in fields])

    out = src.mapInArrow(run, T.StructType(fields)).withColumn("over_limit", F.col("n_tokens") > limit)
    return out.withColumnRenamed("id", id_col)
