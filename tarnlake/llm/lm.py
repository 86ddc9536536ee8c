"""Language-model scores from a log-frequency Bloom filter.

Counts of word n-grams (orders 1 and 2) of the training documents are gathered over
the whole corpus.  A count c is quantised to the level 1 + floor(log2 c), and the
n-gram is put into a Bloom filter once for each level up to its own.  A count is read
back by probing level after level until one is missing, so the structure never holds
an n-gram itself.  A text's probability interpolates the two orders:

    p(w | h) = weight * c(h, w) / c(h) + (1 - weight) * (c(w) + 1) / (N + V + 1)

All n-grams go in, whatever their count.  The filter is in segments by range of hash;
their number grows with the corpus, and each is as large as its own n-grams ask for, so
that at most half of its bits are set.  No worker holds more than one segment: the
n-grams to be scored come to the segment that has them, packed by batch of texts, and
their levels go back to the batch.

The exact base score needs exact counts of all words.  The most frequent words are
looked up in the worker (a bounded list); the others are joined by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import small_batches
from .common import give_back, keep_only, packed, unpacked, written

END = b""  # no word is empty, so the empty word stands for a document's end
#: Of a filter held as a whole: 2**LOG_BITS bits in 2**LOG_SEGMENTS parts.  There are as many ranges as parts at least.
LOG_BITS, LOG_SEGMENTS, PROBES = 27, 6, 4
#: An n-gram is known in its range by so many more bits of its hash.
ITEM_BITS = 40
#: Tokens of a batch of texts.
BATCH_TOKENS = 1_500_000
#: Elements of long arrays that are worked on at once: what is made meanwhile fits a core's cache, and a worker's heap.
PART = 50_000
#: Words looked up in the worker; each at most so many bytes long: 20 MB at the most.
HOT_WORDS, HOT_BYTES = 200_000, 100
TOP_LEVEL = 48


def words_of(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know A-Z and the six ASCII blanks alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def bigram(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64)


def parts(n: int) -> Iterator[slice]:
    return (slice(a, min(a + PART, n)) for a in range(0, n, PART))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c)


# -- the filter ---------------------------------------------------------------
def places(items: np.ndarray, level: int | np.ndarray, log_bits: int = LOG_BITS - LOG_SEGMENTS) -> Iterator[np.ndarray]:
    """Bit numbers inside an item's segment of 2**log_bits bits, one array for each probe."""
    inside = np.uint64((1 << log_bits) - 1)
    h = mixed(items + np.asarray(level).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    step = mixed(h) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) >> np.uint64(20)) & inside


class LogFrequencyFilter:
    """2**log_segments segments by an item's first bits, all of one size; 0 is one segment for all items."""

    def __init__(self, raw: bytes, log_segments: int = LOG_SEGMENTS):
        self.bits = np.frombuffer(raw, np.uint8)
        self.log_segments = log_segments
        self.log_bits = (len(raw) * 8).bit_length() - 1 - log_segments  # of a segment

    def level(self, items: np.ndarray) -> np.ndarray:
        """The level of each item: probes go up while every probe of a level hits."""
        out = np.zeros(len(items), np.uint8)
        for own in parts(len(items)):
            out[own] = self._level(items[own])
        return out

    def _level(self, items: np.ndarray) -> np.ndarray:
        out = np.zeros(len(items), np.uint8)
        at = np.arange(len(items))
        for level in range(1, TOP_LEVEL):
            own = items[at]
            base = (own >> np.uint64(64 - self.log_segments)) << np.uint64(self.log_bits) if self.log_segments else np.uint64(0)
            hit = np.ones(len(own), bool)
            for p in places(own, level, self.log_bits):
                p = base + p
                hit &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at = at[hit]
            if not len(at):
                break
            out[at] = level
        return out


def expected(level: np.ndarray) -> np.ndarray:
    """Expected counts: the middle of a level's range; 0 where the first level misses."""
    level = level.astype(np.float64)
    return np.where(level > 0, (3.0 * 2.0 ** (level - 1) - 1) / 2, 0.0)


# -- counting -----------------------------------------------------------------
def held_out(docs: DataFrame, id_col: str) -> F.Column:
    """Whether a row's id puts it into the held-out seventh."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c: counts of the words and ends of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for text in b.column(0):
                c.update(words_of(text.as_py()))
            c[END] += b.num_rows
            if len(c) > 400_000:
                yield out()
                c.clear()
        if c:
            yield out()
        c.clear()
        give_back()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _grams(words: np.ndarray, seq: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """order, items (distinct, ascending), place of each token's item: the n-grams of a batch of texts."""
    items = mixed(words)
    by = np.argsort(items)
    place = np.empty(len(by), np.uint32)
    place[by] = np.arange(len(by), dtype=np.uint32)
    yield 1, items[by], place[seq]
    items = np.empty(len(seq), np.uint64)
    before = word_hashes([END])
    for part in parts(len(seq)):
        w = np.r_[before, words[seq[part]]]
        items[part] = bigram(w[:-1], w[1:])
        before = w[-1:]
    by = np.argsort(items)
    items = items[by]
    first = np.r_[True, items[1:] != items[:-1]]
    place = np.empty(len(by), np.uint32)
    place[by] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
    del by
    items = items[first]
    yield 2, items, place


def _dealt(batches: DataFrame, bits: int) -> DataFrame:
    """range, order, batch, high, low, counts: each batch's n-grams and how often its training texts have them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        for r in rows:
            for at in range(r.num_rows):
                x = {k: r.column(k)[at].as_py() for k in r.schema.names}
                words, seq = np.frombuffer(x["words"], np.uint64), unpacked(x["seq"], np.uint32)
                train = ~np.repeat(np.array(x["held_out"], bool), x["sizes"])
                out = []
                for order, items, place in _grams(words, seq):
                    counts = np.bincount(place[train], minlength=len(items)).astype(np.uint32)
                    cuts = np.searchsorted(items, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                    for number, (a, b) in enumerate(zip(cuts, np.r_[cuts[1:], len(items)], strict=True)):
                        if a < b:
                            own = (items[a:b] >> np.uint64(64 - bits - ITEM_BITS)) & np.uint64((1 << ITEM_BITS) - 1)
                            out.append((number, order, x["batch"], packed((own >> np.uint64(32)).astype(np.uint8)), own.astype(np.uint32).tobytes(), packed(counts[a:b])))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["range", "order", "batch", "high", "low", "counts"])
        give_back()

    return batches.select("batch", "held_out", "sizes", "words", "seq").mapInArrow(run, "range long, order int, batch long, high binary, low binary, counts binary")


def _segment(least: dict[int, int], log_bits: int = LOG_BITS - LOG_SEGMENTS):
    """Sets the bits of the n-grams of one segment whose level is ``least`` or more."""

    def run(key, rows):
        bits = np.zeros(1 << log_bits, bool)
        for r in rows.itertuples(index=False):
            items, level = np.frombuffer(r.items, np.uint64), np.frombuffer(r.levels, np.uint8)
            for part in parts(len(items)):
                keep = level[part] >= least[r.order]
                these, up_to = items[part][keep], level[part][keep]
                for x in range(1, int(up_to.max(initial=0)) + 1):
                    for p in places(these[up_to >= x], x, log_bits):
                        bits[p] = True
        return pd.DataFrame({"segment": [key[0]], "part": [np.packbits(bits, bitorder="little").tobytes()]})

    return run


def _looked_up(rows: pd.DataFrame) -> pd.DataFrame:
    """One range: its segment of the filter from all training counts, and the levels it has for each batch's n-grams."""
    keep_only(None)
    asked, put = [], []
    for order, own in rows.groupby("order"):
        own = own.reset_index(drop=True)
        ends = np.cumsum([len(x) // 4 for x in own["low"]])
        items, counts = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
        for a, b, h, x, c in zip(np.r_[0, ends[:-1]], ends, own["high"], own["low"], own["counts"], strict=True):
            items[a:b] = unpacked(h, np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(x, np.uint32)
            counts[a:b] = unpacked(c, np.uint32)
        by = np.argsort(items)
        items, counts, by = items[by], counts[by], by.astype(np.uint32)
        first = np.r_[True, items[1:] != items[:-1]]
        starts = np.flatnonzero(first)
        level = levels(np.add.reduceat(counts, starts, dtype=np.int64)).astype(np.uint8)  # of no training text: 0
        del counts, starts
        items = items[first]
        put.append((int(order), items, level))
        asked.append((int(order), own[["batch", "range"]], ends, items, by, first))
    insertions = sum(int(level.sum(dtype=np.int64)) for _, _, level in put)
    log_bits = max(10, int(np.ceil(np.log2(max(1, insertions) * PROBES / 0.69))))  # half of the bits are set at most
    frame = pd.DataFrame(put, columns=["order", "items", "levels"])
    model = LogFrequencyFilter(_segment({1: 1, 2: 1}, log_bits)((0,), frame)["part"][0], 0)
    out = []
    for order, own, ends, items, by, first in asked:
        level = np.empty(len(by), np.uint8)
        level[by] = np.repeat(model.level(items), np.diff(np.flatnonzero(np.r_[first, True])))
        for batch, range_, a, b in zip(own["batch"], own["range"], np.r_[0, ends[:-1]], ends, strict=True):
            out.append((int(batch), int(range_), order, packed(level[a:b])))
    return pd.DataFrame(out, columns=["batch", "range", "order", "levels"])


def gram_levels(batches: DataFrame, n_tokens: int, range_items: int = 2_000_000) -> DataFrame:
    """batch, levels: for each batch the filter's levels of its n-grams, by order and range."""
    bits = max(LOG_SEGMENTS, (max(1, n_tokens) // range_items).bit_length())
    out = _dealt(batches, bits).groupBy("range").applyInPandas(_looked_up, "batch long, range long, order int, levels binary")
    return out.groupBy("batch").agg(F.collect_list(F.struct("order", "range", "levels")).alias("levels"))


def _frequent(counts: DataFrame) -> dict[bytes, int]:
    """Words that are more frequent than a certain count, HOT_WORDS at the most; ties go in or stay out together."""
    short = counts.filter(F.octet_length("word") <= HOT_BYTES).withColumn("step", F.floor(16 * F.log2("c")))
    least, room = None, HOT_WORDS
    for step, n in sorted(((r["step"], r["count"]) for r in short.groupBy("step").count().collect()), reverse=True):  # a row for each step, 800 at most
        room -= n
        if room < 0:
            break
        least = step
    rows = short.filter(F.col("step") >= least).select("word", "c").toArrow() if least is not None else pa.table({"word": [], "c": []})
    return dict(zip(rows.column("word").to_pylist(), rows.column("c").to_pylist(), strict=True))


# -- scoring ------------------------------------------------------------------
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = 0.15) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose id is not held out.  A null text is the empty text, whose
    only token is the end; a null id counts as ''.  One row for each row in.  Without any
    training row N and V are 0.  Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), held_out(docs, id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = src.filter(~F.col("held_out")).select("text")
    counts = written(word_counts(texts), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    hot = spark.sparkContext.broadcast(_frequent(counts))
    id_type = src.schema["id"].dataType
    each = [("n_known", T.LongType()), ("base", T.DoubleType()), ("rare", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.IntegerType()))]
    lists = [("ids", id_type), ("held_out", T.BooleanType()), ("sizes", T.LongType()), *each]
    schema = T.StructType([T.StructField("batch", T.LongType()), *[T.StructField(k, T.ArrayType(t)) for k, t in lists], T.StructField("words", T.BinaryType()), T.StructField("seq", T.BinaryType())])
    scale = n + v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_only(None)
        known = hot.value
        rid = TaskContext.get().partitionId() << 40
        held: dict[str, list] = {k: [] for k in (*[k for k, _ in lists], "w", "seq")}
        tokens = 0

        def out() -> pa.RecordBatch:
            nonlocal rid
            words, place = np.unique(np.concatenate(held["w"]), return_inverse=True)
            place = np.split(place.astype(np.uint32), np.cumsum([len(w) for w in held["w"]])[:-1])
            seq = np.concatenate([p[s] for p, s in zip(place, held["seq"], strict=True)])
            by = np.argsort(-np.bincount(seq), kind="stable")  # frequent words have small numbers, which pack well
            place = np.empty(len(by), np.uint32)
            place[by] = np.arange(len(by))
            columns = [pa.array([rid])]
            for k, _ in lists:
                flat = pa.concat_arrays(held[k])
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            rid += len(flat)
            for x in held.values():
                x.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array([words[by].tobytes()]), pa.array([packed(place[seq])])], names=schema.names)

        for b in batches:
            done = 0
            for part in small_batches(t.as_py() for t in b.column("text")):
                split = [[*words_of(t), END] for t in part]
                sizes = np.array([len(s) for s in split])
                number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
                seq = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.uint32, sizes.sum())
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                c = np.fromiter((known.get(w, -1) for w in number), np.int64, len(number))
                logs = np.where(c >= 0, np.log10((np.maximum(c, 0) + 1) / scale), 0.0)
                rare, times = [], []
                for a, s in zip(starts, split, strict=True):
                    own = np.flatnonzero(c[seq[a : a + len(s)]] < 0)
                    r = Counter([s[k] for k in own])
                    rare.append(list(r.keys()))
                    times.append(list(r.values()))
                k = len(part)
                new = (b.column("id").slice(done, k), b.column("held_out").slice(done, k), pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat((c > 0)[seq], starts, dtype=np.int64)), pa.array(np.add.reduceat(logs[seq], starts)), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())))
                for (name, _), x in zip(lists, new, strict=True):
                    held[name].append(x)
                held["w"].append(word_hashes(number))
                held["seq"].append(seq)
                done += k
                tokens += len(seq)
                if tokens > BATCH_TOKENS:
                    yield out()
                    tokens = 0
        if tokens:
            yield out()
        give_back()

    batches = written(src.mapInArrow(run, schema), "batches")

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        for r in rows:
            for at in range(r.num_rows):
                x = {k: r.column(k)[at] for k in ("batch", "ids", "held_out", "sizes", "n_known", "base", "words", "seq", "levels")}
                sizes = np.array(x["sizes"].as_py())
                level: dict[int, list] = {1: [], 2: []}
                for y in sorted(x["levels"].as_py(), key=lambda y: y["range"]):
                    level[y["order"]].append(unpacked(y["levels"], np.uint8))
                grams = _grams(np.frombuffer(x["words"].as_py(), np.uint64), unpacked(x["seq"].as_py(), np.uint32))
                single, pair = (np.concatenate(level[order])[place] for order, _, place in grams)
                logs = np.empty(len(single))
                for part in parts(len(single)):
                    c, before = expected(single[part]), expected(single[np.arange(part.start, part.stop) - 1])  # every text ends with the end, and starts from it
                    p = weight * np.divide(np.minimum(expected(pair[part]), before), before, out=np.zeros(len(c)), where=before > 0) + (1 - weight) * (c + 1) / scale
                    logs[part] = np.log10(np.where(before > 0, p, (c + 1) / scale))
                scores = np.add.reduceat(logs, np.r_[0, np.cumsum(sizes)[:-1]])
                columns = [pa.array(x["batch"].as_py() + np.arange(len(sizes))), x["ids"].values, x["held_out"].values, pa.array(sizes.astype(np.int64)), x["n_known"].values, x["base"].values, pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "held_out", "n_tokens", "n_known", "base", "score"])
        give_back()

    fields = [("rid", T.LongType()), ("id", id_type), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), *each[:2], ("score", T.DoubleType())]
    whole = batches.drop("rare", "times").join(gram_levels(batches, n), "batch")
    part = whole.mapInArrow(scored, T.StructType([T.StructField(k, t) for k, t in fields]))
    rare = batches.select("batch", F.posexplode(F.arrays_zip("rare", "times"))).select((F.col("batch") + F.col("pos")).alias("rid"), F.explode(F.arrays_zip("col.rare", "col.times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    joined = rare.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = joined.groupBy("rid").agg(F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("also"))
    out = part.join(sums, "rid", "left")
    zero = F.lit(0)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", zero)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
