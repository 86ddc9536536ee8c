"""Jaccard join of word n-gram sets, and the groups that its links make.

1. Every text becomes the set of hashes of its n-grams.  Equal sets are one class.
2. Hashes are dealt by range.  Only a hash that another class has too can ever count
   in an intersection, so those alone come back, and a class with under ``threshold`` of
   its hashes shared drops out.  A stretch of input tells a range about a hash once,
   however many of its sets have it, so no task ever holds all sets of a common hash.
   What remains is ordered by exact document frequency.
3. Prefix lists: sets that reach the threshold share one of their rarest hashes.
   Sets on a common list form a candidate group (a star for each list, never all its
   pairs).  A group is one unit of work as long as it has ``block_sets`` sets at most.
   A larger one is cut into blocks by class of size (sets that match are in the same or
   in neighbouring classes).  First the blocks are done alone, each with a set that all
   blocks of its kind have; a dense group, such as thousands of near copies, is one
   component then.  Only pairs of blocks of neighbouring classes that still hold different
   components follow.
4. Inside a unit, index lists are ordered by set size, so that the stretch outside the
   possible sizes is skipped by position.  A set's overlaps with all others are
   derived from those of a highly similar set that has been done: only the hashes in
   which the two differ are looked up.  A unit returns one row for each of its sets.

The hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, give_back, keep_only, packed, per_worker, unpacked, written
from .components import components

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# -- sets ---------------------------------------------------------------------
class Shingler:
    """Sets of n-gram hashes; the hash of a word is made once per worker."""

    def __init__(self, n: int, cache_words: int = 300_000):
        self.n, self.cache_words = n, cache_words
        self.words: dict[bytes, int] = {}

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of each text; bytes.lower and bytes.split know ASCII alone."""
        if len(self.words) > self.cache_words:
            self.words.clear()
        known = self.words
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        for w in {w for ws in split for w in ws if w not in known}:
            known[w] = xxhash.xxh64_intdigest(w)
        for ws in split:
            if not ws:
                yield np.zeros(0, np.uint64)
                continue
            h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
            n = min(self.n, len(h))
            s = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                s *= MULTIPLIER
                s += h[k : len(h) - n + 1 + k]
            s ^= s >> np.uint64(29)
            s *= np.uint64(0xBF58476D1CE4E5B9)
            s ^= np.uint64(n)
            s ^= s >> np.uint64(32)
            s *= np.uint64(0x94D049BB133111EB)
            s.sort()
            yield s[np.r_[True, s[1:] != s[:-1]]]


@per_worker
def shingler(n: int) -> Shingler:
    return Shingler(n)


def _sig(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _chunks(texts: pa.Array, most: int = 2_000_000) -> Iterator[list[str]]:
    from .bpe import small_batches

    return small_batches((t.as_py() for t in texts), most)


def set_classes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, rid (hash of id), n_shingles, sig (of the set) of every row."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *[T.StructField(x, T.LongType()) for x in ("rid", "n_shingles", "sig")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(shingler)
        for b in batches:
            got = [(len(s), _sig(s)) for part in _chunks(b.column("text")) for s in shingler(n).sets(part)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def _delta(tok: np.ndarray) -> bytes:
    """Ascending hashes as differences, whose leading bytes pack away."""
    return packed(np.diff(tok, prepend=np.uint64(0)))


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def _bucket(sig: np.ndarray, bits: int) -> np.ndarray:
    return (sig.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)


def _by_bucket(tok: np.ndarray, sig: np.ndarray, size: np.ndarray, bits: int) -> Iterator[tuple]:
    """bucket, sigs, sizes, runs, toks: (set, hash) pairs, each once, by range of sets."""
    if not len(tok):
        return
    order = np.lexsort((tok, sig.view(np.uint64)))  # a bucket is a range of sets
    tok, sig, size = tok[order], sig[order], size[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (tok[1:] != tok[:-1])]
    tok, sig, size = tok[new], sig[new], size[new]
    bucket = _bucket(sig, bits)
    firsts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    runs = np.diff(np.r_[firsts, len(sig)]).astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
        i, j = np.searchsorted(firsts, (a, b))
        yield int(bucket[a]), sig[firsts[i:j]].tobytes(), size[firsts[i:j]].tobytes(), runs[i:j].tobytes(), packed(tok[a:b])


#: Hashes of a stretch of input: some 100 bytes each while it is dealt.
STRETCH_HASHES = 2_000_000
#: Rows that tasks send to a range: hashes of one set each, hashes that several sets have, pairs on their way to a bucket.
SINGLE, SEVERAL, PAIRS = 0, 1, 2
DEALT = "range long, kind int, idx binary, tok binary, sigs binary, sizes binary, runs binary"


#: (set, hash) pairs of a stretch that are ordered at once.
ORDERED_PAIRS = 250_000


def _stretch(sets: list[tuple[int, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """DEALT of one stretch, whose (sig, hashes) are taken out of ``sets``; what is done with is let go."""
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["range", "kind", "idx", "tok", "sigs", "sizes", "runs"])

    sets.sort(key=lambda s: s[0] % (1 << 64))  # as _by_bucket orders them
    sigs = np.array([g for g, _ in sets], np.int64)
    sizes = np.array([len(s) for _, s in sets], np.uint32)
    tok = np.concatenate([s for _, s in sets])
    sets.clear()
    order = np.argsort(tok, kind="stable").astype(np.uint32)
    tok = tok[order]
    own = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)[order]
    del order
    first = np.r_[True, tok[1:] != tok[:-1]]
    single = first & np.r_[first[1:], True]
    for kind, keep in ((SINGLE, single), (SEVERAL, first & ~single)):
        t, o, rows = tok[keep], own[keep], []
        if not len(t):
            continue
        ranges = (t >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(t), np.int64)
        at = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        for a, b in zip(at, np.r_[at[1:], len(t)], strict=True):
            if kind == SEVERAL:
                rows.append((int(ranges[a]), kind, b"", _delta(t[a:b]), b"", b"", b""))
                continue
            there, idx = np.unique(o[a:b], return_inverse=True)
            rows.append((int(ranges[a]), kind, packed(idx.astype(np.uint32)), _delta(t[a:b]), sigs[there].tobytes(), sizes[there].tobytes(), b""))
        del t, o, ranges
        yield batch(rows)
    tok, own = tok[~single], own[~single]
    del first, single
    if not len(tok):
        return
    # Sets come in order, so a part of them is some buckets, of which the ends may be in two parts.
    ends = np.cumsum(np.bincount(own, minlength=len(sizes)))
    cuts = np.searchsorted(ends, np.arange(0, len(own), ORDERED_PAIRS), side="right")
    for a, b in zip(cuts, np.r_[cuts[1:], len(sizes)], strict=True):
        part = (own >= a) & (own < b)
        t, o = tok[part], own[part]
        if rows := [(bucket, PAIRS, b"", toks, s, z, runs) for bucket, s, z, runs, toks in _by_bucket(t, sigs[o], sizes[o], bits)]:
            yield batch(rows)


def _dealt(docs: DataFrame, id_col: str, text_col: str, n: int, bits: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """DEALT, one stretch of input at a time.

    A stretch tells a range about a hash once: by its set, if one set has it, or else that
    it is shared already; then its (set, hash) pairs go to the sets' buckets right away.
    So a range never holds the sets of a very common hash.  ``hot``: ascending sigs of very
    common sets and for each the hash of the id whose row speaks for it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(shingler)
        hot_sigs, speakers = shared.value
        seen: set[int] = set()
        held, count = [], 0
        for b in batches:
            rids, at = b.column(0).to_numpy(), 0
            for part in _chunks(b.column(1)):
                sets = list(shingler(n).sets(part))
                sig = np.array([_sig(s) for s in sets], np.int64)
                place = np.minimum(np.searchsorted(hot_sigs, sig), max(0, len(hot_sigs) - 1))
                silent = (hot_sigs[place] == sig) & (speakers[place] != rids[at : at + len(sets)]) if len(hot_sigs) else np.zeros(len(sets), bool)
                at += len(sets)
                for s, g, quiet in zip(sets, sig.tolist(), silent.tolist(), strict=True):
                    if not len(s) or quiet or g in seen:
                        continue  # copies within a task count once
                    if len(seen) < 1_000_000:
                        seen.add(g)
                    held.append((g, s))
                    count += len(s)
                    if count > STRETCH_HASHES:
                        yield from _stretch(held, bits)
                        count = 0
        if held:
            yield from _stretch(held, bits)
        give_back()

    src = docs.select(F.xxhash64(id_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, DEALT)


def _shared(bits: int):
    """Of one range: the pairs of hashes that two sets have or more, packed by bucket of the set."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tok, sig, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        several = [np.zeros(0, np.uint64)]
        out = []
        for r in rows.itertuples(index=False):
            if r.kind == PAIRS:
                out.append((r.range, r.sigs, r.sizes, r.runs, r.tok))
            elif r.kind == SEVERAL:
                several.append(_undelta(r.tok))
            else:
                idx = unpacked(r.idx, np.uint32)
                tok.append(_undelta(r.tok))
                sig.append(np.frombuffer(r.sigs, np.int64)[idx])
                size.append(np.frombuffer(r.sizes, np.uint32)[idx])
        tok, sig, size = (np.concatenate(x) for x in (tok, sig, size))
        order = np.argsort(tok, kind="stable")
        tok, sig, size = tok[order], sig[order], size[order]
        if len(tok):
            # a hash counts as shared if its holders aren't all the same set
            starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            differs = np.maximum.reduceat(sig, starts) != np.minimum.reduceat(sig, starts)
            differs |= np.isin(tok[starts], np.concatenate(several))
            keep = np.repeat(differs, np.diff(np.r_[starts, len(tok)]))
            out += _by_bucket(tok[keep], sig[keep], size[keep], bits)
        return pd.DataFrame(out, columns=["bucket", "sigs", "sizes", "runs", "toks"])

    return run


def _alive(percent: int):
    """Of one bucket of sets: those with enough shared hashes, one row each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        runs = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["runs"]])
        sig = np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in rows["sigs"]]), runs)
        size = np.repeat(np.concatenate([np.frombuffer(x, np.uint32) for x in rows["sizes"]]), runs)
        tok = np.concatenate([unpacked(x, np.int64) for x in rows["toks"]])
        order = np.lexsort((tok, sig))
        sig, size, tok = sig[order], size[order], tok[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (tok[1:] != tok[:-1])] if len(sig) else np.zeros(0, bool)
        sig, size, tok = sig[new], size[new], tok[new]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(sig)][: len(starts)]
        enough = 100 * (ends - starts) >= percent * size[starts].astype(np.int64)
        starts, ends = starts[enough], ends[enough]
        return pd.DataFrame({"sig": sig[starts], "n": size[starts].astype(np.int32), "tok": pd.Series([tok[a:b] for a, b in zip(starts, ends, strict=True)], dtype=object)})

    return run


# -- one unit of work ---------------------------------------------------------
class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def linked(sizes: np.ndarray, tokens: list[np.ndarray], percent: int) -> Forest:
    """Links among sets, which are ordered by ``sizes``; ``tokens``: their shared hashes."""
    k = len(sizes)
    forest = Forest(k)
    flat = np.concatenate(tokens) if k else np.zeros(0, np.int64)
    own = np.repeat(np.arange(k), [len(t) for t in tokens])
    uniq, code = np.unique(flat, return_inverse=True)
    by = np.argsort(code, kind="stable")  # a list holds its sets in order of size
    bounds = np.r_[0, np.cumsum(np.bincount(code, minlength=len(uniq)))]
    lists = own[by]
    cut = np.r_[0, np.cumsum([len(t) for t in tokens])]
    codes = [np.sort(code[cut[i] : cut[i + 1]]) for i in range(k)]
    low = np.searchsorted(sizes * 100, sizes * percent, side="left")  # the least size that can match
    overlaps: dict[int, np.ndarray] = {}  # with all sets, of those that others derive theirs from
    parent, best, waiting = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k, np.int64)

    def release(p: int) -> None:
        waiting[p] -= 1
        if not waiting[p]:
            del overlaps[p]

    def counted(i: int, first: int) -> np.ndarray:
        """Overlaps of set i with those from ``first`` on; the lists' beginnings are skipped."""
        parts = [lists[bounds[c] : bounds[c + 1]] for c in codes[i]]
        if first:
            parts = [x[np.searchsorted(x, first) :] for x in parts]
        return np.bincount(np.concatenate(parts), minlength=k).astype(np.int32) if parts else np.zeros(k, np.int32)

    for i in range(k - 1, -1, -1):  # largest first: its possible partners are to the left, down to low[i]
        p, first = int(parent[i]), int(low[i])
        if p >= 0:
            ov = overlaps[p].copy()
            for c in np.setdiff1d(codes[p], codes[i], True):
                ov[lists[bounds[c] : bounds[c + 1]]] -= 1
            for c in np.setdiff1d(codes[i], codes[p], True):
                ov[lists[bounds[c] : bounds[c + 1]]] += 1
            release(p)
        else:
            ov = counted(i, first)
        at = np.arange(first, i)
        o = ov[at].astype(np.int64)
        for j in at[100 * o >= percent * (sizes[i] + sizes[at] - o)]:
            forest.join(i, int(j))
        # Sets very like this one derive theirs from it, unless one before is more like them.
        near = at[(4 * o > 3 * sizes[at]) & (o > best[at])]
        if len(near):
            for q in parent[near]:
                if q >= 0:
                    release(int(q))
            parent[near], best[near], waiting[i] = i, ov[near], len(near)
            overlaps[i] = counted(i, 0) if p < 0 and first else ov
    return forest


def _unit(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("sig").sort_values(["n", "sig"], ignore_index=True)
        sig = rows["sig"].to_numpy()
        forest = linked(rows["n"].to_numpy(np.int64), [np.asarray(t, np.int64) for t in rows["tok"]], percent)
        roots = np.array([forest.root(i) for i in range(len(sig))], np.int64)
        least = np.full(len(sig), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, sig)
        return pd.DataFrame({"u": sig, "v": least[roots] if len(sig) else sig})

    return run


# -- units of large groups ----------------------------------------------------
def _first_units(large: DataFrame, block_sets: int) -> DataFrame:
    """root, c, h, part, sig, n, tok: bounded blocks of sets of like size with a common rarest hash.

    Where they are too many for one block, one of them is in every part, so that a dense
    group is linked through it.
    """
    keys = ["root", "c", "h"]
    large = large.withColumn("h", F.pmod(F.xxhash64(F.get("prefix", F.lit(0))), 4 * F.ceil(F.col("k") / block_sets)))
    count = large.groupBy(*keys).agg(F.count("*").alias("size"), F.min("sig").alias("hub"))
    rows = attach(large.drop("prefix"), count, keys, "size").withColumn("parts", F.ceil(F.col("size") / block_sets))
    plain = rows.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")))
    hubs = rows.filter("sig = hub and parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = [*keys, "part", "sig", "n", "tok"]
    return plain.select(*columns).unionByName(hubs.select(*columns))


def _open_pairs(light: DataFrame, block_sets: int) -> DataFrame:
    """unit, sig: pairs of blocks that may hold sets of different components that can match.

    ``light``: root, sig, n, c, r (the component so far).  Blocks are of one size class and,
    where a component fills a block, of one component; pairs inside one component are done,
    and classes that aren't neighbours differ too much in size.
    """
    mixed = light.groupBy("root").agg(F.min("r").alias("a"), F.max("r").alias("b")).filter("a < b").select("root")
    light = light.join(mixed, "root", "left_semi")
    each = light.groupBy("root", "c", "r").agg(F.count("*").alias("size"))
    each = each.withColumn("alone", 2 * F.col("size") >= block_sets).withColumn("own", F.when(F.col("alone"), F.col("r")).otherwise(0))
    total = each.groupBy("root", "c", "alone", "own").agg(F.sum("size").alias("all"))
    each = each.join(total, ["root", "c", "alone", "own"])
    rows = attach(light, each, ["root", "c", "r"], "size").withColumn("parts", F.ceil(F.col("all") / block_sets))
    part = F.when(F.col("alone"), F.pmod(F.xxhash64("sig"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("r"), F.col("parts")))
    rows = written(rows.select("root", "c", "sig", "r", F.xxhash64("root", "c", "alone", "own", part).alias("block")), "blocks")
    blocks = rows.groupBy("root", "c", "block").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    a, b = (blocks.select("root", *[F.col(x).alias(x + s) for x in ("c", "block", "lo", "hi")]) for s in ("1", "2"))
    pairs = a.join(b, "root").filter("(c1 = c2 and block1 <= block2) or c2 = c1 + 1").filter("not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    pairs = pairs.select(F.xxhash64("block1", "block2").alias("unit"), F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    return pairs.join(rows, "block").select("unit", "sig").distinct()


# -- the join -----------------------------------------------------------------
def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, n_hashes: int = 0, hot: DataFrame | None = None, range_hashes: int = 1_500_000, block_sets: int = 1024) -> DataFrame:
    """node, root: classes of equal sets (by sig) that are linked to another class.

    ``hot``: sig, speaker of very common sets (see ``_dealt``), MOST_HOT at the most.
    """
    spark = docs.sparkSession
    bits = max(0, (max(1, n_hashes) // range_hashes).bit_length())
    table = hot.select("sig", "speaker").toArrow() if hot is not None else pa.table({"sig": pa.array([], pa.int64()), "speaker": pa.array([], pa.int64())})
    sigs, speakers = table.column("sig").to_numpy(), table.column("speaker").to_numpy()
    order = np.argsort(sigs)
    dealt = _dealt(docs, id_col, text_col, n, bits, (sigs[order], speakers[order]))
    pairs = dealt.groupBy("range").applyInPandas(_shared(bits), "bucket long, sigs binary, sizes binary, runs binary, toks binary")
    alive = written(pairs.groupBy("bucket").applyInPandas(_alive(percent), "sig long, n int, tok array<long>"), "alive")
    # Frequencies among the sets that are left; a hash that only one of them has can't count any more.
    tokens = alive.select("sig", "n", F.explode("tok").alias("t"))
    frequency = written(tokens.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1"), "frequency")
    sets = attach(tokens, frequency, ["t"], "df").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("x"))  # one text's hashes
    sets = sets.filter(100 * F.size("x") >= percent * F.col("n"))
    # The rest of the prefix of n - ceil(percent n) + 1 are hashes no other set has.
    quota = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - (F.col("n") - F.size("x"))
    sets = written(sets.select("sig", "n", F.col("x.t").alias("tok"), F.slice("x.t", 1, quota.cast("int")).alias("prefix")), "sets")
    posts = sets.select("sig", F.explode("prefix").alias("t"))
    stars = posts.groupBy("t").agg(F.min("sig").alias("hub"), F.max("sig").alias("other"), F.count("*").alias("size")).filter("hub < other")
    edges = attach(posts, stars, ["t"], "size").select(F.col("sig").alias("u"), F.col("hub").alias("v")).filter("u <> v")
    groups = components(edges)
    size = groups.groupBy("root").agg(F.count("*").alias("k"))
    groups = written(attach(groups, size, ["root"], "k"), "groups")
    if groups.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    placed = sets.join(groups, F.col("sig") == F.col("node")).drop("node")
    links = written(placed.filter(F.col("k") <= block_sets).groupBy("root").applyInPandas(_unit(percent), "u long, v long"), "links")
    if groups.filter(F.col("k") > block_sets).isEmpty():
        return components(links)
    # Sets that match are in the same or in neighbouring classes of size.
    c = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    large = written(placed.filter(F.col("k") > block_sets).withColumn("c", c), "large")
    first = written(_first_units(large, block_sets).groupBy("root", "c", "h", "part").applyInPandas(_unit(percent), "u long, v long"), "links")
    so_far = components(first).select(F.col("node").alias("sig"), F.col("root").alias("r"))
    light = written(large.select("root", "sig", "n", "c").join(so_far, "sig", "left").withColumn("r", F.coalesce("r", "sig")), "light")
    units = _open_pairs(light, block_sets).join(large.select("sig", "n", "tok"), "sig")
    second = written(units.groupBy("unit").applyInPandas(_unit(percent), "u long, v long"), "links")
    return components(links.unionByName(first).unionByName(second))


#: Sets that more rows have than a millionth of them, and than LEAST_HOT, are very common: there are MOST_HOT at the most, 16 bytes each.
LEAST_HOT, MOST_HOT = 10_000, 1_000_000


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, least_hot: int = LEAST_HOT, **options) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links).

    Sets are distinct n-grams of lower-cased (A-Z) words; fewer words are one n-gram as a
    whole.  Null and empty texts have the empty set and are linked with nothing, so are
    rows of null id, which keep a null component.  Repeated rows stay; other columns are
    ignored.
    """
    classes = written(set_classes(docs, id_col, text_col, n), "classes")
    by_sig = classes.filter("n_shingles > 0").groupBy("sig").agg(F.min("id").alias("least"), F.min("rid").alias("speaker"), F.count("*").alias("size"))
    by_sig = written(by_sig, "by_sig")
    n_hashes, rows = classes.agg(F.sum("n_shingles"), F.count("*")).head()
    hot = by_sig.filter(F.col("size") > max(least_hot, rows // MOST_HOT))
    roots = similar_sets(docs, id_col, text_col, n, percent, n_hashes=n_hashes or 0, hot=hot, **options)
    # Equal sets are one row up to here, so only the last join meets very common ones.
    placed = by_sig.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least", "size", "root")
    of_root = placed.filter("root is not null").groupBy("root").agg(F.min("least").alias("of_root"), F.count("*").alias("n_sigs"))
    single = placed.filter("root is null").select("sig", "least", "size")
    grouped = attach(placed.filter("root is not null").drop("least"), of_root, ["root"], "n_sigs").select("sig", F.col("of_root").alias("least"), "size")
    out = attach(classes.filter("n_shingles > 0"), written(single.unionByName(grouped), "least"), ["sig"], "size").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id"))
    empty = classes.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(empty).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, **options) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest id.

    Rows equal in id and text count as one.  Rows without words are in no group and all
    stay, as do rows of null id.  All columns are returned.
    """
    joined = ngram_join(docs, id_col, text_col, n, percent, **options)
    stay = joined.filter(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("__stay")).distinct()
    kept = docs.join(stay, docs[id_col] == stay["__stay"], "left_semi")
    words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = kept.filter(words).withColumn("__text", F.xxhash64(text_col)).dropDuplicates([id_col, "__text"]).drop("__text")
    return once.unionByName(kept.filter(~words)).unionByName(docs.filter(F.col(id_col).isNull()))
