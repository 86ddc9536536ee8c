"""Best-fit packing with certified bin counts.

Tokenised documents are cut into pieces of at most ``capacity`` tokens and dealt to
groups.  Each group packs by best-fit decreasing and computes a lower bound for its
own pieces from dual-feasible functions (an f with sum f(x) <= 1 for every set of
sizes that fits a bin, so that sum f over all pieces never exceeds the bin count).
A group that meets its bound is certified and gives up only its loosest bin; a group
with a gap gives up its loosest bins, more the larger the gap.  What is given up
moves to fewer groups, which pack and certify again, until one group is left or the
pieces on the move can't take fewer bins.  Every round is a written table.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet, small_batches
from .common import keep_only, per_worker, tokenizer_file, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# -- tokens -------------------------------------------------------------------
#: The pre-tokenizer's pattern after lower-casing; a fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words(dict):
    """Ids by word, made when first asked for; the words of the last generation are taken over."""

    def __init__(self, make, old: dict):
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        self[w] = ids = self.make(w) if ids is None else ids
        return ids


class WordCodec:
    """Ids of whole texts for a tokenizer that drops white space.

    White space always separates its words, so each distinct word is encoded once
    per worker and a text's ids are its words' ids in a row, held as little-endian
    unsigned 32-bit bytes.  Words of Latin letters, digits and signs are normalised and
    cut here and their pieces go to the tokenizer's model; all others, and those that
    could hold a special string, go through the whole tokenizer.  Full tables are
    replaced by generations, so that frequent words stay known.
    """

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.most = words
        self.cache = Words(self.word, {})
        self.pieces: dict[str, bytes] = {}
        # Latin letters are their own normal form; lower case of one of them is no single letter.
        self.plain = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
        self.cut = regex.compile(PRETOKEN)
        self.marks = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})

    def piece(self, text: str) -> bytes:
        found = self.model.tokenize(text.encode().decode("latin-1").translate(self.marks))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def word(self, w: str) -> bytes:
        if not self.plain.fullmatch(w) or "<|" in w:
            return np.array(self.tok.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces, out = self.pieces, []
        for p in self.cut.findall(w.lower()):
            ids = pieces.get(p)
            if ids is None:
                ids = pieces[p] = self.piece(p)
            out.append(ids)
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.cache) > self.most:
            self.cache = Words(self.word, dict(self.cache))
        if len(self.pieces) > self.most:
            self.pieces.clear()
        of = self.cache.__getitem__
        for t in texts:
            yield b"".join(map(of, t.replace("\n", " ").split(" ")))


@per_worker
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and ``end_id``.

    Only documents of over ``capacity`` ids are cut.  A null text is the empty text,
    which is the end id alone; ids are read as long; null and repeated ids are kept.
    """
    path = tokenizer_file(tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(word_codec)
        for b in batches:
            ids, rows = b.column("id").to_pylist(), []
            texts = (v.as_py() for v in b.column("text"))
            k = 0
            for part in small_batches(texts):
                for raw in word_codec(path).encode_batch(part):
                    raw += end
                    for p, at in enumerate(range(0, len(raw), step)):
                        own = raw[at : at + step]
                        rows.append((ids[k], p, at // 4, len(own) // 4, zlib.crc32(own)))
                    k += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, PIECES)


# -- bounds and packing of one group ------------------------------------------
def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of three families of dual-feasible functions, rounded up."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(object)  # exact integers
    x = np.arange(capacity + 1).astype(object)
    best = -(-int((count * x).sum()) // capacity)
    number, volume = np.cumsum(count), np.cumsum(count * x)
    for least in range(1, capacity // 2 + 1):
        # up to ``least`` counts nothing, above capacity - least counts a whole bin
        if count[least]:
            whole = int(number[capacity] - number[capacity - least])
            middle = int(volume[capacity - least] - volume[least - 1])
            best = max(best, whole + -(-middle // capacity))
    for k in range(1, 40):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        value = np.where(exact, x * k, (scaled // capacity) * capacity)  # over k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, fill of each bin.

    Bins are kept by free space, the occupied free spaces as bits of one number, so
    that the tightest bin that fits is its lowest set bit from the size on.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = by_free[free]
            b = own.pop()
            if not own:
                mask ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            if not by_free[left]:
                mask |= 1 << left
            by_free[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def pack_group(sizes: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bin, offset and whether the piece moves on; the group's lower bound."""
    bins, offsets, fill = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    moves = np.zeros(len(sizes), bool)
    loose = np.flatnonzero(fill < capacity)
    if not last and len(loose):
        gap = len(fill) - bound
        give = loose[np.argsort(fill[loose], kind="stable")][: 1 + 4 * gap]
        moves = np.isin(bins, give)
    return bins, offsets, moves, bound


def _packer(turn: int, last: bool, capacity: int):
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(key, rows):
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets, moves, bound = pack_group(rows["length"].to_numpy(np.int64), capacity, last)
        out = rows[names].copy()
        out["sequence_id"] = (np.int64(turn) << 56) | (np.int64(key[0]) << 28) | bins
        out["offset"], out["certified"], out["moves"] = offsets, bool(bins.max() + 1 == bound), moves
        return out

    return run


# -- rounds -------------------------------------------------------------------
def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = 20_000, most_rounds: int = 12) -> DataFrame:
    """``pieces`` with sequence_id, offset and certified (the bin count of the piece's
    last group met its lower bound).

    After ``most_rounds`` the groups that are left keep what they have, which costs at
    most their loosest bins; every piece is packed all the same.

    ``pieces`` has doc_id, piece and length from 1 to ``capacity``; other columns must
    be those of PIECES.  An empty table gives an empty one.
    """
    done: list[DataFrame] = []
    pool = pieces
    schema = f"{PIECES}, sequence_id long, offset long, certified boolean, moves boolean"
    names = [f.split()[0] for f in PIECES.split(", ")]
    n = pool.count()
    for turn in range(most_rounds):
        groups = max(1, -(-n // group_pieces))
        last = groups == 1 or turn == most_rounds - 1

        dealt = pool.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(groups)))
        packed = written(dealt.groupBy("g").applyInPandas(_packer(turn, last, capacity), schema), "packed")
        done.append(packed.filter(~F.col("moves")).drop("moves"))
        if last:
            break
        pool = packed.filter("moves").select(*names)
        n = pool.count()
        if not n:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``cut_pieces`` and ``pack``."""
    return pack(written(cut_pieces(docs, id_col, text_col, tokenizer, capacity), "pieces"), capacity, **options)
