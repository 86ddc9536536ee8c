"""Byte-level BPE encoding and decoding by tree concatenation.

Text is cut where the pre-tokenizer always cuts (before white space that follows
something else), so the chunks encode independently; each distinct chunk is
encoded once per worker.  A chunk without such a place that is longer than a leaf
is long unsplit text: it goes through a binary tree.  The leaves (halves of
halves) are encoded as one batch, which the library runs in parallel, and the sibling
sequences of a level are joined by encoding a window of tokens around each join again,
these as a batch too.  A window grows until its first token is the left side's token at
that place and its last token is the right side's.  Then every adjacent pair of the result occurs in
a correct encoding, and a sequence of pairwise stable tokens is *the* encoding of
its text, so the join is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_only, per_worker, tokenizer_file

#: The pre-tokenizer's pattern for byte-level BPE of this kind; a fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """Character that stands for each byte: itself if printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class TreeCodec:
    def __init__(self, path: str, leaf: int = 16384, window: int = 8, cache_chunks: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.plain = Tokenizer(self.tok.model)  # no pre-tokenizer: it takes what it gets as one piece
        self.leaf, self.window, self.cache_chunks = leaf, window, cache_chunks
        alphabet = byte_alphabet()
        self.to_marks = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        back = {c: b for b, c in enumerate(alphabet)}
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.bytes_of: list[bytes] = []
        for i in range(self.tok.get_vocab_size()):
            token = self.tok.id_to_token(i)
            self.bytes_of.append(token.encode() if token in self.special else bytes(back[c] for c in token))
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.pretoken = regex.compile(PRETOKEN)
        self.unsafe = re.compile(r"\s ")
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, tuple[int, ...]] = {}

    # -- encoding ---------------------------------------------------------
    def bpe(self, raws: list[bytes]) -> list[list[int]]:
        """BPE of stretches inside one pre-token each, as one batch that the library runs in parallel."""
        marked = [raw.decode("latin-1").translate(self.to_marks) for raw in raws]
        return [e.ids for e in self.plain.encode_batch_fast(marked, add_special_tokens=False)]

    def joins(self, level: list[list[int]]) -> list[list[int]]:
        """Encodings of neighbouring stretches of one pre-token, joined two and two."""
        out: list = [None] * (len(level) // 2)
        waiting, size = list(range(len(out))), self.window
        while waiting:
            cut = [(level[2 * k], level[2 * k + 1], max(0, len(level[2 * k]) - size), min(len(level[2 * k + 1]), size)) for k in waiting]
            middles = self.bpe([b"".join(self.bytes_of[t] for t in left[i:] + right[:j]) for left, right, i, j in cut])
            open_ = []
            for k, (left, right, i, j), middle in zip(waiting, cut, middles, strict=True):
                if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
                    out[k] = left[:i] + middle + right[j:]
                else:
                    open_.append(k)
            waiting, size = open_, size * 2
        return out

    def tree(self, raw: bytes) -> list[int]:
        """One long pre-token: leaves as one batch, then the joins level by level."""
        n = 1 << max(0, (-(-len(raw) // self.leaf) - 1).bit_length())
        cuts = [len(raw) * k // n for k in range(n + 1)]
        level = self.bpe([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        while len(level) > 1:
            level = self.joins(level)
        return level[0]

    def long_chunk(self, text: str) -> list[int]:
        """A chunk beyond the leaf size: special strings, pre-tokens, then the tree."""
        ids: list[int] = []
        at = 0
        for m in [*self.special_re.finditer(text), None]:
            pieces = [p[0].encode() for p in self.pretoken.finditer(text[at : m.start() if m else len(text)])]
            short = iter(self.bpe([raw for raw in pieces if len(raw) <= self.leaf]))
            for raw in pieces:
                ids += self.tree(raw) if len(raw) > self.leaf else next(short)
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return ids

    def chunks(self, text: str) -> list[str]:
        """Stretches that the pre-tokenizer treats alone; they concatenate to the text."""
        if not text:
            return []
        if self.unsafe.search(text):
            cut = [m.start() + 1 for m in re.finditer(r"\S(?=\s)", text)]
            return [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True) if a < b]
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self.cache) > self.cache_chunks:
            self.cache.clear()
        cache, pieces, new = self.cache, [self.chunks(t) for t in texts], {}
        for p in pieces:
            for c in p:
                if c not in cache:
                    new[c] = None
        short = [c for c in new if len(c) <= self.leaf]
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[c] = tuple(e.ids)
        long = {c: self.long_chunk(c) for c in new if len(c) > self.leaf}
        for p in pieces:
            ids: list[int] = []
            for c in p:
                ids += cache[c] if c in cache else long[c]
            yield ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """Bytes of all tokens, ill-formed sequences replaced as the library does."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids if 0 <= i < len(of)]).decode("utf-8", "replace")


@per_worker
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def small_batches(texts: Iterator[str], most_chars: int = 2_000_000) -> Iterator[list[str]]:
    """Lists of texts of together about ``most_chars``; a longer text comes alone."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > most_chars:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def _mapped(docs: DataFrame, id_col: str, value: F.Column, fields: list[T.StructField], of) -> DataFrame:
    """Run ``of(list of values) -> iterator of tuples for fields`` over each Arrow batch."""
    src = docs.select(F.col(id_col).alias("id"), value.alias("v"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *fields])
    arrow = pa.schema([pa.field(f.name, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(of(b.column("v")))
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", *arrow.names])

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _text(text_col: str) -> F.Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """id_col, ids (array of int).  A null text is the empty text: no ids.  One row for
    each row in, null and repeated ids included; other columns are ignored."""
    path = tokenizer_file(tokenizer)

    def of(column):
        for part in small_batches(v.as_py() for v in column):
            for ids in codec(path).encode_batch(part):
                yield (ids,)

    return _mapped(docs, id_col, _text(text_col), [T.StructField("ids", T.ArrayType(T.IntegerType()))], of)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """id_col, text.  Null ids give the empty text; ids outside the vocabulary are skipped."""
    path = tokenizer_file(tokenizer)

    def of(column):
        for v in column:
            yield (codec(path).decode(v.as_py() or []),)

    return _mapped(encoded, id_col, F.col(ids_col), [T.StructField("text", T.StringType())], of)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Encode and decode in one pass: id_col, n_tokens, ids_sha256, decoded_sha256.
    Null texts count as empty."""
    path = tokenizer_file(tokenizer)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def of(column):
        keep_only(codec)
        c = codec(path)
        name = c.decimal
        for part in small_batches(v.as_py() for v in column):
            for ids in c.encode_batch(part):
                yield len(ids), sha(",".join([name[i] for i in ids])), sha(c.decode(ids))

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, id_col, _text(text_col), fields, of)
