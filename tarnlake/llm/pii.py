"""Personal data: exact patterns, and terms that reveal the protected entities.

Patterns find the protected entities: emails, IP addresses, cards, phones, and secrets
(long runs of letters and digits of high entropy).  Each is protected as the value it
is, as a member of its group (an email's domain, an address's network, a card's issuer,
a phone's area) and as one of its kind, so that values which occur once count as well.
The corpus then says which other terms give an entity away.  For entity e and term t,
with document frequencies over distinct texts,

    disclosure(t, e) = PMI(t, e) / IC(e) = 1 + log2(n(e,t) / n(t)) / log2(N / n(e))

is 1 where every text with t has t near e, and 0 where the two are independent.  A
term that reaches ``disclose`` with at least ``min_contexts`` different contexts (so
that copies of one text prove nothing) is sensitive: from ``remove`` on it is
removed, below that generalised to a placeholder.  Terms are words of letters and digits;
those of ``width`` words on either side of an entity are near it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, keep_only, written

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "term")
PLACEHOLDER = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>", "term": "<TERM>"}
#: Terms held in a worker at once; more are joined.  Longer ones go by a hash of the whole term.
BLOCK_TERMS, LONGEST_TERM = 100_000, 100
#: Pairs of term and text that a worker holds before it passes them on.
HELD_PAIRS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from every later start: the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]{2,}")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans by kind, then start; code points, end exclusive."""
    found: list[Span] = []
    if "@" in text:
        found += (("email", a, b) for a, b in _emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


def secret_spans(text: str, least_bits: float = 3.0) -> list[Span]:
    """Runs of 20 letters and digits or more, both among them, of ``least_bits`` of entropy a character."""
    out = []
    for m in _SECRET.finditer(text):
        n = Counter(m[0])
        digits = sum(k for c, k in n.items() if c <= "9")
        if 0 < digits < len(m[0]) and -sum(k / len(m[0]) * math.log2(k / len(m[0])) for k in n.values()) >= least_bits:
            out.append(("secret", *m.span()))
    return out


def entity_spans(text: str) -> list[Span]:
    return base_spans(text) + secret_spans(text)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def entities(kind: str, value: str) -> Iterator[int]:
    """Hashes of what a span is protected as: a value, a member of its group, one of its kind."""
    value = value.lower() if kind in ("email", "ip", "secret") else _digits(value)
    group = {"email": lambda: value.rpartition("@")[2], "ip": lambda: value.rpartition(".")[0], "card": lambda: value[:6], "phone": lambda: value[:-4]}.get(kind)
    yield _hash(f"{kind}:{value}")
    if group:
        yield _hash(f"{kind} group:{group()}")
    yield _hash(f"{kind} kind")


class Covered:
    """The stretches that spans cover, as disjoint intervals in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def contexts(text: str, width: int) -> Iterator[tuple[int, list[str], int]]:
    """For each protected entity: its hash, the terms of ``width`` words on either side, the context's hash."""
    spans = entity_spans(text)
    if not spans:
        return
    covered = Covered(spans)
    terms = [m for m in _TERM.finditer(text) if not covered.meets(m.start(), m.end())]
    starts = [m.start() for m in terms]
    for kind, a, b in spans:
        i, j = bisect_right(starts, a), bisect_right(starts, b)
        near = [term_key(m[0]) for m in terms[max(0, i - width) : i] + terms[j : j + width]]
        context, near = _hash(" ".join(near)), sorted(set(near))
        for e in entities(kind, text[a:b]):
            yield e, near, context


def term_key(term: str) -> str:
    """What a term is known by: itself in lower case, or, over LONGEST_TERM characters, a hash of all of it (no term has a '#')."""
    low = term.lower()
    return low if len(low) <= LONGEST_TERM else "#" + hashlib.sha256(low.encode("utf-8", "surrogatepass")).hexdigest()


def terms_of(text: str) -> set[str]:
    return set(map(term_key, _TERM.findall(text)))


def sensitive_terms(docs: DataFrame, text_col: str = "text", width: int = 6, min_contexts: int = 3, disclose: float = 0.9, remove: float = 0.99) -> DataFrame:
    """term, disclosure, removed: terms that reveal an entity, over all documents.

    Null and empty texts hold nothing.  Entities leave the workers as hashes only.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "entity long, terms array<string>, context long, doc long"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        for b in batches:
            rows = [(e, t, c, _hash(text)) for text in b.column(0).to_pylist() for e, t, c in contexts(text, width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64()))], names=["entity", "terms", "context", "doc"])

    ctx = written(texts.mapInArrow(near, schema), "contexts")
    near_terms = ctx.select("entity", "context", "doc", F.explode("terms").alias("term"))
    pairs = near_terms.groupBy("entity", "term").agg(F.countDistinct("context").alias("n_c"), F.countDistinct("doc").alias("n_et")).filter(F.col("n_c") >= min_contexts)
    pairs = written(pairs.drop("n_c"), "pairs")
    n_texts = texts.select(F.xxhash64("text").alias("h")).distinct().count()
    sizes = pairs.groupBy("entity").agg(F.count("*").alias("n_pairs"))
    of_entity = ctx.groupBy("entity").agg(F.countDistinct("doc").alias("n_e")).join(sizes, "entity")
    # An entity in half of all texts or more is no secret that a term could reveal.
    pairs = written(attach(pairs, of_entity.filter(2 * F.col("n_e") < n_texts), ["entity"], "n_pairs").drop("n_pairs"), "pairs")
    # A term reaches the threshold with an entity only if no more than n(e,t) 2**((1 - disclose) IC(e))
    # texts have it.  So many of its texts are counted at most, and terms that exceed this
    # around entities alone are no candidates.
    ic = F.log2(F.lit(float(n_texts)) / F.col("n_e"))
    bound = F.col("n_et") * F.pow(F.lit(2.0), (1 - disclose) * ic)
    around = near_terms.groupBy("term").agg(F.countDistinct("doc").alias("n_around"))
    terms = pairs.groupBy("term").agg(F.ceil(F.max(bound)).alias("most")).join(around, "term").filter("n_around <= most").select("term", "most")
    terms = written(terms, "candidates")
    n_terms = terms.count()
    if not n_terms:
        return spark.createDataFrame([], "term string, disclosure double, removed boolean")
    frequencies = _frequencies(texts, terms, n_terms)
    scored = pairs.join(frequencies, "term").withColumn("d", 1 + F.log2(F.col("n_et") / F.col("n_t")) / ic)
    found = scored.filter(F.col("d") >= disclose).groupBy("term").agg(F.max("d").alias("disclosure"))
    return written(found.withColumn("removed", F.col("disclosure") >= remove), "sensitive")


def _frequencies(texts: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """term, n_t: in how many distinct texts each candidate is.

    Up to BLOCK_TERMS candidates are looked up in the texts, and no more of a term's texts
    are counted than matter; more candidates are joined to the counts of all terms.
    """
    known = {r[0]: r[1] for r in terms.toLocalIterator()} if n_terms <= BLOCK_TERMS else None

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(t, h) for t, own in seen.items() for h in own]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "doc"])

        for b in batches:
            for text in b.column(0):
                text, h = text.as_py(), None
                own_terms = terms_of(text)
                for t in own_terms if known is None else known.keys() & own_terms:
                    own = seen.setdefault(t, set())
                    if known is None or len(own) <= known[t]:
                        h = _hash(text) if h is None else h
                        held += h not in own
                        own.add(h)
                if held > HELD_PAIRS:
                    yield out()
                    seen.clear()
                    held = 0
        yield out()

    counts = texts.mapInArrow(holding, "term string, doc long").groupBy("term").agg(F.countDistinct("doc").alias("n_t"))
    return counts if known is not None else counts.join(terms.select("term"), "term", "left_semi")


def all_spans(text: str, terms: dict[str, bool]) -> list[Span]:
    """The spans of entities and those of sensitive terms outside them."""
    spans = entity_spans(text)
    if not terms:
        return spans
    covered = Covered(spans)
    return spans + [("term", *m.span()) for m in _TERM.finditer(text) if term_key(m[0]) in terms and not covered.meets(*m.span())]


class Sensitive:
    """Sensitive terms for the workers: up to BLOCK_TERMS of them as one set; more are
    joined to the rows that hold them, as an extra column of each row's own terms."""

    COLUMN = "__sensitive_terms"

    def __init__(self, docs: DataFrame, text_col: str, **options):
        terms = sensitive_terms(docs, text_col, **options)
        self.n = terms.count()
        self.shared = {r[0]: r[1] for r in terms.select("term", "removed").collect()} if self.n <= BLOCK_TERMS else None
        self.docs = docs if self.shared is not None else self._joined(docs, text_col, terms)

    def _joined(self, docs: DataFrame, text_col: str, terms: DataFrame, shares: int = 16) -> DataFrame:
        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [sorted(terms_of(x)) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["key", "terms"])

        texts = docs.select(F.xxhash64(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        pairs = texts.mapInArrow(held, "key long, terms array<string>").select("key", F.explode("terms").alias("term")).distinct()
        own = pairs.join(terms, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias(self.COLUMN))
        # A text that very many rows have is shared out, and so are the terms it holds.
        own = own.select(F.col("key").alias("__key"), self.COLUMN, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("__share"))
        keyed = docs.withColumn("__key", F.xxhash64(text_col)).withColumn("__share", F.pmod(F.monotonically_increasing_id(), F.lit(shares)).cast("int"))
        return keyed.join(own, ["__key", "__share"], "left").drop("__key", "__share")

    def of(self, batch: pa.RecordBatch) -> list[dict[str, bool]]:
        if self.shared is not None:
            return [self.shared] * batch.num_rows
        return [dict(x or ()) for x in batch.column(batch.schema.get_field_index(self.COLUMN)).to_pylist()]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, n_secret, n_term, base_sha256, spans.

    A null text is the empty text: no spans.  One row for each row in, null and
    repeated ids included; other columns are ignored.
    """
    sensitive = Sensitive(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", **options)
    src, of = sensitive.docs, _reader(sensitive)
    counts = [f"n_{k}" for k in (*KINDS, *MORE)]
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, out = {c: [] for c in counts}, [], []
            for text, terms in zip(b.column("text"), of(b), strict=True):
                spans = all_spans(text.as_py(), terms)
                kinds = [s[0] for s in spans]
                for c in counts:
                    n[c].append(kinds.count(c[2:]))
                sha.append(hashlib.sha256(joined([s for s in spans if s[0] not in MORE]).encode()).hexdigest())
                out.append(joined(spans))
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(n[c], pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(out, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _reader(sensitive: Sensitive):
    """What a worker needs of it: no DataFrame goes along."""
    light = object.__new__(Sensitive)
    light.shared = sensitive.shared
    return light.of


def clean(text: str, terms: dict[str, bool]) -> str:
    """Protected entities become placeholders; sensitive terms go or are generalised."""
    out, at = [], 0
    for kind, a, b in sorted(all_spans(text, terms), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue  # within a span already replaced
        out.append(text[at : max(a, at)])
        out.append("" if kind == "term" and terms[term_key(text[a:b])] else PLACEHOLDER[kind])
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with personal data and sensitive terms taken out of ``text_col``.

    All columns stay; null texts stay null.
    """
    names = docs.columns
    sensitive = Sensitive(docs, text_col, **options)
    of, at = _reader(sensitive), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if x is None else clean(x, terms) for x, terms in zip(b.column(at).to_pylist(), of(b), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else b.column(k) for k in range(len(names))], names=names)

    return sensitive.docs.mapInArrow(run, docs.schema)
