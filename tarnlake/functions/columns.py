"""Scalar functions as Column builders: parsing, dates, JSON, text, lookups, calibration.

All but ``document_text`` (a tree of any depth) stay in the JVM.  Each takes and returns Columns; a value that can't be read is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted time formats, in order; fixed values.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


def to_utc(x: Column) -> Column:
    """First format that reads the text; zone-less text is UTC.

    A format that fails costs a raised error, so each is tried only on texts with its signs.
    """
    t = F.trim(x)
    has = {c: F.contains(F.upper(t), F.lit(c)) for c in (" ", "T", ".", ":", "-")}

    def signs(f: str) -> Column:
        place = has["T"] if "'T'" in f else has[" "] if " " in f else ~has[":"]
        return has["-"] & place & (has["."] if "." in f else ~has["."])

    return F.coalesce(*[F.when(signs(f), F.try_to_timestamp(t, F.lit(f))) for f in TIME_FORMATS])


def to_flag(x: Column) -> Column:
    word = F.lower(F.trim(x))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def to_finite(x: Column) -> Column:
    """A finite double or null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def lead_int(x: Column, low: int, high: int) -> Column:
    """The integer a text begins with ('1 - Critical'), if it lies in the range."""
    n = F.regexp_extract(F.trim(x), r"^(\d{1,9})(?:\D|$)", 1).try_cast("int")
    return F.when(n.between(low, high), n)


def duration_seconds(x: Column) -> Column:
    """Whole seconds, given as such or as an instant of 1970."""
    digits = F.when(F.trim(x).rlike(r"^\d+$"), F.trim(x).try_cast("bigint"))
    return F.coalesce(digits, F.unix_timestamp(to_utc(x)))


def json_text(x: Column, path: str) -> Column:
    return blank_to_null(F.get_json_object(x, path))


def json_names(x: Column) -> Column:
    """Names of an array of objects, empty where the text is no such array."""
    names = F.from_json(x, "array<struct<name:string>>")
    return F.coalesce(F.transform(F.filter(names, lambda n: n["name"].isNotNull()), lambda n: n["name"]), F.array().cast("array<string>"))


def json_member(x: Column, path: str) -> Column:
    """The text at a path; null where there is none or the text is no JSON."""
    return F.get_json_object(x, path)


def named_value(x: Column) -> Column:
    """The name (else title, else value) of a JSON object, the text of a JSON string, other text as it is."""
    t = F.trim(x)
    named = F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("name", "title", "value")])
    return F.when(t.startswith("{") & F.get_json_object(x, "$").isNotNull(), named).when(t.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"t":'), x, F.lit("}")), "$.t"), x)).otherwise(x)


def _texts(node: object) -> Iterator[str]:
    """Values of the keys 'text' of a JSON tree, in the order of the document."""
    for key, value in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
        if key == "text":
            yield value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        yield from _texts(value)


@F.pandas_udf(T.StringType())
def _joined_texts(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: " ".join(_texts(json.loads(d))), na_action="ignore")


def document_text(x: Column) -> Column:
    """All texts of a JSON document (type 'doc') joined by blanks; other text as it is."""
    is_doc = F.coalesce(F.get_json_object(x, "$.type") == "doc", F.lit(False))
    return F.when(is_doc, _joined_texts(F.when(is_doc, x))).otherwise(x)


def bucket_start(ts: Column, unit: str, zone: str) -> Column:
    """First local day of the week, month or quarter of an instant."""
    return F.to_date(F.date_trunc(unit, F.from_utc_timestamp(ts, zone)))


def boundaries(a: Column, b: Column, seconds: int) -> Column:
    """How many multiples of ``seconds`` lie between two instants (not elapsed units)."""
    return (F.floor(F.unix_timestamp(b) / seconds) - F.floor(F.unix_timestamp(a) / seconds)).cast("bigint")


def elapsed_hours(a: Column, b: Column, most_days: int) -> Column:
    """Hours from a to b where b isn't before a and not over ``most_days`` later."""
    s = F.unix_timestamp(b) - F.unix_timestamp(a)
    return F.when((s >= 0) & (s <= most_days * 86400), s / 3600.0)


def lookup(key: Column, table: Mapping, default: object) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default)) if pairs else F.lit(default)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def content_hash(*parts: Column) -> Column:
    """32 hex digits over the parts, null ones empty."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def normal_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\p{P}", " "), r"\s+", " "))


#: Upper ends of percent ranks and the steps up to them; fixed values.
FIBONACCI_STEPS = ((0.15, 1), (0.30, 2), (0.45, 3), (0.60, 5), (0.75, 8), (0.90, 13))
FIBONACCI_LAST = 20


def fibonacci_bucket(share: Column, bump: Column | None = None) -> Column:
    """Percent rank to its step; null stays null.  Where ``bump`` holds, the step after it (the last stays)."""
    steps = [*[n for _, n in FIBONACCI_STEPS], FIBONACCI_LAST]

    def of(values: list[int]) -> Column:
        out = F.lit(values[-1])
        for (end, _), n in reversed(list(zip(FIBONACCI_STEPS, values, strict=False))):
            out = F.when(share <= end, F.lit(n)).otherwise(out)
        return F.when(share.isNotNull(), out)

    return of(steps) if bump is None else F.when(bump, of([*steps[1:], steps[-1]])).otherwise(of(steps))


def scaled_sigmoid(p: Column, temperature: Column) -> Column:
    """A probability after temperature scaling of its logit."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / temperature))


def softmax_of(shares: Column, key: Column, temperature: Column) -> Column:
    """The share of ``key`` in a map of shares after temperature scaling; a missing key counts as zero."""
    scaled = lambda x: F.exp(F.log(x + 1e-9) / temperature)
    total = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, x: a + scaled(x))
    return scaled(F.coalesce(F.element_at(shares, key), F.lit(0.0))) / total


def flags(*named: tuple[str, Column]) -> Column:
    """Sorted, distinct names of the conditions that hold, joined by commas."""
    held = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())
    return F.array_join(F.array_sort(F.array_distinct(held)), ",")
