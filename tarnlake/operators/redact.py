"""Redaction with stable pseudonyms: detectors in a fixed order, each claiming free text.

A span is replaced by ``[KIND_10 hex digits]`` of a keyed hash of its normal form, so equal
values stay equal; secrets become ``[SECRET]``.  Where a detector fails the text is
withheld (null) rather than let through.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of detection; fixed values.
ORDER = ("CREDENTIAL", "URL_TOKEN", "EMAIL", "CARD", "EMPLOYEE_ID", "PHONE", "IP", "PERSON")
SECRET = ("CREDENTIAL", "URL_TOKEN")
#: A directory's names together, in characters: an automaton takes some 50 bytes for each.
MOST_NAME_CHARACTERS = 4_000_000
TOKEN = re.compile(r"\[(?:EMAIL|PHONE|IP|PERSON|EMPLOYEE_ID|CARD)_[0-9a-f]{10}\]|\[SECRET\]")
PATTERNS = {
    "CREDENTIAL": re.compile(r"(?i)\b(?:password|passwd|secret|api[_-]?key|token)\s*[:=]\s*(\S+)"),
    "URL_TOKEN": re.compile(r"(?i)[?&](?:sig|token|key|code)=([^&\s#]+)"),
    "EMAIL": re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "CARD": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "EMPLOYEE_ID": re.compile(r"\bE[0-9]{6}\b"),
    # Runs of what these are written with; what a run holds is judged by ``fits``.
    "PHONE": re.compile(r"\+?[0-9][0-9 ()./-]*[0-9]"),
    "IP": re.compile(r"[0-9]+(?:[.][0-9]+)+"),
}


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind: str, value: str, before: str, after: str) -> bool:
    """Whether a run of digits and separators is what it seems, given the characters around it."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "CARD":
        return 13 <= len(digits) <= 19 and not before.isdigit() and not after.isdigit() and luhn(digits)
    if kind == "PHONE":
        return 9 <= len(digits) <= 15 and len(value) <= 24 and not (before.isalnum() or before in ("_", ".")) and not (after.isalnum() or after == "_")
    if kind == "IP":
        parts = value.split(".")
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and before != "." and after != "."
    return True


def _low(text: str) -> str:
    """Lower case, letter by letter: places stay where they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Directory:
    """A directory of person names as one automaton: a text is read once, however many names there are.

    Of the names that begin at a place the longest that ends at a word's end is found, and
    the next one is looked for after it.
    """

    def __init__(self, names: Iterable[str]):
        import ahocorasick

        kept = {_low(n) for n in names if n}
        if sum(map(len, kept)) > MOST_NAME_CHARACTERS:
            raise ValueError(f"a directory of over {MOST_NAME_CHARACTERS} characters is too large for every worker")
        self.automaton = ahocorasick.Automaton() if kept else None
        for n in kept:
            self.automaton.add_word(n, len(n))
        if kept:
            self.automaton.make_automaton()

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if self.automaton is None:
            return
        is_word = [False, *(c.isalnum() or c == "_" for c in text), False]
        found = []
        for last, size in self.automaton.iter(_low(text)):
            a, b = last + 1 - size, last + 1
            if is_word[a] != is_word[a + 1] and is_word[b] != is_word[b + 1]:
                found.append((a, -b))
        at = 0
        for a, b in sorted(found):
            if a >= at:
                yield a, -b
                at = -b


class Redactor:
    def __init__(self, key: bytes, names: tuple[str, ...] | Directory = ()):
        self.key = key
        self.names = names if isinstance(names, Directory) else Directory(names)

    def pseudonym(self, kind: str, value: str) -> str:
        normal = re.sub("[^0-9]", "", value) if kind in ("CARD", "PHONE") else value.strip().lower()
        return f"[{kind}_{hmac.digest(self.key, f'{kind}:{normal}'.encode(), 'sha256').hex()[:10]}]"

    def found(self, kind: str, text: str) -> Iterator[tuple[int, int]]:
        if kind == "PERSON":
            yield from self.names.spans(text)
            return
        pattern = PATTERNS[kind]
        for m in pattern.finditer(text):
            a, b = m.span(pattern.groups)
            if fits(kind, text[a:b], text[a - 1 : a], text[b : b + 1]):
                yield a, b

    def redact(self, text: str) -> tuple[str, int]:
        """The redacted text and the number of replaced spans; redacting again changes nothing."""
        taken = [m.span() for m in TOKEN.finditer(text)]
        spans = []
        for kind in ORDER:
            for a, b in self.found(kind, text):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    spans.append((a, b, "[SECRET]" if kind in SECRET else self.pseudonym(kind, text[a:b])))
        out, at = [], 0
        for a, b, new in sorted(spans):
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:], len(spans)


def redact(df: DataFrame, text_col: str, key: bytes, names: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``text_col`` redacted and n_redacted; null texts stay null, failures become null.

    The directory of names is made once and broadcast; its size is checked.
    """
    at = df.columns.index(text_col)
    directory = df.sparkSession.sparkContext.broadcast(Directory(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Redactor(key, directory.value)
        for b in batches:
            texts, counts = [], []
            for x in b.column(at).to_pylist():
                try:
                    new, n = (None, 0) if x is None else r.redact(x)
                except Exception:  # fail closed: no text rather than a raw one
                    new, n = None, -1
                texts.append(new)
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*b.schema.names, "n_redacted"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, n_redacted int")


def luhn_flag(x):
    """Whether the digits of a text pass Luhn; in the JVM."""
    return F.call_function("luhn_check", F.regexp_replace(x, r"\D", ""))


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:8]
