"""The directory of names against one alternation and against brute force."""

import pickle
import random
import re
import time

import pytest

from tarnlake.operators import redact as R


def alternation(names, text):
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b")
    return [m.span() for m in pattern.finditer(R._low(text))]


def test_spans_match_one_alternation():
    r = random.Random(3)
    for _ in range(200):
        names = ["".join(r.choice("ab -é.") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 12))]
        text = "".join(r.choice("abAB -é._1") for _ in range(r.randrange(60)))
        assert list(R.Directory(names).spans(text)) == alternation({R._low(n) for n in names}, text)


def test_a_hundred_thousand_names():
    r = random.Random(4)
    names = {f"{''.join(r.choices('abcdefghij', k=5))} {''.join(r.choices('klmnopqrst', k=6))}" for _ in range(100_000)}
    some = sorted(names)[::997]
    text = " ".join(f"{x.title()} met {''.join(r.choices('abcdefghij', k=5))} and x{x}" for x in some)
    directory = R.Directory(names)
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    brute = [(a, d) for (a, _), (_, d) in zip(words, words[1:], strict=False) if text[a:d].lower() in names]
    began = time.time()
    got = list(directory.spans(text))
    assert got == brute and len(got) >= len(some) and time.time() - began < 5
    assert list(pickle.loads(pickle.dumps(directory)).spans(text)) == got


def test_places_stay_with_odd_letters_and_bounds(monkeypatch):
    assert list(R.Directory(["ann lee"]).spans("İİ Ann Lee")) == [(3, 10)]
    assert list(R.Directory([]).spans("x")) == [] and list(R.Directory(["", "x"]).spans("")) == []
    monkeypatch.setattr(R, "MOST_NAME_CHARACTERS", 10)
    with pytest.raises(ValueError, match="too large"):
        R.Directory(["a long name", "another"])


def test_redaction_by_directory(spark):
    df = spark.createDataFrame([("Ann Lee wrote to ann lee, not to Annlee",), (None,)], "t string")
    row = R.redact(df, "t", b"k", ("Ann Lee",)).collect()[0]
    assert row["n_redacted"] == 2 and row["t"].count("[PERSON_") == 2 and row["t"].endswith("not to Annlee")
