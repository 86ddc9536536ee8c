import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF = "/root/testdata/sf0.001"


def edge_texts():
    r = random.Random(11)
    bits = ["a", "The", "the", "of", " ", "  ", "\n", "\t", "é", "漢字", "1", "23", "#", "|", "x@y.org", "1.2.3.4", "+1 (555) 555-1234", "4111 1111 1111 1111", "<|endoftext|>", "▁", "😀", "\x1c", "É", "ﬁ", "don't"]
    texts = [None, "", " ", "\n\n", "one", "a b c d", "a b c d e", "ab" * 40_000, "漢" * 9_000, "!" * 30_000, "word " * 3_000, "line\nline\nline\n"]
    texts += ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(80))) for _ in range(60)]
    base = [r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(40)) for _ in range(120)]
    for k in range(25):
        w = list(base)
        for _ in range(k % 6):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


@pytest.fixture(scope="session")
def edge_rows():
    return list(enumerate(edge_texts()))


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Texts with nulls, long ones and repeats, and columns whose names clash with those used inside."""
    rows = [(i, t, None if i % 7 == 0 else "en", "s", 0, "x", 1.5, 2) for i, t in edge_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, sig double, key long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("doc_id < 0")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """A null id and rows repeated."""
    text = "this is a repeated row of more than five words"
    return spark.createDataFrame([(None, "no id here"), (5, text), (5, text), (3, text), (None, None), (9, None)], "doc_id long, text string").withColumn("lang", __import__("pyspark").sql.functions.lit("en"))


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
