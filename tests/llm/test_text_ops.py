"""Personal data, rules, language model, tokens and encodings against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import common, bpe, lm, pii, quality, token_count
from tarnlake.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(edge_docs, sf_docs):
    more = sf_docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    return edge_docs.unionByName(more, allowMissingColumns=True)


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    bits = [*"ab.@+-%1 23() ", "@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-1234", "é", "😀", "255", ".0", "٣"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == brute.pii(t)


def test_find_pii(docs):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in rows(docs):
        base = brute.pii(t or "")
        own = [s for s in got[i]["spans"].split(",") if s and not s.startswith(("term:", "secret:"))]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert ",".join(own) == text
        assert got[i]["base_sha256"] == brute.sha(text)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_sensitive_terms_are_those_that_occur_with_one_entity(spark):
    filler = [f"plain text number {k} about the weather and nothing else" for k in range(60)]
    secret = [f"{w} note {w} zanzibar writes from a@b.org about {w}" for w in "red green blue white black".split()]
    docs = spark.createDataFrame(list(enumerate(filler + secret + ["about zanzibar without an address"])), "doc_id long, text string")
    terms = {r["term"]: r["removed"] for r in pii.sensitive_terms(docs).collect()}
    assert "zanzibar" in terms and "about" not in terms
    copies = spark.createDataFrame([(k, secret[0]) for k in range(50)] + [(100 + k, x) for k, x in enumerate(filler)], "doc_id long, text string")
    assert pii.sensitive_terms(copies).count() == 0  # one text's copies prove nothing
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "a@b.org" not in clean[60] and "zanzibar" not in clean[65] and clean[3] == filler[3]
    blocks = pii.BLOCK_TERMS
    try:
        pii.BLOCK_TERMS = 1  # terms joined to the rows give the same
        assert {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()} == clean
    finally:
        pii.BLOCK_TERMS = blocks


def test_long_terms_of_one_prefix_are_different_terms(spark):
    stem = "x" * 150
    rows = [(k, f"filler{k} {stem}secret wrote to ann{k % 2}@corp.example today note{k}") for k in range(8)]
    rows += [(100 + k, f"nothing here but {stem}plain{k} and other words {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["term"] for r in pii.sensitive_terms(docs).collect()}
    assert pii.term_key(f"{stem}SECRET") in keys and not any(pii.term_key(f"{stem}plain{k}") in keys for k in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(f"{stem}secret" not in clean[k] for k in range(8)) and all(clean[100 + k] == rows[8 + k][1] for k in range(40))


def test_sensitive_terms_match_the_plain_version(spark):
    """Entities that occur once count by group and kind; many spans, spans within a span, long runs of digits."""
    r = random.Random(12)
    words = [f"word{k}" for k in range(30)]
    texts = []
    for k in range(120):
        w = [r.choice(words) for _ in range(25)]
        if k % 5 == 0:
            w.insert(r.randrange(20), r.choice([f"ask Zanzibar p{k}.x@corp.example.org now", f"key = {hashlib.sha1(str(k).encode()).hexdigest()}", f"dial +1 (5{k:02d}) 555-{1000 + k}", "4111 1111 1111 1111 visa"]))
        texts.append(" ".join(w))
    texts += [texts[0]] * 9 + ["", " ".join(["1.2.3.4"] * 6) + "@a.b rest", "1.2.3.4.1.2.3.4.1.2.3.4name@host.org tail", "9" * 100_000, None]
    want = brute.sensitive([t or "" for t in texts], 6, 3, 0.9, 0.99)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["term"]: x["removed"] for x in pii.sensitive_terms(docs).collect()}
    assert got == want and {"zanzibar", "key", "dial"} <= set(got)
    found = {x["doc_id"]: x for x in pii.find_pii(docs).collect()}
    for k, t in enumerate(texts):
        own = {k for _, a, b in pii.entity_spans(t or "") for k in range(a, b)}
        terms = [m.span() for m in re.finditer(r"[^\W_]{2,}", t or "") if m[0].lower() in want and not own & set(range(*m.span()))]
        assert [x for x in found[k]["spans"].split(",") if x.startswith("term:")] == [f"term:{a}:{b}" for a, b in terms]


def test_quality_counts(docs):
    got = {r["id"]: r for r in quality.features(docs).collect()}
    for i, t in rows(docs):
        want = brute.quality(t)
        assert {k: got[i][k] for k in want} == want, i
        assert got[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_binomial_bound(spark):
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.0125), (2000, 11, 0.0125)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).head()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_thresholds_reject_only_what_labels_certify(spark):
    good, bad = "plain words of a text " * 20, "plain#### words**** of$$$$ a text " * 20
    rows = [(k, f"{good} {k}", "en") for k in range(900)] + [(1000 + k, f"{bad} {k}", "en") for k in range(200)] + [(2000 + k, f"{bad} {k}", "de") for k in range(5)]
    varied = [(i, " ".join(f"{w}{j}" for j, w in enumerate(t.split())), s) for i, t, s in rows]
    docs = spark.createDataFrame(varied, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.quality_rules(docs, labels).filter("kept").collect()}
    assert {i for i in kept if i < 1000} == set(range(900))
    assert not any(1000 <= i < 2000 for i in kept)
    assert all(2000 + k in kept for k in range(5))  # five labels certify nothing in 'de'
    assert quality.passed(docs, labels).count() == len(kept)


def test_base_scores(docs):
    want = {x[0]: x for x in brute.base_scores(rows(docs))}
    for r in lm.score(docs).collect():
        i, held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def test_bloom_counts_are_close_and_never_low():
    import numpy as np

    items = lm.mixed(np.arange(20_000, dtype=np.uint64))
    level = lm.levels(np.random.default_rng(1).integers(1, 500, len(items)))
    raw, size = bytearray(1 << (lm.LOG_BITS - 3)), 1 << (lm.LOG_BITS - lm.LOG_SEGMENTS - 3)
    import pandas as pd

    for s in range(1 << lm.LOG_SEGMENTS):
        own = (items >> np.uint64(64 - lm.LOG_SEGMENTS)) == s
        frame = pd.DataFrame([(s, 1, items[own].tobytes(), level[own].astype(np.uint8).tobytes())], columns=["range", "order", "items", "levels"])
        raw[s * size : (s + 1) * size] = lm._segment({1: 1, 2: 1})((s,), frame)["part"][0]
    model = lm.LogFrequencyFilter(bytes(raw))
    assert (model.level(items) >= level).all() and (model.level(items) == level).mean() > 0.99
    assert (model.level(lm.mixed(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))) > 0).mean() < 0.01


def test_every_word_pair_of_the_training_texts_counts(spark, monkeypatch):
    import collections

    texts = [(k, " ".join(f"w{(k * 37 + j * j) % 400}" for j in range(60))) for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = {r["doc_id"]: r["held_out"] for r in docs.select("doc_id", lm.held_out(docs, "doc_id").alias("held_out")).collect()}
    tokens = {i: [*t.split(), ""] for i, t in texts}
    one, two = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["", *w[:-1]], w, strict=True))
    assert list(two.values()).count(1) > 100
    kept = lambda c: (3 * 2 ** (c.bit_length() - 1) - 1) / 2 if c else 0
    scale = sum(one.values()) + len(one) + 1
    for tokens_a_batch in (1_500_000, 500):
        monkeypatch.setattr(lm, "BATCH_TOKENS", tokens_a_batch)
        got = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
        assert set(got) == set(tokens)
        for i, w in tokens.items():
            p = [0.15 * min(kept(two[h, x]), kept(one[h])) / kept(one[h]) + 0.85 * (kept(one[x]) + 1) / scale if one[h] else (kept(one[x]) + 1) / scale for h, x in zip(["", *w[:-1]], w, strict=True)]
            if not held[i]:
                assert got[i] == pytest.approx(sum(map(math.log10, p)), rel=0.02)  # a level too high is rare
                assert got[i] > sum(map(math.log10, p)) - 3


def test_the_filter_grows_with_what_goes_in():
    import numpy as np
    import pandas as pd

    n = 600_000  # of one of 64 ranges: 38 million insertions in all
    items = np.unique(np.random.default_rng(4).integers(0, 1 << lm.ITEM_BITS, n, dtype=np.uint64))
    row = (0, 2, 7, common.packed((items >> np.uint64(32)).astype(np.uint8)), items.astype(np.uint32).tobytes(), common.packed(np.ones(len(items), np.uint32)))
    got = lm._looked_up(pd.DataFrame([row], columns=["range", "order", "batch", "high", "low", "counts"]))
    level = common.unpacked(got["levels"][0], np.uint8)
    assert len(level) == len(items) and (level >= 1).all() and (level == 1).mean() > 0.9


def test_scores_are_those_of_the_quantised_counts(spark, sf_docs):
    """The model from its definition, with plain counters; a false positive of the filter may lift a text's score a little."""
    texts = sf_docs.unionByName(sf_docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text", "lang", "source", "n_chars").limit(40))
    all_rows = [(r["doc_id"], [*brute.words(brute.lower(r["text"])), ""]) for r in texts.collect()]
    got = lm.score(texts).collect()
    held = {r["doc_id"]: r["held_out"] for r in got}
    one, two = Counter(), Counter()
    for i, ws in all_rows:
        if not held[i]:
            one.update(ws)
            two.update(zip(["", *ws[:-1]], ws, strict=True))
    n, v = sum(one.values()), len(one)
    near = lambda c: (3 * 2 ** (c.bit_length() - 1) - 1) / 2 if c else 0.0
    want = {}
    for i, ws in all_rows:
        s = 0.0
        for h, w in zip(["", *ws[:-1]], ws, strict=True):
            ch, cw, base = near(one[h]), near(two[h, w]), (near(one[w]) + 1) / (n + v + 1)
            s += math.log10(0.15 * min(cw, ch) / ch + 0.85 * base) if ch else math.log10(base)
        want[i] = s
    off = [abs(r["score"] / want[r["doc_id"]] - 1) for r in got]
    assert min(off) < 1e-9 and sum(off) / len(off) < 0.01 and max(off) < 0.05, (min(off), sum(off) / len(off), max(off))


def test_frequent_words_go_in_by_step(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{k}".encode(), 1 + k // 10) for k in range(100)], "word binary, c long")
    monkeypatch.setattr(lm, "HOT_WORDS", 35)
    assert set(lm._frequent(counts).values()) == {8, 9, 10}
    assert lm._frequent(counts.limit(0)) == {}


def test_model_beats_the_base_on_held_out_texts(sf_docs):
    r = lm.score(sf_docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert r[0] > r[1]


def test_token_counts(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in token_count.token_counts(docs, limit=300).collect()}
    for i, t in rows(docs):
        t = t or ""
        n = len(sp.encode(t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 300)
        fit = got[i]["fit_chars"]
        assert len(sp.encode(t[:fit])) <= 300 and (fit == len(t) or len(t) > 5000 or all(len(sp.encode(t[:k])) > 300 for k in range(fit + 1, len(t) + 1)))


def test_counts_at_every_prefix():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    c = token_count.counter(tokenizer_file("piece_bpe_32k.model"))
    for t in ("", "a", "thing  of\nthe 漢字 ▁x", "  unbelievable 123\t", "antidisestablishmentarianism" * 4):
        table = c.prefix_table(t)
        want = [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert [0, *table.counts().tolist()] == want == [table.count_at(k) for k in range(len(t) + 1)]


def test_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    text = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    for i, t in rows(docs):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and text[i] == tok.decode(want, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(want), brute.sha(",".join(map(str, want))), brute.sha(text[i]))


def test_tree_joins_are_exact_at_any_leaf_size():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(2)
    for leaf in (16, 100):
        c = bpe.TreeCodec(path, leaf=leaf, window=1)
        for t in ("a" * 3000, "abc" * 999, "".join(r.choice("abcdeéth") for _ in range(4000)), "!" * 2000 + "<|endoftext|>" + "9" * 700):
            assert c.encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_empty_and_odd_tables(no_docs, odd_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    calls = (pii.find_pii, lambda d: quality.quality_rules(d, labels), lm.score, token_count.token_counts, bpe.round_trip, bpe.encode, pii.sanitise, lambda d: quality.passed(d, labels))
    for f in calls:
        assert f(no_docs).count() == 0
    for f in calls[:-1]:
        assert f(odd_docs).count() == 6


def test_digest_of_nothing(no_docs):
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
