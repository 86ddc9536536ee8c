"""What workers hold: freed memory, stretches of input, unpacked payloads."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tarnlake.llm import common, lm, ngram_join, warc

FREED = """
import re
import numpy as np
from tarnlake.llm import common

def held():
    return int(re.search(r"\\nRssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

common.keep_only(None)
before, pins = held(), []
for _ in range(4):
    arrays = []
    for k in range(100):  # each with small objects behind it, as caches leave them
        arrays.append(np.ones(262_144))
        pins.append([bytes(5000 + k) for _ in range(20)])
    arrays.clear()
common.keep_only(None)
print(held() - before)
"""


def test_freed_memory_goes_back():
    out = subprocess.run([sys.executable, "-c", FREED], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(out.stdout.split()[-1]) < 100  # pins 40 MB; arrays 200 MB


def _sets(rng, k, size, common):
    base = rng.integers(0, 1 << 63, common, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, common // 2), rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)]) for _ in range(k)]
    return [(ngram_join._sig(s), s) for s in sets]


def _read(batches):
    """single and several pairs as (sig, hash), hashes sent as shared already."""
    single, pairs, several = [], [], []
    for b in batches:
        for r in b.to_pandas().itertuples(index=False):
            if r.kind == ngram_join.SEVERAL:
                several += ngram_join._undelta(r.tok).tolist()
            elif r.kind == ngram_join.SINGLE:
                sig = np.frombuffer(r.sigs, np.int64)[ngram_join.unpacked(r.idx, np.uint32)]
                single += zip(sig.tolist(), ngram_join._undelta(r.tok).tolist(), strict=True)
            else:
                sig = np.repeat(np.frombuffer(r.sigs, np.int64), np.frombuffer(r.runs, np.uint32))
                assert set(ngram_join._bucket(sig, 3).tolist()) == {r.range}
                pairs += zip(sig.tolist(), ngram_join.unpacked(r.tok, np.uint64).tolist(), strict=True)
    return single, pairs, several


def test_stretch_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "ORDERED_PAIRS", 37)
    rng = np.random.default_rng(3)
    for sets in (_sets(rng, 40, 30, 60), _sets(rng, 5, 20, 0), _sets(rng, 1, 9, 0), _sets(rng, 3, 0, 400)):
        wanted = {(g, h) for g, s in sets for h in s.tolist()}
        times = {}
        for _, h in wanted:
            times[h] = times.get(h, 0) + 1
        held = list(sets)
        single, pairs, several = _read(ngram_join._stretch(held, 3))
        assert not held
        assert sorted(single + pairs) == sorted(wanted)
        assert {h for _, h in single} == {h for h, n in times.items() if n == 1}
        assert sorted(several) == sorted(h for h, n in times.items() if n > 1)


def test_stretch_needs_little_more_than_its_hashes():
    sets = _sets(np.random.default_rng(4), 250, 2_000, 4_000)
    n = sum(len(s) for _, s in sets)
    tracemalloc.start()
    try:
        for _ in ngram_join._stretch(sets, 6):
            pass
        assert tracemalloc.get_traced_memory()[1] < 70 * n
    finally:
        tracemalloc.stop()


def test_long_payloads_of_short_records_one_after_another():
    payload, raw, own = b"x" * 4_000_000, b"", []
    for k in range(40):
        own.append((len(raw), len(r := warc.record(k, "u", payload, "d", "response", None))))
        raw += r
    assert len(raw) < 1_000_000
    tracemalloc.start()
    try:
        assert sum(len(x) for x in warc.parsed(raw, 0, own, False, 8_388_608)) == 40
        lists = 0
        for found in warc.parsed(raw, 0, own, True, 8_388_608):
            lists += 1
            assert all(x["payload"] == payload for x in found)
        assert lists == 14
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()


def test_a_range_of_ngrams_needs_little_more_than_they():
    rng, rows, n = np.random.default_rng(5), [], 0
    for batch in range(20):
        for order, most in ((1, 10_000), (2, 60_000)):
            items = np.unique(rng.integers(0, 1 << lm.ITEM_BITS, most, dtype=np.uint64) % np.uint64(20 * most))
            rows.append((0, order, batch, common.packed((items >> np.uint64(32)).astype(np.uint8)), items.astype(np.uint32).tobytes(), common.packed(rng.integers(0, 4, len(items)).astype(np.uint32))))
            n += len(items)
    rows = pd.DataFrame(rows, columns=["range", "order", "batch", "high", "low", "counts"])
    tracemalloc.start()
    try:
        got = lm._looked_up(rows)
        assert tracemalloc.get_traced_memory()[1] < 50 * n
    finally:
        tracemalloc.stop()
    assert sum(len(common.unpacked(x, np.uint8)) for x in got["levels"]) == n


def test_the_ngrams_of_a_batch_need_little_more_than_they():
    n = 400_000
    rng = np.random.default_rng(6)
    words, seq = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), rng.integers(0, 20_000, n).astype(np.uint32)
    tracemalloc.start()
    try:
        found = {order: (len(items), len(place)) for order, items, place in lm._grams(words, seq)}
        assert tracemalloc.get_traced_memory()[1] < 40 * n
    finally:
        tracemalloc.stop()
    assert found[1] == (20_000, n) and found[2][1] == n


class Mapped:
    """Stands for a DataFrame: keeps what its workers would run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def __getattr__(self, name):
        return lambda *args, **more: self


@pytest.mark.parametrize("of", [lm.word_counts, lambda batches: lm._dealt(batches, 6)])
def test_workers_of_op3_drop_what_others_kept(spark, monkeypatch, of):
    monkeypatch.setattr(common, "_CACHES", [])
    kept = common.per_worker(lambda: bytearray(1))
    first, rows = kept(), Mapped()
    of(rows)
    assert list(rows.run(iter([]))) == []
    assert kept() is not first
