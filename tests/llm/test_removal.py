"""Repeated word windows and byte strings, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm import sketch, substrings, suffixes
from tests.llm.helpers import awkward, empty, words


def windows_brute(rows, size=35):
    seen = Counter()
    for _, text in rows:
        w = words(text)
        seen.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def strings_brute(rows, size=50):
    least = {}
    big = 2**63 - 1
    for doc_id, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - size + 1):
            s = raw[k : k + size]
            least[s] = min(least.get(s, big), big if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if least[raw[k : k + size]] < (big if doc_id is None else doc_id):
                gone[k : k + size] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def by_value(rows):
    return sorted(map(str, rows))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_windows_of_awkward_rows(spark):
    docs = awkward(spark)
    got = substrings.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert by_value(map(tuple, got.collect())) == by_value(windows_brute(pairs(docs)))
    assert substrings.dedup(empty(spark)).collect() == []


@pytest.mark.parametrize("hot", [50_000, 1])
def test_strings_of_awkward_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    docs = awkward(spark)
    got = suffixes.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert by_value(map(tuple, got.collect())) == by_value(strings_brute(pairs(docs)))


def test_strings_of_no_rows(spark):
    assert suffixes.dedup(empty(spark)).collect() == []


def test_suffix_array_and_prefixes():
    draw = np.random.RandomState(0)
    for k in range(60):
        text = draw.randint(97, 98 + k % 4, draw.randint(1, 150)).astype(np.uint8)
        text = np.tile(text, 3) if k % 3 == 0 else text
        raw, order = text.tobytes(), suffixes.suffix_array(text, 50)
        assert sorted(order.tolist()) == list(range(len(raw)))
        shared = suffixes.common_prefixes(text, order, 50)
        for i in range(1, len(order)):
            a, b = raw[order[i - 1] :][:50], raw[order[i] :][:50]
            assert a <= b
            n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert shared[i] == n or n == min(len(a), len(b)) and shared[i] >= n


def test_sketch_misses_no_repeated_key(spark):
    keys = np.random.RandomState(0).randint(0, 2**62, 5000).astype(np.uint64)
    rows = spark.createDataFrame([(int(k),) for k in np.concatenate([keys, keys[:700]])], "key long")
    found = sketch.repeated(
        rows.repartition(5), lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 10
    )
    assert found.may(keys[:700]).all()
    wide = sketch.repeated(rows, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 1 << 22)
    assert wide.may(keys[:700]).all() and wide.may(keys[700:]).mean() < 0.01


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = pairs(spark.read.parquet(f"{sf}/documents.parquet"))
    assert by_value(map(tuple, substrings.op3_substring_dedup(spark, sf).collect())) == by_value(windows_brute(rows))
    assert by_value(map(tuple, suffixes.op7_suffix_dedup(spark, sf).collect())) == by_value(strings_brute(rows))
