"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lockstep.llm import spelling
from tests.conftest import SF
from tests.llm.helpers import awkward, empty


def counted(rows, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def grouped(counts):
    near = defaultdict(set)
    changed = defaultdict(list)
    for w in counts:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            changed[k, short].append(w)
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    for alike in changed.values():
        for w in alike:
            near[w].update(x for x in alike if x != w)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 2 * counts[w]:
            forms[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out.append((w, form, root, n, len(near[w]), counts[form] if form else None))
    return out


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())))


def expected(counts):
    return sorted(map(str, grouped(counts)))


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(spelling.op11_spelling(spark, SF)) == expected(counted((r.doc_id, r.text) for r in docs))


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(k, f"Colour colours cOlour coulour colourr {'x' * 5000} Àbcd×f", "n", 1) for k in range(300)]
    rows += [(None, "colour", None, 2), (None, None, None, None), (7, "", "", 0), (7, "naïveté naïvete " * 40, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    counts = counted((r[0], r[1]) for r in rows)
    assert len(counts) > 8
    assert rows_of(spelling.group(spelling.count_words(docs))) == expected(counts)
    more = awkward(spark)
    pairs = [(r.doc_id, r.text) for r in more.collect()]
    assert rows_of(spelling.group(spelling.count_words(more))) == expected(counted(pairs))


def test_no_rows(spark):
    assert spelling.group(spelling.count_words(empty(spark))).count() == 0


def test_chains_lead_to_the_last_form(spark):
    words, n = [], 1
    for k in range(12):  # each one edit from the next and half as frequent
        words.append(("b" * k + "a" * (20 - k), n))
        n *= 2
    df = spark.createDataFrame(words, "word string, n long")
    assert rows_of(spelling.group(df)) == expected(dict(words))
    with pytest.raises(ValueError, match="ratio"):
        spelling.group(df, ratio=1)


def test_ties_take_the_least_form(spark):
    counts = {"aaaaa": 1, "aaaab": 4, "aaaac": 4, "aaaaé": 4, "zzzzz": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("mine"))
    assert rows_of(spelling.group(df)) == expected(counts)


@settings(max_examples=300, deadline=None)
@given(st.text("abcß", min_size=4, max_size=9), st.integers(0, 2), st.integers(0, 9), st.sampled_from("abcß"))
def test_every_edit_meets_in_the_index(word, kind, at, letter):
    at = min(at, len(word) - 1)
    other = [word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]][kind]
    if other == word or len(other) < 4:
        return
    weights = [3] * spelling.GRAM_SLOTS
    found = {w: spelling.pivots(w, weights) for w in (word, other)}
    first, second = sorted((word, other), key=lambda w: (found[w][2], w))
    (left, right), prefix, _ = found[first]
    assert right >= left + 2 and {left, right} <= set(prefix)
    assert set(spelling._sought(first, left, right)) & set(spelling._indexed(second, found[second][1]))
