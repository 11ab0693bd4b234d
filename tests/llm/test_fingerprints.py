"""Fingerprints as sums over paragraphs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lockstep.llm import fingerprints
from tests.conftest import SF
from tests.llm.helpers import awkward, empty, prose


def edited_brute(rows):
    """rows: (doc_id, text) in order."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, text, following))
    return out


def codes(*texts):
    return fingerprints.vectors(pa.array(texts, pa.string())).encode()


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    expected = {r[0]: r for r in edited_brute([(r.doc_id, r.text) for r in docs])}
    got = fingerprints.op13_fingerprints(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(expected)
    print_of = {}
    for r in got:
        _, n, digest, edited, text, following = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert codes(text, edited) == [r.fingerprint, r.edited_fingerprint]
        assert print_of.setdefault(text, r.fingerprint) == r.fingerprint
        a, b, c = (fingerprints.decode([x]) for x in codes(text, edited, following))
        assert (r.near_edited, r.near_next) == (a.alike(b)[0], a.alike(c)[0])
    assert len(set(print_of.values())) == len(print_of)
    long = [r for r in got if r.n_chars > 500]
    assert np.mean([r.near_edited > 0.5 and r.near_next < 0.3 for r in long]) > 0.95


def test_awkward_rows(spark):
    docs = awkward(spark).withColumns({"mark": F.lit(1), "range": F.lit(2), "after": F.lit("x")})
    got = fingerprints.beside_next(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    # Distinct ids have one defined neighbour; the two rows of id 2 are equal, so have nulls' order alone open.
    ids = sorted(i for i, _ in rows if i is not None)
    text_of = dict(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != ids[-1] and r.doc_id != 2:
            following = text_of[ids[ids.index(r.doc_id) + 1]]
            assert r.edited == edited_brute([(r.doc_id, text_of[r.doc_id]), (0, following)])[0][3]
    assert {r.near_edited for r in got if r.n_chars == 0} == {1.0}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    (row,) = fingerprints.beside_next(one).collect()
    assert row.edited == "abcdefab" and row.near_next == 1.0
    assert fingerprints.beside_next(empty(spark)).count() == fingerprints.fingerprint(empty(spark)).count() == 0


def test_many_rows_of_one_id_keep_their_order(spark):
    rows = [(None if k % 3 else 1, prose(k, 9)) for k in range(900)] + [(k, "x" * 40) for k in range(2, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = {(r.doc_id, r.text): r.m for r in docs.withColumn("m", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, marks[r]))
    expected = [(str(r[0]), r[2]) for r in edited_brute(order)]
    got = fingerprints.beside_next(docs).select("doc_id", F.sha2("edited", 256).alias("h")).collect()
    assert sorted((str(r.doc_id), r.h) for r in got) == sorted(expected)


def test_order_does_not_count_but_number_does():
    lines = [prose(k, 12) for k in range(9)]
    turned = random.Random(1).sample(lines, 9)
    a, b, c, d = codes("\n".join(lines), "\n\n".join(turned) + "\n", "\n".join([*lines, lines[0]]), "\n".join(lines[1:]))
    assert a == b and len({a, c, d}) == 3
    assert codes(None, "", " \n\t") == [codes("")[0]] * 3


def test_paragraphs_come_and_go(spark):
    old, new = "one two three\nfour", "five six\nseven eight nine ten"
    before, after = codes(old, "four\n" + new)
    df = spark.createDataFrame([(before, "one two three", new), (before, None, None)], "f string, a string, b string")
    got = df.select(fingerprints.amend(F.col("f"), F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [after, before]


def test_sums_of_groups(spark):
    texts = [(k, prose(k, 20 + k), None if k % 5 == 0 else k % 3) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, fingerprint int").repartition(7)
    prints = fingerprints.fingerprint(docs).withColumn("g", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 3))
    got = {r.g: r.fingerprint for r in fingerprints.combine(prints, "g").collect()}
    for g in (None, 0, 1, 2):
        assert got[g] == codes("\n".join(t for _, t, h in texts if h == g))[0]


def test_likeness_follows_the_share_that_stays(spark):
    lines = [prose(100 + k, 30) for k in range(40)]
    codes_of = [(codes("\n".join(lines))[0], codes("\n".join(lines[:n]))[0], n) for n in (0, 10, 20, 30, 40)]
    df = spark.createDataFrame(codes_of, "a string, b string, n int")
    got = {r.n: r.x for r in df.select("n", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    for n, x in got.items():
        assert abs(x - (n / 40) ** 0.5) < 0.2
    assert got[40] == 1.0 and got[0] == 0.0
