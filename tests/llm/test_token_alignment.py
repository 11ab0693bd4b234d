"""Aligned tokens against a walk along both tokenisations."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lockstep.llm import token_alignment as ta
from tests.conftest import SF
from tests.llm.helpers import awkward, empty

BYTE_JSON = os.path.join(os.path.dirname(ta.BYTE_BPE), "byte_bpe_50k.json")
ODD = [
    "é▁y", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x01　 x", "日本語 😀 ﬁ", "a  b\t\tc\n\n d ",
    "don't I'LL 12ab34 !?…", "‍́é é", "ab" * 4000, "!" * 999,
]


@pytest.fixture(scope="module")
def tokenizers():
    one = Tokenizer.from_file(BYTE_JSON)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=ta.PIECE_BPE)


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}


def walked(rows, tokenizers):
    one, two = tokenizers
    back, found, counts = byte_of(), [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        e = one.encode(" " + (text or ""), add_special_tokens=False)
        a = [(k, bytes(back[c] for c in t)) for k, t in zip(e.ids, e.tokens, strict=True)]
        b = []
        for k in two.encode(text or ""):
            piece = two.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if two.is_byte(k) else piece.replace("▁", " ").encode()))
        if not text or any(b"".join(t for _, t in x) != raw for x in (a, b)):
            found.append((doc_id, [], [], [], []))
            continue
        links, groups, now, i, j, end_a, end_b = [], [], ([], []), 0, 0, 0, 0
        while i < len(a):
            links.append((a[i][0], b[j][0]))
            stop_a, stop_b = end_a + len(a[i][1]), end_b + len(b[j][1])
            if stop_a <= stop_b:
                now[0].append(a[i][0])
            if stop_b <= stop_a:
                now[1].append(b[j][0])
            if stop_a == stop_b:
                groups.append(now)
                now = ([], [])
            if stop_a <= stop_b:
                i, end_a = i + 1, stop_a
            if stop_b <= stop_a:
                j, end_b = j + 1, stop_b
        counts.update(links)
        found.append((doc_id, a, b, groups, links))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == highest[p[1]] for p in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(map(str, out)), counts, highest


def test_query_matches_walk(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(str(tuple(r)) for r in ta.op12_token_alignment(spark, SF).collect())
    assert got == walked([tuple(r) for r in docs], tokenizers)[0]


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_awkward_rows(spark, tokenizers, monkeypatch, hot):
    monkeypatch.setattr(ta, "HOT_PAIRS", hot)
    docs = awkward(spark)
    more = [(100 + k, t, "a", "b", 1) for k, t in enumerate(ODD)]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).withColumnRenamed("lang", "key").withColumnRenamed("source", "times")
    found = ta.align_corpus(docs)
    rows, counts, highest = walked([(r.doc_id, r.text) for r in docs.collect()], tokenizers)
    assert sorted(str(tuple(r)) for r in found.measures.collect()) == rows
    pairs = {(r.a, r.b): (r.n, r.best) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == highest[p[1]]) for p, n in counts.items()}


def test_no_rows(spark):
    found = ta.align_corpus(empty(spark))
    assert found.measures.count() == found.pairs.count() == 0


def test_ranks_and_file_agree():
    ranks, file = ta.Vocabulary.read(ta.BYTE_BPE), ta.Vocabulary.read(BYTE_JSON)
    assert ranks.encode(ODD) == file.encode(ODD)
    assert ranks._tokens() == file._tokens()[:50_256]
    letters = [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}!  {chr(c)}{chr(c)} b" for c in range(0x3000) if c]
    assert ranks.encode(letters) == file.encode(letters)
