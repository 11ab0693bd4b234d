"""Language identification, language-model scores and quality rules."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm import language, quality, suffix_tree_lm
from lockstep.llm.common import held_out
from tests.llm.helpers import awkward, empty, prose, words

SF = "/root/testdata/sf0.01"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def test_language_is_learnt(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language.op1_language(spark, SF).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.98 * len(tested)


def test_every_language_has_its_quota_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 48)
    monkeypatch.setattr(language, "CALIBRATE_EVERY", 10**9)
    seen = []
    monkeypatch.setattr(
        language, "_ftrl", lambda rows, n: seen.extend(rows) or (np.zeros((language.FEATURES, n)), np.zeros(n))
    )
    rows = [(f"text {chr(97 + j)} of {chr(97 + k)}", f"l{k:02}") for k in range(24) for j in range(10)]
    rows += [(text, lang) for text, lang in rows[:10] for _ in range(100)]  # any draw meets a text with copies
    rows.append(("one text alone", "zz"))
    language.fit(spark.createDataFrame(rows, "text string, lang string"))
    # 25 languages share 48 texts, one each.
    assert Counter(label for *_, label in seen) == dict.fromkeys(range(25), 1)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark).withColumnRenamed("n_chars", "score")
    found = language.predict(docs, language.fit(docs)).collect()
    assert len(found) == docs.count()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred in (("de", "en") if letters else ("und",)) and 0 <= r.score <= 1
    assert language.predict(empty(spark), language.fit(docs)).collect() == []
    unlearnt = language.predict(docs, language.fit(empty(spark))).collect()
    assert {(r.lang_pred, r.score) for r in unlearnt} == {("und", 0.0)}


def test_scores_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: (t or "").encode().translate(LOWER).split() + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(count.values()), len(count)
    rows = suffix_tree_lm.op2_suffix_tree_lm(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), total)
        assert r.n_known == sum(count[w] > 0 for w in ws)
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def symbols(text):
    return [0] * suffix_tree_lm.ORDER + [10, *b" ".join(w.translate(LOWER) for w in words(text)), 10]


class BruteTree:
    """Counts in dictionaries, states by the rules, one probability at a time."""

    def __init__(self, texts):
        m = suffix_tree_lm
        self.after = defaultdict(Counter)
        for text in texts:
            s = symbols(text)
            for at in range(m.ORDER + 1, len(s)):
                for k in range(m.ORDER + 1):
                    self.after[tuple(s[at - k : at])][s[at]] += 1
        self.states = {()} if self.after else set()
        for context, seen in self.after.items():
            total = sum(seen.values())
            if not context or total < m.LEAST_COUNT:
                continue
            if len(context) > m.SHORT:
                shorter = self.after[context[1:]]
                below = sum(shorter.values())
                nats = sum(n * math.log(n / total * below / shorter[c]) for c, n in seen.items())
                if nats < m.DIVERGENCE:
                    continue
            self.states.update(context[k:] for k in range(len(context)))

    def probability(self, before, c):
        m, p = suffix_tree_lm, 1 / 256
        for k in range(m.ORDER + 1):
            context = tuple(before[len(before) - k :])
            if context not in self.states:
                break
            seen = self.after[context]
            total, more = sum(seen.values()), m.SMOOTH * len(seen)
            p = (seen[c] + more * p) / (total + more)
        return p

    def score(self, text):
        s = symbols(text)
        return sum(math.log10(self.probability(s[:at], s[at])) for at in range(suffix_tree_lm.ORDER + 1, len(s)))


@pytest.mark.parametrize("hot", [1 << 22, 300, 0])
def test_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree_lm, "HOT_GRAMS", hot)
    monkeypatch.setattr(suffix_tree_lm, "HOT_WORDS", hot)
    monkeypatch.setattr(suffix_tree_lm, "TASK_GRAMS", 700)
    texts = [prose(k, 25).replace("kappa", "KAPPA") for k in range(30)] + ["", None, " \t", "É ß", "x", *[prose(3, 25)] * 3]
    rows = [(k, t, k % 4 == 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("key", F.lit(1))
    tree = BruteTree([t for _, t, h in rows if not h])
    assert sum(len(c) > 3 for c in tree.states) > 20
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs).collect()}
    count = Counter(w for _, t, h in rows if not h for w in [*(x.translate(LOWER) for x in words(t)), None])
    total, kinds = sum(count.values()), len(count)
    for k, text, _ in rows:
        ws = [*(x.translate(LOWER) for x in words(text)), None]
        assert got[k].score == pytest.approx(tree.score(text), abs=1e-9)
        assert (got[k].n_tokens, got[k].n_known) == (len(ws), sum(count[w] > 0 for w in ws))
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws)
        assert got[k].base_score == pytest.approx(base, abs=1e-9)


def test_states_are_distributions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", F.lit(False).alias("held_out"))
    grams = suffix_tree_lm.count_grams(docs).toArrow()
    keys, n = grams["key"].to_numpy().view(np.uint64), grams["n"].to_numpy().astype(float)
    low = np.uint64((1 << 24) - 1)
    after, where = np.unique(keys & low, return_inverse=True)
    short = suffix_tree_lm.Short(after, np.bincount(where, n))
    for before in (b" the ", b"\0\0\0\0\0\n", b"zqxzqz", b"nation"):
        context = int.from_bytes(before[-6:].rjust(6, b"\0"), "big")
        every = np.array([context << 8 | c for c in range(256)], np.uint64)
        new = ~np.isin(every, keys)
        all_keys = np.concatenate([keys, every[new]])
        value = dict(zip(all_keys.tolist(), suffix_tree_lm.probabilities(all_keys, np.append(n, np.zeros(new.sum())), short).tolist(), strict=True))
        assert sum(value[k] for k in every.tolist()) == pytest.approx(1.0)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        rows = suffix_tree_lm.op2_suffix_tree_lm(spark, sf).where("held_out")
        score, base = rows.agg(F.sum("score"), F.sum("base_score")).first()
        assert score > base


def test_scores_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = suffix_tree_lm.score(docs.withColumn("held_out", held_out(F.col("doc_id"), 7))).collect()
    assert len(rows) == docs.count()
    same = [r for r in rows if r.doc_id == 2]
    assert same[0][:6] == same[1][:6] and same[0].base_score == pytest.approx(same[1].base_score)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_tokens == by_id[5].n_tokens == 1 and math.isfinite(by_id[4].score)
    nothing = empty(spark).withColumn("held_out", held_out(F.col("doc_id"), 7))
    assert suffix_tree_lm.score(nothing).collect() == []


def quality_brute(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(again), failed,
    )


def test_quality_counts(spark):
    counts = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    docs = awkward(spark)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    got = quality.judge(docs).collect()
    assert sorted(str((r.doc_id, *(r[c] for c in counts))) for r in got if r.doc_id != 2) == sorted(
        str((i, *quality_brute(t))) for i, t in text if i != 2
    )
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.judge(empty(spark)).collect() == []


def test_votes_are_weighed_by_expectation_maximisation(spark):
    """Votes, and the posterior against the same rounds over single texts."""
    counts = quality.statistics(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [r.asDict() for r in quality.votes(counts).collect()]
    rules = quality.RULES
    for r in rows:
        for name, (part, whole, good, fair) in rules.items():
            x = r[part] / r[whole] if r[whole] and r[part] is not None else None
            want = 0 if x is None else -1 if not fair[0] <= x <= fair[1] else 1 if good[0] <= x <= good[1] else 0
            assert r[f"v_{name}"] == want
    v = np.array([[r[f"v_{name}"] for name in rules] for r in rows])
    p = np.choose(np.minimum((v == -1).sum(1), 2), [0.95, 0.3, 0.05])
    before = None
    for _ in range(quality.MAX_ROUNDS):
        g, b = p.sum(), (1 - p).sum()
        rates = np.array([[[(p[v[:, k] == x].sum() + quality.PSEUDO) / (g + 3 * quality.PSEUDO),
                            ((1 - p)[v[:, k] == x].sum() + quality.PSEUDO) / (b + 3 * quality.PSEUDO)]
                           for x in (-1, 0, 1)] for k in range(len(rules))])
        prior = (g + 8 * quality.PSEUDO) / (g + b + 10 * quality.PSEUDO)
        ratio = np.log(rates[:, :, 0] / rates[:, :, 1])
        p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sum(ratio[k][v[:, k] + 1] for k in range(len(rules))))))
        if before is not None and np.abs(rates - before).max() < quality.TOLERANCE:
            break
        before = rates
    posterior = dict(zip([r["doc_id"] for r in rows], p, strict=True))
    for r in quality.op10_quality(spark, SF).collect():
        assert r.p_good == pytest.approx(posterior[r.doc_id], abs=1e-9)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_quality_verdicts(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = quality.op10_quality(spark, SF).collect()
    for r in rows:
        assert tuple(r[1:7]) == quality_brute(texts[r.doc_id])
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
