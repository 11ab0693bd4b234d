"""Near-duplicates, leaks, main text, shards, mixes and the pipeline."""

import html
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lockstep.llm import decontamination, extraction, mixing, near_duplicates, queries, sharding
from lockstep.llm.common import settle, table
from tests.llm.helpers import awkward, empty, prose, words

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def classes_brute(texts):
    """Least id of each class, by comparing all pairs that share a shingle."""
    sets, at = {i: shingles(t) for i, t in texts.items()}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    common = Counter((a, b) for ids in at.values() for k, b in enumerate(ids) for a in ids[:k])
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}


def test_classes_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in near_duplicates.op8_near_duplicates(spark, SF).collect()}
    assert got == classes_brute(texts)


@pytest.mark.parametrize("component", [near_duplicates.COMPONENT, 1])
def test_a_chain_of_edits_is_one_class(spark, monkeypatch, component):
    monkeypatch.setattr(near_duplicates, "COMPONENT", component)
    w = prose(9, 100).split()
    chain = {}
    for k in range(14):  # each is similar to its neighbours, hardly to those further on
        chain[100 + k] = " ".join(w)
        w[7 * k] = f"changed{k}"
    docs = spark.createDataFrame(list(chain.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    assert got == classes_brute(chain) and set(got.values()) == {100}


@pytest.mark.parametrize("component", [near_duplicates.COMPONENT, 1])
def test_copies_with_a_line_repeated_are_one_class(spark, monkeypatch, component):
    monkeypatch.setattr(near_duplicates, "COMPONENT", component)
    texts = {}
    for k in range(12):
        w = [f"{x}{k}" for x in prose(k, 204).split()]
        texts[2 * k] = " ".join(w)
        texts[2 * k + 1] = " ".join(w[:100] + 20 * w[50:100] + w[100:])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    assert got == classes_brute(texts) == {i: i // 2 * 2 for i in texts}


def test_classes_of_awkward_rows(spark):
    docs = awkward(spark)
    got = near_duplicates.classes(docs).collect()
    assert len(got) == docs.count()
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    assert {r.doc_id: r.class_id for r in got if r.doc_id in (9, 10)} == {9: 9, 10: 9}
    kept = near_duplicates.dedup(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 3, 4, 5, 6, None, None, 7, 9, 11, 12])
    assert near_duplicates.classes(empty(spark)).collect() == []
    assert near_duplicates.dedup(empty(spark)).collect() == []


def test_agreement_in_registers_follows_probability_jaccard():
    draw = np.random.RandomState(0)
    base = draw.randint(0, 2**62, 60).astype(np.uint64)
    agree = []
    for trial in range(40):
        elements = base + np.uint64(trial * 1000)
        a, b = elements[:50], elements[10:]
        who = near_duplicates.prob_min_hash(
            np.concatenate([a, b]), np.repeat([0, 1], 50), np.ones(100), 2
        )
        agree.append((who[0] == who[1]).mean())
    assert np.mean(agree) == pytest.approx(40 / 60, abs=0.03)


def test_leaks(spark):
    docs = {r.doc_id: " ".join((r.text or "").split()) for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in table(spark, SF, "benchmark").collect()}
    want = {(i, j) for i, t in docs.items() for j, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontamination.op6_decontamination(spark, SF).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want)


def test_leaks_of_paraphrases_and_awkward_rows(spark):
    item = "Which river flows through the old town of Arles? It is called the great Rhone by sailors."
    bench = spark.createDataFrame(
        [(1, item), (2, None), (3, ""), (None, "...")], "item_id long, text string"
    )
    changed = "Which river flows quietly through that old town of Arles? It is called the great Rhone by sailors."
    docs = awkward(spark).union(
        spark.createDataFrame(
            [(50, prose(8, 90) + " " + changed + " " + prose(7, 90), "en", "a", 1), (51, prose(6, 300), "en", "a", 1)],
            awkward(spark).schema,
        )
    )
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == {(50, 1)}
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert decontamination.leaks(empty(spark), bench).collect() == []
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_leaks_outside_the_latent_directions_are_found():
    items = [(k, " ".join(f"{w}{k}" for w in prose(k, 20).split())) for k in range(12)]
    texts = [prose(50 + k, 70) + " " + text + " " + prose(80 + k, 70) for k, text in items]
    for k, text in items:  # paraphrases: every sixth word replaced, one put in after every third
        w = [x if j % 6 else "other" for j, x in enumerate(text.split())]
        texts.append(prose(20 + k, 9) + " " + " ".join(" ".join([*w[j : j + 3], "more"]) for j in range(0, 20, 3)))
    bench = decontamination.Benchmark(items)
    bench.weigh(np.full(len(bench.vocabulary), 2), 1000)
    bench.direct(np.zeros((len(bench.vocabulary), 1)))  # no block is close to any piece
    got = sorted((row, item.item_id) for row, item, *_ in decontamination._found(bench, pa.array(texts)))
    assert got == [(row, row % 12) for row in range(24)]


def leaks_brute(texts, items):
    """Every (text, item) with a span of the item's width that passes; spans are tried from every token."""
    out = set()
    for i, text in texts.items():
        tokens = decontamination._of_text(text).tolist()
        for j, raw in items.items():
            item = decontamination.Item(j, raw)
            n = len(item.tokens)
            if len(set(tokens) & item.words) < 0.5 * len(item.words):
                continue
            for lo in range(len(tokens)):
                span = tokens[lo : lo + item.width]
                common = subsequence(item.tokens, span)
                if common >= 0.8 * n or common >= 0.6 * n and subsequence(item.answer, span) >= 0.8 * len(item.answer):
                    out.add((i, j))
                    break
    return out


def subsequence(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = best[:]
        for k, y in enumerate(b):
            best[k + 1] = before[k] + 1 if x == y else max(before[k + 1], best[k])
    return best[-1]


def planted(items, draw):
    """Items word for word and in other words, alone and beside the same words in another order."""
    texts, k = {}, 0
    for j, raw in items.items():
        body, _, answer = raw.rpartition(". ")
        changed = [w if draw.random_sample() > 0.3 else f"other{n}" for n, w in enumerate(body.split())]
        changed = " ".join([*changed, answer])
        mixed = " ".join(draw.permutation(raw.split()))
        for text in (raw, changed, f"{mixed} {changed}", f"{changed} {mixed}", f"{mixed} {changed} {mixed}", mixed):
            texts[k] = f"{prose(k, 40)} {text} {prose(k + 9000, 40)}"
            k += 1
    return texts


@pytest.mark.parametrize("latent", [True, False])
def test_every_leak_by_the_rule_is_found(latent):
    draw = np.random.RandomState(3)
    items = {j: f"{prose(500 + j, 22)} q{j}. {prose(700 + j, 4)} a{j}." for j in range(8)}
    texts = planted(items, draw)
    expected = leaks_brute(texts, items)
    assert len(expected) > 4 * len(items)
    bench = decontamination.Benchmark(sorted(items.items()))
    bench.weigh(np.arange(len(bench.vocabulary)) % 7 + 1, 1000)
    size = len(bench.vocabulary)
    bench.direct(np.eye(size) if latent else np.zeros((size, 1)))  # close to its own words, or to nothing
    column = pa.array([texts[k] for k in sorted(texts)])
    got = {(row, item.item_id) for row, item, *_ in decontamination._found(bench, column)}
    assert got == expected


def test_common_subsequence():
    def table_of(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    draw = np.random.RandomState(0)
    for _ in range(200):
        a, b = draw.randint(0, 6, draw.randint(1, 30)).tolist(), draw.randint(0, 6, draw.randint(0, 40)).tolist()
        assert decontamination.common_subsequence(decontamination._masks(a), len(a), b) == table_of(a, b)


def test_main_text_of_pages(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in extraction.op4_html(spark, SF).collect():
        inside = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
        assert (r.text, r.n_chars) == (text, len(text))


def test_the_distribution_alone_finds_every_article():
    pages = marked_pages()
    for page, text in pages:
        assert extraction.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == text


def marked_pages():
    out = []
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        inside = re.search("<article>(.*)</article>", page, re.S)[1]
        out.append((page, " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())))
    return out


LONG = "many words of a long article. " * 12


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{LONG}</p></div><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul>"
         "<article class=card>a teaser of some other thing</article>", LONG),
        (f"<h2><a href=x>A linked heading</a></h2><p>{LONG}</p>", f"A linked heading {LONG}"),
        (f"<p>{LONG}</p><p><a href=1>one</a><p><a href=2>two</a><p><a href=3>three</a><p>{'closing words ' * 5}", f"{LONG} {'closing words ' * 5}"),
        (f"<p>{LONG}</p><div class=responses><p>{'nice ' * 60}</div>", LONG),
        (f"<p>{LONG}</p><section id=discussion><p>{'nice ' * 60}</section>", LONG),
        ("<p>x</p>", "x"), ("x", "x"), ("<a href=x>only</a>", "only"), ("<a href=x>", ""), ("", ""), (None, ""),
        (f"<article><p>{LONG}<p><a href=x>all linked</a></article><p>{'outside it ' * 9}", f"{LONG} all linked"),
    ],
)
def test_awkward_pages(page, want):
    got = extraction.main_text(page)
    links = [x for x in ("one", "two", "three", "a", "b", "c") if f">{x}</a>" in (page or "")]
    assert " ".join(w for w in got.split() if w not in links or w in want.split()) == " ".join(want.split())


@pytest.mark.parametrize("tag", ["<nav>", "<div class=widget>", '<a b="', "<div>x", "<script>", "<!--", "<article>", "</div>", "<p class='x"])
def test_time_is_linear_in_hostile_pages(tag):
    began = time.perf_counter()
    extraction.main_text(tag * 8000)
    assert time.perf_counter() - began < 2


def test_main_text_of_other_markup(spark):
    body = "<p>" + "many words here " * 12 + "</p><p>few</p><p>" + "and more of them " * 12 + "</p>"
    page = (
        "<html><body><header><h1>Site</h1></header><ul class=menu><li><a href=x>Home</a></ul>"
        f"<div id=content>{body}</div><div class='comments'><p>{'nice ' * 40}</p></div>"
        f"<form>{'name ' * 40}</form><footer>end</footer><script>if (a < b) {{}}</script>"
    )
    text = " ".join(re.sub("<[^>]*>", " ", body).split())
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>x</p>"), (1, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in extraction.extract(pages).collect()]
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (None, "x", 1), (1, text, len(text))]
    assert extraction.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single comments-closed"><div>{}</div></body>',
        '<article class="post comments-open">{}</article>',
        '<article class="post"><h2><a href=x>{}</a></h2><p>text</p></article>',
        *(f'<div class="{c}">{{}}</div>' for c in ("content has-sidebar", "no-sidebar", "content-with-nav", "search-results")),
        '<div class="widget">{}</div><div class="sidebar">other words</div>',
        '<div class="widget"><main>{}</main></div><p>' + "not the article " * 20 + "</p>",
    ],
)
@pytest.mark.parametrize("text", ["a short article", "many words of a long article " * 9])
def test_articles_in_wrappers_with_telling_names_and_short_ones_stay(page, text):
    want = text.strip() + " text" * ("<h2>" in page)
    assert extraction.main_text("<html>" + page.format(text)) == want


def test_comments_and_boxes_go():
    article = "many words of a long article " * 9
    for name in ("comments", "comments-area", "site-footer", "related-posts", "cookie-banner", "widget_area", "nav"):
        assert extraction.main_text(f'<p>{article}<div class="x {name}"><p>{"no " * 60}</div>') == article.strip()
    assert extraction.main_text(f'<article>{article}</article><article class="comment">no</article>') == article.strip()


@pytest.mark.parametrize("name", queries.all_oracles())
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.all_queries()[name](spark, SF)
    want = db.execute(queries.all_oracles()[name]).df()[got.columns].itertuples(index=False)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        str(tuple(None if x != x else x for x in row)) for row in (tuple(w) for w in want)
    ) or sorted(map(tuple, got.collect())) == sorted(tuple(w) for w in want)


def test_shards_of_awkward_rows(spark):
    got = sharding.shard(awkward(spark), sharding.tree()).collect()
    assert len(got) == awkward(spark).count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(empty(spark), sharding.tree()).collect() == []


def test_shards_move_only_where_weights_change(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = sharding.tree()
    rows = sharding.assign(rows, "doc_id", before, "a")
    rows = settle(sharding.assign(rows, "doc_id", sharding.grow(before), "b"))
    moved = rows.where("a != b")
    assert {r.b for r in moved.select("b").distinct().collect()} == {24}
    assert 0.02 < moved.count() / 20_000 < 0.06
    counts = [r["count"] for r in rows.groupBy("a").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.25 * 20_000 / 24
    # Weights that change inside a rack, its sum unchanged, move rows only inside it.
    shifted = [sharding.Leaf(x.region, x.rack, x.shard, {0: 0.5, 1: 1.5}.get(x.shard, 1.0)) for x in before]
    moved = sharding.assign(rows, "doc_id", shifted, "c").where("a != c").select("a", "c").distinct()
    assert {(r.a, r.c) for r in moved.collect()} == {(0, 1)}


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.take(docs.select("doc_id", "source", mixing.n_words().alias("size"))).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    targets = {r.source_size: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for s, t in targets.items())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).collect() == []


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, "b").otherwise("c").alias("source"),
        F.lit("four words are here").alias("text"),
    )
    got = mixing.mix(docs).groupBy("source").count().collect()
    light = mixing.take(docs.select("doc_id", "source", mixing.n_words().alias("size")))
    want = {r.source: r.target / 4 for r in light.join(docs, "doc_id").select("source", "target").distinct().collect()}
    for r in got:
        assert r["count"] == pytest.approx(want[r.source], rel=0.03)


@pytest.mark.parametrize("languages", [["de", "en"], ["de", "en", "es", "fr"]])
def test_texts_of_unlearnt_languages_go_and_short_ones_stay(spark, languages):
    docs = table(spark, SF, "documents").where(F.col("lang").isin(languages)).select("doc_id", "text", "lang")
    strange = ["Это предложение на русском языке и оно не выучено", "这是一个没有学过的句子", "これは日本語の文です"]
    planted = [(-1 - k, x, None) for k, x in enumerate([*strange, "the", "der und"])]
    kept = corpus_pipeline.identify(spark, docs.union(spark.createDataFrame(planted, docs.schema)), SF)
    assert {r.doc_id for r in kept.where("doc_id < 0").collect()} == {-4, -5}


CLASHES = ["score", "lang_pred", "__id", "__rate", "__copies", "__text", "node", "comp", "class_id", "shard", "size", "n_words"]


def test_every_stage_keeps_columns_of_any_name(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = settle(stage(spark, docs, SF))
        assert kept.schema == docs.schema and kept.count() > 0
        for row in kept.collect():
            assert [row[c] for c in CLASHES] == [f"{c} of {row.doc_id}" for c in CLASHES]
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_every_stage_takes_awkward_rows_and_none(spark):
    shared = " ".join(["the", "and", "of", "to", "in", "river", "runs", "through", "old", "town"] * 4)
    more = [(k, shared, "en", None, None) for k in (60, 61, 61, 62)] + [(None, shared + " again", "en", "a", 1)]
    for docs in (awkward(spark).union(spark.createDataFrame(more, awkward(spark).schema)), empty(spark)):
        counts = [docs.count()]
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, SF))
            counts.append(docs.count())
        assert counts[0] == 0 and not any(counts) or counts[1] > counts[2] > 0 and counts[-1] == counts[-2]


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = settle(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        before, after = [r.doc_id for r in docs.collect()], [r.doc_id for r in kept.collect()]
        if name.startswith("language"):
            assert set(before) - set(after) <= {i for i in texts if not re.search(r"\w", texts[i] or "")}
        elif name.startswith("MinHash"):
            classes = classes_brute({i: texts[i] for i in before})
            assert sorted(after) == sorted(set(classes.values()))
        elif name.startswith("benchmark"):
            gone = {r.doc_id for r in decontamination.leaks(docs, table(spark, SF, "benchmark")).collect()}
            assert gone and set(after) == set(before) - gone
        elif name.startswith("mixing"):
            assert max(Counter(after).values()) <= 3 and set(after) <= set(before)
        else:
            assert sorted(after) == sorted(before)
        docs = kept
