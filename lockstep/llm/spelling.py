"""Spelling variants: words one edit apart, found through pivotal bigrams.

Every word has its bigrams in one global order, rare ones first. Its prefix is the EDITS * 2 + 1 first of
them, with all others that equal the last. Dynamic programming picks two pivots among them that
share no letter and are rare together. One edit leaves one pivot whole: if it lies before the later
pivot, that one and all behind it stay as they are, else the earlier pivot and all before it. So if
two words are near, the one whose prefix ends first in the order has a pivot that is in the other's
prefix, at the same place from the front or from the back, with the same letters on that side. On the
other side, one of the two halves is the same too. Pivots are joined with prefixes on just that, and
what meets is verified.

Bigrams are ordered by how many share one of 65,536 hashes of them, so what is broadcast has a
fixed size for any alphabet.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import as_key, settle, table

# Fixed values of the task: what a run of letters is, and which runs lose a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
# A form has to come at least so many times as often as its variant.
RATIO = 2
PREFIX = 3
GRAM_SLOTS = 1 << 16


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of docs (doc_id, text) that are long and frequent enough, settled.

    A word is a maximal run of letters with A-Z in lower case; where SLIP divides the crc32 of
    '<doc_id>:<run>', the code point at crc32 % length is missing. A null text has no words, a null
    doc_id is written 'null', repeated rows count each, other columns are ignored, no rows give no words.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(as_key(F.col("doc_id")).alias("id"), lowered.alias("text")).select(
        "id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    )
    drawn = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    found = drawn.select(word.alias("word")).where(F.length("word") >= least_length)
    return settle(found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def _slot(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % GRAM_SLOTS


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of all words fall into each slot."""

    def partial(batches):
        for batch in batches:
            counts = np.zeros(GRAM_SLOTS, np.int64)
            for word in batch.column(0).to_pylist():
                for k in range(len(word) - 1):
                    counts[_slot(word[k : k + 2])] += 1
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])

    merged = words.select("word").mapInArrow(partial, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(GRAM_SLOTS, np.int64)
    found = merged.toArrow()  # GRAM_SLOTS rows at most
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def pivots(word: str, weight) -> tuple[tuple[int, int], list[int], int]:
    """Places of a word's two pivots and of its prefix, and the rank of the prefix's last bigram.

    weight: of a slot of bigrams; bigrams of one slot have one rank.
    """
    slots = [_slot(word[k : k + 2]) for k in range(len(word) - 1)]
    ranks = [int(weight[s]) * GRAM_SLOTS + s for s in slots]
    last = sorted(ranks)[PREFIX - 1]
    prefix = [k for k, r in enumerate(ranks) if r <= last]
    best: tuple | None = None  # lightest pair that ends so far
    single: tuple | None = None  # lightest place that shares no letter with the current one
    waiting = 0
    for k in prefix:
        while prefix[waiting] <= k - 2:
            one = (ranks[prefix[waiting]] // GRAM_SLOTS, -prefix[waiting])
            single = min(single, one) if single else one
            waiting += 1
        if single:
            pair = (single[0] + ranks[k] // GRAM_SLOTS, -single[1], k)
            best = min(best, pair) if best else pair
    return (best[1], best[2]), prefix, last


def _indexed(word: str, places: list[int]) -> list[str]:
    """Where a word is found: by each bigram of its prefix with all on one side of it and half of the other."""
    n, out = len(word), []
    for k in places:
        half = k + 2 + (n - k - 1) // 2
        out += [f"{n},{k}<{word[:half]}", f"{n},{k}[{word[: k + 2]},{word[half:]}"]
        half = (k + 1) // 2
        out += [f"{n},{k}>{word[half:]}", f"{n},{k}]{word[:half]},{word[k:]}"]
    return out


def _sought(word: str, left: int, right: int) -> list[str]:
    """Where near words of each length would be indexed, by the two pivots of a word."""
    size, out = len(word), []
    for n in (size - 1, size, size + 1):
        half = left + 2 + (n - left - 1) // 2
        out += [f"{n},{left}<{word[:half]}", f"{n},{left}[{word[: left + 2]},{word[half + size - n :]}"]
        k = right + n - size
        half = (k + 1) // 2
        out += [f"{n},{k}>{word[half + size - n :]}", f"{n},{k}]{word[:half]},{word[right:]}"]
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """word, other, n, other_n: every pair of words one edit apart, once in each direction.

    words: word, n; distinct words of at least four code points. No words give no pairs.
    """
    counts = words.sparkSession.sparkContext.broadcast(_gram_counts(words))

    def index(as_pivot: bool) -> DataFrame:
        def rows(batches):
            weights = counts.value
            for batch in batches:
                keys, of, last = [], [], []
                for row, word in enumerate(batch.column(0).to_pylist()):
                    places, prefix, rank = pivots(word, weights)
                    found = _sought(word, *places) if as_pivot else _indexed(word, prefix)
                    keys += found
                    of += [row] * len(found)
                    last += [rank] * len(found)
                row = pa.array(of, pa.int64())
                yield pa.record_batch(
                    [pa.array(keys, pa.string()), *(c.take(row) for c in batch.columns), pa.array(last, pa.int64())],
                    ["key", "word", "n", "last"],
                )

        found = words.select("word", "n").mapInArrow(rows, "key string, word string, n long, last long")
        return found.withColumn("key", F.xxhash64("key"))

    a, b = index(True).alias("a"), index(False).alias("b")
    ahead = (F.col("a.last") < F.col("b.last")) | (
        (F.col("a.last") == F.col("b.last")) & (F.col("a.word") < F.col("b.word"))
    )
    near = F.levenshtein("a.word", "b.word", 1) == 1
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & ahead & near)
    found = found.select("a.word", F.col("b.word").alias("other"), "a.n", F.col("b.n").alias("other_n")).distinct()
    names = ["word", "other", "n", "other_n"]
    turned = ["other", "word", "other_n", "n"]
    both = [F.struct(*[F.col(c).alias(x) for x, c in zip(names, of, strict=True)]) for of in (names, turned)]
    return found.select(F.inline(F.array(*both)))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form; each round doubles how far it looks."""
    reached = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        further = settle(
            reached.join(ahead, reached["root"] == ahead["via"], "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.isnotnull("beyond").alias("moved")
            )
        )
        if further.where("moved").isEmpty():
            return reached
        reached = further.drop("moved")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words (word, n).

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is its near word of
    the largest n (of equal ones the least), if that is at least `ratio` times its own n, else null; root is
    where its forms lead, the word itself without one. The ratio is over 1, so forms never go in a circle. words
    has each word once, of at least four code points; other columns are ignored; no words give no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio has to be over 1")
    words = words.select("word", "n")
    best = (
        near_pairs(words)
        .groupBy("word")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"),
        )
        .select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))
    )
    found = settle(words.join(best, "word", "left"))
    enough = F.col("form_n") >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"),
    )
    return found.join(_roots(found.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return group(count_words(table(spark, sf_dir, "documents")))
