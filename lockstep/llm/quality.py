"""Quality by weak supervision: rules vote or abstain, and their reliability is estimated.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or not at all (0). Votes are
independent given a hidden class. Expectation-maximisation over the counts of vote patterns (at
most 3 to the number of rules rows, however many texts) estimates how often each rule votes what for either
class, and the posterior probability of the good class decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import BLANKS, settle, table

SPAN = 8
SYMBOLS = r"#*$%&|<>"
MIN_WORDS = 20
REPEAT_PERCENT = 30

# Name: a count and what it is a share of, bounds inside which a rule votes good, and beyond
# which it votes bad.
RULES: dict[str, tuple[str, str, tuple[float, float], tuple[float, float]]] = {
    "symbols": ("n_symbols", "n_words", (0, 0.02), (0, 0.1)),
    "capitals": ("n_upper", "n_alnum", (0, 0.12), (0, 0.3)),
    "exclaiming": ("n_bangs", "n_words", (0, 0.05), (0, 0.2)),
    "repeated_spans": ("n_repeat_words", "n_words", (0, 0.02), (0, 0.35)),
    "stuttering": ("n_stutters", "n_words", (0, 0.05), (0, 0.15)),
    "word_length": ("word_chars", "n_words", (3.5, 6.5), (2.5, 9.0)),
    "alphanumerics": ("n_alnum", "word_chars", (0.9, 1.0), (0.7, 1.0)),
    "repeated_lines": ("n_dup_lines", "n_lines", (0, 0.02), (0, 0.4)),
    "sentence_ends": ("n_ended", "n_lines", (0.8, 1.0), (0.3, 1.0)),
}
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_alnum", "n_bangs", "n_stutters", "n_lines", "n_ended",
]

PRIOR_GOOD = 0.8
# Votes assumed before any is seen, so that no probability is 0 or 1.
PSEUDO = 1.0
MAX_ROUNDS, TOLERANCE = 40, 1e-4


def _only(pattern: str) -> Column:
    """Characters of a class in the text."""
    return F.length(F.regexp_replace("text", f"[^{pattern}]+", ""))


def _next(column: str) -> Column:
    return F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs' rows (doc_id, text) with the counts that the rules look at; a null text is empty.

    All are expressions over one row; no row needs another. Spans of words are compared by a 64-bit hash,
    and sorted only where a text repeats one.
    """
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = F.sequence(F.lit(1), F.size("words") - (SPAN - 1))
    hashes = F.transform(spans, lambda i: F.xxhash64(F.slice(F.col("words"), i, SPAN)))
    none = F.array().cast("array<bigint>")
    rows = (
        body.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("spans", F.when(F.size("words") >= SPAN, hashes).otherwise(none))
        .select(
            "doc_id",
            "spans",
            F.size("words").alias("n_words"),
            F.length(F.array_join("words", "")).alias("word_chars"),
            _only(SYMBOLS).alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
            (F.size(F.array_distinct("spans")) < F.size("spans")).alias("repeats"),
            _only(r"\p{Lu}").alias("n_upper"),
            _only(r"\p{L}\p{N}").alias("n_alnum"),
            _only("!").alias("n_bangs"),
            F.size(
                F.filter(F.zip_with("words", _next("words"), lambda a, b: a == b), lambda x: x)
            ).alias("n_stutters"),
            F.size("lines").alias("n_lines"),
            F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).alias("n_ended"),
        )
    )
    return rows.withColumn("n_repeat_words", F.when(F.col("repeats"), _covered()).otherwise(0)).select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in COUNTS]
    )


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs_after(array: Column) -> Column:
    return F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0)))


def _covered() -> Column:
    """Words in spans whose hash comes twice or more: the length of a union of intervals."""

    def places(ordered: Column) -> Column:
        same = F.zip_with(
            ordered, _pairs_after(ordered), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        )

        def marked(eq: Column) -> Column:
            before = F.concat(F.array(F.lit(False)), eq)
            hit = F.zip_with(eq, F.slice(before, 1, F.size(eq)), lambda a, b: a | b)
            found = F.zip_with(ordered, hit, lambda p, h: F.when(h, p["i"]))
            return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

        return _let(same, marked)

    def length(at: Column) -> Column:
        steps = F.zip_with(at, _pairs_after(at), lambda a, b: F.least(F.lit(SPAN), F.coalesce(b - a, F.lit(SPAN))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    numbered = F.transform("spans", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(_let(F.sort_array(numbered), places), length)


def votes(counts: DataFrame) -> DataFrame:
    """counts with a column v_<rule> per rule; a statistic that does not exist abstains."""

    def vote(value: Column, good: tuple, fair: tuple) -> Column:
        return (
            F.when(value.isNull(), 0)
            .when((value < fair[0]) | (value > fair[1]), -1)
            .when(value.between(*good), 1)
            .otherwise(0)
            .cast("tinyint")
        )

    return counts.withColumns(
        {
            f"v_{name}": vote(F.col(part) / F.when(F.col(whole) != 0, F.col(whole)), good, fair)
            for name, (part, whole, good, fair) in RULES.items()
        }
    )


def _log_odds(prior: float, rates: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """rates: for each rule and vote its probabilities in the good and in the bad class."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for rule, by_vote in rates.items():
        ratio = {v: math.log(good / bad) for v, (good, bad) in by_vote.items()}
        vote = F.col(f"v_{rule}")
        odds = odds + F.when(vote == 1, ratio[1]).when(vote == -1, ratio[-1]).otherwise(ratio[0])
    return odds


def _posterior(odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(voted: DataFrame) -> tuple[float, dict]:
    """The share of good texts and each rule's vote probabilities, by expectation-maximisation.

    It starts from texts with a bad vote being doubtful, and ends when no probability moves by more than
    TOLERANCE. Texts count only by their pattern of votes, of which there are 3 ** len(RULES) at most however
    large the corpus: Spark counts these, and the rounds run over their table. No rows give the prior.
    """
    rules = list(RULES)
    counted = voted.groupBy(*[f"v_{r}" for r in rules]).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(row)[:-1], row["n"]) for row in counted)
    good = [(0.95, 0.3, 0.05)[min(votes.count(-1), 2)] for votes, _ in patterns]
    prior, rates = PRIOR_GOOD, None
    for _ in range(MAX_ROUNDS):
        all_good = sum(n * p for (_, n), p in zip(patterns, good, strict=True))
        all_bad = sum(n for _, n in patterns) - all_good
        seen = {(r, v): [PSEUDO, PSEUDO] for r in rules for v in (-1, 0, 1)}
        for (votes, n), p in zip(patterns, good, strict=True):
            for cell in zip(rules, votes, strict=True):
                seen[cell][0] += n * p
                seen[cell][1] += n * (1 - p)
        new = {
            r: {v: (seen[r, v][0] / (all_good + 3 * PSEUDO), seen[r, v][1] / (all_bad + 3 * PSEUDO)) for v in (-1, 0, 1)}
            for r in rules
        }
        prior = (all_good + 8 * PSEUDO) / (all_good + all_bad + 10 * PSEUDO)
        moved = max(
            abs(x - y) for r in rules for v in (-1, 0, 1) for x, y in zip(new[r][v], rates[r][v], strict=True)
        ) if rates else 1.0
        rates, odds = new, math.log(prior / (1 - prior))
        good = []
        for votes, _ in patterns:
            against = odds + sum(math.log(new[r][v][0] / new[r][v][1]) for r, v in zip(rules, votes, strict=True))
            good.append(1 / (1 + math.exp(-max(min(against, 700), -700))))
        if moved < TOLERANCE:
            break
    return prior, rates


def judge(docs: DataFrame) -> DataFrame:
    """Counts, votes, base_failed, p_good and kept for every row of docs (doc_id, text).

    Other columns are ignored. A null or empty text has no words and fails; a text too short for a rule
    gets no vote from it; repeated rows are judged alike; no rows give no rows.
    """
    voted = settle(votes(statistics(docs)))
    odds = _log_odds(*estimate(voted))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("p_good", _posterior(odds))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the weighed rules for every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good",
    )
