"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its words, A-Z lower-cased, with a space between and an end mark after the last. All runs of
ORDER + 1 bytes are counted, how often in training texts and in all. A context, the last k bytes, becomes a state
if it came LEAST_COUNT times in training and what follows it diverges from what follows the context one byte
shorter by DIVERGENCE nats; its own suffixes come with it, and contexts of up to SHORT bytes need the count
alone. A state's next-byte distribution is smoothed with that of the next shorter state, by SMOOTH
pseudo-counts for each byte seen to follow, down to a uniform one over 256 bytes. A byte is
scored by the longest state that is a suffix of what came before.

No count or share is tied to the size of the corpus, so the tree grows with it. It is never in one
place: runs are dealt by their last SHORT + 1 context bytes, so all longer states with these bytes are in one
task, which grows that part of the tree and scores the runs that ended there. Only counts after contexts of up
to SHORT bytes, 2 ** 24 at most, go to every task. Of the scored runs the most frequent, HOT_GRAMS at most, are
broadcast, texts meet all others by a join; and so it is with the counts of words for the base score.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import held_out, least_count, partitions, table
from lockstep.llm.rolling import Roll, changes, slices, words
from lockstep.scratch import new_dir

ORDER, SHORT = 6, 2
LEAST_COUNT = 2
# Times 2 this is a likelihood ratio; nats.
DIVERGENCE = 1.0
SMOOTH = 5.0
ALPHABET = 256
# Most rows of a broadcast table; runs that a task of the tree holds.
HOT_GRAMS, HOT_WORDS = 1 << 21, 1 << 20
TASK_GRAMS = 2_000_000
END, SPACE = 0x0A, 0x20
# Distinct keys a task holds before it sends them.
HELD_KEYS = 2_000_000
CACHE_BITS = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _roll() -> Roll:
    return Roll(21)


# --- what a batch holds ----------------------------------------------------------------


def _symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, ORDER zeros and an end mark before each; and where each begins."""
    starts, ends, first = words(data, bounds)
    n_docs, n_words = len(bounds) - 1, np.diff(first)
    lengths = ends - starts
    before = np.concatenate([[0], np.cumsum(lengths)])
    # Before the first symbol of a word: all earlier bytes, one separator per earlier word, the lead
    # of each text up to here and the end marks of texts without words.
    of = np.repeat(np.arange(n_docs), n_words)
    empty = np.cumsum(n_words == 0)
    lead = ORDER + 1
    at = before[:-1] + np.arange(len(starts)) + lead * (of + 1) + empty[of]
    total = before[-1] + len(starts) + lead * n_docs + (empty[-1] if n_docs else 0)
    out = np.zeros(total, np.uint8)
    bytes_at = np.repeat(at - before[:-1], lengths) + np.arange(before[-1])
    out[bytes_at] = _LOWER[data[np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])]]
    out[at + lengths] = SPACE
    sizes = before[first[1:]] - before[first[:-1]] + np.maximum(n_words, 1) + lead
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out[begins[1:] - 1] = END
    out[begins[:-1] + ORDER] = END
    return out, begins


def _grams(out: np.ndarray) -> np.ndarray:
    """The symbol at each place and the ORDER before it, the symbol in the low byte."""
    keys = np.zeros(len(out), np.uint64)
    for k in range(ORDER + 1):
        keys[k:] |= out[: len(out) - k].astype(np.uint64) << np.uint64(8 * k)
    return keys


def _scored(begins: np.ndarray, n: int) -> np.ndarray:
    """Places that hold a symbol to predict: all but the lead of each text."""
    keep = np.ones(n, bool)
    for k in range(ORDER + 1):
        keep[begins[:-1] + k] = False
    return keep


def _word_hashes(data, bounds):
    starts, ends, first = words(data, bounds)
    return _roll().spans(_roll().of_bytes(_LOWER[data]), starts, ends), first


END_KEY = int(np.uint64(0x9E3779B97F4A7C15).view(np.int64))


def _summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _counted(keys_of):
    """A mapInArrow function: key, n of all keys in a partition, summed before they are sent."""

    def run(batches):
        pairs, held = [], 0
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(0)):
                keys = np.sort(keys_of(data, bounds))
                new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys[:0].astype(int)
                pairs.append((keys[new], np.diff(np.append(new, len(keys)))))
                held += len(new)
                if held >= HELD_KEYS:
                    pairs = [_summed(pairs)]
                    held = len(pairs[0][0])
                    if held >= HELD_KEYS // 2:
                        yield _counts(*pairs[0])
                        pairs, held = [], 0
        if pairs:
            yield _counts(*_summed(pairs))

    return run


def _counts(keys, n) -> pa.RecordBatch:
    return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _text_words(data, bounds):
    hashes, _ = _word_hashes(data, bounds)
    return np.concatenate([hashes, np.full(len(bounds) - 1, END_KEY, np.int64).view(np.uint64)])


# --- the tree --------------------------------------------------------------------------


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << (8 * symbols)) - 1)


def _gram_counts(batches):
    """A mapInArrow function over held_out, text: code and n of all runs, the code's low bit telling whether the
    text is for training."""
    pairs, held = [], 0
    for batch in batches:
        training = ~np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
        for lo, hi, data, bounds in slices(batch.column(1)):
            out, begins = _symbols(data, bounds)
            keep = _scored(begins, len(out))
            learn = np.repeat(training[lo:hi], np.diff(begins))[keep]
            codes = np.sort((_grams(out)[keep] << np.uint64(1)) | learn.astype(np.uint64))
            new = changes(codes)
            pairs.append((codes[new], np.diff(np.append(new, len(codes)))))
            held += len(new)
            if held >= HELD_KEYS:
                pairs = [_summed(pairs)]
                held = len(pairs[0][0])
                if held >= HELD_KEYS // 2:
                    yield _counts(*pairs[0])
                    pairs, held = [], 0
    if pairs:
        yield _counts(*_summed(pairs))


class Short:
    """The states of up to SHORT bytes, from the training counts of the runs one byte longer."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.levels = []
        for k in range(SHORT + 1):
            level = keys[order] & _mask(k + 1)
            found, where = np.unique(level, return_inverse=True)
            self.levels.append(_Level(found, np.bincount(where, n[order], len(found))))

    def probability(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each run's last byte, by the longest of these states; and whether that is one of SHORT bytes."""
        p, alive = np.full(len(grams), 1.0 / ALPHABET), np.ones(len(grams), bool)
        for k, level in enumerate(self.levels):
            n, group = level.find(grams & _mask(k + 1))
            alive &= (group >= 0) & (level.total[group] >= (LEAST_COUNT if k else 1))
            p = np.where(alive, level.smoothed(n, group, p), p)
        return p, alive


class _Level:
    """Runs of one length with their training counts, grouped by context. keys: sorted."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.first = changes(keys >> np.uint64(8))
        self.contexts = keys[self.first] >> np.uint64(8)
        self.group = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(keys))))
        self.total = np.append(self.sums(n), 0)
        self.followers = np.append(self.sums((n > 0).astype(float)), 0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of some runs of this length, and the number of each one's context, -1 for none."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        context = keys >> np.uint64(8)
        group = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0.0), np.where(self.contexts[group] == context, group, -1)

    def smoothed(self, n: np.ndarray, group: np.ndarray, p: np.ndarray) -> np.ndarray:
        more = SMOOTH * self.followers[group]
        return (n + more * p) / np.maximum(self.total[group] + more, 1e-300)


def probabilities(keys: np.ndarray, n: np.ndarray, short: Short) -> np.ndarray:
    """Of the last byte of each run after those before it, by the longest state.

    keys, n: distinct runs and their training counts; with a run come all others with its last SHORT + 1
    context bytes that were counted.
    """
    p, alive = short.probability(keys)
    levels, places, kept = [short.levels[SHORT]], [], []
    for k in range(SHORT + 1, ORDER + 1):
        found, where = np.unique(keys & _mask(k + 1), return_inverse=True)
        level = _Level(found, np.bincount(where, n, len(found)))
        shorter, group = levels[-1].find(found & _mask(k))
        seen = level.n > 0
        ratio = np.ones(len(found))
        own, below = level.total[level.group], levels[-1].total[group]
        ratio[seen] = level.n[seen] / own[seen] / (shorter[seen] / below[seen])
        nats = level.sums(level.n * np.log(ratio))
        kept.append((level.total[:-1] >= LEAST_COUNT) & (nats >= DIVERGENCE))
        levels.append(level)
        places.append(where)
    for k in range(len(kept) - 1, 0, -1):  # a state's suffixes are states
        suffixes = levels[k + 1].contexts[kept[k]] & _mask(SHORT + k)
        kept[k - 1][np.searchsorted(levels[k].contexts, suffixes)] = True
    for level, where, state in zip(levels[1:], places, kept, strict=True):
        group = level.group[where]
        alive &= state[group]
        p = np.where(alive, level.smoothed(level.n[where], group, p), p)
    return p


GRAMS = "key long, n long, n_all long"


def count_grams(docs: DataFrame) -> DataFrame:
    """key, n (in training texts), n_all of every run of ORDER + 1 bytes of docs (held_out, text), written to the
    shared folder."""
    codes = docs.select("held_out", "text").mapInArrow(_gram_counts, "key long, n long")
    summed = codes.groupBy(F.shiftrightunsigned("key", 1).alias("key")).agg(
        F.sum(F.when(F.col("key").bitwiseAND(F.lit(1).cast("bigint")) == 1, F.col("n")).otherwise(0)).alias("n"),
        F.sum("n").alias("n_all"),
    )
    return _written(summed, GRAMS, "grams")


def _written(df: DataFrame, schema: str, label: str) -> DataFrame:
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def short_states(grams: DataFrame) -> Short:
    """From the counts after contexts of SHORT bytes: 256 ** (SHORT + 1) rows at most."""
    after = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(int(_mask(SHORT + 1)))).alias("key"))
    found = after.agg(F.sum("n").alias("n")).toArrow()
    return Short(found["key"].to_numpy().view(np.uint64), found["n"].to_numpy())


def gram_scores(grams: DataFrame) -> DataFrame:
    """key, n_all and log10 of the last byte's probability for every run, written to the shared folder."""
    spark = grams.sparkSession
    short = spark.sparkContext.broadcast(short_states(grams))
    tasks = max(partitions(spark), -(-grams.count() // TASK_GRAMS))
    context = F.shiftright("key", 8).bitwiseAND(F.lit(int(_mask(SHORT + 1))))

    def run(batches):
        parts = list(batches)
        if parts:
            rows = pa.Table.from_batches(parts)
            keys = rows["key"].to_numpy().view(np.uint64)
            value = np.log10(probabilities(keys, rows["n"].to_numpy().astype(float), short.value))
            for batch in pa.table([rows["key"], rows["n_all"], pa.array(value)], ["key", "n_all", "value"]).to_batches(10_000):
                yield batch

    schema = "key long, n_all long, value double"
    dealt = grams.repartition(tasks, context.alias("context"))
    return _written(dealt.mapInArrow(run, schema), schema, "states")


# --- scores ----------------------------------------------------------------------------


class _Hot:
    """A broadcast table of keys and values, with what was asked for last; NaN for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(float)

    def __getstate__(self):
        return {"keys": self.keys, "values": self.values}

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not hasattr(self, "slots"):
            self.slots, self.held = np.zeros(1 << CACHE_BITS, np.uint64), np.full(1 << CACHE_BITS, np.nan)
            self.slots[0] = ~np.uint64(0)
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.held[slot]
        miss = np.flatnonzero(self.slots[slot] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, new), max(len(self.keys) - 1, 0))
            value = np.where(self.keys[at] == new, self.values[at], np.nan) if len(self.keys) else np.full(len(new), np.nan)
            out[miss] = value[back]
            at = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.slots[at], self.held[at] = new, value
        return out


def _hot(counts: DataFrame, n: str, value: str, most: int):
    """The most frequent keys with their values, broadcast."""
    found = counts.where(F.col(n) >= least_count(counts, n, most)).select("key", value).toArrow()
    return counts.sparkSession.sparkContext.broadcast(
        _Hot(found["key"].to_numpy().view(np.uint64), found[value].to_numpy())
    )


def _lists(keys: np.ndarray, of: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """The distinct keys of each row and how often each comes; of: the row of each key, ascending."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = changes(of, keys)
    ends = pa.array(np.searchsorted(of[new], np.arange(rows + 1)).astype(np.int32))
    n = np.diff(np.append(new, len(of))).astype(np.int32)
    return (
        pa.ListArray.from_arrays(ends, pa.array(keys[new].view(np.int64))),
        pa.ListArray.from_arrays(ends, pa.array(n)),
    )


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs with its base score and the tree's log10 probability.

    docs: doc_id, text, held_out (boolean); other columns are ignored. Learnt from rows that are not held
    out. A null text is empty: its only token is the end. Repeated rows are scored alike, and
    each counts in training. Without training rows every byte has probability 1/256 and every token is
    unknown. No rows give no rows. Words are told apart by a 64-bit hash.
    """
    rows = docs.select("doc_id", "held_out", "text")
    training = rows.where(~F.col("held_out")).select("text")
    states = gram_scores(count_grams(rows))
    words_ = training.mapInArrow(_counted(_text_words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = _written(words_, "key long, n long", "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot_grams, hot_words = _hot(states, "n_all", "value", HOT_GRAMS), _hot(counts, "n", "n", HOT_WORDS)

    def scored(batches):
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(2)):
                out, begins = _symbols(data, bounds)
                keep = _scored(begins, len(out))
                grams = _grams(out)[keep]
                sizes = np.diff(begins) - ORDER - 1
                of = np.repeat(np.arange(hi - lo), sizes)
                value = hot_grams.value.find(grams)
                cold = np.isnan(value)
                hashes, first = _word_hashes(data, bounds)
                n = hot_words.value.find(hashes)
                rare = np.isnan(n)
                of_word = np.repeat(np.arange(hi - lo), np.diff(first))
                yield pa.record_batch(
                    [
                        *(c.slice(lo, hi - lo) for c in batch.columns[:2]),
                        pa.array(np.diff(first) + 1),
                        pa.array(np.bincount(of_word[~rare], minlength=hi - lo)),
                        pa.array(np.bincount(of_word, np.log10(np.where(rare, 0.0, n) + 1.0), hi - lo)),
                        pa.array(np.bincount(of, np.where(cold, 0.0, value), hi - lo)),
                        *_lists(hashes[rare], of_word[rare], hi - lo), *_lists(grams[cold], of[cold], hi - lo),
                    ],
                    SCORED_NAMES,
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, held_out boolean, n_tokens long, known long, logs double, value double, "
        "rare array<long>, rare_n array<int>, cold array<long>, cold_n array<int>"
    )
    found = rows.mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id())
    found = _written(found, f"{schema}, row long", "scored")

    def met(keys: str, n: str, with_: DataFrame, *sums) -> DataFrame:
        each = found.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(n).alias("n_of"))).alias("e"))
        return each.select("row", "e.key", "e.n_of").join(with_, "key").groupBy("row").agg(*sums)

    rare = met(
        "rare", "rare_n", counts,
        F.sum("n_of").alias("more_known"), F.sum(F.col("n_of") * F.log10(F.col("n") + 1)).alias("more_logs"),
    )
    cold = met("cold", "cold_n", states.select("key", F.col("value").alias("log")), F.sum(F.col("n_of") * F.col("log")).alias("more"))
    end = counts.where(F.col("key") == END_KEY).select("n").first()
    end_log = float(np.log10((end[0] if end else 0) + 1.0))
    thin = found.drop("rare", "rare_n", "cold", "cold_n")
    return thin.join(rare, "row", "left").join(cold, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + (1 if end else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end_log)
         - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"),
        (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


SCORED_NAMES = ["doc_id", "held_out", "n_tokens", "known", "logs", "value", "rare", "rare_n", "cold", "cold_n"]


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out")))
