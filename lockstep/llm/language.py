"""Language identification: sparse multinomial logistic regression on character n-grams.

Letters are lower-cased, everything between them is one space, and runs of one to three
characters are hashed to FEATURES counters. Counts are damped, weighted by inverse document
frequency over all training texts, and scaled to length one. The weights are learnt by following the
regularised leader (FTRL-proximal, with L1 and L2 penalties) from at most SAMPLE labelled
texts, an equal quota for each language; a temperature fitted on others of them calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockstep.llm.common import held_out, settle, table

GRAMS = 3
FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
# Labelled texts to learn from, per language and in all; one in five calibrates.
PER_LANGUAGE, SAMPLE, CALIBRATE_EVERY = 500, 20_000, 5
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01
LEAST_TEMPERATURE = 0.5
# Values that a text's hash takes in the draw.
DRAWS = 1 << 52
UNKNOWN = "und"
# Texts, and characters of them, whose counters are made at once; a longer text is alone.
BLOCK, BLOCK_CHARS = 256, 500_000


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _blocks(texts: list[str | None]):
    """First and last row and counters of a few texts at a time."""
    lo = size = 0
    for k, text in enumerate(texts):
        if k > lo and (k - lo == BLOCK or size + len(text or "") > BLOCK_CHARS):
            yield lo, k, _counters([(t or "").lower() for t in texts[lo:k]])
            lo, size = k, 0
        size += len(text or "")
    if texts:
        yield lo, len(texts), _counters([(t or "").lower() for t in texts[lo:]])


def _counters(texts: list[str]) -> np.ndarray:
    """How often each hashed n-gram comes in each text; a text without letters has none."""
    n = len(texts)
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    # A space before, between and after the texts; one run of other characters is one space.
    edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[edges] = True
    of = np.cumsum(np.bincount(edges[1:], minlength=len(codes)))[keep]
    codes = np.where(letter, codes, 32).astype(np.uint32)[keep]
    letter = letter[keep]
    counts = np.zeros(n * FEATURES, np.int32)
    hashes = np.zeros(len(codes), np.uint32)
    for k in range(GRAMS):
        hashes = (hashes[: len(codes) - k] * np.uint32(0x01000193)) ^ codes[k:]
        spread = (hashes + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        inside = (of[: len(spread)] == of[k:]) & (of[: len(spread)] < n)
        some = letter[: len(spread)].copy()
        for j in range(1, k + 1):
            some |= letter[j : j + len(spread)]
        inside &= some
        cells = of[: len(spread)][inside] * FEATURES + (spread[inside] >> np.uint32(32 - FEATURE_BITS))
        counts += np.bincount(cells, minlength=n * FEATURES).astype(np.int32)
    return counts.reshape(n, FEATURES)


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features by languages
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = (x @ self.weights + self.bias) / self.temperature
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after EPOCHS passes over (features, values, class)."""
    z = np.zeros((FEATURES + 1, n_classes))
    n = np.zeros_like(z)

    def weights(at):
        zz, root = z[at], np.sqrt(n[at])
        w = -(zz - np.sign(zz) * L1) / ((BETA + root) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    order = np.random.RandomState(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            w = weights(at)
            scores = x @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = weights(np.arange(FEATURES + 1))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    It stays at least LEAST_TEMPERATURE: where no text is mistaken the loss has no minimum.
    """

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean())

    lo, hi, golden = np.log(LEAST_TEMPERATURE), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches):
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for lo, hi, counts in _blocks(batch.column(0).to_pylist()):
            df += (counts > 0).sum(0)
            n += hi - lo
    some = np.flatnonzero(df)
    yield pa.record_batch(
        [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n))], ["feature", "n"]
    )


def _features(batches):
    for batch in batches:
        langs = batch.column(1)
        for lo, hi, counts in _blocks(batch.column(0).to_pylist()):
            at, what = [], []
            for row in counts:
                some = np.flatnonzero(row)
                at.append(some.astype(np.uint16).tobytes())
                what.append(row[some].astype(np.int32).tobytes())
            yield pa.record_batch(
                [langs.slice(lo, hi - lo), pa.array(at, pa.binary()), pa.array(what, pa.binary())],
                ["lang", "at", "counts"],
            )


def _by_language(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def fit(training: DataFrame) -> Model:
    """A model from training's text and non-null lang; without any it knows no language.

    Document frequencies come from all texts; the classifier sees a sample of PER_LANGUAGE different texts per
    language, chosen by hash, or an equal quota of SAMPLE, but one at least; all if a language has fewer.
    """
    rows = training.where(F.col("lang").isNotNull()).select("text", "lang")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(DRAWS)))
    keys = settle(rows.select("lang", "h").distinct())
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(FEATURES, np.float32), np.zeros((FEATURES, 0)), np.zeros(0))
    found = rows.select("text").mapInArrow(_frequencies, "feature int, n long")
    found = {r["feature"]: r["n"] for r in found.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(FEATURES)
    total = found.pop(-1, 0)
    df[list(found)] = list(found.values())
    idf = (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)

    each = max(1, min(PER_LANGUAGE, SAMPLE // len(languages)))
    # So many are drawn that a language misses its quota by six standard deviations only; the least hashes stay.
    drawn = each + 6 * each**0.5 + 10
    few = keys.where(F.col("h") < F.element_at(_by_language({x: drawn / n * DRAWS for x, n in sizes.items()}), F.col("lang")))
    drawn = {}
    for r in few.collect():
        drawn.setdefault(r["lang"], []).append(r["h"])
    last = {lang: float(sorted(hashes)[:each][-1]) for lang, hashes in drawn.items()}
    sample = rows.where(F.col("h") <= F.element_at(_by_language(last), F.col("lang"))).dropDuplicates(["lang", "h"])
    seen = sample.orderBy("lang", "h").select("text", "lang").mapInArrow(
        _features, "lang string, at binary, counts binary"
    ).collect()
    number = {lang: k for k, lang in enumerate(languages)}
    learn, hold = [], []
    for k, r in enumerate(seen):
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        x = np.log1p(np.frombuffer(r["counts"], np.int32)) * idf[at]
        x = x / (np.sqrt((x * x).sum()) or 1.0)
        row = (np.append(at, FEATURES), np.append(x, 1.0), number[r["lang"]])
        (hold if k % CALIBRATE_EVERY == CALIBRATE_EVERY - 1 else learn).append(row)
    weights, bias = _ftrl(learn, len(languages))
    model = Model(languages, idf, weights, bias)
    if hold:
        whole = np.vstack([weights, bias])
        scores = np.array([x @ whole[at] for at, x, _ in hold])
        model.temperature = _temperature(scores, np.array([label for *_, label in hold]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with two more columns, lang_pred and score, from the whole text alone.

    A text that is null or has no letter is `und` with score 0, and so is every text if no language was
    learnt. Ties go to the language that sorts first. Rows are independent: repeated ones agree,
    other columns stay as they are except that ones called lang_pred or score are replaced; no rows
    give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *more])
    where = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for lo, hi, counts in _blocks(batch.column(where).to_pylist()):
                if not m.languages:
                    names += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                p = m.probabilities(_weighed(counts, m.idf)).astype(float)
                some, best = counts.any(1), p.argmax(1)
                names += [m.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                scores += np.where(some, np.clip(p.max(1), 0.0, 1.0), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame) -> Model:
    """The model of documents that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id"), 4)).select("text", "lang"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
