"""Document fingerprints that are sums over paragraphs: a homomorphic multiset hash.

A paragraph is a line with at least one word. Its vector has two parts. LANES lanes modulo 2**64 are a
BLAKE2b digest of its bytes; they tell whether two texts have the same paragraphs. CELLS cells modulo
2**16 hold one count, +1 or -1, at a hashed place for each run of SHINGLE words of the paragraph (all of
a shorter one); the cosine of two such parts estimates how much of two texts is alike, with a standard
error of about 1 / sqrt(CELLS). A document's fingerprint is the sum of its paragraphs' vectors. So the
order of paragraphs does not matter, paragraphs are inserted by adding and deleted by subtracting their
vectors, and the fingerprint of a set of documents is the sum of theirs.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import partitions, table
from lockstep.llm.rolling import SLICE_BYTES, Roll, slices, words

LANES, CELLS, SHINGLE = 8, 256, 3
WIDTH = 8 * LANES + 2 * CELLS
# Groups whose sums a task holds before it sends them on.
HELD_GROUPS = 10_000
# Ranges of documents per shuffle partition, so that hashed ranges spread evenly.
RANGES = 4

_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True


@dataclass
class Vectors:
    """One row per text. exact: uint64, LANES wide; likeness: uint16, CELLS wide."""

    exact: np.ndarray
    likeness: np.ndarray

    def __len__(self) -> int:
        return len(self.exact)

    def __getitem__(self, rows) -> Vectors:
        return Vectors(self.exact[rows], self.likeness[rows])

    def __add__(self, other: Vectors) -> Vectors:
        return Vectors(self.exact + other.exact, self.likeness + other.likeness)

    def __sub__(self, other: Vectors) -> Vectors:
        return Vectors(self.exact - other.exact, self.likeness - other.likeness)

    def sum(self) -> Vectors:
        """The sum over all rows, as one row."""
        cells = self.likeness.sum(0, dtype=np.uint16, keepdims=True)
        return Vectors(self.exact.sum(0, dtype=np.uint64, keepdims=True), cells)

    def encode(self) -> list[str]:
        raw = np.hstack([self.exact.astype("<u8").view(np.uint8), self.likeness.astype("<u2").view(np.uint8)])
        return [base64.b64encode(row).decode("ascii") for row in raw]

    def alike(self, other: Vectors) -> np.ndarray:
        """Cosine of the likeness cells, row by row, from 0 to 1; 1 where fingerprints are equal."""
        a, b = (x.likeness.view(np.int16).astype(np.float64) for x in (self, other))
        norms = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        cosine = np.clip((a * b).sum(1) / np.where(norms > 0, norms, 1.0), 0.0, 1.0)
        same = (self.exact == other.exact).all(1) & (self.likeness == other.likeness).all(1)
        return np.where(same, 1.0, cosine)


def zeros(n: int) -> Vectors:
    return Vectors(np.zeros((n, LANES), np.uint64), np.zeros((n, CELLS), np.uint16))


def joined(parts: list[Vectors]) -> Vectors:
    return Vectors(np.vstack([p.exact for p in parts]), np.vstack([p.likeness for p in parts]))


def decode(texts) -> Vectors:
    """Vectors of encoded fingerprints; null is that of an empty text."""
    empty = bytes(WIDTH)
    raw = b"".join(empty if t is None or t != t else base64.b64decode(t) for t in texts)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    exact, cells = rows[:, : 8 * LANES], rows[:, 8 * LANES :]
    return Vectors(
        np.ascontiguousarray(exact).view("<u8").astype(np.uint64),
        np.ascontiguousarray(cells).view("<u2").astype(np.uint16),
    )


@cache
def _rolls() -> tuple[Roll, Roll]:
    return Roll(131), Roll(132)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows first[i] to first[i + 1], modulo the power that the type holds."""
    total = np.zeros((len(values) + 1, values.shape[1]), values.dtype)
    np.cumsum(values, 0, out=total[1:], dtype=values.dtype)
    return total[first[1:]] - total[first[:-1]]


def _of_slice(data: np.ndarray, bounds: np.ndarray) -> Vectors:
    by_word, by_run = _rolls()
    n = len(bounds) - 1
    starts, ends, _ = words(data, bounds)
    left, right, _ = words(data, bounds, _LINE_END)
    if not len(starts):
        return zeros(n)
    line = np.searchsorted(left, starts, "right") - 1
    full, at = np.unique(line, return_index=True)  # lines with a word, and the first word of each
    left, right = left[full], right[full]
    upto = np.append(at[1:], len(starts))

    raw = data.tobytes()
    digests = b"".join(
        blake2b(raw[a:b], digest_size=8 * LANES).digest() for a, b in zip(left.tolist(), right.tolist(), strict=True)
    )
    exact = np.frombuffer(digests, "<u8").astype(np.uint64).reshape(-1, LANES)

    prefix = by_run.prefix(by_word.spans(by_word.of_bytes(data), starts, ends))
    index = np.arange(len(starts))
    last = np.repeat(upto, upto - at)
    whole = index + SHINGLE <= last
    short = at[upto - at < SHINGLE]
    lo = np.concatenate([index[whole], short])
    hi = np.concatenate([index[whole] + SHINGLE, upto[upto - at < SHINGLE]])
    hashes = by_run.spans(prefix, lo, hi)
    of = np.searchsorted(bounds, starts[lo], "right") - 1
    cell = of * CELLS + (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    sign = np.where((hashes >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
    cells = np.bincount(cell, sign, n * CELLS).astype(np.int64).astype(np.uint16)
    return Vectors(_sums(exact, np.searchsorted(left, bounds)), cells.reshape(n, CELLS))


def vectors(texts: pa.Array) -> Vectors:
    """The fingerprints of texts; null is empty, and a text without words has the zero vector."""
    parts = [_of_slice(data, bounds) for _, _, data, bounds in slices(texts)]
    return joined(parts) if parts else zeros(0)


# --- for users ---------------------------------------------------------------------------


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every row of docs (doc_id, text).

    Other columns are ignored. A null or empty text and one without words have the zero vector's
    fingerprint. Repeated rows get the same fingerprint each; no rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), "text")

    def work(batches):
        for batch in batches:
            codes = pa.array(vectors(batch.column(2)).encode(), pa.string())
            yield pa.record_batch([*batch.columns[:2], codes], ["doc_id", "n_chars", "fingerprint"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {id_type}, n_chars long, fingerprint string")


def likeness(one: Column, other: Column) -> Column:
    """How alike two fingerprints are, 0 to 1; null counts as an empty text's."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(decode(a).alike(decode(b)))

    return alike(one, other)


def amend(code: Column, deleted: Column, inserted: Column) -> Column:
    """A fingerprint after some paragraphs went and others came; each a text of whole lines, or null."""

    @F.pandas_udf("string")
    def amended(old: pd.Series, less: pd.Series, more: pd.Series) -> pd.Series:
        gone, new = (vectors(pa.array(x, pa.string(), from_pandas=True)) for x in (less, more))
        return pd.Series((decode(old) - gone + new).encode())

    return amended(code, deleted, inserted)


def combine(prints: DataFrame, by: str) -> DataFrame:
    """Fingerprint of all texts of each group, from their fingerprints: columns `by`, fingerprint.

    Each task adds up what it holds, so of a group, however large, one row per task is shuffled, and
    these are added up as they stream by. Null is a group of its own.
    """
    rows = prints.select(F.col(by).alias("by"), "fingerprint")
    kind = rows.schema["by"].dataType.simpleString()

    def folded(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        codes = [v.encode()[0] for v in held.values()]
        return pa.record_batch([pa.array(list(held), kind), pa.array(codes)], ["by", "fingerprint"])

    def partial(batches):
        held: dict = {}
        for batch in batches:
            frame = pd.DataFrame({"by": pd.Series(batch.column(0).to_pylist(), dtype=object)})
            all_of = decode(batch.column(1).to_pylist())
            for key, index in frame.groupby("by", dropna=False).indices.items():
                key = None if key != key else key
                total = all_of[index].sum()
                held[key] = held[key] + total if key in held else total
            if len(held) >= HELD_GROUPS:
                yield folded(held, batch.column(0).type)
                held = {}
        if held:
            yield folded(held, batch.column(0).type)

    def fold(batches):
        key, total = None, None
        for batch in batches:
            for k, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total is not None and k != key:
                    yield folded({key: total}, batch.column(0).type)
                    total = None
                key, total = k, decode([code]) if total is None else total + decode([code])
        if total is not None:
            yield folded({key: total}, batch.column(0).type)

    schema = f"by {kind}, fingerprint string"
    sums = rows.mapInArrow(partial, schema).repartition("by").sortWithinPartitions("by").mapInArrow(fold, schema)
    return sums.select(F.col("by").alias(by), "fingerprint")


# --- every document beside the next ---------------------------------------------------------


class _Ranges:
    """Ranges of (doc_id, mark) in order, nulls last; a repeated id is split by mark."""

    def __init__(self, bounds: list[int], null_ranges: int):
        self.bounds, self.null_ranges = np.array(bounds, np.int64), null_ranges
        self.heads: dict[int, tuple] = {}

    def of(self, ids: pd.Series, marks: pd.Series) -> np.ndarray:
        null = ids.isna().to_numpy()
        at = ids.fillna(0).to_numpy().astype(np.int64)
        share = marks.to_numpy().astype(np.float64) / 2.0**64 + 0.5
        lo = np.searchsorted(self.bounds, at, "left")
        wide = np.searchsorted(self.bounds, at, "right") - lo + 1
        lo, wide = np.where(null, len(self.bounds) + 1, lo), np.where(null, self.null_ranges, wide)
        return lo + np.minimum((share * wide).astype(np.int64), wide - 1)


def _ranges(rows: DataFrame) -> _Ranges:
    """About RANGES ranges of rows per shuffle partition; only their bounds come to the driver."""
    n = RANGES * partitions(rows.sparkSession)
    fractions = F.array(*[F.lit(k / n) for k in range(1, n)])
    bounds, total, given = rows.agg(
        F.percentile_approx("doc_id", fractions, 20 * n), F.count("*"), F.count("doc_id")
    ).first()
    return _Ranges(bounds or [], max(1, round(n * (total - given) / max(total, 1))))


def beside_next(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside its edited text's and the next document's.

    docs: doc_id (an integer), text; other columns are ignored. The next document is that of the next
    greater doc_id, nulls last, equal ids by a hash of their texts; after the last comes the first. A
    document's edited text has its last floor(n_chars / 4) code points replaced by the first as many, or
    all, of the next. Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited and
    near_next. A null text is empty. A single row is its own next; repeated rows follow each other; no
    rows give no rows. Rows of one id are split by their texts; only rows equal in both, which
    stream through and are not held, meet in a task.

    Texts are shuffled once, into ranges of ids. The first text of each range also goes to the end of
    the one before.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    ranges = _ranges(rows)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(ids, marks).astype(np.int32))

    key = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")
    heads = rows.select(range_of("doc_id", "mark").alias("range"), key.alias("key"))
    heads = sorted(heads.groupBy("range").agg(F.min("key").alias("key")).collect())  # a row a range
    before = {h["range"]: heads[k - 1]["range"] for k, h in enumerate(heads)}
    first = {h["range"]: (h["key"]["doc_id"], h["key"]["mark"]) for h in heads}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, marks: pd.Series) -> pd.Series:
        """A row's own range, and where it is the first of its range also the one before."""
        out = []
        for i, m, r in zip(ids, marks, ranges.of(ids, marks).tolist(), strict=True):
            head = first.get(r)
            begins = head is not None and m == head[1] and (i == head[0] or (i != i and head[0] is None))
            out.append([r, before[r]] if begins else [r])
        return pd.Series(out)

    placed = rows.select("doc_id", "text", "mark", F.posexplode(places("doc_id", "mark")).alias("after", "range"))
    ordered = placed.repartition(partitions(spark), "range").sortWithinPartitions(
        "range", "after", F.isnull("doc_id"), "doc_id", "mark"
    )
    return ordered.select("doc_id", "after", "text").mapInArrow(
        _beside,
        "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


@dataclass
class _Rows:
    """Some documents in order: what stays of each when its end is edited, and what it is in all."""

    ids: list
    after: list
    texts: list[str]
    kept: Vectors
    whole: Vectors


def _read(batches) -> Iterator[_Rows]:
    for batch in batches:
        ids, after, texts = (c.to_pylist() for c in batch.columns)
        lo, held = 0, 0
        for hi, text in enumerate(texts, 1):
            held += len(text)
            if held >= SLICE_BYTES or hi == len(texts):
                part = texts[lo:hi]
                cuts = [t.rfind("\n", 0, len(t) - len(t) // 4) + 1 for t in part]
                kept = vectors(pa.array([t[:c] for t, c in zip(part, cuts, strict=True)], pa.string()))
                ends = vectors(pa.array([t[c:] for t, c in zip(part, cuts, strict=True)], pa.string()))
                yield _Rows(ids[lo:hi], after[lo:hi], part, kept, kept + ends)
                lo, held = hi, 0


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, `after` 0 for those of the range and 1 for the first of the next one."""
    last: _Rows | None = None
    for some in _read(batches):
        if last:
            some = _Rows(
                last.ids + some.ids, last.after + some.after, last.texts + some.texts,
                joined([last.kept, some.kept]), joined([last.whole, some.whole]),
            )
        end = len(some.ids) - 1
        own = [k for k in range(end) if not some.after[k]]
        if own:
            edited, ends = [], []
            for k in own:
                text, following = some.texts[k], some.texts[k + 1]
                n = len(text) // 4
                edited.append(text[: len(text) - n] + following[:n])
                ends.append(edited[-1][text.rfind("\n", 0, len(text) - n) + 1 :])
            whole = some.whole[own]
            changed = some.kept[own] + vectors(pa.array(ends, pa.string()))
            yield pa.record_batch(
                [
                    pa.array([some.ids[k] for k in own], pa.int64()),
                    pa.array([len(some.texts[k]) for k in own], pa.int64()),
                    pa.array(edited, pa.string()),
                    pa.array(whole.encode(), pa.string()),
                    pa.array(changed.encode(), pa.string()),
                    pa.array(whole.alike(changed)),
                    pa.array(whole.alike(some.whole[[k + 1 for k in own]])),
                ],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        last = _Rows(some.ids[end:], some.after[end:], some.texts[end:], some.kept[[end]], some.whole[[end]])


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = beside_next(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited")
