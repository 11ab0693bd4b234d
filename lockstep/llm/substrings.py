"""Exact removal of repeated word windows behind a count-min prefilter.

Two passes decide which windows occur more than once. The first sketches windows: partition
sketches are merged and overestimate how often a window came. To keep the sketch small, a window
is keyed by its anchor, the run of ANCHOR words of least hash inside; a stretch of windows with
one anchor adds one count. Equal windows at two places have equal anchors at two places,
so a repeated window is always estimated repeated. The second pass groups only those windows
exactly, by 128 bits of hash and with map-side sums.

Most windows that get this far are repeated, so it is the others, each of which is one row by
nature, that travel back to their documents: no group of copies, however large, meets in a task.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm import sketch
from lockstep.llm.common import table
from lockstep.llm.rolling import Roll, anchors, changes, slices, words

WINDOW, ANCHOR = 35, 8
# Expected bytes per stretch of windows with one anchor, to choose the sketch's size.
BYTES_PER_KEY = 80


@cache
def _rolls() -> tuple[Roll, Roll, Roll, Roll]:
    return Roll(1), Roll(2), Roll(3), Roll(4)


def _hashed(data, bounds, rolls):
    """Word starts, ends, first word of each text, and one hash per word and roll."""
    starts, ends, first = words(data, bounds)
    return starts, ends, first, [r.spans(r.of_bytes(data), starts, ends) for r in rolls]


def _windows(wide: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """Starts of all windows and the key of each one's anchor; and where the anchor changes."""
    roll = _rolls()[2]
    grams = roll.runs(roll.prefix(wide), anchor)
    at, where = anchors(grams, first, anchor, window)
    return at, grams[where], changes(where)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the text without the words of repeated windows.

    docs: doc_id, text; other columns are ignored. A window is `window` consecutive words of one
    text; each word covered by a window whose words also start anywhere else goes, the first
    occurrence too. kept joins what is left by one space. A null text has no words; texts shorter
    than a window are kept; repeated rows lose all their windows; no rows give no rows.
    """
    spark = docs.sparkSession
    anchor = min(ANCHOR, window)
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def keys_of(batch):
        for _, _, data, bounds in slices(batch.column(0)):
            _, _, first, (wide,) = _hashed(data, bounds, _rolls()[:1])
            _, keys, new = _windows(wide, first, window, anchor)
            yield keys[new]

    found = sketch.repeated(rows.select("text"), keys_of, size // BYTES_PER_KEY)
    shared = spark.sparkContext.broadcast(found)

    def suspects(batches):
        a, b, _, d = _rolls()
        for batch in batches:
            marks, parts = batch.column(1).to_numpy(zero_copy_only=False), []
            for lo, _, data, bounds in slices(batch.column(2)):
                _, _, first, (wide, other) = _hashed(data, bounds, (a, b))
                at, keys, _ = _windows(wide, first, window, anchor)
                at = at[shared.value.may(keys)]
                row = np.searchsorted(first, at, "right") - 1
                one, two = a.runs(a.prefix(wide), window), d.runs(d.prefix(other), window)
                parts.append((one[at], two[at], lo + row, at - first[row]))
            if not parts:
                continue
            one, two, row, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((two, one))
            new = changes(one[order], two[order])
            n = np.minimum(np.diff(np.append(new, len(order))), 2)
            # In the order of the texts again, so that equal ids stand together and compress.
            again = np.argsort(order[new])
            pick, n = order[new][again], n[again]
            yield pa.record_batch(
                [
                    pa.array(one[pick].view(np.int64)),
                    pa.array(two[pick].view(np.int64)),
                    pa.array(n.astype(np.int32)),
                    batch.column(0).take(pa.array(row[pick])),
                    pa.array(marks[row[pick]]),
                    pa.array(at[pick].astype(np.int32)),
                ],
                ["one", "two", "n", "doc_id", "mark", "at"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    exact = marked.mapInArrow(
        suspects, f"one long, two long, n int, doc_id {id_type}, mark long, at int"
    ).groupBy("one", "two")
    single = exact.agg(
        F.sum("n").alias("n"),
        F.first("doc_id").alias("__id"),
        F.first("mark").alias("__mark"),
        F.first("at").alias("at"),
    ).where("n = 1")
    spared = single.groupBy("__id", "__mark").agg(F.collect_list("at").alias("spared"))
    joined = marked.join(
        spared, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left"
    ).select("doc_id", "text", "spared")

    def keep(batches):
        for batch in batches:
            spare = batch.column(2)
            for lo, hi, data, bounds in slices(batch.column(1)):
                starts, ends, first, (wide,) = _hashed(data, bounds, _rolls()[:1])
                at, keys, _ = _windows(wide, first, window, anchor)
                hit = np.zeros(len(wide) + 1, bool)
                hit[at[shared.value.may(keys)]] = True
                part = spare.slice(lo, hi - lo)
                counts = np.diff(np.append(part.offsets.to_numpy(), 0)[: len(part) + 1])
                counts[~part.is_valid().to_numpy(zero_copy_only=False)] = 0
                hit[np.repeat(first[:-1], counts) + part.flatten().to_numpy()] = False
                edge = np.zeros(len(wide) + window + 1, np.int32)
                gone = np.flatnonzero(hit)
                edge[gone] += 1
                edge[gone + window] -= 1
                removed = np.cumsum(edge)[: len(wide)] > 0
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        pa.array(np.diff(np.concatenate([[0], np.cumsum(removed)])[first])),
                        pa.array(_kept(data, bounds, first, removed), pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.mapInArrow(keep, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def _kept(data, bounds, first, removed) -> list[bytes]:
    out, raw = [], data.tobytes()
    for k in range(len(bounds) - 1):
        found = raw[bounds[k] : bounds[k + 1]].split()
        gone = removed[first[k] : first[k + 1]]
        if gone.any():
            found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
        out.append(b" ".join(found))
    return out


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated windows of 35 words."""
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
