"""Removal of repeated byte strings with suffix arrays.

A string of WINDOW bytes is found by its anchor, the run of ANCHOR bytes of least hash inside. Stretches
of windows with one anchor form segments; a merged sketch of anchors tells which segments
may share a window with another place. Their hashes meet by anchor, equal ones folded; where an anchor
has several different segments, their bytes meet too, and a suffix array of each bucket brings
equal windows together:

* suffixes smaller than their successors are sorted directly,
* the rest is induced from them by scanning the buckets of first bytes from left to right,
* common prefixes of neighbours are computed, and neighbours that share a whole window form a group.

The least doc_id of a group owns the window, and only owners are told, one short message for each
different segment; every other flagged window goes. So a segment that a third of all documents share
is folded before the shuffle, and its answer is one row.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm import sketch
from lockstep.llm.common import partitions, settle, table
from lockstep.llm.rolling import Roll, anchors, changes, mixed, slices

WINDOW, ANCHOR = 50, 20
# Expected bytes per segment, to choose the sketch's size.
BYTES_PER_KEY = 16
# A bucket's segments are sorted together up to about this many bytes; an anchor stays whole.
BUCKET_BYTES = 1_000_000
BREAK = 0xFF  # in no UTF-8 text
NO_ID = 2**63 - 1
# An anchor with more different segments than this is settled window by window.
HOT = 50_000
OWNERS = "__id long, print long, bits binary"


# --- suffix array ----------------------------------------------------------------------


def _eights(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, in byte order."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)[at]
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a byte later; the last is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    nearest = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return step[nearest] > 0


def _sorted(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes there, as far as depth bytes tell."""
    key = _eights(text, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key, of = _eights(text, at[where] + d), group[where]
        order = np.lexsort((key, of))
        at[where], key, of = at[where][order], key[order], of[order]
        new = np.ones(len(at), bool)
        new[1:] = ~same
        new[where[1:]] |= (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        group = np.cumsum(new)
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start places of all suffixes in order, ties beyond depth bytes aside.

    Two stages: suffixes smaller than their successors are sorted directly and put at the ends
    of the buckets of their first bytes; scanning the buckets in order then places each
    larger suffix when its successor is met.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    small = _smaller(text)
    direct = _sorted(padded, np.flatnonzero(small), depth)
    size = np.bincount(text, minlength=256)
    end = np.cumsum(size)
    head = end - size
    tail = end - np.bincount(text[direct], minlength=256)
    out = np.full(n, -1, np.int64)
    firsts = text[direct]
    out[tail[firsts] + np.arange(len(direct)) - np.searchsorted(firsts, firsts)] = direct
    out[head[text[-1]]] = n - 1
    filled = head.copy()
    filled[text[-1]] += 1

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        out[filled[byte] + np.arange(len(byte)) - np.searchsorted(byte, byte)] = before
        filled[:] += np.bincount(byte, minlength=256)

    for c in np.flatnonzero(size):
        done = head[c]
        while done < filled[c]:
            done, lo = filled[c], done
            induce(out[lo:done])
        induce(out[tail[c] : end[c]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before in order, up to most; 0 for the first."""
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for d in range(0, most, 8):
        differ = _eights(padded, order[alive] + d) ^ _eights(padded, order[alive - 1] + d)
        equal = np.full(len(alive), 8)
        for k in range(8):
            equal[differ >= np.uint64(1 << (8 * k))] = 7 - k
        shared[alive] = np.minimum(d + equal, most)
        alive = alive[equal == 8]
    return shared


def owned(segments: list[bytes], ids: list[int], window: int) -> list[int]:
    """For each segment a bit set of the windows inside, 1 where its id is the least of all."""
    text = np.frombuffer(bytes([BREAK]).join([*segments, b""]), np.uint8)
    lengths = np.array([len(s) + 1 for s in segments])
    owner = np.repeat(np.array(ids, np.int64), lengths)
    order = suffix_array(text, window)
    new = np.flatnonzero(common_prefixes(text, order, window) < window)
    least = np.minimum.reduceat(owner[order], new)
    mine = np.empty(len(text), bool)
    mine[order] = owner[order] == np.repeat(least, np.diff(np.append(new, len(order))))
    starts = np.cumsum(lengths) - lengths
    bits = []
    for lo, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        packed = np.packbits(mine[lo : lo + length - window], bitorder="little").tobytes()
        bits.append(int.from_bytes(packed, "little"))
    return bits


# --- the operator ----------------------------------------------------------------------


@cache
def _rolls() -> tuple[Roll, Roll]:
    return Roll(11), Roll(12)


def _segments(data: np.ndarray, bounds: np.ndarray, window: int, anchor: int):
    """Anchor hash, first and last window and content hash of each segment."""
    roll, other = _rolls()
    grams = roll.runs(roll.of_bytes(data), anchor)
    at, where = anchors(grams, bounds, anchor, window)
    # Neighbouring texts can't share an anchor; windows of one anchor are consecutive.
    new = changes(where)
    lo, hi = at[new], at[np.append(new[1:], len(at))[: len(new)] - 1] if len(new) else at[:0]
    return grams[where[new]], lo, hi


def _prints(data, lo, hi, window):
    _, other = _rolls()
    return other.spans(other.of_bytes(data), lo, hi + window)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: the bytes without repeated strings.

    docs: doc_id (integer), text; other columns are ignored. Each byte covered by `window` bytes of one
    text that also start in a document with a smaller doc_id goes; a null doc_id counts as the
    largest, and equal ones as one document. n_spans counts the maximal runs that go. A null
    text is empty, repeated rows are treated alike, no rows give no rows. window: 21 to 80.
    """
    spark = docs.sparkSession
    anchor = min(ANCHOR, window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def keys_of(batch):
        for _, _, data, bounds in slices(batch.column(0)):
            yield _segments(data, bounds, window, anchor)[0]

    found = sketch.repeated(rows.select("text"), keys_of, size // BYTES_PER_KEY)
    shared = spark.sparkContext.broadcast(found)

    def flagged(batch):
        """Anchor, print, id, first and last window and bytes of the segments that may repeat."""
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        for lo, _, data, bounds in slices(batch.column(1)):
            keys, a, b = _segments(data, bounds, window, anchor)
            hit = shared.value.may(keys)
            keys, a, b = keys[hit], a[hit], b[hit]
            of = ids[lo + np.searchsorted(bounds, a, "right") - 1]
            yield keys, _prints(data, a, b, window), of, a, b, data

    def suspects(batches):
        for batch in batches:
            parts = [(keys, prints, of) for keys, prints, of, *_ in flagged(batch)]
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                first = np.sort(_least(*columns))
                yield pa.record_batch(
                    [pa.array(c[first].view(np.int64)) for c in columns], ["anchor", "print", "doc_id"]
                )

    # Who has the segments of each anchor: one print alone is its least id's; others are compared.
    by_anchor = settle(
        rows.mapInArrow(suspects, "anchor long, print long, doc_id long")
        .repartition(partitions(spark), "anchor")
        .groupBy("anchor", "print")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("anchor")
        .agg(F.count("*").alias("n"), F.first("print").alias("print"), F.first("doc_id").alias("__id"))
    )
    many, hot = by_anchor.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("n") > HOT)).first()
    several = spark.sparkContext.broadcast(_members(by_anchor.where("n > 1").select("anchor"), many))
    crowded = spark.sparkContext.broadcast(_members(by_anchor.where(F.col("n") > HOT).select("anchor"), hot))

    def segments(batches):
        for batch in batches:
            least: dict[bytes, tuple[int, int, int]] = {}
            for keys, prints, of, a, b, data in flagged(batch):
                pick = np.flatnonzero(several.value.may(keys) & ~crowded.value.may(keys))
                raw = data.tobytes()
                for x, y, key, mark, i in zip(
                    a[pick].tolist(), (b[pick] + window).tolist(), keys[pick].view(np.int64).tolist(),
                    prints[pick].view(np.int64).tolist(), of[pick].tolist(), strict=True,
                ):
                    segment = raw[x:y]
                    had = least.get(segment)
                    if had is None or i < had[2]:
                        least[segment] = (key, mark, i)
            keys, prints, of = zip(*least.values(), strict=True) if least else ((), (), ())
            yield pa.record_batch(
                [
                    pa.array(keys, pa.int64()), pa.array(prints, pa.int64()),
                    pa.array(of, pa.int64()), pa.array(list(least), pa.binary()),
                ],
                ["anchor", "print", "doc_id", "segment"],
            )

    def own(batches):
        anchors_, prints, ids, segments, held = [], [], [], [], 0
        for batch in batches:
            for key, mark, i, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= BUCKET_BYTES and key != anchors_[-1]:
                    yield _answers(anchors_, prints, ids, segments, window)
                    anchors_, prints, ids, segments, held = [], [], [], [], 0
                anchors_.append(key)
                prints.append(mark)
                ids.append(i)
                segments.append(segment)
                held += len(segment)
        if segments:
            yield _answers(anchors_, prints, ids, segments, window)

    owners = by_anchor.where("n = 1").select("__id", "print", F.lit(b"").alias("bits"))
    owners = owners.union(
        rows.mapInArrow(segments, "anchor long, print long, doc_id long, segment binary")
        .repartition(partitions(spark), "anchor")
        .groupBy("anchor", "segment")
        .agg(F.min("print").alias("print"), F.min("doc_id").alias("doc_id"))
        .select("anchor", "print", "doc_id", "segment")
        .sortWithinPartitions("anchor")
        .mapInArrow(own, OWNERS)
    )
    if hot:
        owners = owners.union(_owners_by_window(rows, flagged, crowded, window))
    told = owners.groupBy("__id").agg(F.collect_list(F.struct("print", "bits")).alias("own"))
    joined = rows.join(
        told, F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("__id"), "left"
    ).select("doc_id", "text", "own.print", "own.bits")

    def keep(batches):
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1)):
                n = len(data)
                keys, a, b = _segments(data, bounds, window, anchor)
                hit = shared.value.may(keys)
                a, b = a[hit], b[hit]
                row = np.searchsorted(bounds, a, "right") - 1
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, a, 1)
                np.add.at(gone, b + 1, -1)
                gone = np.cumsum(gone)[:n] > 0
                _spare(gone, a, b, _prints(data, a, b, window), row, batch.column(2), batch.column(3), lo, hi)
                edge = np.zeros(n + window + 1, np.int32)
                at = np.flatnonzero(gone)
                edge[at] += 1
                edge[at + window] -= 1
                removed = np.cumsum(edge)[:n] > 0
                first = removed.copy()
                first[1:] &= ~removed[:-1]
                first[bounds[:-1][bounds[:-1] < n]] = removed[bounds[:-1][bounds[:-1] < n]]
                total = np.concatenate([[0], np.cumsum(removed)])
                spans = np.concatenate([[0], np.cumsum(first)])
                left = data[~removed].tobytes()
                ends = bounds - total[bounds]
                kept = [left[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)),
                        pa.array(np.diff(total[bounds])), pa.array(np.diff(spans[bounds])),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _least(keys, prints, of) -> np.ndarray:
    """For each different key and print the place of the least id."""
    order = np.lexsort((of, prints, keys))
    return order[changes(keys[order], prints[order])]


def _members(keys: DataFrame, n: int) -> sketch.Repeated:
    """A sketch that knows the different keys of a one-column table, and may claim others."""

    def twice(batch):
        yield np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)

    return sketch.repeated(keys, twice, n)


def _owners_by_window(rows, flagged, crowded, window) -> DataFrame:
    """Owners of the windows of anchors with very many different segments, found by grouping
    single windows by 128 bits of hash, so that no task sees all segments of such an anchor."""

    def windows(batches):
        roll, other = _rolls()
        for batch in batches:
            for keys, prints, of, a, b, data in flagged(batch):
                pick = np.flatnonzero(crowded.value.may(keys))
                pick = pick[_least(keys[pick], prints[pick], of[pick])]
                n = b[pick] + 1 - a[pick]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(a[pick], n) + inside
                yield pa.record_batch(
                    [
                        pa.array(roll.spans(roll.of_bytes(data), at, at + window).view(np.int64)),
                        pa.array(other.spans(other.of_bytes(data), at, at + window).view(np.int64)),
                        pa.array(np.repeat(of[pick], n)),
                        pa.array(np.repeat(prints[pick], n).view(np.int64)),
                        pa.array(inside.astype(np.int32)),
                    ],
                    ["one", "two", "__id", "print", "inside"],
                )

    def bits(batches):
        for batch in batches:
            packed = [sum(1 << k for k in set(x)).to_bytes(max(x) // 8 + 1, "little") for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["__id", "print", "bits"])

    each = rows.mapInArrow(windows, "one long, two long, __id long, print long, inside int")
    least = each.groupBy("one", "two").agg(F.min("__id").alias("__least"))
    mine = each.join(least, ["one", "two"]).where(F.col("__id") == F.col("__least"))
    return (
        mine.groupBy("__id", "print").agg(F.collect_set("inside").alias("inside")).mapInArrow(bits, OWNERS)
    )


def _answers(keys, prints, ids, segments, window) -> pa.RecordBatch:
    """Owned windows of each segment; all of them where no other segment has its anchor."""
    keys = np.array(keys, np.int64)
    new = changes(keys)
    alone = np.repeat(np.diff(np.append(new, len(keys))) == 1, np.diff(np.append(new, len(keys))))
    shared = np.flatnonzero(~alone).tolist()
    bits = [b""] * len(keys)
    if shared:
        found = owned([segments[k] for k in shared], [ids[k] for k in shared], window)
        for k, own in zip(shared, found, strict=True):
            bits[k] = own.to_bytes(8 * ((len(segments[k]) - window) // 64 + 1), "little")
    told = [k for k in range(len(keys)) if alone[k] or any(bits[k])]
    return pa.record_batch(
        [
            pa.array([ids[k] for k in told], pa.int64()),
            pa.array([prints[k] for k in told], pa.int64()),
            pa.array([bits[k] for k in told], pa.binary()),
        ],
        ["__id", "print", "bits"],
    )


def _spare(gone, a, b, prints, row, told_prints, told_bits, lo, hi) -> None:
    """Clear the windows that their own document owns; empty bits stand for all of a segment."""
    part = told_prints.slice(lo, hi - lo)
    if not len(a) or part.null_count == len(part):
        return
    counts = np.diff(part.offsets.to_numpy())[: len(part)]
    counts = np.where(part.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    told = part.flatten().to_numpy().view(np.uint64) ^ mixed(np.repeat(np.arange(len(part)), counts).astype(np.uint64))
    bits = told_bits.slice(lo, hi - lo).flatten()
    order = np.argsort(told)
    mine = prints ^ mixed(row.astype(np.uint64))
    at = np.searchsorted(told[order], mine)
    at[at == len(order)] = 0
    known = np.flatnonzero(told[order][at] == mine) if len(order) else np.zeros(0, np.int64)
    values = bits.take(pa.array(order[at[known]])).to_pylist()
    for k, packed in zip(known.tolist(), values, strict=True):
        if packed:
            n = b[k] + 1 - a[k]
            own = np.unpackbits(np.frombuffer(packed, np.uint8), count=n, bitorder="little")
            gone[a[k] : b[k] + 1] &= own == 0
        else:
            gone[a[k] : b[k] + 1] = False


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of earlier documents."""
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )
