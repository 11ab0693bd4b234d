"""Near-duplicate classes by ProbMinHash.

A text's shingles, runs of WORDS words, are weighted by how often they come. Each shingle sends
out a Poisson process of arrivals with its weight as rate; an arrival falls on one of REGISTERS
registers, and a register keeps the shingle that came first. Two texts agree in a register
with a probability equal to their probability Jaccard similarity. A shingle's process ends as soon as its next arrival
comes after the last of all registers. Registers are banded; texts that share a band are
candidates; candidates are verified by the Jaccard similarity of their shingle sets.

That one can be high where probability Jaccard is low, if texts differ in what they repeat. So texts with
repeated shingles have second registers, all weights 1, whose agreement is the set similarity itself. The bands of
both make candidates; the bits that tell hopeless pairs come from those of weight 1 alone.

Texts with equal words are folded first. Candidates that bands connect form components, and a component is
verified in one task: starting from any text, those it is similar to are taken, then those similar to
these, each compared only with texts that share a band and are not taken yet. So a large group costs about a
comparison per text. A component too large for a task is verified in rounds of joins instead:
members of a band are compared with a few hubs a round, those already linked are not compared
again, and rounds go on until every two members are linked or compared. No link is lost to a limit.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.llm import sketch
from lockstep.llm.common import partitions, settle, shielded, small, table
from lockstep.llm.rolling import Roll, changes, mixed, slices, words

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
# One bit per register: similar texts agree in 90 % of them at least, 86 of 96; 26 differences are 5.6
# standard deviations off.
MOST_DIFFERENT_BITS = 26
# Shingles of a component, 4 bytes each, that one task verifies.
COMPONENT = 16_000_000
NO_ID = 2**63 - 1
# Ids that go are broadcast up to this many.
GONE_ROWS = 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def _rolls() -> tuple[Roll, Roll, Roll]:
    return Roll(31), Roll(32), Roll(33)


# --- a batch ---------------------------------------------------------------------------


def _digests(data, bounds, named: bool = False):
    """Shingles with the text each belongs to, a 16-byte name of each text's words, word counts.

    With named the shingles are left out.
    """
    a, b, c = _rolls()
    starts, ends, first = words(data, bounds)
    one = a.spans(a.of_bytes(data), starts, ends)
    two = b.spans(b.of_bytes(data), starts, ends)
    n = np.diff(first)
    whole = a.prefix(one)
    other = b.prefix(two)
    name = np.stack([a.spans(whole, first[:-1], first[1:]), b.spans(other, first[:-1], first[1:])], 1)
    if named:
        return None, None, name, n
    # A text with fewer words than a shingle is one shingle.
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(int))
    of = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][of]
    shingles = c.spans(c.prefix(one), at, np.minimum(at + WORDS, first[1:][of]))
    return shingles, of, name, n


def _weighted(shingles, of):
    """Different shingles of each text in order, their texts and counts."""
    order = np.argsort((of.astype(np.uint64) << np.uint64(44)) | (shingles >> np.uint64(20)), kind="stable")
    shingles, of = shingles[order], of[order]
    new = changes(shingles, of)
    return shingles[new], of[new], np.diff(np.append(new, len(shingles)))


def prob_min_hash(shingles: np.ndarray, of: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The first shingle on each register of each of n texts, as an n by REGISTERS array.

    All texts advance together: in each round the shingles that are not yet done make their next arrivals,
    one at first and twice as many each time.
    """
    first = np.full(n * REGISTERS, np.inf)
    who = np.zeros(n * REGISTERS, np.uint64)
    alive, time = np.arange(len(shingles)), np.zeros(len(shingles))
    step, width = 0, 1
    while len(alive):
        draws = mixed(shingles[alive, None] + STEP * np.arange(step + 1, step + width + 1, dtype=np.uint64))
        waits = -np.log(((draws >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
        arrivals = time[:, None] + np.cumsum(waits, 1) / weights[alive, None]
        cells = (of[alive, None] * REGISTERS + (mixed(draws) % np.uint64(REGISTERS)).astype(np.int64)).ravel()
        times = arrivals.ravel()
        np.minimum.at(first, cells, times)
        won = np.flatnonzero(times == first[cells])
        who[cells[won]] = shingles[alive[won // width]]
        last = first.reshape(n, REGISTERS).max(1)
        going = arrivals[:, -1] < last[of[alive]]
        alive, time = alive[going], arrivals[going, -1]
        step, width = step + width, min(2 * width, 64)
    return who.reshape(n, REGISTERS)


def _band_keys(who: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * STEP
    for k in range(ROWS):
        keys = mixed(keys + who[:, k::ROWS])
    return keys


def _names(name: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(name).view(np.uint8).reshape(-1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(name), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _named(batches):
    for batch in batches:
        for lo, hi, data, bounds in slices(batch.column(1)):
            _, _, name, n = _digests(data, bounds, named=True)
            yield pa.record_batch(
                [batch.column(0).slice(lo, hi - lo), _names(name), pa.array(n)], ["doc_id", "node", "n_words"]
            )


def _fresh(batches):
    """The texts of each batch whose words no earlier one of the batch has."""
    for batch in batches:
        seen: set[bytes] = set()
        for _, _, data, bounds in slices(batch.column(0)):
            shingles, of, name, n = _digests(data, bounds)
            fresh = np.zeros(len(n), bool)
            for k, key in enumerate(map(bytes, name)):
                if n[k] and key not in seen:
                    seen.add(key)
                    fresh[k] = True
            place = np.cumsum(fresh) - 1
            inside = fresh[of]
            yield (*_weighted(shingles[inside], place[of[inside]]), name[fresh])


def _registers(shingles: np.ndarray, of: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The registers of n texts with all weights 1, then weighted ones of texts that repeat a shingle; and whose each are."""
    again = np.flatnonzero(np.bincount(of, weights > 1, minlength=n))
    row = np.full(n, -1)
    row[again] = n + np.arange(len(again))
    more = row[of] >= 0
    who = prob_min_hash(
        np.concatenate([shingles, shingles[more]]), np.concatenate([of, row[of[more]]]),
        np.concatenate([np.ones(len(of)), weights[more]]), n + len(again),
    )
    return who, np.concatenate([np.arange(n), again])


def _banded(batches):
    for shingles, of, weights, name in _fresh(batches):
        n = len(name)
        if not n:
            continue
        who, text = _registers(shingles, of, weights, n)
        bits = np.packbits(mixed(who[:n]) >> np.uint64(63) == 1, axis=1)
        bits = np.concatenate([bits, np.zeros((n, 16 - bits.shape[1]), np.uint8)], 1).view(np.int64)
        size = np.bincount(of, minlength=n)
        keys = _band_keys(who)
        new = np.ones(keys.shape, bool)
        new[n:] = keys[n:] != keys[text[n:]]
        row = np.repeat(text, BANDS)[new.ravel()]
        yield pa.record_batch(
            [
                pa.array(keys[new].view(np.int64)), _names(name).take(pa.array(row)),
                pa.array(bits[row, 0]), pa.array(bits[row, 1]), pa.array(size[row].astype(np.int32)),
            ],
            ["band", "node", "bits1", "bits2", "size"],
        )


def _similar(batches):
    for batch in batches:
        sets = [[np.frombuffer(x, np.uint32) for x in batch.column(k).to_pylist()] for k in (2, 3)]
        hit = [_alike(a, b) for a, b in zip(*sets, strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))


# --- components ------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that the edges (a, b) connect each node with.

    First every node keeps one edge, to its least neighbour, and hands its other neighbours on to
    that one, which leaves the connections as they are and about an edge per node. Then nodes take the
    least label among their neighbours and their label's label, until none changes.
    """
    down = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    )
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    handed = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select("a", F.col("m").alias("b")).union(handed.distinct())
    both = settle(kept.union(kept.select("b", "a")).distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("comp")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        )
        taken = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("to")
        )
        up = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        new = settle(taken.join(up, "to").select("node", "old", F.least("to", "up").alias("comp")))
        changed = new.where(F.col("old") != F.col("comp")).limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


# --- the operator ----------------------------------------------------------------------


def _payloads(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingle set, as sorted 32-bit hashes, of the wanted nodes, once or a few times each.

    wanted: node and the least doc_id with its words; a sketch of both picks the rows to read sets from.
    """

    def picked(batch):
        raw = b"".join(batch.column(0).to_pylist())
        ids = batch.column(1).fill_null(NO_ID).to_numpy()
        yield np.repeat(_pick(np.frombuffer(raw, np.uint64)[::2], ids), 2)

    ids = F.col("doc_id").cast("long").alias("doc_id")
    wanted = wanted.select("node", ids)
    found = docs.sparkSession.sparkContext.broadcast(sketch.repeated(wanted, picked, wanted.count()))

    def sets(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for lo, hi, data, bounds in slices(batch.column(1)):
                shingles, of, name, n = _digests(data, bounds)
                pick = (n > 0) & found.value.may(_pick(name[:, 0], ids[lo:hi]))
                inside = pick[of]
                shingles, of, _ = _weighted(shingles[inside], of[inside])
                short = (shingles >> np.uint64(32)).astype(np.uint32)
                new = changes(short, of)
                short, of = short[new], of[new]
                ends = np.searchsorted(of, np.arange(len(n) + 1))
                raw = [short[ends[k] : ends[k + 1]].tobytes() for k in np.flatnonzero(pick)]
                yield pa.record_batch([_names(name[pick]), pa.array(raw, pa.binary())], ["node", "shingles"])

    return docs.select(ids, "text").mapInArrow(sets, "node binary, shingles binary")


def _pick(name: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mixed(name ^ mixed(ids.astype(np.int64).view(np.uint64)))


def _alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Are two sorted sets similar enough?"""
    if len(one) > len(other):
        one, other = other, one
    if len(one) < SIMILARITY * len(other):
        return False
    both = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
    return both >= SIMILARITY * (len(one) + len(other) - both)


def _linked(bands: list[np.ndarray], bits: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """For each text of a component the number of the text from which it was reached."""
    at: dict[int, set[int]] = {}
    for k, keys in enumerate(bands):
        for key in keys.tolist():
            at.setdefault(key, set()).add(k)
    found = np.full(len(sets), -1)
    for start in range(len(sets)):
        if found[start] >= 0:
            continue
        found[start], todo = start, [start]
        while todo:
            k = todo.pop()
            near: set[int] = set()
            for key in bands[k].tolist():
                at[key].discard(k)
                near |= at[key]
            near = np.fromiter(near, np.int64, len(near))
            near = near[found[near] < 0]
            near = near[np.bitwise_count(bits[near] ^ bits[k]).sum(1) <= MOST_DIFFERENT_BITS]
            for j in near.tolist():
                if _alike(sets[k], sets[j]):
                    found[j] = start
                    todo.append(j)
    return found


def _verified(batches):
    """node and comp of every row, rows of a component being consecutive and in order."""
    held, of = {}, None
    for batch in batches:
        for comp, node, bands, bits1, bits2, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if comp != of:
                yield from _flushed(held)
                held, of = {}, comp
            held[node] = (np.array(bands, np.int64), (bits1, bits2), np.frombuffer(shingles, np.uint32))
    yield from _flushed(held)


def _flushed(held: dict):
    if held:
        names = sorted(held)
        bands, bits, sets = zip(*(held[n] for n in names), strict=True)
        found = _linked(list(bands), np.array(bits, np.int64), list(sets))
        comps = [names[k] for k in found.tolist()]
        yield pa.record_batch([pa.array(names, pa.binary()), pa.array(comps, pa.binary())], ["node", "comp"])


def _links(docs: DataFrame, named: DataFrame) -> DataFrame:
    """node, comp of all texts that share a band with another: comp is one name for all that are
    similar, directly or through others."""
    spark = docs.sparkSession
    banded = docs.select("text").mapInArrow(_banded, "band long, node binary, bits1 long, bits2 long, size int")
    banded = banded.dropDuplicates(["band", "node"])
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    members = settle(banded.join(shared.drop("n"), "band"))
    candidates = components(members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    nodes = members.groupBy("node").agg(
        F.collect_list("band").alias("bands"), F.first("bits1").alias("bits1"), F.first("bits2").alias("bits2"),
        F.first("size").alias("size"),
    )
    nodes = settle(nodes.join(candidates, "node"))
    least = named.where("n_words > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = _payloads(docs, settle(least.join(nodes.select("node"), "node", "left_semi")))
    heavy = nodes.groupBy("comp").agg(F.sum("size").alias("n")).where(F.col("n") > COMPONENT).select("comp")
    heavy = settle(heavy)
    rows = nodes.join(sets, "node").select("comp", "node", "bands", "bits1", "bits2", "shingles")
    if not heavy.limit(1).count():
        rows = rows.repartition(partitions(spark), "comp").sortWithinPartitions("comp")
        return rows.mapInArrow(_verified, "node binary, comp binary")
    light = rows.join(heavy, "comp", "left_anti").repartition(partitions(spark), "comp")
    found = light.sortWithinPartitions("comp").mapInArrow(_verified, "node binary, comp binary")
    large = settle(nodes.join(heavy, "comp", "left_semi").select("node"))
    sets = settle(sets.join(large, "node", "left_semi").dropDuplicates(["node"]))
    return found.union(_links_in_rounds(settle(members.join(large, "node", "left_semi")), sets))


def _links_in_rounds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for components of any size; members: band, node, bits1, bits2, size; sets: node, shingles."""
    spark = members.sparkSession
    comps = spark.createDataFrame([], "node binary, comp binary")
    tested, expanded, hubs = None, None, 1
    while True:
        # Members that have not been a hub of their band yet, in bands where two are not linked.
        rest = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        left = rest if expanded is None else rest.join(expanded, ["band", "node"], "left_anti")
        open_ = left.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
        left = left.join(open_.select("band"), "band", "left_semi")
        # One member of each component offers itself as hub, of these the first few are taken.
        offered = left.groupBy("band", "comp").agg(F.min(F.struct("node", "bits1", "bits2", "size")).alias("hub"))
        chosen = settle(_first_few(offered, hubs))
        if not chosen.limit(1).count():
            return comps
        hub = chosen.select(
            "band", F.col("comp").alias("hub_comp"), F.col("hub.node").alias("a"),
            F.col("hub.bits1").alias("h1"), F.col("hub.bits2").alias("h2"), F.col("hub.size").alias("hub_size"),
        )
        differ = F.bit_count(F.col("bits1").bitwiseXOR(F.col("h1"))) + F.bit_count(F.col("bits2").bitwiseXOR(F.col("h2")))
        fits = F.least("size", "hub_size") >= SIMILARITY * F.greatest("size", "hub_size")
        pairs = (
            rest.join(hub, "band")
            .where((F.col("comp") != F.col("hub_comp")) & (differ <= MOST_DIFFERENT_BITS) & fits)
            .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs)
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        linked = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
        linked = settle(linked.mapInArrow(_similar, "a binary, b binary"))
        comps = _merged(comps, linked)
        tested = pairs if tested is None else settle(tested.union(pairs))
        spent = chosen.select("band", F.col("hub.node").alias("node"))
        expanded = spent if expanded is None else settle(expanded.union(spent))
        hubs *= 2


def _first_few(offered: DataFrame, hubs: int) -> DataFrame:
    """The first `hubs` offers of each band, by a limit that Spark applies before it shuffles."""
    place = F.row_number().over(Window.partitionBy("band").orderBy("hub"))
    if hubs == 1:
        return offered.groupBy("band").agg(F.min(F.struct("hub", "comp")).alias("x")).select("band", "x.*")
    return offered.withColumn("place", place).where(F.col("place") <= hubs).drop("place")


def _merged(comps: DataFrame, linked: DataFrame) -> DataFrame:
    """Components after more links: those of the links between components carry over."""
    if not linked.limit(1).count():
        return comps
    a = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    between = linked.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    found = components(settle(between.where("a != b")))
    renamed = found.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    kept = comps.join(renamed, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return settle(kept.union(found.join(comps, "node", "left_anti")))


def _classified(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    named = settle(rows.mapInArrow(_named, f"doc_id {kind}, node binary, n_words long"))
    of = named.join(_links(rows, named), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of = settle(of)
    least = of.where("n_words > 0").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return of.join(least, "comp", "left").select(
        "doc_id", "node", "comp", "n_words",
        F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_words, class_id of every row of docs (doc_id, text).

    class_id is the least doc_id of the class: all rows whose texts have the same words or are connected by
    similar texts. node names a text's words. Texts without words, null ones too, are alone:
    class_id is their own doc_id. A text of fewer than five words is one shingle; a null doc_id is
    never the least unless all are null. Repeated rows share a class; other columns are
    ignored; no rows give no rows.
    """
    return _classified(docs).drop("comp")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: one with the least doc_id. All columns stay.

    Rows without words all stay. Where an id has several rows, they are told apart by their words,
    and of rows that agree in id and text one stays. Other columns may have any name.
    """
    safe, back = shielded(docs, ["doc_id", "text"])
    return back(_dedup(safe))


def _dedup(docs: DataFrame) -> DataFrame:
    found = settle(_classified(docs))
    if found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _one_each(docs, found)
    gone = found.where((F.col("n_words") > 0) & ~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = small(settle(gone.select(F.col("doc_id").alias("__id"))), GONE_ROWS)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def _one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """dedup() where ids repeat."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    best = (
        found.where((F.col("n_words") > 0) & first)
        .groupBy("comp")
        .agg(F.min("node").alias("node"), F.first("class_id").alias("id"))
        .drop("comp")
    )
    names = docs.select("doc_id", "text").distinct().mapInArrow(
        _texted, f"__id {kind}, __text string, __node binary"
    )
    kept = names.join(best, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__node") == F.col("node")))
    one = kept.groupBy("__id", "__node").agg(F.min("__text").alias("__text")).drop("__node")
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text") == F.col("__text"))
    return docs.where(blank).union(docs.join(one, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _texted(batches):
    for batch in batches:
        for lo, hi, data, bounds in slices(batch.column(1)):
            name = _digests(data, bounds, named=True)[2]
            yield pa.record_batch(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), _names(name)],
                ["__id", "__text", "__node"],
            )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it is the one that stays."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )
