"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of BLOCK tokens. Over the vocabulary of the benchmark, blocks are TF-IDF
vectors; a randomised singular value decomposition of all of them, done in one distributed pass,
gives RANK latent directions. Every block and every two neighbouring blocks are compared with every
piece of the benchmark by cosine there, the benchmark being the stated query set. Pairs that come
close are verified on the tokens themselves: by the longest common subsequence with the item, and for paraphrases
also by whether the item's answer, its last sentence, is found.

A second way to the same check is exact, whatever lies outside the leading directions. A leak lacks at
most n - PARAPHRASE n of an item's n tokens, so it holds one of any n - PARAPHRASE n + 1 of them, the rarest too. Every
token of a text that is among these is looked at, with all spans around it: of any place that may hold a
leak every span of the item's width is tried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import table
from lockstep.llm.rolling import Roll, changes, slices, words

BLOCK = 32
PIECE = 48
RANK, EXTRA = 64, 8
COSINE = 0.45
# Words in more than this share of all blocks tell little; of each item the RAREST stay even so.
MOST_COMMON, RAREST = 0.005, 8
# Share of a piece's weight that has to be near before the item's subsequence is computed.
SHARED = 0.3
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
# A span of this many times an item's length is searched for it.
STRETCH, SLACK = 1.3, 4
# Items compared at a time; a larger benchmark takes several rounds.
ITEMS = 5_000
# Tokens around rare words that are counted at once, and the cells of an item's filter, a power of 2.
AROUND, CELLS = 2_000_000, 1024

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_APART = ~_LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROLL = Roll(41)


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, lower-case runs of letters and digits, and each text's first one."""
    starts, ends, first = words(data, bounds, _APART)
    return _ROLL.spans(_ROLL.of_bytes(_LOWER[data]), starts, ends), first


def _of_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _tokens(raw, np.array([0, len(raw)]))[0]


class Item:
    """A benchmark item: its tokens, those of its answer, and bit masks for subsequences."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        self.tokens = _of_text(text).tolist()
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
        answer = _of_text(sentences[-1]).tolist() if len(sentences) > 1 else []
        self.answer = answer if len(answer) >= 3 else self.tokens[-5:]
        self.masks, self.answer_masks = _masks(self.tokens), _masks(self.answer)
        self.words = set(self.tokens)
        self.sorted = np.array(sorted(self.words), np.uint64)
        self.width = int(len(self.tokens) * STRETCH) + SLACK
        self.least = max(1, int(np.ceil(PARAPHRASE * len(self.tokens) - 1e-9)))


def _masks(tokens: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, t in enumerate(tokens):
        out[t] = out.get(t, 0) | 1 << k
    return out


def common_subsequence(masks: dict[int, int], n: int, tokens: list[int]) -> int:
    """Length of the longest common subsequence, a whole row of the table as one number."""
    full = (1 << n) - 1
    row = full
    for t in tokens:
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


class Benchmark:
    """Items, their vocabulary and, once learnt, its weights and latent directions."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = [item for item in (Item(i, t) for i, t in rows) if item.tokens]
        self.vocabulary = np.unique(np.array([t for item in self.items for t in item.tokens], np.uint64))
        self.idf = np.ones(len(self.vocabulary), np.float32)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Each token's number in the vocabulary, -1 if it has none."""
        at = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == tokens, at, -1)

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Keep the words that tell something and weigh them by inverse document frequency."""
        self._find_rare(df)
        keep = df <= MOST_COMMON * n
        for item in self.items:
            at = np.unique(self.places(np.array(item.tokens, np.uint64)))
            keep[at[np.argsort(df[at], kind="stable")[:RAREST]]] = True
        self.vocabulary = self.vocabulary[keep]
        self.idf = np.log((n + 1) / (df[keep] + 1)).astype(np.float32) + np.float32(0.1)

    def _find_rare(self, df: np.ndarray) -> None:
        """The rarest tokens of each item, so many that every leak holds one; and a filter of its tokens."""
        pairs, self.filter = [], np.zeros((len(self.items), CELLS), bool)
        for k, item in enumerate(self.items):
            tokens = np.array(item.tokens, np.uint64)
            self.filter[k, tokens & np.uint64(CELLS - 1)] = True
            at = self.places(tokens)
            rare = at[np.argsort(df[at], kind="stable")[: len(at) - item.least + 1]]
            pairs += [(w, k) for w in np.unique(rare).tolist()]
        word, self.rare_items = np.array(sorted(pairs), np.int64).T
        new = changes(word)
        self.rare_words, self.rare_first = self.vocabulary[word[new]], np.append(new, len(word))
        self.width = np.array([item.width for item in self.items])
        self.least = np.array([item.least for item in self.items])

    def around(self, tokens: np.ndarray, first: np.ndarray):
        """Tokens that are rare ones of an item, the item, and first and last token of the spans around
        each; of those alone where a span may hold enough of the item's tokens."""
        at = np.minimum(np.searchsorted(self.rare_words, tokens), len(self.rare_words) - 1)
        hit = np.flatnonzero(self.rare_words[at] == tokens)
        lo, n = self.rare_first[at[hit]], np.diff(self.rare_first)[at[hit]]
        place = np.repeat(hit, n)
        item = self.rare_items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        text = np.searchsorted(first, place, "right") - 1
        x = np.maximum(place - self.width[item] + 1, first[text])
        y = np.minimum(place + self.width[item], first[text + 1])
        low = (tokens & np.uint64(CELLS - 1)).astype(np.int64)
        size, good = np.cumsum(y - x), np.zeros(len(place), bool)
        a = 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AROUND, "right")))
            good[a:b] = self._dense(low, item[a:b], x[a:b], y[a:b])
            a = b
        return place[good], item[good], x[good], y[good], text[good]

    def _dense(self, low, item, x, y) -> np.ndarray:
        """Whether a span from x to y of the item's width may hold enough of its tokens."""
        n = y - x
        ends = np.cumsum(n)
        pair = np.repeat(np.arange(len(n)), n)
        inside = np.arange(ends[-1]) - (ends - n)[pair]
        total = np.zeros(len(pair) + 1, np.int32)
        np.cumsum(self.filter[item[pair], low[inside + x[pair]]], out=total[1:])
        last = np.minimum(np.arange(len(pair)) + self.width[item][pair], ends[pair])
        held = total[last] - total[:-1]
        return np.maximum.reduceat(held, ends - n) >= self.least[item]

    def cosine(self, k: int, tokens: np.ndarray) -> float:
        """The best cosine of one of an item's pieces with the tokens."""
        at, counts = np.unique(self.places(tokens), return_counts=True)
        x = np.log1p(counts[at >= 0]).astype(np.float32) @ self.basis[at[at >= 0]]
        return float((_unit(x[None]) @ self.pieces[self.owner == k].T).max())

    def direct(self, basis: np.ndarray) -> None:
        """Take the latent directions and place every piece of every item there."""
        self.basis = (basis * self.idf[:, None]).astype(np.float32)
        owner, rows, cells, weights = [], [], [], []
        for k, item in enumerate(self.items):
            at = self.places(np.array(item.tokens, np.uint64))
            for lo in range(0, max(len(at) - PIECE // 2, 1), PIECE // 2):
                known = np.unique(at[lo : lo + PIECE])
                known = known[known >= 0]
                cells.append(len(owner) * len(self.vocabulary) + known)
                weights.append(self.idf[known].sum())
                owner.append(k)
                rows.append(self.basis[at[lo : lo + PIECE][at[lo : lo + PIECE] >= 0]].sum(0))
        self.owner, self.pieces = np.array(owner), _unit(np.array(rows))
        self.cells, self.weights = np.concatenate(cells), np.array(weights)

    def shared(self, pieces: np.ndarray, blocks: np.ndarray, block: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each pair of piece and block the share of the piece's weight in the block; block, word: sorted."""
        lo, hi = np.searchsorted(block, blocks), np.searchsorted(block, blocks, "right")
        n = hi - lo
        pair = np.repeat(np.arange(len(blocks)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[pair]
        cell = pieces[pair] * len(self.vocabulary) + word[at]
        found = self.cells[np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)] == cell
        total = np.bincount(pair[found], self.idf[word[at[found]]], minlength=len(blocks))
        return total / self.weights[pieces]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of every block of BLOCK tokens, the last of a text may be shorter; and its text."""
    n = np.diff(first)
    count = -(-n // BLOCK)
    of = np.repeat(np.arange(len(n)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][of] + inside * BLOCK, of


def _matrix(bench: Benchmark, tokens: np.ndarray, starts: np.ndarray):
    """Block and word numbers with counts, sorted by block, of words in the vocabulary."""
    at = bench.places(tokens)
    known = np.flatnonzero(at >= 0)
    block = np.searchsorted(starts, known, "right") - 1
    keys, counts = np.unique(block * len(bench.vocabulary) + at[known], return_counts=True)
    return keys // len(bench.vocabulary), keys % len(bench.vocabulary), counts


def _projected(basis: np.ndarray, word: np.ndarray, x: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Sum of x times the words' rows of the basis for each of n blocks; block: sorted.

    Words are added by their rank in the block, so each step adds whole rows to different blocks.
    """
    out = np.zeros((n, basis.shape[1]), np.float32)
    ends = np.searchsorted(block, np.arange(n + 1))
    size = np.diff(ends)
    some = np.flatnonzero(size)
    k = 0
    while len(some):
        at = ends[some] + k
        out[some] += basis[word[at]] * x[at, None]
        k += 1
        some = some[size[some] > k]
    return out


def _document_frequencies(text: DataFrame, shared) -> tuple[np.ndarray, int]:
    """In how many blocks of all texts each word of the vocabulary comes, and how many there are."""

    def run(batches):
        bench = shared.value
        df, n = np.zeros(len(bench.vocabulary), np.int64), 0
        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0)):
                tokens, first = _tokens(data, bounds)
                starts, _ = _blocks(first)
                _, word, _ = _matrix(bench, tokens, starts)
                df += np.bincount(word, minlength=len(df))
                n += len(starts)
        some = np.flatnonzero(df)
        yield pa.record_batch(
            [pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["word", "n"]
        )

    found = text.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True))
    n = found.pop(-1, 0)
    df = np.zeros(len(shared.value.vocabulary), np.int64)
    df[list(found)] = list(found.values())
    return df, n


def _directions(text: DataFrame, shared, rank: int) -> np.ndarray:
    """The leading right singular vectors of all blocks' TF-IDF matrix A, words by rank.

    With a random test matrix W one pass over the texts sums A'(A W); from that and W the
    leading eigenvectors of A'A follow (the Nystrom form of the randomised decomposition).
    """
    size = len(shared.value.vocabulary)
    width = min(rank + EXTRA, size)
    test = np.linalg.qr(np.random.RandomState(0).standard_normal((size, width)))[0]
    probe = text.sparkSession.sparkContext.broadcast(test.astype(np.float32))

    def run(batches):
        bench, total = shared.value, np.zeros((size, width))
        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0)):
                tokens, first = _tokens(data, bounds)
                starts, _ = _blocks(first)
                block, word, counts = _matrix(bench, tokens, starts)
                x = np.log1p(counts).astype(np.float32) * bench.idf[word]
                norm = np.sqrt(np.bincount(block, x * x, minlength=len(starts)))
                x = (x / norm[block]).astype(np.float32)
                left = _projected(probe.value, word, x, block, len(starts))
                order = np.argsort(word, kind="stable")
                new = changes(word[order])
                if len(new):
                    rows = left[block[order]] * x[order, None]
                    total[word[order][new]] += np.add.reduceat(rows, new, axis=0)
        some = np.flatnonzero(total.any(1))
        yield pa.record_batch(
            [pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["word", "row"]
        )

    parts = text.mapInArrow(run, "word long, row array<double>")
    summed = parts.groupBy("word").agg(*[F.sum(F.col("row")[k]).alias(f"c{k}") for k in range(width)]).toArrow()
    image = np.zeros((size, width))
    if summed.num_rows:
        image[summed["word"].to_numpy()] = np.stack([summed[f"c{k}"].to_numpy() for k in range(width)], 1)
    small = test.T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    good = values > max(values.max(initial=0) * 1e-10, 1e-300)
    if not good.any():
        return test[:, :rank]
    left, _, _ = np.linalg.svd(image @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank]


def _verified(item: Item, near: np.ndarray) -> tuple[int, bool, int] | None:
    """The longest common subsequence of any span of the tokens near that passes, whether the answer is there, and
    where the span begins.

    Every span of the item's width is considered. One that begins with a token of the item stands for those that
    begin before it, and a span can't beat the best one if it holds no more of the item's tokens.
    """
    at = np.minimum(np.searchsorted(item.sorted, near), len(item.sorted) - 1)
    held = item.sorted[at] == near
    total = np.concatenate([[0], np.cumsum(held)])
    starts = np.flatnonzero(held)
    dense = total[np.minimum(starts + item.width, len(near))] - total[starts]
    enough = dense >= item.least
    if not enough.any():
        return None
    tokens = near.tolist()
    best: tuple[int, bool, int] | None = None
    for lo, most in zip(starts[enough].tolist(), dense[enough].tolist(), strict=True):
        if best and most <= best[0]:
            continue
        span = tokens[lo : lo + item.width]
        n = common_subsequence(item.masks, len(item.tokens), span)
        if n < item.least or best and n <= best[0]:
            continue
        answer = common_subsequence(item.answer_masks, len(item.answer), span) >= ANSWER * len(item.answer)
        if answer or n >= VERBATIM * len(item.tokens):
            best = n, answer, lo
            if n == len(item.tokens):
                break
    return best


def _found(bench: Benchmark, texts: pa.Array):
    """Row, item, common subsequence, whether the answer is there and cosine of every leak."""
    for lo, _, data, bounds in slices(texts):
        tokens, first = _tokens(data, bounds)
        starts, of = _blocks(first)
        if not len(starts):
            continue
        block, word, counts = _matrix(bench, tokens, starts)
        # Of two neighbouring blocks the first stands for both; too light ones can't share enough.
        weight = np.bincount(block, bench.idf[word], minlength=len(starts) + 1)
        joined = np.append(of[1:] == of[:-1], False)
        heavy = weight[:-1] + np.where(joined, weight[1:], 0) >= SHARED * bench.weights.min()
        heavy, joined = np.flatnonzero(heavy), joined[heavy]
        x = np.log1p(counts).astype(np.float32)
        used = np.zeros(len(starts) + 1, bool)
        used[heavy] = used[heavy + 1] = True
        inside = used[block]
        place = np.cumsum(used) - 1
        one = _projected(bench.basis, word[inside], x[inside], place[block[inside]], int(used.sum()))
        two = one[place[heavy]] + one[place[heavy + 1]] * joined[:, None]
        cosine = np.maximum(_unit(one[place[heavy]]) @ bench.pieces.T, _unit(two) @ bench.pieces.T)
        at, piece = np.nonzero(cosine >= COSINE)
        close, at, joined = cosine[at, piece], heavy[at], joined[at]
        near = bench.shared(piece, at, block, word)
        near[joined] += bench.shared(piece[joined], at[joined] + 1, block, word)
        good = near >= SHARED
        piece, at, close = piece[good], at[good], close[good]
        k, row = bench.owner[piece], of[at]
        reach = np.array([len(item.tokens) for item in bench.items])[k]
        x = np.maximum(starts[at] - reach, first[row])
        y = np.minimum(starts[at] + 2 * BLOCK + reach, first[row + 1])
        place, items, left, right, text = bench.around(tokens, first)
        none = np.full(len(place), -1.0)
        regions = _regions(
            np.append(row, text), np.append(k, items), np.append(x, left), np.append(y, right), np.append(close, none)
        )
        best: dict[tuple[int, int], tuple[int, bool, float]] = {}
        for row, k, x, y, c in regions:
            known = best.get((row, k), (0,))
            if known[0] == len(bench.items[k].tokens):
                continue
            found = _verified(bench.items[k], tokens[x:y])
            if found and found[0] > known[0]:
                n, answer, at = found
                best[row, k] = (n, answer, c if c >= 0 else _cosine_at(bench, k, tokens, x + at, starts, first, row))
        for (row, k), (n, answer, c) in best.items():
            yield lo + row, bench.items[k], n, answer, c


def _regions(row: np.ndarray, item: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: np.ndarray):
    """Places of one item in one text that overlap, as one, with the best cosine found there."""
    order = np.lexsort((x, item, row))
    now: list | None = None
    for r, k, lo, hi, c in zip(*(v[order].tolist() for v in (row, item, x, y, cosine)), strict=True):
        if now and now[:2] == [r, k] and lo < now[3]:
            now[3], now[4] = max(now[3], hi), max(now[4], c)
            continue
        if now:
            yield now
        now = [r, k, lo, hi, c]
    if now:
        yield now


def _cosine_at(bench: Benchmark, k: int, tokens, at: int, starts, first, row: int) -> float:
    b = starts[np.searchsorted(starts, at, "right") - 1]
    near = [tokens[max(lo, first[row]) : min(lo + n, first[row + 1])]
            for lo, n in ((b - BLOCK, 2 * BLOCK), (b, BLOCK), (b, 2 * BLOCK))]
    return max(bench.cosine(k, part) for part in near)


def _rounds(docs: DataFrame, benchmark: DataFrame, rank: int):
    """The benchmark ITEMS items at a time, learnt on all of docs, as broadcast variables."""
    spark, text = docs.sparkSession, docs.select("text")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    rounds = -(-items.count() // ITEMS)
    for k in range(rounds):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k).distinct()
        bench = Benchmark(sorted((r["item_id"] or 0, r["text"]) for r in mine.collect()))
        if bench.items:
            bench.weigh(*_document_frequencies(text, spark.sparkContext.broadcast(bench)))
            bench.direct(_directions(text, spark.sparkContext.broadcast(bench), rank))
            yield spark.sparkContext.broadcast(bench)


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, common, item_words, answer, cosine for every document an item leaked into.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A document leaks an item if
    VERBATIM of the item's tokens follow each other in it, others between allowed, or
    PARAPHRASE of them and its answer; cosine is that of the place where it was found, and no condition. Null and empty texts leak nothing, an item without tokens is in no
    document, repeated rows leak alike, an empty table gives no rows. Whole texts are
    searched. The benchmark goes to every task, ITEMS items a round.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, common long, item_words long, answer boolean, cosine double"
    out = None
    for shared in _rounds(docs, benchmark, rank):

        def run(batches, shared=shared):
            for batch in batches:
                found = list(_found(shared.value, batch.column(1)))
                rows, items, common, answers, cosines = zip(*found, strict=True) if found else [()] * 5
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([i.item_id for i in items], pa.int64()), pa.array(common, pa.int64()),
                        pa.array([len(i.tokens) for i in items], pa.int64()),
                        pa.array(answers, pa.bool_()), pa.array(cosines, pa.float64()),
                    ],
                    ["doc_id", "item_id", "common", "item_words", "answer", "cosine"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """The rows of docs into which no item leaked, by the rules of leaks(); all columns stay."""
    where = docs.columns.index("text")
    out = docs
    for shared in _rounds(docs, benchmark, rank):

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _found(shared.value, batch.column(where)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that a benchmark item leaked into."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
