"""How the tokens of two tokenizers lie on each other, over a whole corpus.

Texts are deduplicated exactly first: they are grouped by their full text, copies folded before the
shuffle, and each distinct text is tokenised and aligned once; its tokens and where they end are written
to the shared folder. From there pairs of ids are counted over all links, each text by its multiplicity, and the
counts go back to the links. What was measured then joins the documents by the text's SHA-256.

Most links belong to few pairs. The most frequent pairs, HOT_PAIRS at most, are broadcast; links of all others
meet their counts in a join.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import least_count, table
from lockstep.scratch import new_dir

# Ranks of the byte-level vocabulary: ids and tokens are those of its .json file, and it is encoded faster.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts of about this many bytes are aligned at a time; a longer one by itself.
SLICE_BYTES = 500_000
# Links that are counted at a time, and pairs that a task holds before it sends their counts.
SLICE_LINKS, HELD_PAIRS = 1_000_000, 4_000_000
HOT_PAIRS = 1 << 20


# --- tokenizers ------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """A tokenizer by its file, whose content travels to the tasks. Its kind is told by the file's name.

    .tiktoken: ranks of byte-level BPE, cut by PATTERN; .json: a `tokenizers` file of byte-level BPE;
    .model: SentencePiece, which puts the leading space itself. Strings of special tokens in a text are plain text.
    """

    kind: str
    content: bytes = field(repr=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls(Path(path).suffix, Path(path).read_bytes())

    def __getstate__(self):
        return {"kind": self.kind, "content": self.content}

    @cached_property
    def _loaded(self):
        if self.kind == ".tiktoken":
            import tiktoken

            lines = map(bytes.split, self.content.splitlines())
            ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
            return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.kind == ".json":
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_str(self.content.decode())
            loaded.encode_special_tokens = True
            return loaded
        if self.kind == ".model":
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_proto=self.content)
        raise ValueError(f"no tokenizer is known by the ending {self.kind!r}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        if self.kind == ".tiktoken":
            return [self._loaded.encode_ordinary(" " + t) for t in texts]
        if self.kind == ".json":
            found = self._loaded.encode_batch([" " + t for t in texts], add_special_tokens=False)
            return [e.ids for e in found]
        return self._loaded.encode(texts, num_threads=1)

    def _tokens(self) -> list[bytes]:
        loaded = self._loaded
        if self.kind == ".tiktoken":
            return [loaded.decode_single_token_bytes(k) for k in range(loaded.n_vocab)]
        if self.kind == ".json":
            # Byte-level files write printable bytes as themselves and the others from U+0100 on.
            shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            rest = [b for b in range(256) if b not in shown]
            byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
            vocabulary = json.loads(self.content)["model"]["vocab"]
            out = [b""] * (max(vocabulary.values()) + 1)
            for token, k in vocabulary.items():
                out[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
            return out
        out = []
        for k in range(loaded.get_piece_size()):
            piece = loaded.id_to_piece(k)
            out.append(bytes([int(piece[3:5], 16)]) if loaded.is_byte(k) else piece.replace("▁", " ").encode())
        return out

    @cached_property
    def bytes_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, where each begins, and how long it is."""
        tokens = self._tokens()
        sizes = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    @cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id as decimal digits, left-aligned with room for one character more; and how many."""
        n = len(self.bytes_of[1])
        wide = len(str(max(n - 1, 0)))
        texts = [str(k) for k in range(n)]
        flat = "".join(t.ljust(wide + 1) for t in texts).encode()
        return np.frombuffer(flat, np.uint8).reshape(n, wide + 1), np.array([len(t) for t in texts])

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, joined."""
        flat, begins, sizes = self.bytes_of
        size = sizes[ids]
        ends = np.cumsum(size)
        return flat[np.repeat(begins[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _id_type(n: int):
    return np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")


# --- alignment of a few texts ------------------------------------------------------------


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(ids) for ids in found], np.int64)
    return np.fromiter((k for ids in found for k in ids), np.int64, n.sum()), n


def _parted(values: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the texts that stay, and how many each has."""
    return values[np.repeat(keep, sizes)], np.where(keep, sizes, 0)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each text's values; sizes: how many each has."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


@dataclass
class Aligned:
    """Tokens of some texts. a_ends and b_ends have a flag for each link: does its token end there?"""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    n_links: np.ndarray

    @property
    def n_groups(self) -> np.ndarray:
        return _sums(self.a_ends & self.b_ends, self.n_links)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each link's two tokens."""
        return self.a[np.cumsum(self.a_ends) - self.a_ends], self.b[np.cumsum(self.b_ends) - self.b_ends]


def align(texts: list[str], one: Vocabulary, two: Vocabulary) -> Aligned:
    """The tokens of texts by two vocabularies; none where joined tokens differ from a space and the text."""
    raws = [b" " + t.encode() for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    good = np.ones(len(texts), bool)
    tokens = []
    for vocabulary in (one, two):
        ids, n = _flat(vocabulary.encode(texts))
        same = _sums(vocabulary.bytes_of[2][ids], n) == sizes
        kept, m = _parted(ids, n, same)
        spelled, (given, width) = vocabulary.spelled(kept), _parted(raw, sizes, same)
        good &= same & (_sums(spelled != given, width) == 0)
        tokens.append((ids, n))
    (a, n_a), (b, n_b) = (_parted(ids, n, good) for ids, n in tokens)
    width = np.where(good, sizes, 0)
    ends = []
    for vocabulary, ids in ((one, a), (two, b)):
        mark = np.zeros(width.sum() + 1, bool)
        mark[np.cumsum(vocabulary.bytes_of[2][ids])] = True
        ends.append(mark)
    at = np.flatnonzero(ends[0] | ends[1])
    upto = np.searchsorted(at, np.cumsum(width), "right")
    n_links = np.diff(np.concatenate([[0], upto]))
    return Aligned(a, b, n_a, n_b, ends[0][at], ends[1][at], n_links)


def written(found: Aligned, one: Vocabulary, two: Vocabulary) -> list[bytes]:
    """Each text's groups as 'a1,a2|b1;a3|b2,b3'; empty without tokens."""
    both = found.a_ends & found.b_ends
    group = np.cumsum(both) - both
    group_a, group_b = group[found.a_ends], group[found.b_ends]
    n = len(found.a) + len(found.b)
    if not n:
        return [b""] * len(found.n_a)
    after_a = np.concatenate([[0], np.cumsum(np.bincount(group_b))])[group_a]
    after_b = np.cumsum(np.bincount(group_a))[group_b]
    place_a, place_b = np.arange(len(found.a)) + after_a, np.arange(len(found.b)) + after_b
    wide = max(one.digits[0].shape[1], two.digits[0].shape[1])
    rows, sizes = np.zeros((n, wide), np.uint8), np.zeros(n, np.int64)
    for ids, place, of, vocabulary, end in (
        (found.a, place_a, group_a, one, b"|"), (found.b, place_b, group_b, two, b";"),
    ):
        digits, size = vocabulary.digits
        part = np.zeros((len(ids), wide), np.uint8)
        part[:, : digits.shape[1]] = digits[ids]
        last = np.ones(len(ids), bool)
        last[:-1] = of[1:] != of[:-1]
        part[np.arange(len(ids)), size[ids]] = np.where(last, ord(end), ord(","))
        rows[place], sizes[place] = part, size[ids] + 1
    flat = rows[np.arange(wide) < sizes[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(found.n_a + found.n_b)].tolist()
    return [flat[lo : max(lo, hi - 1)] for lo, hi in zip([0, *ends], ends, strict=False)]


# --- over a corpus ------------------------------------------------------------------------

_MEASURES = "n_a long, n_b long, n_groups long, n_links long"
_TOKENS = f"key binary, times long, {_MEASURES}, groups_sha256 string, a binary, b binary, ends binary"


def _tokenised(texts: DataFrame, one: Vocabulary, two: Vocabulary) -> DataFrame:
    """Every distinct text with its tokens, written to the shared folder. texts: key, times, text."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((one, two))

    def rows(part: list[tuple], one: Vocabulary, two: Vocabulary) -> pa.RecordBatch:
        keys, times, some = zip(*part, strict=True)
        found = align(list(some), one, two)
        hashes = [sha256(g).hexdigest() if g else "" for g in written(found, one, two)]
        ends = np.stack([found.a_ends, found.b_ends], 1)
        links = np.cumsum(found.n_links).tolist()
        columns = [
            pa.array(keys, pa.binary()), pa.array(times, pa.int64()), pa.array(found.n_a), pa.array(found.n_b),
            pa.array(found.n_groups), pa.array(found.n_links), pa.array(hashes, pa.string()),
        ]
        for ids, n, vocabulary in ((found.a, found.n_a, one), (found.b, found.n_b, two)):
            ids, upto = ids.astype(_id_type(len(vocabulary.bytes_of[1]))), np.cumsum(n).tolist()
            parts = [ids[lo:hi].tobytes() for lo, hi in zip([0, *upto], upto, strict=False)]
            columns.append(pa.array(parts, pa.binary()))
        parts = [np.packbits(ends[lo:hi].reshape(-1)).tobytes() for lo, hi in zip([0, *links], links, strict=False)]
        columns.append(pa.array(parts, pa.binary()))
        return pa.record_batch(columns, [c.split()[0] for c in _TOKENS.split(", ")])

    def work(batches):
        part, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part.append(row)
                held += len(row[2])
                if held >= SLICE_BYTES:
                    yield rows(part, *shared.value)
                    part, held = [], 0
        if part:
            yield rows(part, *shared.value)

    path = new_dir(spark, "tokens")
    texts.select("key", "times", "text").mapInArrow(work, _TOKENS).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _restored(batch: pa.RecordBatch, type_a, type_b) -> Iterator[tuple[int, int, Aligned]]:
    """First and last row of a few texts, and their tokens; the batch has n_a, n_b, n_links, a, b and ends."""
    columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    n_a, n_b, n_links = (columns[c].to_numpy() for c in ("n_a", "n_b", "n_links"))
    upto = np.cumsum(n_links)
    lo = 0
    while lo < len(n_links):
        before = upto[lo] - n_links[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE_LINKS, "right")))
        a, b, ends = (columns[c].slice(lo, hi - lo).to_pylist() for c in ("a", "b", "ends"))
        size = [2 * k for k in n_links[lo:hi].tolist()]
        bits = [np.unpackbits(np.frombuffer(e, np.uint8), count=k) for e, k in zip(ends, size, strict=True)]
        flags = np.concatenate(bits).reshape(-1, 2).astype(bool)
        yield lo, hi, Aligned(
            np.frombuffer(b"".join(a), type_a).astype(np.int64), np.frombuffer(b"".join(b), type_b).astype(np.int64),
            n_a[lo:hi], n_b[lo:hi], flags[:, 0], flags[:, 1], n_links[lo:hi],
        )
        lo = hi


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(codes), return_inverse=True)
    # Counts are whole numbers far below 2**53.
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


@dataclass
class Alignment:
    """measures: doc_id and what was measured; pairs: a, b, n and whether n is the highest of b's pairs."""

    measures: DataFrame
    pairs: DataFrame


def align_corpus(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> Alignment:
    """Align the tokens of two tokenizers in all texts of docs (doc_id, text); other columns are ignored.

    Each text is tokenised with a space before it. Where tokens of both end at one byte, a group ends; a link
    is a pair of tokens whose bytes overlap. measures has one row per row of docs: n_a and n_b tokens,
    n_groups, n_links, n_best (links whose pair of ids is the most frequent one of its b, ties included),
    count_sum (over all links, how often the link's pair of ids is linked in the corpus) and groups_sha256
    of the groups written as 'a1,a2|b1;a3|b2,b3'. Null and empty texts, and those whose tokens do not
    spell the text, have no tokens: all zeros and an empty hash. Repeated rows and texts count each; no
    rows give no rows. Texts are held whole, so the longest has to fit in a task some thirty times.
    """
    spark = docs.sparkSession
    one, two = Vocabulary.read(a_path), Vocabulary.read(b_path)
    key = F.unhex(F.sha2(F.col("text"), 256))
    filled = docs.select("doc_id", "text")
    distinct = filled.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("times"))
    tokens = _tokenised(distinct.select(key.alias("key"), "times", "text"), one, two)

    size_a, size_b = (len(v.bytes_of[1]) for v in (one, two))
    type_a, type_b = _id_type(size_a), _id_type(size_b)

    def counted(batches):
        codes, counts, held = [], [], 0
        for batch in batches:
            times = batch.column(0).to_numpy()
            for lo, hi, found in _restored(batch, type_a, type_b):
                a, b = found.links()
                code, of = a * size_b + b, np.repeat(times[lo:hi], found.n_links)
                for t in np.unique(times[lo:hi]).tolist():
                    some, n = np.unique(code[of == t], return_counts=True)
                    codes.append(some)
                    counts.append(n * t)
                    held += len(some)
                if held >= HELD_PAIRS:
                    code, n = _merged(codes, counts)
                    codes, counts, held = [code], [n], len(code)
                    if held >= HELD_PAIRS:
                        yield pa.record_batch([pa.array(code), pa.array(n)], ["pair", "n"])
                        codes, counts, held = [], [], 0
        if held:
            code, n = _merged(codes, counts)
            yield pa.record_batch([pa.array(code), pa.array(n)], ["pair", "n"])

    stored = ["n_a", "n_b", "n_links", "a", "b", "ends"]
    per_task = tokens.where("n_links > 0").select("times", *stored).mapInArrow(counted, "pair long, n long")
    path = new_dir(spark, "pairs")
    per_task.groupBy("pair").agg(F.sum("n").alias("n")).write.parquet(path)
    pairs = spark.read.parquet(path).select(
        "pair", (F.col("pair") / size_b).cast("long").alias("a"), (F.col("pair") % size_b).alias("b"), "n"
    )
    highest = pairs.groupBy("b").agg(F.max("n").alias("highest"))  # a row for each id of b at most
    pairs = pairs.join(F.broadcast(highest), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))

    least = least_count(pairs, "n", HOT_PAIRS)
    hot = pairs.where(F.col("n") >= least).select("pair", "n", "best").toArrow()  # HOT_PAIRS rows at most
    order = np.argsort(hot["pair"].to_numpy())
    known = spark.sparkContext.broadcast(
        tuple(hot[c].to_numpy()[order] for c in ("pair", "n")) + (hot["best"].to_numpy(zero_copy_only=False)[order],)
    )

    def met(found: Aligned):
        """The distinct pairs of some texts, which one each link has, and which of the known ones each is."""
        a, b = found.links()
        codes, which = np.unique(a * size_b + b, return_inverse=True)
        hot_codes = known.value[0]
        at = np.minimum(np.searchsorted(hot_codes, codes), max(len(hot_codes) - 1, 0))
        return codes, which, at, hot_codes[at] == codes if len(hot_codes) else np.zeros(len(codes), bool)

    def measured(batches):
        _, n, best = known.value
        for batch in batches:
            for lo, hi, found in _restored(batch, type_a, type_b):
                _, which, at, is_hot = met(found)
                good = np.where(is_hot, best[at], False) if len(n) else is_hot
                count = np.where(is_hot, n[at], 0) if len(n) else is_hot.astype(np.int64)
                yield pa.record_batch(
                    [
                        *(c.slice(lo, hi - lo) for c in batch.columns[:6]),
                        pa.array(_sums(good[which], found.n_links)), pa.array(_sums(count[which], found.n_links)),
                    ],
                    [*batch.schema.names[:6], "n_best", "count_sum"],
                )

    def rare(batches):
        for batch in batches:
            for lo, hi, found in _restored(batch, type_a, type_b):
                codes, which, _, is_hot = met(found)
                cold = ~is_hot[which]
                of = np.repeat(np.arange(lo, hi), found.n_links)[cold]
                order = np.lexsort((which[cold], of))
                row, pair = of[order], which[cold][order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
                first = np.flatnonzero(new)
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(row[first])), pa.array(codes[pair[first]]),
                        pa.array(np.diff(np.append(first, len(row)))),
                    ],
                    ["key", "pair", "links"],
                )

    of_texts = tokens.select("key", "groups_sha256", "n_groups", *stored).mapInArrow(
        measured,
        "key binary, groups_sha256 string, n_groups long, n_a long, n_b long, n_links long, n_best long, count_sum long",
    )
    if least > 1:
        more = (
            tokens.where("n_links > 0").select("key", *stored)
            .mapInArrow(rare, "key binary, pair long, links long")
            .join(pairs, "pair")
            .groupBy("key")
            .agg(
                F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
                F.sum(F.col("links") * F.col("n")).alias("more_count"),
            )
        )
        of_texts = of_texts.join(more, "key", "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                "count_sum": F.col("count_sum") + F.coalesce("more_count", F.lit(0)),
            }
        )
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measures = filled.select("doc_id", key.alias("key")).join(of_texts, "key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
    return Alignment(measures, pairs.drop("pair"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' tokens of all documents on each other."""
    return align_corpus(table(spark, sf_dir, "documents")).measures
