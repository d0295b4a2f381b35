"""Hierarchical multi-length packing.

Each document is tokenised once and cut into whole windows of the longest context and one rest. Rests are routed
to context-size tiers by length (the smallest tier that holds them). The plan works on the histogram of lengths
alone, at most one entry a length: from the longest down, every piece opens a window of its tier, and the gap is
filled by the largest pieces of the shorter tiers that fit. A window of a shorter tier must come out full, or it
becomes a window of the longest tier, so that padding stays small. The sequences of a tier are dealt to step groups
in the order of their tokens, there and back, so that groups get nearly equal numbers of sequences and of tokens.

Pieces find their place by rank among the pieces of their length. Ranks are counted by length and bucket, so a
length that a third of all documents share is spread over many tasks.

Defined cases: null text counts as empty, a document of the end id alone; documents of any length are cut; equal
rows are packed as often as they occur; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import slices, written

#: Context sizes, the longest first.
TIERS = (1024, 512, 256, 128)
#: A document's last id.
END = 0
#: A worker forgets its known stretches of text beyond so many (about 230 bytes each).
KNOWN = 1_600_000
#: Pieces that one bucket holds on average.
BUCKET_ROWS = 1 << 18


class Tokens:
    """A tokenizer with a table of the ids of stretches of text it has met.

    Between a character that is no white space and a following space a byte-level pre-token always ends, so a text
    is the concatenation of stretches that begin at such spaces, and so are its ids."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # by id: whether the token's text begins with a space (byte-level names it so)
        self.begins = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True
        self.doubled = regex.compile(r"\s\x20").search
        self.whole: dict[str, bytes] = {}  # ids of texts and of their first stretches
        self.spaced: dict[str, bytes] = {}  # ids of a space and the stretch

    def learn(self, into: dict[str, bytes], fresh: list[str], before: str) -> None:
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            found = self.tokenizer.encode_batch_fast([before + u for u in part], add_special_tokens=False)
            into.update((u, array("I", e.ids).tobytes()) for u, e in zip(part, found, strict=True))

    def learn_spaced(self, fresh: list[str]) -> None:
        """Stretches after a space are encoded many at a time: each begins at a token that begins with a space, and no other
        token does. What ends in white space, or would not come out so, is encoded by itself."""
        alone = [u for u in fresh if not u or u[-1].isspace()]
        fresh = [u for u in fresh if u and not u[-1].isspace()]
        for i in range(0, len(fresh), 256):
            part = fresh[i : i + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(part):
                raw, ends = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
                self.spaced.update((u, raw[a:b]) for u, a, b in zip(part, ends, ends[1:], strict=False))
            else:
                alone += part
        self.learn(self.spaced, alone, " ")

    def ids(self, texts: list[str], known: int = KNOWN) -> list[np.ndarray]:
        if len(self.spaced) + len(self.whole) > known:
            self.spaced.clear()
            self.whole.clear()
        cut = [[t] if self.doubled(t) else t.split(" ") for t in texts]
        first = [units.pop(0) for units in cut]
        self.learn(self.whole, list(set(first).difference(self.whole)), "")
        self.learn_spaced(list(set().union(*cut).difference(self.spaced)))
        whole, spaced = self.whole, self.spaced.__getitem__
        return [np.frombuffer(b"".join([whole[begin], *map(spaced, units)]), "<u4") for begin, units in zip(first, cut, strict=True)]


_loaded: dict[str, Tokens] = {}


def load(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = TIERS[0], known: int = KNOWN) -> DataFrame:
    """Of documents (doc_id, text): the pieces of each, whole windows first and then the rest.
    known: stretches of text that a worker remembers, for speed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(tokenizer)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in slices(batches, 1, 4 << 20):
            out: list[list] = [[], [], [], [], []]
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, tokens.ids([t or "" for t in batch.column(1).to_pylist()], known), strict=True):
                ids = np.append(ids, np.uint32(END))
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    for column, value in zip(out, (key, at, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Window_:
    """count sequences of context `tier`, each with pieces of these lengths in this order."""

    tier: int
    lengths: tuple[int, ...]
    count: int


def plan(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[Window_]:
    """Windows for so many pieces of each length, each piece in one of them."""
    left = {n: c for n, c in histogram.items() if c > 0}
    present = sorted(left)
    out: list[Window_] = []

    def filled(first: int, size: int) -> list[int]:
        chosen, used, gap = [first], {first: 1}, size - first
        at = bisect_right(present, gap) - 1
        while gap > 0 and at >= 0:
            n = present[at]
            spare = min((left[n] - used.get(n, 0)), gap // n)
            if spare > 0:
                chosen += [n] * spare
                used[n] = used.get(n, 0) + spare
                gap -= spare * n
            at = min(at, bisect_right(present, gap)) - 1
        return chosen

    while present:
        longest = present[-1]
        tier = min(t for t in tiers if t >= longest)
        chosen = filled(longest, tier)
        if tier < tiers[0] and sum(chosen) < tier:
            tier = tiers[0]
            chosen = filled(longest, tier)
        used: dict[int, int] = {}
        for n in chosen:
            used[n] = used.get(n, 0) + 1
        count = min(left[n] // k for n, k in used.items())
        out.append(Window_(tier, tuple(chosen), count))
        for n, k in used.items():
            left[n] -= k * count
            if not left[n]:
                del left[n]
                present.remove(n)
    return out


def places(windows: list[Window_]) -> list[tuple[int, int, int, int, int, int, int]]:
    """length, first and last rank, first sequence, offset, tier, first turn: where the pieces of those ranks go, and when
    their sequences are dealt, those with the most tokens of a tier first."""
    turns, turn = {}, dict[int, int]()
    for i in sorted(range(len(windows)), key=lambda i: (-sum(windows[i].lengths), i)):
        turns[i] = turn.get(windows[i].tier, 0)
        turn[windows[i].tier] = turns[i] + windows[i].count
    out, sequence, rank = [], 0, dict[int, int]()
    for i, w in enumerate(windows):
        offset = 0
        for n in w.lengths:
            lo = rank.get(n, 0)
            out.append((n, lo, lo + w.count - 1, sequence, offset, w.tier, turns[i]))
            rank[n] = lo + w.count
            offset += n
        sequence += w.count
    return out


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, sequences_per_step: int = 512, known: int = KNOWN) -> DataFrame:
    """The pieces of documents (doc_id, text) and, of each, sequence_id, offset, context (its tier) and step_group."""
    cut = written(pieces(docs, tokenizer, tiers[0], known), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    windows = plan(histogram, tiers)
    rows = places(windows)
    spark = docs.sparkSession
    where = spark.createDataFrame(rows, "length long, lo long, hi long, first_sequence long, offset long, context int, first_turn long")
    steps = {t: -(-sum(w.count for w in windows if w.tier == t) // sequences_per_step) for t in tiers}

    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS)
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        bucketed.withColumn("within", F.row_number().over(within) - 1)
        .join(first, ["length", "bucket"])
        .withColumn("rank", F.col("first_rank") + F.col("within"))
        .drop("bucket", "within", "first_rank")
    )
    # the plan has a few rows for each of at most tiers[0] lengths, whatever the input
    placed = ranked.join(F.broadcast(where), (ranked.length == where.length) & F.col("rank").between(F.col("lo"), F.col("hi"))).drop(where.length)
    sequence = F.col("first_sequence") + F.col("rank") - F.col("lo")
    groups = F.create_map(*[F.lit(x) for t, n in steps.items() for x in (t, max(n, 1))])[F.col("context")]
    turn = F.col("first_turn") + F.col("rank") - F.col("lo")
    back = F.floor(turn / groups) % 2 == 1
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        sequence.alias("sequence_id"),
        F.col("offset"),
        "context",
        F.when(back, groups - 1 - turn % groups).otherwise(turn % groups).cast("long").alias("step_group"),
    )
