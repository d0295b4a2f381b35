"""Filter interaction audit by truth-table survival words.

With five filters there are 32 subsets of them. A document's word has bit S set if it survives the filters of the subset S,
so it is the conjunction, over the filters that it fails, of the truth table "S is without this filter". Positional
popcounts of the words of a part of the corpus count the survivors of every subset at once, and all that filters do to each
other in any order follows from these 32 numbers. The popcounts are carry-save: three words of one weight become a word of
their sums and a word of their carries, of twice the weight, for all 32 positions together.

One narrow shuffle of ids and digests finds identical texts; copies are summed up before they meet, so a large group of
copies is never in one task.

Defined cases: null text is empty, so it fails A alone (and E, if a smaller id has no text either); null source is the part
''; rows of a null id fail E never and make no other row fail it; rows of one id with one text are no copies of each other;
labels of an id that are repeated count if one of them says 1, and null labels don't; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import text_or_empty, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: For each filter, the bits of the subsets without it.
WITHOUT = [sum(1 << s for s in range(SUBSETS) if not s >> f & 1) for f in range(len(FILTERS))]
ALL = (1 << SUBSETS) - 1
ORDERS = ["".join(x) for x in itertools.permutations(FILTERS)]


def failures(text: Column) -> list[Column]:
    """Conditions of the filters A to D on the text: few words, few different ones, many capitals, symbols."""
    # a struct of one element is bound once, so that the words are split once
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    sizes = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return [sizes, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def survival_word(failed: list[Column]) -> Column:
    """The subsets that a document survives, as a number of 32 bits."""
    word = F.lit(ALL)
    for without, fails in zip(WITHOUT, failed, strict=False):
        word = word.bitwiseAND(F.when(fails, F.lit(without)).otherwise(F.lit(ALL)))
    return word


def positional_popcounts(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set in the words, each counted with its weight."""
    counts = np.zeros(SUBSETS, np.int64)
    bits = np.arange(SUBSETS, dtype=np.uint32)
    carried: list[np.ndarray] = []
    level = 0
    while carried or (weights >> level).any():
        now = np.concatenate([*carried, words[(weights >> level) & 1 == 1]])
        carried = []
        while len(now) > 2:  # full adders over thirds
            third = len(now) // 3
            a, b, c, rest = now[:third], now[third : 2 * third], now[2 * third : 3 * third], now[3 * third :]
            half = a ^ b
            carried.append((a & b) | (half & c))
            now = np.concatenate([half ^ c, rest])
        if len(now) == 2:
            carried.append(now[:1] & now[1:])
            now = now[:1] ^ now[1:]
        if len(now):
            counts += ((now[0] >> bits) & np.uint32(1)).astype(np.int64) << level
        level += 1
        # nothing carried: the words of higher weights, if any, go on
        carried = [c for c in carried if len(c) and c.any()]
    return counts


def words_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, word, n: how many documents (doc_id, text, source) of a part and label have each survival word.
    labels: doc_id, quality, toxic."""
    text = text_or_empty()
    sizes, capitals, symbols = failures(text)
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), sizes.alias("sizes"), capitals.alias("c"), symbols.alias("d"))
    n, distinct = F.col("sizes.n"), F.col("sizes.distinct")
    rows = rows.select("doc_id", "part", "digest", survival_word([n < 50, 100 * distinct < 65 * n, F.col("c"), F.col("d")]).alias("word"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias("good" if c == "quality" else c)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("marked")).agg(is_one("quality"), is_one("toxic"))
    marked = rows.join(marks, rows.doc_id == marks.marked, "left")
    # repeated rows first, on the partitioning by id; then what is left of each text, which copies reach as sums
    labelled = [F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    once = marked.select("doc_id", "part", "digest", "word", *labelled).groupBy("doc_id", "part", "digest", "word", "good", "toxic").agg(F.count("*").alias("rows"))
    known = F.col("doc_id").isNotNull()
    texts = once.groupBy("digest", "part", "word", "good", "toxic").agg(
        F.sum("rows").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("nameless"),
        F.min("doc_id").alias("least"),
        F.min_by("rows", "doc_id").alias("least_rows"),
    )
    # one text in one part and label is one row now, so what meets here is small however many copies there are
    texts = written(texts, "texts")
    both = texts.join(texts.groupBy("digest").agg(F.min("least").alias("first")), "digest", "left")
    stay = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("least_rows")).otherwise(F.lit(0))
    copy = F.col("word").bitwiseAND(F.lit(WITHOUT[4]))
    pair = F.explode(F.array(F.struct(F.col("word"), stay.alias("n")), F.struct(copy.alias("word"), (F.col("n") - stay).alias("n"))))
    return both.select("part", "good", "toxic", pair.alias("x")).select("part", "good", "toxic", "x.word", "x.n").filter("n > 0")


def survivors(words: DataFrame) -> DataFrame:
    """part, kind, counts: survivors of each of the 32 subsets of filters, of kind all, good and toxic. Each batch of words
    is counted in its task; the sums of a part meet afterwards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, part = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2))
            words, n = batch.column(3).to_numpy().astype(np.uint32), batch.column(4).to_numpy()
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(len(names) + 1))
            out: tuple[list, list, list] = ([], [], [])
            for i, name in enumerate(names):
                mine = order[ends[i] : ends[i + 1]]
                for kind, chosen in (("all", mine), ("good", mine[good[mine]]), ("toxic", mine[toxic[mine]])):
                    if len(chosen):
                        out[0].append(name)
                        out[1].append(kind)
                        out[2].append(positional_popcounts(words[chosen], n[chosen]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array([x.tolist() for x in out[2]], pa.list_(pa.int64()))], ["part", "kind", "counts"])

    partial = words.select("part", "good", "toxic", "word", "n").mapInArrow(count, "part string, kind string, counts array<bigint>")
    sums = partial.groupBy("part", "kind").agg(*[F.sum(F.get("counts", F.lit(s))).alias(f"s{s}") for s in range(SUBSETS)])
    return sums.select("part", "kind", F.array(*[F.col(f"s{s}") for s in range(SUBSETS)]).alias("counts"))


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report(counts: DataFrame) -> DataFrame:
    """REPORT: for each part, each order of the filters and each step what its filter does there. counts: of survivors()."""
    by_kind = [F.max(F.when(F.col("kind") == k, F.col("counts"))).alias(k) for k in ("all", "good", "toxic")]
    before, after, letter = [], [], []
    for order in ORDERS:
        gone = 0
        for x in order:
            before.append(gone)
            letter.append(FILTERS.index(x))
            gone |= 1 << letter[-1]
            after.append(gone)
    old, new, which = (np.array(x) for x in (before, after, letter))
    steps = len(FILTERS)
    orders, step = pa.array(np.repeat(ORDERS, steps), pa.string()), pa.array(np.tile(np.arange(1, steps + 1), len(ORDERS)), pa.int32())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *kinds in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                every, good, toxic = (np.array(k if k else [0] * SUBSETS, np.int64) for k in kinds)
                removed = every[old] - every[new]
                failing = every[0] - every[1 << np.arange(steps)]
                alone = every[(SUBSETS - 1) ^ (1 << np.arange(steps))] - every[SUBSETS - 1]
                share = np.bincount(which, removed, steps).astype(np.int64)
                values = [every[new], removed, failing[which] - removed, alone[which], good[old] - good[new], toxic[old] - toxic[new], share[which]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(old), pa.string()), orders, step, *map(pa.array, values)], [x.split()[0] for x in REPORT.split(", ")])

    return counts.groupBy("part").agg(*by_kind).mapInArrow(tell, REPORT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole report on documents (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    return report(survivors(words_of(docs, labels)))
