"""N-gram Jaccard join by T-occurrence search.

Two texts link when the Jaccard likeness of their sets of word n-grams reaches num / den. A text can only link if
at least num / den of its shingles occur in other texts, and two texts only if they share enough shingles (the
required overlap T). The steps:

1. Shingle hashes are dealt by value; each bucket finds the shingles that occur once, and a text with too few
   others is done: it links with nothing. What travels is a few bytes a shingle, packed by batch; within a batch
   repeated shingles collapse to one entry, however common they are.
2. The texts left, picked in place by a small map of their ids' hashes, are grouped by equal sets (copies become one class), and their shingles ordered from rare to
   common. Linked classes share one of the first n - T + 1 shingles of each, so the connected components of
   "shares such a shingle" hold every link. These are the neighbourhoods.
3. In a neighbourhood, DivideSkip finds the links: of the inverted lists of a class's shingles, the short ones
   are merged through a heap (by counting where they are many), which leaves the classes that occur often enough;
   the long ones are only probed by binary search for those. Neighbourhoods beyond a size are cut into blocks: each
   block is searched by itself and each two blocks against each other, so that every pair is met once and no task
   holds more than two blocks; small neighbourhoods share a task.
4. A task verifies all links. It returns how many documents each class links with, and the links that join two trees
   of its forest; the components of these are the result.

Every step runs over all rows; buckets, blocks and bins only deal out the work.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; with fewer
words than n, the whole sequence is the one shingle; repeated rows are copies; rows of one id belong together; a
row without id takes no part and has no component; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import as_bytes, slices, written
from mosaiq.operators.components import connected_components

#: Bytes of text whose shingles are handled at once, and texts (their places are 16-bit numbers).
SLICE = 4 << 20
ROWS = 60_000
#: Bytes of text whose shingles meet in one bucket on average.
BUCKET = 8 << 20
#: Shingles that one block of a large neighbourhood, or one bin of small ones, holds on average.
BLOCK = 100_000
BIN = 400_000
#: DivideSkip's weight of probing against merging.
MU = 0.01
#: Lists of so many entries together are merged through a heap, longer ones by counting.
HEAP = 2_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """hash and place of text of every distinct shingle of each text, by hash and then by place."""
    import xxhash

    split = [t.lower().split() for t in texts]  # lower() and split() of bytes know ASCII only
    known = dict.fromkeys(w for words in split for w in words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    for i, w in enumerate(known):
        known[w] = i
    sizes = np.array([len(x) for x in split], np.int64)
    total = int(sizes.sum())
    words = hashes[np.fromiter((known[w] for x in split for w in x), np.int64, total)]
    first = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - n + 1, 0)
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    value = np.full(len(at), np.uint64(n))
    for k in range(n):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    place = np.repeat(np.arange(len(texts), dtype=np.int64), many)
    short = [(i, int(s)) for i, s in enumerate(sizes) if 0 < s < n]
    if short:
        extra = np.zeros(len(short), np.uint64)
        for j, (i, s) in enumerate(short):
            v = np.array([s], np.uint64)
            for w in words[first[i] : first[i] + s]:
                v = mixed(v * np.uint64(0x9E3779B97F4A7C15) + w)
            extra[j] = v[0]
        value, place = np.concatenate([value, extra]), np.concatenate([place, [i for i, _ in short]])
    order = np.lexsort((place, value)) if len(short) else np.argsort(value, kind="stable")
    value, place = value[order], place[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (place[1:] != place[:-1])
    return value[fresh], place[fresh]


# --- 1: how many shingles of each text occur elsewhere ---

_ALONE = np.uint16(0xFFFF)
_PACKED = "batch long, bucket int, ids array<long>, a binary, b binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    batch, bucket, ids, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(batch, pa.int64()), pa.array(bucket, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
        ["batch", "bucket", "ids", "a", "b"],
    )


def shared_counts(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and n_shared, at least the number of the text's shingles that other texts have.

    Buckets are as many as the texts' bytes ask for, so that a task's memory doesn't grow with the input."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, (size // BUCKET).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parts = (b.slice(at, ROWS) for b in slices(batches, 1, SLICE) for at in range(0, b.num_rows, ROWS))
        for seq, batch in enumerate(parts):
            key = part << 32 | seq
            value, place = shingles(as_bytes(batch.column(1)), n)
            counts = np.bincount(place, minlength=batch.num_rows).astype(np.uint32)
            rows = [(key, key % (1 << bits), batch.column(0).to_pylist(), counts.tobytes(), b"")]
            if len(value):
                # one entry for each shingle of the batch; which text it is from matters only if it is one
                starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                once = np.diff(np.append(starts, len(value))) == 1
                who = np.where(once, place[starts].astype(np.uint16), _ALONE)
                value = value[starts]
                bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
                low = (value >> np.uint64(32 - bits)).astype(np.uint32)
                ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                rows += [(key, b, None, low[i:j].tobytes(), who[i:j].tobytes()) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]
            yield _packed(rows)

    def count(t: pa.Table) -> pa.Table:
        out = []
        keys, lows, whos = [], [], []
        for key, bucket, ids, a, b in zip(*[c.to_pylist() for c in t.columns], strict=True):
            if ids is not None:
                out.append((key, bucket, ids, a, b))
            else:
                keys.append(key)
                lows.append(np.frombuffer(a, np.uint32))
                whos.append(np.frombuffer(b, np.uint16))
        if keys:
            low = np.concatenate(lows)
            order = np.argsort(low)
            ranked = low[order]
            different = np.ones(len(low) + 1, bool)
            different[1:-1] = ranked[1:] != ranked[:-1]
            single = order[different[:-1] & different[1:]]
            who = np.concatenate(whos)[single]
            which = np.searchsorted(np.cumsum([len(x) for x in lows]), single, side="right")
            mine = who != _ALONE
            pair, times = np.unique(which[mine] << 16 | who[mine], return_counts=True)
            ends = np.searchsorted(pair >> 16, np.arange(len(keys) + 1))
            for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if j > i:
                    out.append((keys[k], 0, None, (pair[i:j] & 0xFFFF).astype(np.uint16).tobytes(), times[i:j].astype(np.uint32).tobytes()))
        return pa.Table.from_batches([_packed(out)]) if out else pa.table(_packed([(0, 0, None, b"", b"")])).slice(0, 0)

    def total(t: pa.Table) -> pa.Table:
        rows = list(zip(*[c.to_pylist() for c in t.columns], strict=True))
        _, _, ids, sizes, _ = next(r for r in rows if r[2] is not None)
        sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
        alone = np.zeros(len(sizes), np.int64)
        for _, _, own, who, times in rows:
            if own is None:
                alone[np.frombuffer(who, np.uint16)] += np.frombuffer(times, np.uint32)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_shingles": sizes, "n_shared": sizes - alone})

    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, _PACKED)
    counted = dealt.groupBy("bucket").applyInArrow(count, _PACKED)
    return counted.groupBy("batch").applyInArrow(total, "doc_id long, n_shingles long, n_shared long")


# --- 2: classes of equal sets, and their neighbourhoods ---


#: Bits of the map of ids below (2 MB), a multiple of the 2**15 bits of one of Spark's bitmaps.
BITS = 1 << 24


def id_bits(ids: DataFrame) -> np.ndarray:
    """Which values of a hash the ids (doc_id) have, as BITS bits: a filter that loses no id. What reaches the
    driver is at most BITS / 2**15 bitmaps of 4 KB, whatever the number of ids."""
    hashed = ids.select((F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1).alias("h"))
    maps = hashed.groupBy(F.bitmap_bucket_number("h").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for row in maps:
        out[(row["at"] - 1) * 4096 : row["at"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def sets(docs: DataFrame, n: int, among: np.ndarray | None = None) -> DataFrame:
    """doc_id, the shingle set as sorted hashes, and a digest of it; texts without words are left out.
    among: id_bits; other ids are passed over before any work on their texts."""
    sent = docs.sparkSession.sparkContext.broadcast(among)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in slices(batches, 1, SLICE):
            if bits is not None:
                h = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((bits[h >> 3] >> (h & 7)) & 1 > 0))
            value, place = shingles(as_bytes(batch.column(1)), n)
            order = np.argsort(place, kind="stable")
            value, sizes = value[order].view(np.int64), np.bincount(place, minlength=batch.num_rows)
            ends = np.cumsum(sizes)
            digests = [hashlib.blake2b(value[e - s : e].tobytes(), digest_size=16).digest() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "hashes"])

    return docs.mapInArrow(run, "doc_id long, digest binary, hashes array<long>").filter("size(hashes) > 0")


def neighbourhoods(classes: DataFrame, num: int, den: int) -> DataFrame:
    """node, component: of the classes (class_id, n, hashes) that share one of their rarest shingles with others."""
    tokens = classes.select("class_id", "n", F.explode("hashes").alias("h"))
    common = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("class_id")
    required = F.ceil(F.col("n") * num / den)
    ranked = tokens.join(common, "h").select(
        "class_id",
        "h",
        # shingles of this class alone stand first and have no entry
        (F.row_number().over(own.orderBy("df", "h")) + F.col("n") - F.count("*").over(own)).alias("rank"),
        (F.col("n") - required + 1).alias("prefix"),
    )
    index = ranked.filter("rank <= prefix").select("class_id", "h")
    least = index.groupBy("h").agg(F.min("class_id").alias("v"), F.count("*").alias("many")).filter("many > 1")
    stars = index.join(least, "h").filter("class_id <> v").select(F.col("class_id").alias("u"), "v").distinct()
    return connected_components(stars)


# --- 3: T-occurrence search ---


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries that stand in at least so many of the sorted lists, and in how many."""
    if sum(map(len, lists)) <= HEAP:
        found = [(x, c) for x, c in ((x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*[x.tolist() for x in lists]))) if c >= least]
        return np.array([x for x, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    entries, counts = np.unique(np.concatenate(lists), return_counts=True)
    enough = counts >= least
    return entries[enough], counts[enough]


def links(sizes: np.ndarray, sets_: list[np.ndarray], weights: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of all links among the sets, pairs with likeness >= num / den: a forest (i, j) of their components, and the
    weight that each set links with. side (0 or 1 for each): only pairs of different sides count."""
    order = np.argsort(sizes, kind="stable")
    sizes, weights = sizes[order], weights[order]
    flat = np.concatenate([sets_[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    many = np.array([len(sets_[i]) for i in order], np.int64)
    owner = np.repeat(np.arange(len(order)), many)
    _, token = np.unique(flat, return_inverse=True)
    # an inverted list for each shingle (and side), end to end; each is sorted, as owners ascend
    apart = side is not None
    mine = side[order].astype(np.int64) if apart else np.zeros(len(order), np.int64)
    place = token * 2 + mine[owner] if apart else token
    df = np.bincount(place, minlength=2 * len(token) + 2)
    lists = owner[np.argsort(place, kind="stable")]
    ends = np.cumsum(df)
    begins = ends - df
    bounds = np.concatenate([[0], np.cumsum(many)])
    forest, out, linked = Forest(len(order)), [], np.zeros(len(order), np.int64)
    for i in range(len(order)):
        n = int(sizes[i])
        own = token[bounds[i] : bounds[i + 1]]
        own = own * 2 + 1 - mine[i] if apart else own
        own = own[df[own] > (0 if apart else 1)]
        need = -(-num * n // den)
        if len(own) < need:
            continue
        least_size = int(np.searchsorted(sizes, -(-num * n // den)))  # smaller sets can't link
        if least_size >= i:
            continue
        own = own[np.argsort(-df[own], kind="stable")]
        long = min(need - 1, int(need / (MU * math.log2(max(2, int(df[own[0]]))) + 1)))
        cut = lambda t, lo=least_size, hi=i: lists[begins[t] + np.searchsorted(lists[begins[t] : ends[t]], lo) : begins[t] + np.searchsorted(lists[begins[t] : ends[t]], hi)]
        found, counts = merged([x for t in own[long:] if len(x := cut(t))] or [np.zeros(0, np.int64)], need - long)
        wanted = -((-num * (n + sizes[found])) // (num + den))
        for k in range(long - 1, -1, -1):  # the shorter of the long lists first
            if not len(found):
                break
            entries = lists[begins[own[k]] : ends[own[k]]]
            at = np.minimum(np.searchsorted(entries, found), len(entries) - 1)
            counts = counts + (entries[at] == found)
            alive = counts + k >= wanted
            if not alive.all():
                found, counts, wanted = found[alive], counts[alive], wanted[alive]
        near = found[counts >= wanted]
        linked[i] += weights[near].sum()
        linked[near] += weights[i]
        for j in near.tolist():
            if forest.union(i, j):
                out.append((int(order[i]), int(order[j])))
    back = np.empty(len(order), np.int64)
    back[order] = linked
    return out, back


def search(classes: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """u, v, documents: links between classes (class_id, n, hashes, documents) that span the components of all links
    (documents null), and of each class how many documents it links with beyond itself (v null; parts to be summed)."""
    weights = classes.join(near, classes.class_id == near.node).select("class_id", "component", "n", "hashes", "documents")
    sizes = weights.groupBy("component").agg(F.sum("n").alias("weight"))
    bins = 1 + (sizes.filter(F.col("weight") <= BLOCK).agg(F.sum("weight")).first()[0] or 0) // BIN
    blocks = F.ceil(F.col("weight") / BLOCK)
    # a member of a large neighbourhood goes to its own block and to each pair of blocks that this is one of
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("long")
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda j: F.struct(F.col("component").alias("part"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j")),
    )
    shared = F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("part"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    dealt = (
        weights.join(sizes.withColumn("blocks", blocks), "component")
        .withColumn("block", block)
        .withColumn("to", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(shared)))
        .select("to.part", "to.i", "to.j", "block", "class_id", "n", "hashes", "documents")
    )

    def run(t: pa.Table) -> pa.Table:
        ids, i, j = t["class_id"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        column = t["hashes"].combine_chunks()
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        side = (t["block"].to_numpy() == j).astype(np.int64) if i != j else None
        found, linked = links(t["n"].to_numpy(), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], t["documents"].to_numpy(), num, den, side)
        some = np.flatnonzero(linked)
        none = [None]
        return pa.table(
            {
                "u": pa.array([ids[a] for a, _ in found] + ids[some].tolist(), pa.int64()),
                "v": pa.array([ids[b] for _, b in found] + none * len(some), pa.int64()),
                "documents": pa.array(none * len(found) + linked[some].tolist(), pa.int64()),
            }
        )

    return dealt.groupBy("part", "i", "j").applyInArrow(run, "u long, v long, documents long")


# --- 4: all of it ---


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to, its own included) and n_links (the other
    documents that this one links with, copies among them; of an id with several texts, the sum of theirs) of each row."""
    profile = written(shared_counts(docs, n), "profile")
    return _components(docs, profile, n, num, den)


def _components(docs: DataFrame, profile: DataFrame, n: int, num: int, den: int) -> DataFrame:
    able = profile.filter(f"n_shingles > 0 AND {den} * n_shared >= {num} * n_shingles AND doc_id IS NOT NULL").select("doc_id").distinct()
    # the texts stay where they are: the map of ids picks them, and only sets are joined with the exact ids
    members = written(sets(docs, n, id_bits(able)).join(able, "doc_id", "left_semi"), "sets")
    of = written(members.select("doc_id", F.xxhash64("digest").alias("class_id")).distinct(), "of")
    many = of.groupBy("class_id").agg(F.count("*").alias("documents"))
    by_digest = members.groupBy("digest").agg(F.first("hashes").alias("hashes"))
    by_digest = by_digest.select(F.xxhash64("digest").alias("class_id"), F.size("hashes").cast("long").alias("n"), "hashes")
    classes = written(by_digest.join(many, "class_id"), "classes")
    near = neighbourhoods(classes, num, den)
    # rows of one id with different texts belong together
    split = of.groupBy("doc_id").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v"), F.collect_set("class_id").alias("all")).filter("u <> v")
    same = split.select("u", F.explode("all").alias("v")).filter("u <> v")
    found = written(search(classes, near, num, den), "links")
    parts = connected_components(found.filter("v IS NOT NULL").select("u", "v").unionByName(same))
    others = found.filter("v IS NULL").groupBy(F.col("u").alias("class_id")).agg(F.sum("documents").alias("others"))
    linked = of.join(many, "class_id").join(others, "class_id", "left").join(parts, of.class_id == parts.node, "left")
    linked = linked.select("doc_id", F.coalesce("component", "class_id").alias("part"), (F.coalesce("others", F.lit(0)) + F.col("documents") - 1).alias("n_links"))
    least = linked.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    joined = linked.join(least, "part").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.sum("n_links").alias("n_links"))
    return profile.join(joined, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without all but one row of each component: the first by text of those of the least doc_id. Rows without id
    stay."""
    profile = written(shared_counts(docs, n), "profile")
    gone = _components(docs, profile, n, num, den).filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = written(profile.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    rows = F.struct(*docs.columns)
    numbered = kept.join(again, "doc_id", "left_semi").select(first.alias("r"), rows.alias("row")).filter("r = 1").select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(numbered)
