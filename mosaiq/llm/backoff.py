"""Katz backoff language model.

Unigrams: Good-Turing discounted counts of all training tokens; what the discount frees belongs to unseen tokens.
Bigrams: Good-Turing discounted counts over all training words, however rare; words that training never saw are
one class. A bigram that was seen has its discounted relative frequency; otherwise the history's backoff weight
times the unigram model, recursively. Backoff weights are computed from exact sums over each history's seen words,
so that the probabilities after every history sum to one.

Words are 64-bit hashes, or where tasks hold them their places there; bigrams are looked up by two places, or by 63-bit hashes. A text's score is the sum of what its
words cost by backoff (as words and as histories) and of what every seen bigram differs from that. The counts are
rows by bucket of the history, where its words' probabilities and its own sums meet; histories with a large share
of all tokens are spread over the buckets. Counts and backoff weights of words with at least CACHED of all training
tokens (at most 1 / CACHED of them) are also held by tasks, which saves shuffling and changes no result.

Defined cases: null and empty texts are the end token alone; texts of any length are read whole; repeated rows
count as often as they occur; the crc of a null id is that of an empty string; without training rows every text
has the score of one unseen token for each token; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import slices, written

#: Counts above it aren't discounted.
K = 5
#: What is known of words with at least this share of the training tokens is sent to all tasks.
CACHED = 2.0**-20
#: Training tokens whose bigrams meet in one bucket on average: a task's memory doesn't grow with the input.
BUCKET_TOKENS = 1_000_000
#: Bytes of text handled at once, and texts (their places are 16-bit numbers).
SLICE = 8 << 20
END_WORD = b"\n"  # no word holds white space
#: Bits of a place in the cache, which has at most 1 / CACHED words and two classes.
PLACE_BITS = 21
#: In place of hashes: the class of words below a share that the caller sets, and the start of a text.
RARE, BEGIN = 0, 1


def trains(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def discounts(of_counts: dict[int, int], k: int = K) -> np.ndarray:
    """d[c] for c = 0 .. k + 1; d[k + 1] = 1.

    Good-Turing's from the counts of counts as they are; where these are too uneven for discounts between 0 and 1
    (copied texts make some counts too frequent), from counts of counts smoothed by a straight line in logarithms;
    where that fails, too, (c - 0.5) / c."""
    raw = np.array([of_counts.get(c, 0) for c in range(1, k + 2)], float)
    at = np.arange(1, k + 2)
    some = raw > 0
    tries = [raw]
    if some.sum() > 1:
        slope, start = np.polyfit(np.log(at[some]), np.log(raw[some]), 1)
        tries.append(np.exp(start + slope * np.log(at)))
    out = np.ones(k + 2)
    for n in tries:
        if (n > 0).all():
            common = (k + 1) * n[k] / n[0]
            d = ((at[:k] + 1) * n[1:] / (at[:k] * n[:k]) - common) / (1 - common) if common < 1 else np.ones(k)
            if ((d > 0) & (d < 1)).all():
                out[1 : k + 1] = d
                return out
    out[1 : k + 1] = (at[:k] - 0.5) / at[:k]
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, len(d) - 1)]


@dataclass
class Unigrams:
    """log10 p of a count: discounted share of n training tokens; unseen: all that is freed."""

    n: int
    distinct: int
    d: np.ndarray
    scale: float
    unseen: float

    @staticmethod
    def of(n: int, distinct: int, of_counts: dict[int, int]) -> Unigrams:
        d = discounts(of_counts)
        freed = sum(m * c * (1 - d[min(c, len(d) - 1)]) for c, m in of_counts.items())
        mass = 1 - freed / n if n else 0.0
        # all counts large: free as much as one token more
        scale = 1.0 if mass < 1 - 1e-12 else n / (n + 1) / mass
        return Unigrams(n, distinct, d, scale, 1 - mass * scale)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) * self.scale / max(self.n, 1), self.unseen)


def _tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, the code of every token (each text ends with END_WORD), and tokens of each text."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at the characters that bytes.split() splits at
    every = pc.dictionary_encode(lists.flatten())
    codes, words = every.indices.to_numpy().astype(np.int64), every.dictionary.cast(pa.large_binary()).to_pylist()
    many = pc.list_value_length(lists).to_numpy().astype(np.int64)
    # white space at an end leaves an empty word, whose code becomes the end's, if there is one; else the end's is new
    blank = words.index(b"") if b"" in words else len(words)
    whole = np.ones(len(codes), bool) if blank == len(words) else codes != blank
    place = np.repeat(np.arange(len(many)), many)[whole]
    sizes = np.bincount(place, minlength=len(many)) + 1
    words = [*words[:blank], END_WORD, *words[blank + 1 :]]
    out = np.full(int(sizes.sum()), blank, np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = codes[whole]
    return words, out, sizes


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, SLICE):
        for at in range(0, batch.num_rows, 60_000):
            yield batch.slice(at, 60_000)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (64-bit hash) and n: its training tokens; counted by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            train = [trains(i) for i in batch.column(0).to_pylist()]
            words, codes, _ = _tokens(batch.column(1).filter(pa.array(train)))
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(words)), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Cache:
    """Words with many tokens, and the classes, by ascending hash: training count, probability, and whether bigrams
    after it are spread over the buckets. classed: all other words are RARE in bigrams."""

    hash: np.ndarray
    count: np.ndarray
    p: np.ndarray
    hot: np.ndarray
    classed: bool

    @staticmethod
    def of(words: np.ndarray, counts: np.ndarray, unigrams: Unigrams, classed: bool, hot: float) -> Cache:
        p = unigrams.p(counts)
        classes = [(BEGIN, 0.0), *([(RARE, max(1 - p.sum(), unigrams.unseen))] if classed else [])]
        hashes = np.concatenate([words, np.array([c for c, _ in classes], np.int64)])
        order = np.argsort(hashes)
        filled = lambda x, more: np.concatenate([x, np.array(more, x.dtype)])[order]
        none = [0] * len(classes)
        return Cache(hashes[order], filled(counts, none), filled(p, [x for _, x in classes]), filled(counts >= hot, [True] * len(classes)), classed)

    @property
    def begin(self) -> int:
        return int(self.ids(np.array([BEGIN]))[0])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the cache; -1 for others."""
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def modelled(self, hashes: np.ndarray) -> np.ndarray:
        """What the words are in bigrams."""
        return np.where(self.ids(hashes) < 0, RARE, hashes) if self.classed else hashes


# --- packed rows: what tasks send each other about a batch of texts ---

_PACKED = "batch long, kind int, bucket int, ids array<long>, a binary, b binary, c binary"
#: Kinds: digests of the batch's texts; words that aren't cached; bigrams.
TEXTS, RARES, BIGRAMS = 0, 1, 2
#: Place in the cache, in rows of the table: a history that isn't there; a row of the unigrams.
OTHER, UNIGRAM = -1, -2


def _planes(keys: np.ndarray) -> bytes:
    """Ascending keys as the bytes of their differences, all first bytes before all second ones: the high ones are 0."""
    steps = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    """The way back."""
    steps = np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64).view(np.int64)


def _small(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x)


def _large(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PACKED.split(", ")])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(buckets)).astype(np.int64)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, where each distinct key starts in it, and how often it occurs."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(ranked)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def pair_keys(history: np.ndarray, word: np.ndarray, i: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of bigrams, by hashes and places in the cache: two places, or a hash if one isn't there, which is negative."""
    x = history.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(29))) + word.astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    hashed = ((x ^ (x >> np.uint64(29))) | np.uint64(1 << 63)).view(np.int64)
    return np.where((i >= 0) & (w >= 0), i.astype(np.int64) << PLACE_BITS | w, hashed)


def _placed(pairs: np.ndarray, modelled: np.ndarray, ids: np.ndarray, cache: Cache, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and bucket of bigrams (_pairs), of the hashes and the places of the words that codes stand for."""
    history, word = _of_pairs(pairs, modelled, BEGIN)
    i, w = _of_pairs(pairs, ids, cache.begin)
    keys = pair_keys(history, word, i, w)
    return keys, bucket_of(np.where((i >= 0) & cache.hot[i], keys, history), buckets)


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if j > i:
            yield b, order[i:j]


def _dealt(batch: int, kind: int, of: np.ndarray, places: np.ndarray, placed, buckets: int) -> list[tuple]:
    """Rows for each bucket: distinct keys, and of each how often it occurs and in which texts. placed gives the
    keys and buckets of distinct values of `of`."""
    order, starts, sizes = _grouped(of)
    distinct, bucket = placed(of[order][starts])
    rows = []
    for b, own in _by_bucket(bucket, buckets):
        own = own[np.argsort(distinct[own].view(np.uint64))]
        held = places[order[_ranges(starts[own], sizes[own])]].astype(np.uint16)
        rows.append((batch, kind, b, None, *map(_small, (_planes(distinct[own]), sizes[own].astype(np.uint32).tobytes(), held.tobytes()))))
    return rows


def _pairs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """history << 32 | word of every token, by codes; the history of a first one is code + 1 = 0."""
    history = np.empty_like(codes)
    history[1:] = codes[:-1] + 1
    history[np.cumsum(sizes) - sizes] = 0
    return history << 32 | codes


def _of_pairs(pairs: np.ndarray, of_code: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """What history and word have, of what codes and the start have."""
    return np.append(begin, of_code)[pairs >> 32], of_code[pairs & 0xFFFFFFFF]


def _named(ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """Words as places in the cache, and the hashes of those that aren't there."""
    return ids.astype(np.int32).tobytes() + hashes[ids < 0].tobytes()


def _unnamed(data: bytes, n: int, cache: Cache) -> np.ndarray:
    """The hashes of n words."""
    ids = np.frombuffer(data, np.int32, n)
    out = cache.hash[np.maximum(ids, 0)]
    out[ids < 0] = np.frombuffer(data, np.uint8)[4 * n :].copy().view(np.int64)
    return out


def _filled(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.fill_null(column, pa.scalar(0, column.type)).to_numpy()


#: Hashes are null where the places in the cache, i of the history and w of the word, aren't negative; and p, too, which
#: the cache has.
_TABLE = "bucket int, i int, w int, history long, word long, n long, p double"


def _table_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the table as a row a batch and bucket."""
    for batch in batches:
        bucket, i, w, history, word, n, p = map(_filled, batch.columns)
        rows = []
        for b in np.unique(bucket):
            own = bucket == b
            named = [history[own & (i < 0)], word[own & (w < 0)], p[own & (w < 0)]]
            blobs = (np.concatenate([i[own], w[own]]).tobytes(), n[own].tobytes(), b"".join(x.tobytes() for x in named))
            rows.append((0, BIGRAMS, int(b), None, *map(_small, blobs)))
        yield _packed(rows)


def _table_unpacked(t: pa.Table, cache: Cache) -> tuple[np.ndarray, ...]:
    """i, history, word, n, p and w of the rows, with the hashes and probabilities that the cache has."""
    parts = [tuple(np.zeros(0, k) for k in (np.int32, np.int64, np.int64, np.int64, float, np.int32))]
    for places, counts, named in zip(*[t[x].to_pylist() for x in "abc"], strict=True):
        i, w = np.frombuffer(_large(places), np.int32).reshape(2, -1)
        rest = np.frombuffer(_large(named), np.int64)
        # negative ones are no places, and a cache may be too short to count them from its end
        at, to = np.maximum(i, 0), np.maximum(w, 0)
        history, word, p = cache.hash[at], cache.hash[to], cache.p[to]
        k, m = int((i < 0).sum()), int((w < 0).sum())
        history[i < 0], word[w < 0], p[w < 0] = rest[:k], rest[k : k + m], rest[k + m :].view(float)
        parts.append((i, history, word, np.frombuffer(_large(counts), np.int64), p, w))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def bigram_counts(docs: DataFrame, cache, buckets: int) -> DataFrame:
    """The table of bigrams (_TABLE) with training occurrences, without probabilities; summed by batch before the
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cache.value
        for batch in _parts(batches):
            train = [trains(i) for i in batch.column(0).to_pylist()]
            words, codes, sizes = _tokens(batch.column(1).filter(pa.array(train)))
            pairs = _pairs(codes, sizes)
            order, starts, many = _grouped(pairs)
            modelled = c.modelled(_hashes(words))
            ids, distinct = c.ids(modelled), pairs[order][starts]
            history, word = _of_pairs(distinct, modelled, BEGIN)
            i, w = _of_pairs(distinct, ids, c.begin)
            rows = []
            for b, own in _by_bucket(_placed(distinct, modelled, ids, c, buckets)[1], buckets):
                # rows are by history: it once, and how many words follow
                h = history[own]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                numbers = np.concatenate([[len(first)], np.diff(np.append(first, len(h))), many[own]])
                rows.append((0, BIGRAMS, b, None, *map(_small, (_named(i[own[first]], h[first]), numbers.astype(np.uint32).tobytes(), _named(w[own], word[own])))))
            yield _packed(rows)

    def total(t: pa.Table) -> pa.Table:
        c = cache.value
        parts = []
        for a, b, w in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist(), strict=True):
            firsts, numbers = np.frombuffer(_large(b), np.uint32, 1)[0], np.frombuffer(_large(b), np.uint32)[1:]
            follow, many = numbers[:firsts], numbers[firsts:]
            parts.append((np.repeat(_unnamed(_large(a), int(firsts), c), follow), _unnamed(_large(w), len(many), c), many))
        history, word, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((word, history))
        history, word, counts = history[order], word[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.append(True, (history[1:] != history[:-1]) | (word[1:] != word[:-1])))
        history, word = history[starts], word[starts]
        i, w = c.ids(history), c.ids(word)
        bucket = np.full(len(starts), t["bucket"][0].as_py(), np.int32)
        hashes = pa.array(history, mask=i >= 0), pa.array(word, mask=w >= 0)
        columns = [bucket, i.astype(np.int32), w.astype(np.int32), *hashes, np.add.reduceat(counts, starts), pa.nulls(len(w), pa.float64())]
        return pa.table(dict(zip([x.split()[0] for x in _TABLE.split(", ")], columns, strict=True)))

    return docs.mapInArrow(run, _PACKED).groupBy("bucket").applyInArrow(total, _TABLE)


def factors(total: np.ndarray, mass: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of a history's factors for seen and for other words, of the sums over its seen bigrams: counts, discounted
    counts, and the words' probabilities."""
    seen, rest = mass / total, 1 - p
    # every word seen: nothing to back off to; nothing freed: free as much as one token more
    scale = np.where(rest < 1e-12, 1 / seen, np.where(seen > 1 - 1e-12, total / (total + 1) / seen, 1.0))
    # where every word is seen the weight is never used: 1
    backoff = np.where(rest < 1e-12, 1.0, (1 - scale * seen) / np.maximum(rest, 1e-300))
    return np.log10(scale / total), np.log10(backoff)


@dataclass
class Model:
    """Everything but the tables. By place in the cache: log_p its log10 unigram probability, log_scale and
    log_backoff for it as a history."""

    unigrams: Unigrams
    cache: Cache
    buckets: int
    d: np.ndarray
    log_p: np.ndarray
    log_scale: np.ndarray
    log_backoff: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.unigrams.n + self.unigrams.distinct + 1))

    def sums(self, i: np.ndarray, history: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all bigrams of a bucket: how log10 of their probability differs from that by backoff; and the histories
        that aren't cached, with the log10 of their backoff weights."""
        kept = discounted(n, self.d)
        scale, backoff = self.log_scale[i], self.log_backoff[i]
        others = np.flatnonzero(i == OTHER)
        histories, own = np.unique(history[others], return_inverse=True)
        if len(others):
            of_other = factors(*(np.bincount(own, x[others]) for x in (n, kept, p)))
            scale[others], backoff[others] = of_other[0][own], of_other[1][own]
            return np.log10(kept) + scale - backoff - np.log10(p), histories, of_other[1]
        return np.log10(kept) + scale - backoff - np.log10(p), histories, np.zeros(0)


def _cases(n: str, d: np.ndarray):
    """The discount of a count."""
    return F.coalesce(*[F.when(F.col(n) == c, F.lit(float(d[c]))) for c in range(1, len(d) - 1)], F.lit(1.0))


def train(docs: DataFrame, share: float | None = None, k: int = K) -> tuple[Model, DataFrame]:
    """The model and its n-gram table (_TABLE; a unigram's word is its history). Where a share is set, words with
    less of the training tokens are one class in bigrams."""
    spark = docs.sparkSession
    counted = written(word_counts(docs).withColumn("kind", F.lit(RARES)), "unigrams", ["kind"]).select("word", "n")
    small = {c: F.count_if(F.col("n") == c).alias(f"n{c}") for c in range(1, k + 2)}
    row = counted.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct"), *small.values()).first()
    tokens = row["tokens"] or 0
    buckets = max(32, -(-tokens // BUCKET_TOKENS))
    unigrams = Unigrams.of(tokens, row["distinct"], {c: row[f"n{c}"] for c in small})
    # at most 1 / CACHED (or 1 / share) rows
    least = max(1, tokens * (CACHED if share is None else share))
    found = counted.filter(F.col("n") >= least).toPandas()
    cache = Cache.of(found["word"].to_numpy(np.int64), found["n"].to_numpy(np.int64), unigrams, share is not None, tokens / (4 * buckets))
    if len(cache.hash) > 1 << PLACE_BITS:
        raise ValueError(f"share must be at least {CACHED}: tasks hold a word's place in {PLACE_BITS} bits")
    sent = spark.sparkContext.broadcast(cache)

    # as many folders whatever the number of buckets
    counts = written(bigram_counts(docs, sent, buckets).withColumn("part", F.col("bucket") % 64), "bigrams", ["part"]).drop("part")
    row = counts.agg(*small.values()).first()
    d = discounts({c: row[f"n{c}"] for c in small})
    # probabilities of the words that aren't cached
    p = F.col("m") * _cases("m", unigrams.d) * F.lit(unigrams.scale) / F.lit(max(tokens, 1))
    less = counted.filter(F.col("n") < least).select("word", F.col("n").alias("m"))
    rare = counts.filter("w < 0").drop("p").join(less, "word").withColumn("p", p)
    names = [x.split()[0] for x in _TABLE.split(", ")]
    bigrams = counts.filter("w >= 0").select(*names).unionByName(written(rare.select(*names).withColumn("kind", F.lit(BIGRAMS)), "rare_bigrams", ["kind"]).select(*names))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            i, own = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            w, n, p = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _filled(batch.column(3))
            values = [i.astype(np.int32), *(np.bincount(own, x, minlength=len(i)) for x in (n, discounted(n, d), np.where(w >= 0, c.p[w], p)))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["i", "total", "mass", "p"])

    added = bigrams.filter("i >= 0").select("i", "w", "n", "p").mapInArrow(add, "i int, total double, mass double, p double")
    sums = added.groupBy("i").agg(*[F.sum(x).alias(x) for x in ("total", "mass", "p")]).toPandas()
    log_scale, log_backoff = np.zeros(len(cache.hash)), np.zeros(len(cache.hash))
    at = sums["i"].to_numpy(np.int64)
    log_scale[at], log_backoff[at] = factors(*(sums[c].to_numpy(float) for c in ("total", "mass", "p")))
    with np.errstate(divide="ignore"):
        log_p = np.log10(cache.p)
    # tasks and tables must agree on buckets
    return Model(unigrams, cache, buckets, d, log_p, log_scale, log_backoff), bigrams.unionByName(_bucketed(counted.filter(F.col("n") < least), buckets))


def _bucketed(words: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = bucket_of(batch.column(0).to_numpy(), buckets).astype(np.int32)
            none = pa.nulls(len(bucket), pa.int64()), pa.nulls(len(bucket), pa.float64())
            columns = [bucket, np.full(len(bucket), UNIGRAM, np.int32), np.full(len(bucket), OTHER, np.int32), batch.column(0), none[0], batch.column(1), none[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [x.split()[0] for x in _TABLE.split(", ")])

    return words.select("word", "n").mapInArrow(run, _TABLE)


def _looked_up(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values by ascending key; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def score(docs: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark, buckets = docs.sparkSession, model.buckets
    sent = spark.sparkContext.broadcast(model)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        part = TaskContext.get().partitionId()
        begin = m.log_backoff[m.cache.ids(np.array([BEGIN]))]
        alone = m.log_p + m.log_backoff
        for seq, batch in enumerate(_parts(batches)):
            key = part << 32 | seq
            words, codes, sizes = _tokens(batch.column(1))
            hashes = _hashes(words)
            modelled, known_ids = m.cache.modelled(hashes), m.cache.ids(hashes)
            modelled_ids = m.cache.ids(modelled) if m.cache.classed else known_ids
            ids = known_ids[codes]
            place = np.repeat(np.arange(len(sizes)), sizes)
            often = ids >= 0
            summed = lambda x: np.bincount(place[often], x, minlength=len(sizes))  # noqa: E731, B023
            known = np.bincount(place[often], minlength=len(sizes))
            sums = np.concatenate([summed(m.base(m.cache.count[ids[often]])), summed(alone[ids[often]]) + begin])
            rows = [(key, TEXTS, key % buckets, batch.column(0).to_pylist(), sizes.tobytes(), known.astype(np.int64).tobytes(), sums.tobytes())]
            pairs = lambda x: _placed(x, modelled, modelled_ids, m.cache, buckets)  # noqa: E731, B023
            rows += _dealt(key, BIGRAMS, _pairs(codes, sizes), place, pairs, buckets)
            rows += _dealt(key, RARES, hashes[codes[~often]], place[~often], lambda x: (x, bucket_of(x, buckets)), buckets)
            yield _packed(rows)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The sums of each batch's texts over the keys of one kind and bucket: places, then score, base, known."""
        m = sent.value
        out: list[tuple] = []
        i, history, word, n, p, w = _table_unpacked(right, m.cache)
        one = i == UNIGRAM
        order = np.argsort(history[one])
        words, counts = history[one][order], n[one][order]
        i, history, word, n, p, w = (x[~one] for x in (i, history, word, n, p, w))
        differ, others, backoff = m.sums(i, history, n, p)
        keys = pair_keys(history, word, i, w)
        del history, word, p, w
        order = np.argsort(keys)
        keys, differ = keys[order], differ[order]
        of_rare = m.log_backoff[m.cache.ids(np.array([RARE]))] if m.cache.classed else 0.0
        for batch, kind, bucket, ids, a, b, c in zip(*[left[x].to_pylist() for x in ("batch", "kind", "bucket", "ids", "a", "b", "c")], strict=True):
            if kind == TEXTS:
                out.append((batch, kind, bucket, ids, a, b, c))
                continue
            wanted, sizes, places = _keys(_large(a)), np.frombuffer(_large(b), np.uint32), np.frombuffer(_large(c), np.uint16)
            if kind == BIGRAMS:
                values = [_looked_up(keys, wanted, differ)]
            else:
                found = _looked_up(words, wanted, counts)
                values = [np.log10(m.unigrams.p(found)) + _looked_up(others, wanted, backoff) + of_rare, m.base(found), (found > 0).astype(float)]
            some, where = np.unique(places, return_inverse=True)
            sums = np.concatenate([np.bincount(where, np.repeat(v, sizes), minlength=len(some)) for v in values])
            out.append((batch, kind, bucket, None, some.astype(np.uint16).tobytes(), sums.tobytes(), b""))
        return pa.Table.from_batches([_packed(out)])

    def total(t: pa.Table) -> pa.Table:
        rows = list(zip(*[x.to_pylist() for x in t.columns], strict=True))
        _, _, _, ids, sizes, known, sums = next(r for r in rows if r[1] == TEXTS)
        sizes, known = np.frombuffer(sizes, np.int64), np.frombuffer(known, np.int64).astype(float)
        base, points = np.frombuffer(sums).reshape(2, -1).copy()
        for _, kind, bucket, _, a, b, _ in sorted((r for r in rows if r[1] != TEXTS), key=lambda r: r[1:3]):
            at = np.frombuffer(a, np.uint16)
            values = np.frombuffer(b).reshape(-1, len(at))
            points[at] += values[0]
            if kind == RARES:
                base[at] += values[1]
                known[at] += values[2]
        n = sent.value.unigrams.n
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array([not trains(i) for i in ids]),
                "n_tokens": sizes,
                "n_known": known.astype(np.int64),
                "train_tokens": np.full(len(sizes), n, np.int64),
                "base_score": base,
                "score": points,
            }
        )

    dealt = docs.mapInArrow(deal, _PACKED)
    packed = table.select(*[x.split()[0] for x in _TABLE.split(", ")]).mapInArrow(_table_packed, _PACKED)
    joined = dealt.groupBy("bucket").cogroup(packed.groupBy("bucket")).applyInArrow(meet, _PACKED)
    return joined.groupBy("batch").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model, table = train(docs)
    return score(docs, model, table)
