"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q, at least twice as long as q and at least `least` words long, that no
neighbouring word extends. Scales tau = 2, 4, 8, ... each look for the periods from 3 tau - 1 to 6 tau - 2:

- Positions are *highly periodic* where the next tau words have a period of at most tau / 3. They lie in runs that lower
  scales have found.
- A position is *synchronising* if, of the hashes of the tau-word windows at it and at the next tau positions, highly
  periodic ones left out, the least belongs to the first or the last. That depends on the next 2 tau words alone, and of any
  tau positions one is synchronising unless the next 3 tau - 1 words have a period of at most tau / 3. A run of period q so
  holds a synchronising i with the same 2 tau words at i and i + q: such pairs within 6 tau propose periods. They can't be
  many, as equal contexts lie more than tau / 3 apart.
- What that omits are runs whose first half is itself highly periodic with a period p. Their halves lie in two runs of
  period p that touch, at equal phases: each such pair of runs proposes the distances at which its phases agree.

Every proposal grows by longest common extensions, and of equal stretches the least period stays. A slice of texts is worked
through at once, each ended by a word of its own, which no run can hold; windows are compared by 64-bit hashes.

Defined cases: null and empty texts have no words and no runs; a text of any length is one row's work, in memory
proportional to its words times the logarithm of its longest repeat; equal texts get equal runs; an empty table gives an
empty one; extra columns are passed on, but for those named as results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import as_bytes, slices

#: The shortest run that is reported, in words.
LEAST = 12
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of the windows of 1, 2, 4, ... words of a sequence; equal windows have equal hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.levels = [_mixed(words.astype(np.uint64) + _MIX[0])]

    def level(self, k: int) -> np.ndarray:
        """Hashes of the windows of 2^k words, one for each place that has so many."""
        while len(self.levels) <= k:
            half = self.levels[-1]
            step = 1 << (len(self.levels) - 1)
            self.levels.append(_mixed(half[: max(0, len(half) - step)] * _MIX[0] + half[step:] + np.uint64(len(self.levels))))
        return self.levels[k]

    def grow(self, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest [a, b) around the given in which all words equal those q places later."""
        a, b = a.copy(), b.copy()
        k = 0
        live = np.arange(len(a))
        # upwards while whole windows agree, then down again
        for right in (True, False):
            k, live = 0, np.arange(len(a))
            while len(live):
                live = live[self._step(a, b, q, live, k, right)]
                k += 1
            for j in range(k - 1, -1, -1):
                self._step(a, b, q, np.arange(len(a)), j, right)
        return a, b

    def _step(self, a: np.ndarray, b: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int, right: bool) -> np.ndarray:
        """Grows rows by 2^k words where these agree; which did."""
        hashes, size = self.level(k), 1 << k
        at = b[rows] if right else a[rows] - size
        there = at + q[rows]
        ok = (at >= 0) & (there < len(hashes))
        ok[ok] = hashes[at[ok]] == hashes[there[ok]]
        (b if right else a)[rows[ok]] += size if right else -size
        return ok


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _marked(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some [start, end)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def synchronising(windows: Windows, k: int, highly_periodic: np.ndarray) -> np.ndarray:
    """The synchronising positions at scale 2^k."""
    tau = 1 << k
    hashes = windows.level(k)
    n = len(hashes) - tau
    if n <= 0:
        return np.zeros(0, np.int64)
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    rank = np.where(highly_periodic[: len(hashes)], worst, np.minimum(hashes, worst - np.uint64(1)))
    least = rank
    for j in range(k):
        least = np.minimum(least[: len(least) - (1 << j)], least[1 << j :])
    least = np.minimum(least[:n], rank[tau : tau + n])
    return np.flatnonzero((least != worst) & ((rank[:n] == least) | (rank[tau : tau + n] == least)))


def _by_context(windows: Windows, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, ordered by their contexts of 2^(k + 1) words, and the contexts' hashes."""
    hashes = windows.level(k + 1)[places]
    order = np.lexsort((places, hashes))
    return places[order], hashes[order]


def _proposals(at: np.ndarray, hashes: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[a, b) and q of pairs of places with one context (of `width` words), low to high apart; those that follow on each
    other in one stretch are joined."""
    found_at, found_q = [], []
    lag = 1
    while lag < len(at):
        apart = at[lag:] - at[:-lag]
        near = (hashes[lag:] == hashes[:-lag]) & (apart < high)
        if not near.any():
            break
        hit = near & (apart >= low)
        found_at.append(at[:-lag][hit])
        found_q.append(apart[hit])
        lag += 1
    if not found_at:
        return (np.zeros(0, np.int64),) * 3
    a, q = np.concatenate(found_at), np.concatenate(found_q)
    order = np.lexsort((a, q))
    a, q = a[order], q[order]
    new = np.ones(len(a), bool)
    new[1:] = (q[1:] != q[:-1]) | (a[1:] > a[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a))[: len(first)] - 1
    return a[first], a[last] + width, q[first]


def _primitive(runs: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period), the least period of each stretch."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _touching(windows: Windows, words: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposals of the pairs of highly periodic runs of one period that touch: all distances at which their phases agree."""
    a, q = [], []
    long = runs[runs[:, 1] - runs[:, 0] >= 9 * runs[:, 2] - 1]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    close = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1])) if len(long) else []
    for i in close:
        (s1, e1, p), (s2, e2, _) = long[i].tolist(), long[i + 1].tolist()
        # the last place of the first run at which one period of the second begins
        before = words[e1 - 2 * p + 1 : e1]
        starts = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(before, p) == words[s2 : s2 + p]).all(axis=1))
        if len(starts):
            x = e1 - 2 * p + 1 + int(starts[-1])
            distance = np.arange(s2 - x, min(e1 - s1, e2 - s2) + p, p)
            distance = distance[distance >= 9 * p - 1]
            a.append(np.maximum(s1, s2 - distance))
            q.append(distance)
    if not a:
        return (np.zeros(0, np.int64),) * 3
    at = np.concatenate(a)
    return at, at, np.concatenate(q)


def runs_of(words: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of the runs of a sequence of word numbers, by start and period. longest: an upper bound of their
    lengths, as where the sequence is many texts with marks between them."""
    windows = Windows(words)
    runs = np.zeros((0, 3), np.int64)

    def grown(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        a, b = windows.grow(a, b, q)
        keep = (b - a >= q) & (b - a + q >= least)
        return np.stack([a[keep], b[keep] + q[keep], q[keep]], axis=1)

    k = 1
    while (low := 1 if k == 1 else 3 * (1 << k) - 1) * 2 <= longest:
        tau = 1 << k
        if k == 2:  # runs too short to be reported can be highly periodic here
            same = np.append(words[1:] == words[:-1], False)
            starts, ends = _stretches(same)
            periodic = _marked(starts[ends - starts >= 3], (ends - 2)[ends - starts >= 3], len(words))
        elif k == 3:
            periodic = np.zeros(len(words), bool)
            for p in (1, 2):
                starts, ends = _stretches(words[p:] == words[:-p])
                some = ends - starts >= tau - p
                periodic |= _marked(starts[some], ends[some] + p - tau + 1, len(words))
        else:
            some = runs[(3 * runs[:, 2] <= tau) & (runs[:, 1] - runs[:, 0] >= tau)]
            periodic = _marked(some[:, 0], some[:, 1] - tau + 1, len(words))
        places = synchronising(windows, k, periodic)
        at, contexts = _by_context(windows, k, places)
        repeated = (contexts[1:] == contexts[:-1]) & (at[1:] - at[:-1] < longest)
        if repeated.any():
            runs = _primitive(np.concatenate([runs, grown(*_proposals(at, contexts, 2 * tau, low, 6 * tau - 1))]))
        elif not periodic.any():
            break  # no context of a higher scale can be repeated
        k += 1
    runs = _primitive(np.concatenate([runs, grown(*_touching(windows, words, runs))]))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


RESULTS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, their numbers in one sequence with a mark of its own after each text, and where texts begin."""
    split = [t.split() for t in texts]
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    sequence = np.empty(int(first[-1]), np.int64)
    for i, words in enumerate(split):
        sequence[first[i] : first[i + 1] - 1] = [numbers.setdefault(w, len(numbers)) for w in words]
    sequence[first[1:] - 1] = len(numbers) + np.arange(len(split))
    return split, sequence, first


def measure(texts: list[bytes], least: int = LEAST) -> list[tuple]:
    """RESULTS of each text: the runs as lines `start,length,period`, and the text without repetitions: of each run only the
    first period stays."""
    split, sequence, first = _numbered(texts)
    runs = runs_of(sequence, int(np.diff(first).max(initial=1)) - 1, least)
    of = np.searchsorted(first, runs[:, 0], "right") - 1
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    dropped = _marked(runs[:, 0] + runs[:, 2], runs[:, 1], len(sequence))
    out = []
    for i, words in enumerate(split):
        mine = runs[bounds[i] : bounds[i + 1]]
        if not len(mine):
            out.append((len(words), 0, None, None, None, None, "", b" ".join(words).decode()))
            continue
        start, length, period = mine[:, 0] - first[i], mine[:, 1] - mine[:, 0], mine[:, 2]
        best = np.lexsort((period, start, -length))[0]
        s, n, p = int(start[best]), int(length[best]), int(period[best])
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        stays = ~dropped[first[i] : first[i + 1] - 1]
        kept = b" ".join([w for w, k in zip(words, stays.tolist(), strict=True) if k])
        out.append((len(words), len(mine), s, n, p, 1000 * n // p, lines, kept.decode()))
    return out


def find(docs: DataFrame, least: int = LEAST, limit: int = 2 << 20) -> DataFrame:
    """docs without their text, and RESULTS of each row. Row by row in Arrow batches: no shuffle; a task holds about `limit`
    bytes of text at once, or one longer text."""
    names = [x.split()[0] for x in RESULTS.split(", ")]
    keep = [c for c in docs.columns if c not in [*names, "text"]]
    docs = docs.select(*[f"`{c}`" for c in keep], "text")
    schema = docs.select(*[f"`{c}`" for c in keep]).withColumns({x.split()[0]: F.lit(None).cast(x.split()[1]) for x in RESULTS.split(", ")}).schema
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep), limit):
            rows = measure(as_bytes(batch.column(len(keep))), least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], [*keep, *names])

    return docs.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a periodic tail in a tenth of the texts, chosen by the hash of the id: with h its crc32, g =
    h / 10 and n words, where h % 10 = 0 the words from a = g % n on repeat those of the period 1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w"))
    docs = docs.select("doc_id", "text", "g", "w", F.size("w").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
