"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the sum over pairs is half of the difference of
|sum_i x_i v_i|^2 and sum_i x_i^2 |v_i|^2, so that a text is scored in time linear in its features. Words, in lower case and
with digits as zeros, are hashed into `buckets` weights; each text's words have length one together. The statistics
(shares of capitals, digits, symbols and punctuation, word and line lengths, repeats) are cut into bins, each a feature of
its own, so that pairs of them interact; metadata columns, if any are named, are hashed as "column=value".

Learning uses a bounded sample of the labelled rows (`Model.sample`, the rows of the least hashes of their ids) with
`Model.steps` adaptive gradient steps in one task; the sample's features are at most `Model.sample_features`, later rows of the sample
beyond that are left out. Features and scores of all rows are computed in parallel, from whole texts. The parameters
(buckets x (1 + factors) single-precision numbers) are the only thing that goes to all tasks.

Defined cases: null and empty texts have no words, and bins of zeros as statistics, and get a score as others do; a text of
any length is one row's work; equal texts with equal metadata get equal scores; rows of a null id are never learned from;
several labels of an id are several examples; without examples all scores are 0.5; an empty table gives an empty one; extra
columns are passed on, but for `score`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import as_bytes, slices, written


@dataclass(frozen=True)
class Model:
    """sample, sample_features: the most rows, and features of these, that are learned from."""

    buckets: int = 1 << 16
    factors: int = 8
    sample: int = 8192
    sample_features: int = 8_000_000
    steps: int = 200
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 11


_DIGITS = re.compile(rb"[0-9]+")
_UPPER, _DIGIT, _SYMBOLS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*|<>{}[]\\/=_~^@+", b".,;:!?"
#: Weight of a statistic beside all words of a text.
_STATISTIC = 0.5


def _share(count: int, of: int) -> int:
    """The bin of a share, on a logarithmic scale: 0 for none, to 10 for all."""
    return 0 if not count else 10 + max(-9, int(np.floor(np.log2(count / of))))


def statistics(text: bytes, words: list[bytes], seen: Counter[bytes]) -> list[str]:
    """The bins that a text falls in, as names of features."""
    n, size = len(words), max(1, len(text))
    left_out = lambda chars: size - len(text.translate(None, chars)) if text else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = max(seen.values(), default=0)
    follow = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    bins = {
        "words": n.bit_length(),
        "length": min(20, len(b"".join(words)) // n) if n else 0,
        "upper": _share(left_out(_UPPER), size),
        "digit": _share(left_out(_DIGIT), size),
        "symbol": _share(left_out(_SYMBOLS), size),
        "stop": _share(left_out(_STOPS), size),
        "bang": _share(text.count(b"!"), size),
        "bar": _share(text.count(b"|"), size),
        "distinct": _share(len(seen), max(1, n)),
        "half": 2 * len(seen) >= n,
        "top": _share(top, max(1, n)),
        "twice": _share(follow, max(1, n)),
        "lines": len(lines).bit_length(),
        "repeated": _share(len(lines) - len(set(lines)), max(1, len(lines))),
        "ends": _share(ends, max(1, len(lines))),
    }
    return [f"{k}:{int(v)}" for k, v in bins.items()]


def features(text: bytes, more: Sequence[str], model: Model, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's features. known: buckets of words met before."""
    words = text.split()
    seen, counts = Counter(words), Counter[int]()
    for word, n in seen.items():
        at = known.get(word)
        if at is None:
            at = zlib.crc32(b"w" + _DIGITS.sub(b"0", word.lower())) % model.buckets
            if len(known) < 200_000:
                known[word] = at
        counts[at] += n
    at = np.fromiter(counts, np.int32, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    value /= max(1e-9, float(np.sqrt(value @ value)))
    named = np.array([zlib.crc32(b"s" + x.encode()) % model.buckets for x in (*statistics(text, words, seen), *more)], np.int32)
    return np.concatenate([at, named]), np.concatenate([value, np.full(len(named), _STATISTIC, np.float32)])


def _sums(at: np.ndarray, value: np.ndarray, starts: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (features from starts on, none without any): the linear part, sum x v, and x v of each feature."""
    xv = v[at] * value[:, None]
    return np.add.reduceat(w[at] * value, starts), np.add.reduceat(xv, starts, axis=0), xv


def scores(at: np.ndarray, value: np.ndarray, starts: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    linear, s, xv = _sums(at, value, starts, w, v)
    return bias + linear + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((xv * xv).sum(axis=1), starts))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    """bias, w, v of the logistic loss, by adaptive gradient steps over batches in an order that the seed fixes."""
    rng = np.random.default_rng(model.seed)
    w, v = np.zeros(model.buckets, np.float32), rng.normal(0, 0.02, (model.buckets, model.factors)).astype(np.float32)
    if not len(label):
        return 0.0, w, np.zeros_like(v)
    share = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    bias, gw, gv, gb = float(np.log(share / (1 - share))), np.full_like(w, 1e-4), np.full_like(v, 1e-4), 1e-4
    sizes = np.array([len(a) for a, _ in rows])
    order = np.zeros(0, np.int64)
    for _ in range(model.steps):
        while len(order) < min(model.batch, len(rows)):
            order = np.concatenate([order, rng.permutation(len(rows))])
        mine, order = order[: model.batch], order[model.batch :]
        at, value = np.concatenate([rows[i][0] for i in mine]), np.concatenate([rows[i][1] for i in mine])
        starts = np.concatenate([[0], np.cumsum(sizes[mine])[:-1]])
        linear, s, xv = _sums(at, value, starts, w, v)
        z = bias + linear + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((xv * xv).sum(axis=1), starts))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[mine]).astype(np.float32) / len(mine)
        each = np.repeat(np.arange(len(mine)), sizes[mine])
        pull = error[each] * value
        touched, slot = np.unique(at, return_inverse=True)
        dw = np.bincount(slot, pull, len(touched)).astype(np.float32) + model.decay * w[touched]
        move = pull[:, None] * (s[each] - xv)
        dv = np.stack([np.bincount(slot, move[:, f], len(touched)) for f in range(model.factors)], axis=1).astype(np.float32) + model.decay * v[touched]
        gw[touched] += dw * dw
        gv[touched] += dv * dv
        w[touched] -= model.rate * dw / np.sqrt(gw[touched])
        v[touched] -= 0.3 * model.rate * dv / np.sqrt(gv[touched])
        db = float(error.sum())
        gb += db * db
        bias -= model.rate * db / gb**0.5
    return bias, w, v


def _named(metadata: Sequence[str], batch: pa.RecordBatch, first: int) -> list[list[str]]:
    """"column=value" of each row; nulls are no features."""
    columns = [batch.column(first + i).to_pylist() for i in range(len(metadata))]
    return [[f"{c}={x}" for c, x in zip(metadata, row, strict=True) if x is not None] for row in (zip(*columns, strict=True) if columns else [()] * batch.num_rows)]


def train(docs: DataFrame, labels: DataFrame, model: Model = Model(), metadata: Sequence[str] = ()) -> DataFrame:
    """One row: bias, w, v (row by row) as a written table. docs: doc_id, text and the metadata columns; labels: doc_id, label
    (0 or 1)."""
    place = F.xxhash64(F.lit("fm"), "doc_id")
    # the sample is chosen by ids alone, so no text is shuffled or sorted
    known = labels.filter("label IS NOT NULL").select("doc_id", F.col("label").cast("float")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.withColumn("place", place).orderBy("place", "doc_id", "label").limit(model.sample)
    rows = docs.select("doc_id", "text", *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(metadata)])
    sample = rows.join(F.broadcast(chosen), "doc_id").select("place", "doc_id", "label", "text", *[f"m{i}" for i in range(len(metadata))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, 3):
            found = [features(t, m, model, known) for t, m in zip(as_bytes(batch.column(3)), _named(metadata, batch, 4), strict=True)]
            lists = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], ["place", "doc_id", "label", "at", "value"])

    features_of = written(sample.mapInArrow(extract, f"place long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, label float, at binary, value binary"), "features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        label: list[float] = []
        total = 0
        for batch in batches:
            for y, at, value in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                total += len(at) // 4
                if total <= model.sample_features:
                    rows.append((np.frombuffer(at, np.int32), np.frombuffer(value, np.float32)))
                    label.append(y)
        bias, w, v = fit(rows, np.array(label, np.float32), model)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tobytes()]), pa.array([v.tobytes()])], ["bias", "w", "v"])

    # rows of repeated ids are more than ids, so the bound holds here, too
    one = features_of.orderBy("place", "doc_id", "label", "at").limit(model.sample)
    return written(one.mapInArrow(learn, "bias double, w binary, v binary"), "model")


def score(docs: DataFrame, trained: DataFrame, model: Model = Model(), metadata: Sequence[str] = (), text: str = "text") -> DataFrame:
    """docs without their text, and the score of each row, in Arrow batches: no shuffle."""
    row = trained.first()  # one row, of buckets x (1 + factors) numbers
    bias, w = row["bias"], np.frombuffer(row["w"], np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((bias, w, np.frombuffer(row["v"], np.float32).reshape(model.buckets, model.factors)))
    keep = [c for c in docs.columns if c not in (text, "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text), *[F.col(c).cast("string").alias(f"metadata {i}") for i, c in enumerate(metadata)])
    schema = rows.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        bias, w, v = shared.value
        for batch in slices(batches, len(keep)):
            found = [features(t, m, model, known) for t, m in zip(as_bytes(batch.column(len(keep))), _named(metadata, batch, len(keep) + 1), strict=True)]
            z = np.zeros(batch.num_rows)
            # a few rows at a time, as each feature takes a row of factors
            for k in range(0, len(found), 64):
                part = found[k : k + 64]
                starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in part])[:-1]]).astype(np.int64)
                z[k : k + 64] = scores(np.concatenate([a for a, _ in part]), np.concatenate([x for _, x in part]), starts, bias, w, v)
            out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out)], [*keep, "score"])

    return rows.mapInArrow(run, schema)


def size_class(text: Column) -> Column:
    """Metadata of a text's own: the power of two of its bytes."""
    return F.floor(F.log2(1 + F.octet_length(F.coalesce(text, F.lit(""))))).cast("int")
