"""Threshold-scaled document fingerprints.

A fingerprint keeps every hash of a text's five-word shingles below a fixed fraction of the hash range. As the
fraction is the same for all texts, fingerprints of parts merge by union into that of the whole, and the overlap of
two fingerprints estimates Jaccard likeness and containment even between texts of very unequal length. A text of at
most WHOLE shingles has too few hashes below the threshold to say much, so it keeps all of them, and says so: two
such texts are compared exactly; with any other text only hashes below the threshold count.

DataFrame functions only. The one shuffle of texts is that of `with_next`, which pairs neighbours in the order of ids.

Defined cases: null text counts as empty; a text of one to four words is one shingle; a text without words has an
empty fingerprint, alike (1) only to another empty one; repeated shingles count once; equal texts have equal
fingerprints; where neither fingerprint has a hash to compare, likeness and containment are null; equal ids are
ordered by their texts; null ids come last; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import text_or_empty

WORDS = 5
#: One of so many shingles is kept.
SCALE = 4
#: Texts of so many shingles keep all of them.
WHOLE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _below(hashes: Column, scale: int) -> Column:
    """The hashes below 2**64 / scale (as signed numbers, from the least)."""
    return F.filter(hashes, lambda x: x < -(1 << 63) + (1 << 64) // scale)


def _sketch(whole: Column, hashes: Column) -> Column:
    return F.struct(whole.alias("whole"), hashes.alias("hashes"))


def sketch(text: Column, k: int = WORDS, scale: int = SCALE, least: int = WHOLE) -> Column:
    """struct(whole, hashes): the sorted distinct shingle hashes below the threshold, or all if they are few."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        shingle = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
        every = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), shingle)).when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(hashes)))
        # many words can still be few shingles
        sorted_ = lambda h: F.array_sort(F.array_distinct(h))
        return let(every, lambda h: let(sorted_(_below(h, scale)), lambda low: F.when((F.size(h) > least) & (F.size(low) > least), _sketch(F.lit(False), low)).otherwise(
            let(sorted_(h), lambda all_: F.when(F.size(all_) <= least, _sketch(F.lit(True), all_)).otherwise(_sketch(F.lit(False), low))))))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def comparable(a: Column, b: Column, scale: int = SCALE) -> Column:
    """struct(a, b): the hashes of two fingerprints that can be compared."""
    return F.when(a["whole"] & b["whole"], F.struct(a["hashes"].alias("a"), b["hashes"].alias("b"))).otherwise(
        F.struct(_below(a["hashes"], scale).alias("a"), _below(b["hashes"], scale).alias("b"))
    )


def merged(a: Column, b: Column, scale: int = SCALE, least: int = WHOLE) -> Column:
    """The fingerprint of the union of two texts' shingles."""
    both = lambda x, y: F.array_sort(F.array_union(x, y))
    whole = lambda u: F.when(a["whole"] & b["whole"] & (F.size(u) <= least), _sketch(F.lit(True), u)).otherwise(_sketch(F.lit(False), _below(u, scale)))
    return let(both(a["hashes"], b["hashes"]), whole)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets."""

    def of(x: Column) -> Column:
        both, sizes = F.size(F.array_intersect(x["a"], x["b"])), F.size(x["a"]) + F.size(x["b"])
        return F.when(F.size(a["hashes"]) + F.size(b["hashes"]) == 0, F.lit(1.0)).when(sizes > 0, both / (sizes - both))

    return let(comparable(a, b), of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    share = lambda x: F.when(F.size(a["hashes"]) == 0, (F.size(b["hashes"]) == 0).cast("double")).when(F.size(x["a"]) > 0, F.size(F.array_intersect(x["a"], x["b"])) / F.size(x["a"]))
    return let(comparable(a, b), share)


def as_string(s: Column) -> Column:
    """Hexadecimal hashes joined by dots, after an = where they are all of the text's."""
    return F.concat(F.when(s["whole"], "=").otherwise(""), F.array_join(F.transform(s["hashes"], lambda x: F.lower(F.hex(x))), "."))


def _place(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below the key, by groups of cuts and then within one."""
    if not cuts:
        return F.lit(0)
    g = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + g] for i in range(0, len(cuts), g)]
    kind = "array<bigint>"
    heads = F.lit([x[0] for x in groups]).cast(kind)
    every = F.array(*[F.lit(x).cast(kind) for x in groups])
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    return let(F.greatest(below(heads) - 1, F.lit(0)), lambda i: i * g + below(F.get(every, i)))


def with_next(rows: DataFrame, key: str, text: str, columns: list[str], per_range: int = 4000) -> DataFrame:
    """rows and, as next_<c>, the columns of the row that follows by descending key (after the last: the first).

    rows are dealt into ranges of the key by its quantiles, and numbered within each range; a range ends with a
    copy of the first row of the range that follows, which only serves as that row's successor. So no task sees
    more than a range, and the texts are shuffled once. There are as many ranges as rows / per_range, or as the square
    root of the rows where that is less; the quantiles are all that the driver sees, and only the ranges' first keys
    are broadcast."""
    keys = rows.select(F.col(key).alias("k"))
    n = keys.count()
    if n == 0:
        return rows.withColumns({f"next_{c}": F.col(c) for c in columns})
    many = max(1, min(n // per_range, math.isqrt(n)))
    quantiles = keys.agg(F.percentile_approx("k", [i / many for i in range(1, many)], 10 * many)).first()[0] if many > 1 else None
    # range b holds the keys in (cuts[b-1], cuts[b]]; null keys go to range -1, after the rest
    place = F.when(F.col(key).isNull(), -1).otherwise(_place(F.col(key), sorted(set(quantiles or []))))
    dealt = rows.withColumns({"_b": place, "_copy": F.lit(0)})
    first = dealt.select("_b", F.col(key).alias("_k")).groupBy("_b").agg(F.max("_k").alias("_k"))
    # a row for each range: the range before it in the order, which ends with a copy of its first row
    down = Window.orderBy(F.desc("_b"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = first.select("_b", "_k", F.coalesce(F.lag("_b").over(down), F.last("_b").over(whole)).alias("_to"))
    copies = dealt.join(F.broadcast(heads.withColumnRenamed("_b", "_of")), (F.col("_b") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_k")))
    copies = copies.select(*rows.columns, F.col("_to").alias("_b"), F.lit(1).alias("_copy"))
    at = Window.partitionBy("_b").orderBy("_copy", F.col(key).desc_nulls_last(), F.col(text))
    out = dealt.unionByName(copies).withColumns({f"next_{c}": F.lead(c).over(at) for c in columns})
    return out.filter("_copy = 0").drop("_b", "_copy")


def edited(text: Column, other: Column) -> Column:
    """text whose last third of code points is replaced by the first as many (or all) of the other."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def compared(docs: DataFrame) -> DataFrame:
    """Of documents (doc_id, text): the fingerprint of each, that of its edited text, and their likeness."""
    base = docs.select("doc_id", text_or_empty().alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text")))
    paired = with_next(base, "doc_id", "text", ["text", "sketch"])
    paired = paired.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return paired.withColumn("edited_sketch", sketch(F.col("edited")))
