import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mosaiq.llm import sharding
from mosaiq.llm.queries import op10_sharding


def test_query(spark, sf):
    rows = op10_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_movement(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = sharding.assign(keys, "doc_id", [1.0, 1.0, 2.0])
    share = {r.shard: r["count"] / 20_000 for r in before.groupBy("shard").count().collect()}
    assert abs(share[0] - 0.25) < 0.02 and abs(share[2] - 0.5) < 0.02
    after = sharding.assign(before, "doc_id", [1.0, 1.0, 2.0, 1.0], into="after")
    moved = after.filter("shard <> after")
    both = sharding.assign(keys, "doc_id", [1.0, 1.0, 2.0], more=[1.0], grown="after")
    assert both.exceptAll(after).count() == 0 and both.columns == after.columns
    assert moved.filter("after <> 3").count() == 0 and abs(moved.count() / 20_000 - 0.2) < 0.02


def test_odd_rows(odd, none, clash):
    out = sharding.assign(odd, "doc_id", [1.0] * 4)
    numbered = sharding.number(out, out.select("doc_id", "shard"), "doc_id", ["doc_id", "text"])
    assert numbered.count() == odd.count()
    for _, slots in numbered.groupBy("shard").agg(F.collect_list("slot")).collect():
        assert sorted(slots) == list(range(len(slots)))
    assert max(Counter(r.doc_id for r in numbered.select("doc_id", "shard").distinct().collect()).values()) == 1
    assert sharding.assign(none, "doc_id", [1.0]).count() == 0
    names = ["bucket", "within", "first_slot", "row", "first_bucket"]
    named = out.filter("doc_id IS NOT NULL").select("doc_id", "shard", *[F.lit(n).alias(n) for n in names])
    kept = sharding.number(named, named.select("doc_id", "shard"), "doc_id", ["doc_id"])
    assert kept.columns == [*named.columns, "slot"] and all(r[n] == n for r in kept.collect() for n in names)
    assert dict(sharding.assign(clash, "doc_id", [1.0]).dtypes)["shard"] == "int"
