"""Streams: polled feeds, the clock of clusters, the outbox sink, and the watch of runs that don't come."""

import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import cluster
from mosaiq.params import Params
from mosaiq.sources.feed_stream import FeedReader, feed_items, feed_stream
from mosaiq.sources.store import Store
from mosaiq.streaming.jobs import RunWatch, cluster_clock, delivery_sink, delivery_stream


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rss(*numbers):
    item = "<item><title>t{0}</title><link>https://a.example/{0}</link><guid>g{0}</guid><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item>"
    return f"<rss><channel>{''.join(item.format(n) for n in numbers)}</channel></rss>"


def poll(root, feed, number, *numbers):
    (root / feed).mkdir(parents=True, exist_ok=True)
    (root / feed / f".{number}").write_text(rss(*numbers))
    (root / feed / f".{number}").rename(root / feed / f"{number}.xml")


def test_feeds_arrive_once_over_a_restart(spark, tmp_path):
    feeds, out = tmp_path / "feeds", f"file://{tmp_path}/out"

    def run():
        polls = feed_stream(spark, f"file://{feeds}", {"a": 1, "b": 2})
        query = feed_items(polls, cluster.at("2024-01-02 12:00:00")).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(out)
        query.awaitTermination(120)

    poll(feeds, "a", 1, 1, 2)
    poll(feeds, "b", 7, 50)
    run()
    poll(feeds, "a", 2, 3)
    poll(feeds, "a", 3, 4, 5)
    poll(feeds, "c", 1, 90)  # an unknown outlet's
    run()
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.outlet_id or 0, r.feed, r.guid) for r in rows) == [(0, "c", "g90"), (1, "a", "g1"), (1, "a", "g2"), (1, "a", "g3"), (1, "a", "g4"), (1, "a", "g5"), (2, "b", "g50")]


def test_offsets_by_feed(tmp_path):
    reader = FeedReader(str(tmp_path), {})
    assert reader.initialOffset() == reader.latestOffset() == {}
    poll(tmp_path, "a", 1, 1)
    poll(tmp_path, "b", 4, 1)
    first = reader.latestOffset()
    poll(tmp_path, "a", 2, 1)
    last = reader.latestOffset()
    assert first == {"a": 1, "b": 4} and last == {"a": 2, "b": 4}
    assert [(p.feed, p.start, p.end) for p in reader.partitions(first, last)] == [("a", 1, 2)]
    # a batch that is run again reads the same, whatever has come since
    part = reader.partitions({}, first)[0]
    assert [b.column(2).to_pylist() for b in reader.read(part)] == [[1]]


def test_clusters_close_while_nothing_comes(spark, rocks, tmp_path):
    now = datetime.now(UTC).replace(tzinfo=None)
    rows = [(1, 1, now), (1, 2, now), (1, 2, now), (2, 1, now), (3, 1, now - timedelta(days=3)), (3, 2, now - timedelta(days=3))]
    schema = "cluster_id long, outlet_id int, created_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    members = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = cluster_clock(members, open_seconds=15).writeStream.format("memory").queryName("clock").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        seen = lambda: {r.cluster_id: (r.state, r.n_outlets, r.n_articles) for r in spark.table("clock").collect()}
        until = time.time() + 90
        while len(seen()) < 3 and time.time() < until:
            time.sleep(1)
        assert seen() == {1: ("processed", 2, 3), 2: ("discarded", 1, 1), 3: ("processed", 2, 2)}
        # nothing came after the first batch, and what comes late opens nothing
        assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [6]
        spark.createDataFrame([(1, 9, now)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # timers keep such a query busy, so it never says that all is done
        until = time.time() + 60
        while sum(p["numInputRows"] for p in query.recentProgress) < 7 and time.time() < until:
            time.sleep(1)
        time.sleep(3)
        assert len(spark.table("clock").collect()) == 3
    finally:
        query.stop()


ANGLES = "angle_id long, title string, delivered boolean, delivered_at timestamp, attempts int, generated_at timestamp"


def test_outbox_sink(spark, tmp_path):
    at = datetime(2024, 1, 2, 12)
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace(spark.createDataFrame([(1, "old", True, at, 1, at), (2, "waits", False, None, 4, at)], ANGLES), "angles")
    sent = spark.sparkContext.accumulator(0)

    def send(outbox):
        def one(rows):
            for batch in rows:
                sent.add(len(batch))
                yield batch.assign(status=[500 if a == 2 else 200 for a in batch["angle_id"]])[["angle_id", "status"]]

        return outbox.mapInPandas(one, "angle_id long, status int")

    bodies = lambda angles: angles.select("angle_id", F.to_json(F.struct("title")).alias("body"))
    sink = delivery_sink(store, bodies, send, "key")
    changes = [(3, "new", False, None, 0, at), (1, "changed", False, at, 0, at), (1, "older", False, at, 0, at - timedelta(hours=1))]
    spark.createDataFrame(changes, ANGLES).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(ANGLES).parquet(f"{tmp_path}/in")
    delivery_stream(stream(), sink, f"{tmp_path}/cp").awaitTermination(120)
    state = lambda: {r.angle_id: (r.title, r.delivered, r.attempts) for r in store.read("angles").collect()}
    after = {1: ("changed", True, 1), 2: ("waits", False, 5), 3: ("new", True, 1)}
    assert state() == after and sent.value == 3
    # the batch again, as after a crash between its commit and Spark's, and the whole stream again
    sink(spark.createDataFrame(changes, ANGLES), 0)
    delivery_stream(stream(), sink, f"{tmp_path}/lost").awaitTermination(120)
    assert state() == after and sent.value == 3
    assert sorted(map(tuple, store.read("delivery_results").select("angle_id", "status", "batch").collect())) == [(1, 200, 0), (2, 500, 0), (3, 200, 0)]

    # a failure while sending leaves the outbox as it was, and the batch to be done
    def broken(outbox):
        raise OSError("no network")

    more = spark.createDataFrame([(4, "later", False, None, 0, at)], ANGLES)
    with pytest.raises(OSError):
        delivery_sink(store, bodies, broken, "key")(more, 1)
    assert state() == after
    sink(more, 1)
    assert state() == after | {4: ("later", True, 1)} and sent.value == 4  # 2 has no attempts left


def test_a_stopped_query_is_missed(spark, tmp_path):
    said = []
    watch = RunWatch(Params(cycle_minutes=15), alert=lambda what, batch: said.append(what))
    watch.note("q", 3, 1000.0, 5.0)
    watch.check(1000.0 + 1800)
    assert said == []
    watch.check(1000.0 + 1801)
    watch.check(1000.0 + 9000)
    assert said == ["missed run"]
    watch.note("q", 4, 9000.0, 5.0)  # it comes back, and stays out again
    watch.check(9000.0 + 1900)
    assert said == ["missed run"] * 2

    # a query that is stopped, and a clock that goes on by itself
    watch = RunWatch(Params(cycle_minutes=0), alert=lambda what, batch: said.append(what)).start(0.2)
    watch.interval = 1
    spark.streams.addListener(watch)
    try:
        query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        time.sleep(2)
        query.stop()
        said.clear()
        until = time.time() + 20
        while "missed run" not in said and time.time() < until:
            time.sleep(0.2)
        assert "missed run" in said
    finally:
        spark.streams.removeListener(watch)
        watch.stop()
