"""Streams: the stateful throttle gives what the batch version gives, and the cycle keeps its state between batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mosaiq.operators import delivery
from mosaiq.sources.engine_tables import EngineTables
from mosaiq.plans.cycle import State
from mosaiq.sources.store import Store
from mosaiq.streaming.jobs import RunWatch, cycle_stream, item_stream, throttle_stream, utilisation


def test_stateful_throttle(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    alerts = EngineTables(spark, sf).alerts.filter("alert_id < 400")
    ordered = alerts.orderBy("ts", "alert_id").collect()
    for i in range(2):
        spark.createDataFrame(ordered[200 * i : 200 * i + 200], alerts.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = throttle_stream(stream).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    found = {r.alert_id: r.sent for r in spark.table("throttled").collect()}
    assert found == {r.alert_id: r.sent for r in delivery.throttled(alerts).collect()}


def test_cycle_stream(spark, tmp_path):
    """An article without a partner waits in the store and joins the one that comes in a later batch, in its window only."""
    now = datetime(2024, 1, 2, 12)
    schema = "article_id long, outlet_id int, title string, url string, guid string, body string, published_at timestamp"
    item = lambda i, event, hours: (i, i // 2 % 2 + 1, f"event {event}", f"https://a.example/{i}", f"g{i}", f"words of event {event} " * 20, now + timedelta(hours=hours))
    batches = [[item(1, "fire", 0), item(2, "flood", 0)], [item(3, "fire", 1), item(3, "fire", 1)], [item(4, "flood", 14), item(5, "fire", 14)]]
    one_hot = lambda rows, key, text: rows.select(key, F.when(F.col(text).contains("fire"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("embedding"))
    empty = lambda s: spark.createDataFrame([], s)
    outlets = spark.createDataFrame([(1, "uno", False), (2, "dos", False)], "outlet_id int, name string, extract_from_page boolean")
    state = State.begin(
        Store(spark, f"file://{tmp_path}/store"), outlets, empty("url string, page_body string"), articles=empty(schema), vectors=empty("article_id long, embedding array<float>"),
        membership=empty("article_id long, cluster_id long"), clusters=empty("cluster_id long, title string, created_at timestamp, state string, articles_at_synthesis long"),
    )
    watch = RunWatch()
    spark.streams.addListener(watch)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        cycle_stream(item_stream(spark, f"{tmp_path}/in", schema), state, one_hot, f"{tmp_path}/cp").awaitTermination(240)
    spark.streams.removeListener(watch)
    assert sorted(r.article_id for r in state.articles.collect()) == [1, 2, 3, 4, 5]
    groups = state.membership.groupBy("cluster_id").agg(F.array_sort(F.collect_list("article_id")).alias("a")).collect()
    # 2 left its window before 4 came, and the cluster of 1 and 3 was closed before 5 came
    assert [r.a for r in groups] == [[1, 3]]
    assert [r.state for r in state.clusters.collect()] == ["processed"]


def test_run_watch(spark):
    said = []
    watch = RunWatch(alert=lambda what, batch: said.append((what, batch)))
    for batch, began, seconds in ((0, 0.0, 10.0), (1, 900.0, 460.0), (2, 3000.0, 5.0), (3, 3900.0, 449.0)):
        watch.note("q", batch, began, seconds)
    assert said == watch.alerts == [("long run", 1), ("missed run", 2)]
    assert {r.run_id: r.warn for r in utilisation(watch.run_log(spark)).collect()} == {0: False, 1: True, 2: False, 3: False}
