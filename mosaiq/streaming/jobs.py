"""The engine as Structured Streaming jobs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mosaiq.operators import delivery
from mosaiq.params import DEFAULTS, Params
from mosaiq.plans.cycle import Encode, State, run_cycle
from mosaiq.sources.store import Store
from mosaiq.tables import freed, written


def item_stream(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    """Feed items as they arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def ingest_stream(items: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, params: Params = DEFAULTS) -> StreamingQuery:
    """Runs step(batch, id) on each micro-batch of new items; repeated guids within the open window are dropped in
    the stream, the store's own by the step."""
    fresh = items.withWatermark("published_at", f"{params.open_hours} hours").dropDuplicatesWithinWatermark(["guid"])
    writer = fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{params.cycle_minutes} minutes")).start()


def cycle_stream(items: DataFrame, state: State, encode: Encode, checkpoint: str, once: bool = True, params: Params = DEFAULTS, as_of: Callable[[DataFrame], Column] | None = None, **cycle: Any) -> StreamingQuery:
    """The whole cycle on each micro-batch. What outlives a batch is in the state's store: articles that found no cluster
    are tried again in each run until their window passes, and a cluster takes articles for a fixed time from its
    creation, however many come. as_of: the moment of a batch, else that of its latest item."""

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.agg(F.max("published_at").alias("at")).first()["at"]
        if latest is not None:
            moment = as_of(batch) if as_of else F.lit(latest)
            run_cycle(state, batch, moment, encode, params=params, **cycle)

    return ingest_stream(items, step, checkpoint, once, params)


class RunWatch(StreamingQueryListener):
    """Notes how long each run of a query took, and which took half of the interval or more. Runs that don't come are seen
    by a clock of its own, not by the next run: a query without a run for more than two intervals is reported once, and
    again after each further run that stays out; so is one that ended with an error, at once. Give it to
    spark.streams.addListener, and start() the clock."""

    def __init__(self, params: Params = DEFAULTS, alert: Callable[[str, int], None] | None = None) -> None:
        self.interval, self.alert = params.cycle_minutes * 60, alert
        self.runs: list[tuple[int, float]] = []
        self.alerts: list[tuple[str, int]] = []
        #: Of each query that should run: when its last run began, its number, and whether its absence was reported.
        self._last: dict[str, tuple[float, int, bool]] = {}
        self._lock, self._ended = threading.RLock(), threading.Event()

    def start(self, every: float | None = None) -> RunWatch:
        """Checks all queries, `every` so many seconds, until stop()."""

        def watch() -> None:
            while not self._ended.wait(every or self.interval / 4):
                self.check(time.time())

        threading.Thread(target=watch, daemon=True, name="run-watch").start()
        return self

    def stop(self) -> None:
        self._ended.set()

    def onQueryStarted(self, event: Any) -> None:
        self.began(str(event.id), time.time())

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        self.note(str(p.id), p.batchId, pd.Timestamp(p.timestamp).timestamp(), p.batchDuration / 1000)

    def onQueryIdle(self, event: Any) -> None:
        """A run that finds nothing new is a run."""
        self.began(str(event.id), time.time())

    def onQueryTerminated(self, event: Any) -> None:
        if event.exception is not None:
            with self._lock:
                self._say("stopped run", self._last.get(str(event.id), (0.0, -1, False))[1])

    def began(self, query: str, now: float) -> None:
        with self._lock:
            self._last[query] = (now, self._last.get(query, (0.0, -1, False))[1], False)

    def note(self, query: str, batch: int, began: float, seconds: float) -> None:
        with self._lock:
            self.runs.append((batch, seconds))
            if seconds >= self.interval / 2:
                self._say("long run", batch)
            at, _, reported = self._last.get(query, (began, batch, False))
            if began - at > 2 * self.interval and not reported:
                self._say("missed run", batch)
            self._last[query] = (began, batch, False)

    def check(self, now: float) -> None:
        """Reports the queries whose last run is too long ago."""
        with self._lock:
            for query, (at, batch, reported) in list(self._last.items()):
                if now - at > 2 * self.interval and not reported:
                    self._last[query] = (at, batch, True)
                    self._say("missed run", batch)

    def _say(self, what: str, batch: int) -> None:
        self.alerts.append((what, batch))
        if self.alert:
            self.alert(what, batch)

    def run_log(self, spark: SparkSession) -> DataFrame:
        """run_id, duration_seconds, as utilisation() takes them."""
        return spark.createDataFrame(self.runs, "run_id long, duration_seconds double")


class ClusterClock(StatefulProcessor):
    """Keeps, for each cluster, the outlets that reported, and closes it a fixed time after its creation by a timer, which
    fires whether or not anything else comes. What comes for a cluster after that opens nothing again while the state
    remembers it, for one more such time."""

    def __init__(self, open_ms: int, min_outlets: int) -> None:
        self.open_ms, self.min_outlets = open_ms, min_outlets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")
        self.outlets = handle.getMapState("outlets", "outlet_id int", "n long")
        # the state's own clock starts when it is written, at the timer
        self.closed = handle.getValueState("closed", "at long", self.open_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        late = self.closed.exists()
        for part in rows:
            if late:
                continue
            for outlet, n in part.groupby("outlet_id").size().items():
                old = self.outlets.getValue((int(outlet),))[0] if self.outlets.containsKey((int(outlet),)) else 0
                self.outlets.updateValue((int(outlet),), (old + int(n),))
            created = int(part["created_at"].min().timestamp() * 1000)
            if not self.due.exists():
                # a time that has passed fires with the next batch
                self.due.update((created + self.open_ms,))
                self.handle.registerTimer(created + self.open_ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        counts = {k[0]: v[0] for k, v in self.outlets.iterator()}
        state = "processed" if len(counts) >= self.min_outlets else "discarded"
        yield pd.DataFrame([(int(key[0]), state, len(counts), sum(counts.values()))], columns=["cluster_id", "state", "n_outlets", "n_articles"])
        self.closed.update((self.due.get()[0],))
        self.due.clear()
        self.outlets.clear()

    def close(self) -> None:
        pass


def cluster_clock(members: DataFrame, params: Params = DEFAULTS, open_seconds: float | None = None) -> DataFrame:
    """cluster_id, state, n_outlets, n_articles of clusters as they close, from a stream of members (cluster_id,
    outlet_id, created_at). The clock is that of the wall. Needs the RocksDB state store."""
    open_ms = int(1000 * (params.open_hours * 3600 if open_seconds is None else open_seconds))
    return members.groupBy("cluster_id").transformWithStateInPandas(
        statefulProcessor=ClusterClock(open_ms, params.min_outlets), outputStructType="cluster_id long, state string, n_outlets long, n_articles long", outputMode="Append", timeMode="ProcessingTime"
    )


Send = Callable[[DataFrame], DataFrame]


def delivery_sink(store: Store, bodies: Callable[[DataFrame], DataFrame], send: Send, secret: str, params: Params = DEFAULTS, job: str = "delivery") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that empties the outbox. A batch brings angles, new or changed (the columns of the store's table
    `angles`), which take the place of those of their ids; whatever is then pending is signed and sent, once, and the
    results are folded back. bodies: from angles to (angle_id, body); send: from (angle_id, body, timestamp, signature) to
    (angle_id, status).

    Angles, results and the batch's number are one commit, so a batch that is replayed after it neither sends nor counts
    again. A failure between sending and the commit sends again; a receiver tells by angle_id and body."""

    def write(batch: DataFrame, number: int) -> None:
        with store.commit(job, number) as c:
            if c.done:
                return
            now = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz").cast("timestamp")
            old = store.read("angles")
            # the last of a batch, by its time, where one angle changes twice
            newest = batch.withColumn("r", F.row_number().over(Window.partitionBy("angle_id").orderBy(F.desc("generated_at")))).filter("r = 1").select(*old.columns)
            angles = written(old.join(newest.select("angle_id"), "angle_id", "left_anti").select(*old.columns).unionByName(newest), "angles")
            due = delivery.pending(angles, params=params)
            # written before it is counted: sending twice is no way to read twice
            results = written(send(delivery.outbox(bodies(due), secret, now)), "results")
            c.replace(delivery.fold(angles, results, now, params).select(*old.columns), "angles")
            c.append(results.select("angle_id", "status", F.lit(number).cast("long").alias("batch"), now.alias("sent_at")), "delivery_results")
            freed(angles, results)

    return write


def delivery_stream(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, params: Params = DEFAULTS) -> StreamingQuery:
    """Runs a delivery_sink on each micro-batch of changed angles."""
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{params.cycle_minutes} minutes")).start()


class Throttle(StatefulProcessor):
    """Keeps, for each key, when an alert was last delivered. A micro-batch's alerts of one key are sorted together."""

    def __init__(self, minutes: int) -> None:
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pause = pd.Timedelta(minutes=self.minutes)
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "alert_id"]).itertuples():
            sent = bool(row.terminal) or last is None or row.ts - last >= pause
            last = row.ts if sent and row.delivered else last
            out.append((row.alert_id, key[0], row.ts, sent))
        if last is not None:
            self.last.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["alert_id", "key", "ts", "sent"])

    def close(self) -> None:
        pass


def throttle_stream(alerts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """As operators.delivery.throttled, over a stream. Needs the RocksDB state store."""
    return alerts.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Throttle(params.alert_cooldown_minutes), outputStructType="alert_id long, key string, ts timestamp, sent boolean", outputMode="Append", timeMode="None"
    )


def utilisation(run_log: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """run_log (run_id, duration_seconds) with the share of the interval that each run took, and a warning from half on."""
    share = F.round(F.col("duration_seconds") / (params.cycle_minutes * 60), 6)
    return run_log.withColumn("utilisation", share).withColumn("warn", share >= 0.5)
