"""The outbox: payloads, signatures, and the results of deliveries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.times import epoch, iso_utc
from mosaiq.params import DEFAULTS, Params


def pending(angles: DataFrame, force: bool = False, params: Params = DEFAULTS) -> DataFrame:
    """Angles to deliver: not delivered, with attempts left unless forced."""
    return angles.filter(~F.col("delivered") & (F.lit(force) | (F.col("attempts") < params.max_attempts)))


def payloads(angles: DataFrame, angle_articles: DataFrame, articles: DataFrame, outlets: DataFrame, clusters: DataFrame, social: DataFrame) -> DataFrame:
    """angle_id, body: the document that a receiver gets, as JSON with nulls kept."""
    names = outlets.select("outlet_id", "name")
    source = F.struct("published_at", "article_id", F.struct("article_id", "outlet_id", "name", "title", "url", iso_utc(F.col("published_at")).alias("published")).alias("s"))
    sources = angle_articles.join(articles, "article_id").join(names, "outlet_id").groupBy("angle_id").agg(F.transform(F.array_sort(F.collect_list(source)), lambda x: x["s"]).alias("sources"))
    entries = angles.select("angle_id", F.explode("comparison").alias("name", "c")).join(names, "name")
    entry = F.struct("name", F.struct("outlet_id", "name", "c.highlighted", "c.omitted", "c.quote").alias("e"))
    compared = entries.groupBy("angle_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("compared"))
    state = clusters.select("cluster_id", (F.col("state") == "open").alias("still_open"))
    copy = social.select("angle_id", F.struct("hook", "hashtags").alias("social"))
    joined = angles.join(sources, "angle_id", "left").join(compared, "angle_id", "left").join(state, "cluster_id", "left").join(copy, "angle_id", "left")
    ever = F.col("delivered_at").isNotNull() if "delivered_at" in angles.columns else F.lit(False)
    body = F.struct(
        F.when(ever, "updated").otherwise("created").alias("event"),
        F.struct("angle_id", "title", "summary", "key_points", "topics", "subtopics", iso_utc(F.col("generated_at")).alias("generated_at"), "model_used").alias("angle"),
        F.struct("cluster_id", F.col("still_open").alias("open")).alias("cluster"),
        F.coalesce("compared", F.array()).alias("comparison"),
        F.coalesce("sources", F.array()).alias("sources"),
        "social",
    )
    return joined.select("angle_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def signature(secret: str, stamp: Column, body: Column) -> Column:
    """sha256=HMAC-SHA256(secret, stamp.body), from the hash function alone."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat(stamp, F.lit("."), body), "UTF-8")
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def outbox(bodies: DataFrame, secret: str, as_of: Column) -> DataFrame:
    """angle_id, body, timestamp, signature."""
    stamped = bodies.withColumn("timestamp", epoch(as_of))
    return stamped.withColumn("signature", signature(secret, F.col("timestamp"), F.col("body")))


def outcome(status: Column) -> Column:
    """delivered for 2xx; rejected for 4xx that a retry can't mend; else failed."""
    return F.when(status.between(200, 299), "delivered").when(status.between(400, 499) & ~status.isin(408, 425, 429), "rejected").otherwise("failed")


def fold(angles: DataFrame, results: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """angles (angle_id, delivered, delivered_at, attempts) after results (angle_id, status, at most one each), with
    outcome and whether the attempt was the one that used up the last."""
    joined = angles.join(results.select("angle_id", "status"), "angle_id", "left")
    tried = F.col("status").isNotNull()
    attempts = F.col("attempts") + tried.cast("int")
    done = F.coalesce(outcome(F.col("status")) == "delivered", F.lit(False)) & tried
    return joined.withColumns(
        {
            "outcome": F.when(tried, outcome(F.col("status"))),
            "delivered": F.col("delivered") | done,
            "delivered_at": F.when(done, as_of).otherwise(F.col("delivered_at")),
            "newly_exhausted": tried & ~done & (F.col("attempts") < params.max_attempts) & (attempts >= params.max_attempts),
            "attempts": attempts,
        }
    ).drop("status")


def delivery_counters(folded: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    is_ = lambda k: F.count_if(F.col("outcome") == k)
    return folded.agg(
        F.count_if(~F.col("delivered")).alias("pending"),
        is_("delivered").alias("delivered"),
        is_("rejected").alias("rejected"),
        is_("failed").alias("failed"),
        F.count_if("newly_exhausted").alias("newly_exhausted"),
        F.count_if(~F.col("delivered") & (F.col("attempts") >= params.max_attempts)).alias("exhausted"),
    )


def throttled(alerts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """alerts (alert_id, key, ts, terminal, delivered, and more columns) with `sent`: let through, because no alert of
    the key was delivered in the time before, or because it is terminal.

    Only an alert that was let through and delivered starts the key's silence. What an alert meets depends on all
    before it, so a key's alerts go through one task, sorted and streamed: only the last time is held."""
    pause = params.alert_cooldown_minutes * 60_000_000
    names = alerts.columns
    micros = next(n for n in map("micros{}".format, range(len(names) + 1)) if n not in names)
    rows = alerts.withColumn(micros, F.unix_micros("ts")).repartition("key").sortWithinPartitions("key", micros, "alert_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            sent = []
            for k, at, terminal, delivered in zip(*[batch[c].to_pylist() for c in ("key", micros, "terminal", "delivered")], strict=True):
                if k != key:
                    key, last = k, None
                ok = bool(terminal) or last is None or at - last >= pause
                if ok and delivered:
                    last = at
                sent.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(sent, pa.bool_())], [*names, "sent"])

    return rows.mapInArrow(run, alerts.withColumn("sent", F.lit(True)).schema)
