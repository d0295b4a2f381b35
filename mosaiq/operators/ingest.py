"""Ingest: verdicts on feed items, duplicates, crawl permission."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.text import is_live
from mosaiq.functions.urls import host, path, usable
from mosaiq.operators.components import COMPONENT, SMALL, connected_components
from mosaiq.tables import freed, written


def essential(*columns: str) -> Column:
    """None is null or empty."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(F.coalesce(F.col(c), F.lit(""))) > 0)
    return out


def new_to_store(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose guid and url are both unknown to the store: two anti joins, each on one key."""
    return batch.join(store.select("guid"), "guid", "left_anti").join(store.select("url"), "url", "left_anti")


def first_of_duplicates(batch: DataFrame, order: str, small: int = SMALL, cap: int = COMPONENT) -> DataFrame:
    """Rows that stay when, in order, a row is dropped whose guid or url a kept row has.

    A null guid or url equals no other. order: distinct whole numbers; rows without it are dropped. Up to `small` rows are
    gone through in one task. Of more, a row that is the first of its guid's and of its url's rows is kept and the rows that
    share a key with it go, which decides all but chains of shared keys. Up to `cap` rows of these are gone through in one
    task; of more, each connected component (a row links its two keys) of up to so many. Only larger ones go by rounds."""
    alone = F.concat(F.lit("n"), F.col("o").cast("string"))
    own = lambda key: F.coalesce(F.concat(F.lit("k"), key), alone).alias(key)
    keys = batch.select(F.col(order).cast("long").alias("o"), "guid", "url").filter("o IS NOT NULL")
    left = written(keys.select("o", own("guid"), own("url")), "undecided")
    if left.count() <= small:
        kept = written(left.repartition(1).sortWithinPartitions("o").mapInArrow(_first_seen, "o long"), "kept")
    else:
        first, rest = _first_of_both(left)
        chosen = [first.select("o")]
        chained = rest.count()
        if 0 < chained <= cap:
            chosen.append(rest.repartition(1).sortWithinPartitions("o").mapInArrow(_first_seen, "o long"))
        elif chained:
            rest = rest.withColumns({"gk": F.xxhash64(F.lit("guid"), "guid"), "uk": F.xxhash64(F.lit("url"), "url")})
            parts = written(connected_components(rest, "gk", "uk"), "parts")
            placed = rest.join(parts, rest.gk == parts.node).select("component", "o", "guid", "url")
            giant = written(placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > cap).select("component"), "giant")
            whole = placed.join(F.broadcast(giant), "component", "left_anti")  # components over the cap: few
            # components share no key, so a task goes through all of its own together
            chosen.append(whole.repartition("component").sortWithinPartitions("o").mapInArrow(_first_seen, "o long"))
            large = placed.join(F.broadcast(giant), "component", "left_semi").select("o", "guid", "url")
            while giant.limit(1).count() and large.limit(1).count():
                first, large = _first_of_both(large)
                chosen.append(first.select("o"))
        every = chosen[0]
        for more in chosen[1:]:
            every = every.unionByName(more)
        kept = written(every, "kept")
    freed(left)
    return batch.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def _first_of_both(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are the first of both their keys, and those that share no key with these; both written."""
    by_guid, by_url = Window.partitionBy("guid"), Window.partitionBy("url")
    first = written(left.withColumns({"g": F.min("o").over(by_guid), "u": F.min("o").over(by_url)}).filter("o = g AND o = u").select("o", "guid", "url"), "first")
    return first, written(left.join(first.select("guid"), "guid", "left_anti").join(first.select("url"), "url", "left_anti").select("o", "guid", "url"), "undecided")


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """o of the rows, in order, neither of whose keys a kept one before had."""
    guids, urls = set(), set()
    for batch in batches:
        out = []
        for o, guid, url in zip(*[batch[c].to_pylist() for c in ("o", "guid", "url")], strict=True):
            if guid not in guids and url not in urls:
                guids.add(guid)
                urls.add(url)
                out.append(o)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["o"])


def crawl_permission(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with `allowed`: the verdict of the first rule (by rank) of the host whose prefix fits, else true;
    false for hosts whose rules can't be read (a rule of null prefix) and for bad URLs."""
    asked = urls.select("url", host(F.col("url")).alias("host"), F.coalesce(F.nullif(path(F.col("url")), F.lit("")), F.lit("/")).alias("path"))
    fits = asked.distinct().join(rules, "host").filter("prefix IS NULL OR startswith(path, prefix)")
    verdicts = fits.groupBy("url").agg(F.min_by("allow", "rank").alias("allow"), F.bool_or(F.col("prefix").isNull()).alias("unreadable"))
    return urls.join(verdicts, "url", "left").withColumn("allowed", usable(F.col("url")) & ~F.coalesce("unreadable", F.lit(False)) & F.coalesce("allow", F.lit(True))).drop("allow", "unreadable")


def verdicts(items: DataFrame, outlets: DataFrame, store: DataFrame, pages: DataFrame, order: str = "article_id") -> DataFrame:
    """items with a verdict each: no_body, bad_url, live, duplicate, extraction_failed or new, the first that holds;
    `body` is the page's where the feed has none and the outlet's pages are read, and from_page says so."""
    flags = outlets.select("outlet_id", "extract_from_page")
    marked = items.join(flags, "outlet_id", "left").withColumn(
        "early",
        F.when(~essential("title", "url", "guid") | (~essential("body") & ~F.coalesce("extract_from_page", F.lit(False))), "no_body")
        .when(~usable(F.col("url")), "bad_url")
        .when(is_live(F.col("title")), "live"),
    )
    marked = written(marked, "marked")
    fresh = first_of_duplicates(new_to_store(marked.filter("early IS NULL"), store), order).select(order, F.lit(True).alias("fresh"))
    joined = marked.join(fresh, order, "left").join(pages.select("url", "page_body").dropDuplicates(["url"]), "url", "left")
    own = F.nullif("body", F.lit(""))
    body = F.coalesce(own, "page_body")
    return joined.withColumn(
        "verdict",
        F.coalesce("early", F.when(F.col("fresh").isNull(), "duplicate").when(body.isNull(), "extraction_failed").otherwise("new")),
    ).withColumns({"from_page": own.isNull() & F.col("page_body").isNotNull(), "body": body}).drop("early", "fresh", "page_body")


def counters(judged: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Of each outlet, how many items have each verdict and how many bodies came from pages; with feeds (outlet_id,
    feed, failed) also how many feeds it has, how many of them failed, and a row for outlets without items."""
    kinds = ("new", "duplicate", "live", "no_body", "bad_url", "extraction_failed")
    extracted = F.count_if((F.col("verdict") == "new") & F.coalesce("from_page", F.lit(False))).alias("extracted")
    counts = judged.groupBy("outlet_id").agg(F.count("*").alias("items"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds], extracted)
    if feeds is None:
        return counts
    read = feeds.groupBy("outlet_id").agg(F.count("*").alias("feeds"), F.count_if("failed").alias("feed_errors"))
    return counts.join(read, "outlet_id", "full_outer").na.fill(0)


def silent_feeds(judged: DataFrame) -> DataFrame:
    """Outlets all of whose items have no body, or all of whose page extractions failed."""
    tried = F.count_if(F.col("verdict").isin("new", "extraction_failed") & F.col("extract_from_page"))
    failed = F.count_if(F.col("verdict") == "extraction_failed")
    out = judged.groupBy("outlet_id").agg((F.count_if(F.col("verdict") == "no_body") == F.count("*")).alias("no_bodies"), ((tried > 0) & (tried == failed)).alias("no_extractions"))
    return out.filter("no_bodies OR no_extractions")
