"""Feeds and pages as DataFrames; stores as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.text import html_to_text, main_content
from mosaiq.sources.store import Store

ITEM = "title STRING, link STRING, guid STRING, description STRING, pubDate STRING, `content:encoded` STRING"
_LINK = "STRUCT<_href: STRING, _rel: STRING>"
RSS = f"channel STRUCT<item: ARRAY<STRUCT<{ITEM.replace(' STRING', ': STRING')}>>>"
ATOM = f"entry ARRAY<STRUCT<title: STRING, id: STRING, link: ARRAY<{_LINK}>, published: STRING, updated: STRING, content: STRUCT<_VALUE: STRING, _type: STRING>>>"


def published(date: Column, as_of: Column) -> Column:
    """RFC 822 dates in UTC; what can't be read is as_of."""
    return F.coalesce(F.try_to_timestamp(F.substring(date, 6, 20), F.lit("dd MMM yyyy HH:mm:ss")), as_of)


def items(feeds: DataFrame, as_of: Column) -> DataFrame:
    """Of feeds (outlet_id, feed, xml; RSS or Atom): one row an item, with guid from the link where it has none and the
    body from its content; malformed feeds give no rows."""
    rss = feeds.withColumn("doc", F.from_xml("xml", RSS, {"mode": "PERMISSIVE"})).select("outlet_id", "feed", F.explode("doc.channel.item").alias("item"))
    of_rss = rss.select(
        "outlet_id",
        "feed",
        F.trim("item.title").alias("title"),
        F.trim("item.link").alias("url"),
        F.trim(F.col("item.guid")).alias("guid"),
        F.col("item.content:encoded").alias("content"),
        published(F.col("item.pubDate"), as_of).alias("published_at"),
    )
    atom = feeds.withColumn("doc", F.from_xml("xml", ATOM, {"mode": "PERMISSIVE"})).select("outlet_id", "feed", F.explode("doc.entry").alias("item"))
    # the link that is the item itself: of no relation, or of relation alternate
    links = F.filter("item.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    of_atom = atom.select(
        "outlet_id",
        "feed",
        F.trim("item.title").alias("title"),
        F.trim(F.get(links, F.lit(0))["_href"]).alias("url"),
        F.trim(F.col("item.id")).alias("guid"),
        F.col("item.content._VALUE").alias("content"),
        F.coalesce(F.try_to_timestamp(F.coalesce("item.published", "item.updated")), as_of).alias("published_at"),
    )
    return of_rss.unionByName(of_atom).select(
        "outlet_id", "feed", "title", "url", F.coalesce(F.nullif("guid", F.lit("")), "url").alias("guid"), html_to_text(F.coalesce("content", F.lit(""))).alias("body"), "published_at"
    )


def fan_out(outlets: DataFrame) -> DataFrame:
    """outlet_id, feed: every feed of every active outlet."""
    return outlets.filter("active").select("outlet_id", F.explode("feeds").alias("feed"))


def page_bodies(pages: DataFrame) -> DataFrame:
    """url, page_body: null where the extraction fails."""
    return pages.select("url", main_content(F.col("html")).alias("page_body"))


def append_articles(articles: DataFrame, store: Store, name: str = "articles") -> DataFrame:
    """The store's articles with those of `articles` that have a body, partitioned by day."""
    kept = articles.filter("length(coalesce(body, '')) > 0").withColumn("published_date", F.to_date("published_at"))
    return store.append(kept, name, "published_date")


def upsert_outlets(stored: DataFrame, declared: DataFrame) -> DataFrame:
    """stored outlets with the declared feeds and extract_from_page; new names are added; nothing else changes."""
    s, d = stored.alias("s"), declared.alias("d")
    joined = s.join(d, F.col("s.name") == F.col("d.name"), "full_outer")
    own = F.col("s.name").isNotNull()
    given = F.col("d.name").isNotNull()
    return joined.select(
        F.coalesce("s.name", "d.name").alias("name"),
        F.when(own, F.col("s.base_url")).otherwise(F.col("d.base_url")).alias("base_url"),
        F.when(given, F.coalesce("d.feeds", F.array().cast("array<string>"))).otherwise(F.col("s.feeds")).alias("feeds"),
        F.when(own, F.col("s.active")).otherwise(F.coalesce("d.active", F.lit(True))).alias("active"),
        F.when(given, F.coalesce("d.extract_from_page", F.lit(False))).otherwise(F.col("s.extract_from_page")).alias("extract_from_page"),
    )
