"""Reports on coverage: funnels, outlets of clusters, lags, sections, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.topics import declared_topic
from mosaiq.functions.urls import segments
from mosaiq.operators.components import connected_components
from mosaiq.operators.similarity import linked_above_each, similarity_counts
from mosaiq.params import DEFAULTS, Params
from mosaiq.tables import freed, written


def funnel(articles: DataFrame, membership: DataFrame, angle_articles: DataFrame) -> DataFrame:
    """One row: how many articles came in, are in a cluster, and back an angle."""
    backing = angle_articles.select("article_id").distinct().withColumn("backs", F.lit(True))
    steps = articles.select("article_id").join(membership, "article_id", "left").join(backing, "article_id", "left")
    return steps.agg(F.count("*").alias("ingested"), F.count("cluster_id").alias("clustered"), F.count_if(F.col("cluster_id").isNotNull() & F.col("backs")).alias("published"))


def outlets_of_clusters(membership: DataFrame, articles: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """cluster_id, outlets (how many report on it) and publishable."""
    members = membership.join(articles.select("article_id", "outlet_id"), "article_id")
    return members.groupBy("cluster_id").agg(F.count_distinct("outlet_id").alias("outlets")).withColumn("publishable", F.col("outlets") >= params.min_outlets)


def outlets_histogram(membership: DataFrame, articles: DataFrame) -> DataFrame:
    """outlets, clusters: how many clusters have how many outlets."""
    return outlets_of_clusters(membership, articles).groupBy("outlets").agg(F.count("*").alias("clusters"))


def second_outlet_lag(membership: DataFrame, articles: DataFrame) -> DataFrame:
    """cluster_id, lag_minutes from the first outlet's first article to the second outlet's; clusters of one outlet don't count."""
    firsts = membership.join(articles, "article_id").groupBy("cluster_id", "outlet_id").agg(F.min("published_at").alias("at"))
    ordered = firsts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", "outlet_id"))).alias("f")).filter("size(f) > 1")
    at = lambda i: F.unix_timestamp(F.col("f")[i]["at"])
    return ordered.select("cluster_id", ((at(1) - at(0)) / 60).cast("long").alias("lag_minutes"))


def section_coverage(urls: DataFrame, url: Column) -> DataFrame:
    """section, articles, topic: the first section of each path, how often it occurs, and the topic that it declares."""
    first = F.coalesce(F.get(segments(url), F.lit(0)), F.lit(""))
    return urls.select(first.alias("section"), declared_topic(url).alias("topic")).groupBy("section", "topic").agg(F.count("*").alias("articles"))


def threshold_sweep(vectors: DataFrame, articles: DataFrame, thresholds: Sequence[float], params: Params = DEFAULTS) -> DataFrame:
    """threshold, groups, publishable: of the groups that vectors (article_id, embedding) linked at a threshold make,
    how many there are and how many have enough outlets."""
    spark = vectors.sparkSession
    rows = []
    every = written(linked_above_each(vectors.select(F.col("article_id").alias("id"), "embedding"), thresholds), "links")
    for at, threshold in enumerate(thresholds):
        edges = every.filter(F.col("threshold") == at).select("u", "v")
        parts = written(connected_components(edges).select(F.col("node").alias("article_id"), F.col("component").alias("cluster_id")), "sweep")
        counted = outlets_of_clusters(parts, articles, params).agg(F.count("*"), F.count_if("publishable")).first()
        rows.append((float(threshold), *counted))
        freed(parts)
    freed(every)
    return spark.createDataFrame(rows, "threshold double, groups long, publishable long")


def similarity_percentiles(vectors: DataFrame, shares: Sequence[float], bins: int = 20_000) -> DataFrame:
    """share, sim: the lower edge of the bin (of equal bins from -1 to 1) that holds each percentile of all pairs' dot
    products. Only the bins' counts (at most `bins` rows) meet in one place."""
    counts = similarity_counts(vectors, bins)
    every = counts.agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("pairs"))
    asked = every.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares)))))
    # the first bin at which the count so far reaches the share
    walk = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
        lambda s, b: F.struct((s["seen"] + b["n"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + b["n"] >= F.col("share") * F.col("pairs"), b["bin"])).alias("at")),
        lambda s: s["at"],
    )
    return asked.select("share", F.round(walk * 2 / bins - 1, 6).alias("sim"), "pairs")
