"""Search and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.times import iso_local
from mosaiq.functions.vectors import cosine
from mosaiq.operators.similarity import nearest


def search(articles: DataFrame, vectors: DataFrame, outlets: DataFrame, query: Column, k: int = 10, membership: DataFrame | None = None) -> DataFrame:
    """The k articles nearest to a query vector (a literal), only clustered ones if membership is given."""
    near = vectors.select("article_id", F.round(cosine(F.col("embedding"), query), 4).alias("similarity"))
    if membership is not None:
        near = near.join(membership.select("article_id"), "article_id", "left_semi")
    top = near.orderBy(F.desc("similarity"), "article_id").limit(k)
    out = top.join(articles, "article_id").join(outlets.select("outlet_id", "name"), "outlet_id")
    return out.select("article_id", "title", "url", F.col("name").alias("outlet"), iso_local(F.col("published_at")).alias("published"), "similarity").orderBy(F.desc("similarity"), "article_id")


def batch_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, article_id, similarity, rank for many queries (id, embedding) at once."""
    found = nearest(queries, vectors.select(F.col("article_id").alias("id"), "embedding"), k)
    return found.select("query_id", F.col("id").alias("article_id"), F.round("sim", 4).alias("similarity"), "rank")


def list_clusters(clusters: DataFrame, membership: DataFrame, articles: DataFrame, outlets: DataFrame, state: str | None = None, limit: int = 20) -> DataFrame:
    """The newest clusters with their articles (by id) and the sorted names of their outlets; empty ones stay."""
    chosen = clusters if state is None else clusters.filter(F.col("state") == state)
    top = chosen.orderBy(F.desc("created_at"), F.desc("cluster_id")).limit(limit)
    members = membership.join(F.broadcast(top.select("cluster_id")), "cluster_id", "left_semi").join(articles, "article_id").join(outlets.select("outlet_id", "name"), "outlet_id")
    nested = members.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("article_id", "title", "url", F.col("name").alias("outlet"), "published_at"))).alias("articles"),
        F.array_sort(F.collect_set("name")).alias("outlets"),
        F.count("*").alias("n_articles"),
    )
    joined = top.join(nested, "cluster_id", "left")
    return joined.withColumn("n_articles", F.coalesce("n_articles", F.lit(0))).withColumn("outlets", F.coalesce("outlets", F.array().cast("array<string>"))).orderBy(F.desc("created_at"), F.desc("cluster_id"))


def first_model(models: DataFrame) -> DataFrame:
    """The active model of least priority, then id."""
    return models.filter("active").orderBy("priority", "model_id").limit(1)


def activate(models: DataFrame, model_id: int) -> DataFrame:
    """Exactly that model is active."""
    return models.withColumn("active", F.col("model_id") == model_id)


def public_models(models: DataFrame) -> DataFrame:
    """models without what is secret, but for whether a credential is set."""
    configured = F.length(F.coalesce(F.col("api_key_env"), F.lit(""))) > 0
    return models.withColumn("credential_configured", configured).drop("api_key_env", "base_url")
