"""Articles without a vector, and their vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.text import lead
from mosaiq.params import DEFAULTS, Params


#: Limits up to which the chosen ids become a condition of the scan, and up to which they are sent to all tasks.
LISTED, BROADCAST = 1000, 1 << 20


def pending(articles: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles without an embedding; with a limit, so many, by ascending id: these are chosen by their ids alone, and no
    other text is moved."""
    having = vectors.filter("embedding IS NOT NULL").select("article_id")
    if limit is None:
        return articles.join(having, "article_id", "left_anti")
    ids = articles.select("article_id").join(having, "article_id", "left_anti").orderBy("article_id").limit(limit).distinct()
    if limit <= LISTED:
        return articles.filter(F.col("article_id").isin([r[0] for r in ids.collect()])).orderBy("article_id").limit(limit)
    return articles.join(F.broadcast(ids) if limit <= BROADCAST else ids, "article_id", "left_semi").orderBy("article_id").limit(limit)


def pending_count(articles: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """One row, n: how many articles a run would take."""
    n = F.count("*")
    return pending(articles, vectors).agg((n if limit is None else F.least(n, F.lit(limit))).alias("n"))


def encoded(waiting: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame], params: Params = DEFAULTS) -> DataFrame:
    """article_id, embedding of the articles, as an encoder gives them. Encoders take their rows in batches of
    params.vector_batch (see operators.similarity.hashing_encoder)."""
    texts = waiting.select("article_id", lead(F.col("title"), F.col("body"), params.embed_chars).alias("text"))
    return encode(texts, "article_id", "text")
