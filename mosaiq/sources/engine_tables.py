"""The engine's tables as views of the given ones, by fixed rules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.tables import table, written

OUTLETS = """
SELECT DISTINCT CAST(substring(source, 4) AS INT) AS outlet_id, source AS name, concat('https://', source, '.example.com') AS base_url,
       CAST(substring(source, 4) AS INT) % 7 <> 6 AS active, CAST(substring(source, 4) AS INT) % 5 = 0 AS extract_from_page
FROM documents
"""
ARTICLES = """
SELECT d.doc_id AS article_id, CAST(substring(d.source, 4) AS INT) AS outlet_id, substring(d.text, 1, 60) AS title, p.url,
       concat('g', CAST(d.doc_id % (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM documents) AS STRING)) AS guid, d.text AS body,
       TIMESTAMP '2024-01-01 00:00:00' + ((d.doc_id * 7919) % 2880) * INTERVAL '1' MINUTE AS published_at
FROM documents d JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
"""
CLUSTERS = """
SELECT CAST(e.label AS BIGINT) AS cluster_id, concat('event ', CAST(e.label AS STRING)) AS title, min(a.published_at) AS created_at, 'open' AS state,
       CAST(CASE WHEN e.label % 4 = 1 THEN 1000000 WHEN e.label % 4 = 2 THEN 3 END AS BIGINT) AS articles_at_synthesis
FROM embeddings e JOIN articles a ON a.article_id = e.vec_id WHERE e.vec_id % 3 <> 0 GROUP BY e.label
"""
RESULTS = """
SELECT event_id, user_id AS angle_id, ts,
       CASE CAST(get_json_object(props, '$.k') AS INT) % 5 WHEN 1 THEN 400 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 200 END AS status
FROM events
"""


class EngineTables:
    """Lazily built DataFrames over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.given("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self.given("pages")

    @cached_property
    def events(self) -> DataFrame:
        return self.given("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def outlets(self) -> DataFrame:
        # a small table of its own, whose size the planner knows when it chooses a join
        return written(self.spark.sql(OUTLETS.replace("FROM documents", "FROM {documents}"), documents=self.documents), "outlets")

    @cached_property
    def articles(self) -> DataFrame:
        # the counts, from the files' footers, are literals in the plan
        sql = ARTICLES.replace("(SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM documents)", str(self.documents.count() * 9 // 10))
        sql = sql.replace("(SELECT count(*) FROM pages)", str(self.pages.count()))
        sql = sql.replace("FROM documents", "FROM {documents}").replace("JOIN pages", "JOIN {pages}")
        return self.spark.sql(sql, documents=self.documents, pages=self.pages)

    @cached_property
    def vectors(self) -> DataFrame:
        """article_id, embedding."""
        return self.given("embeddings").selectExpr("vec_id AS article_id", "embedding")

    @cached_property
    def membership(self) -> DataFrame:
        """article_id, cluster_id; a third of the articles is loose."""
        return self.given("embeddings").filter("vec_id % 3 <> 0").selectExpr("vec_id AS article_id", "CAST(label AS BIGINT) AS cluster_id")

    @cached_property
    def clusters(self) -> DataFrame:
        sql = CLUSTERS.replace("FROM embeddings", "FROM {embeddings}").replace("JOIN articles", "JOIN {articles}")
        return self.spark.sql(sql, embeddings=self.given("embeddings"), articles=self.articles)

    @cached_property
    def alerts(self) -> DataFrame:
        """alert_id, key, ts, terminal, delivered."""
        return self.events.selectExpr("event_id AS alert_id", "event_type AS key", "ts", "event_type = 'error' AS terminal", "event_id % 3 <> 1 AS delivered")

    @cached_property
    def delivery_results(self) -> DataFrame:
        return self.spark.sql(RESULTS.replace("FROM events", "FROM {events}"), events=self.events)


#: The same views for an engine that has the given tables under their names: WITH clauses for an oracle.
ORACLE_VIEWS = f"""
outlets AS ({OUTLETS}),
articles AS ({ARTICLES}),
vectors AS (SELECT vec_id AS article_id, embedding FROM embeddings),
membership AS (SELECT vec_id AS article_id, CAST(label AS BIGINT) AS cluster_id FROM embeddings WHERE vec_id % 3 <> 0),
clusters AS ({CLUSTERS}),
members AS (SELECT m.cluster_id, a.* FROM membership m JOIN articles a USING (article_id)),
alerts AS (SELECT event_id AS alert_id, event_type AS key, ts, event_type = 'error' AS terminal, event_id % 3 <> 1 AS delivered FROM events),
results AS ({RESULTS.replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')")})
"""
