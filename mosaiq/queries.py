"""One query for each operator over the given tables, each with the same in SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions import text, times, topics, urls, vectors
from mosaiq.operators import cluster, components, delivery, evidence, ingest, reports, search, similarity, synthesis, vectorise
from mosaiq.params import Params
from mosaiq.plans.cycle import State, run_cycle
from mosaiq.sources import feeds
from mosaiq.sources.engine_tables import ORACLE_VIEWS, EngineTables
from mosaiq.sources.store import Store
from mosaiq.tables import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Thresholds at which the given vectors, unlike news, have neighbours.
LOOSE = Params(threshold=0.30, fusion=0.35, open_hours=48)
AS_OF = "2024-01-02 12:00:00"


def query(sql: str | None = None) -> Callable[[Callable[[EngineTables], DataFrame]], Callable[[EngineTables], DataFrame]]:
    """Registers a function of the engine's tables under its name, with its oracle (which may use ORACLE_VIEWS)."""

    def register(f: Callable[[EngineTables], DataFrame]) -> Callable[[EngineTables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(EngineTables(spark, sf_dir))
        if sql is not None:
            rest = sql.strip().removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
            ORACLES[f.__name__] = f"WITH RECURSIVE {ORACLE_VIEWS}{',' if rest != sql.strip() else ''} {rest}"
        return f

    return register


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def joined(column: str) -> Column:
    return F.array_join(column, "|")


def sql_map(of: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + " END"


#: Articles with URLs whose path declares sections: of the section words, one by the article's number.
_SECTION_WORDS = sorted({*topics.SECTIONS, *topics.SUBSECTIONS, "actualidad", "horoscopo", "opinion", "editoriales", "quiniela", "receta-facil"})
_SECTION_URL = (
    "concat(regexp_replace(url, '(https?://[^/]+).*', '{g}1'), '/', "
    + "{at}(" + "{arr}" + ", CAST(article_id % " + str(len(_SECTION_WORDS)) + " AS INT) + 1), CASE WHEN article_id % 3 = 0 THEN '//' ELSE '/' END, "
    + "{at}(" + "{arr}" + ", CAST((article_id * 7) % " + str(len(_SECTION_WORDS)) + " AS INT) + 1), '/nota?x=/politica/')"
)
_WORDS_SQL = ", ".join(f"'{w}'" for w in _SECTION_WORDS)
SECTION_URL_SPARK = _SECTION_URL.format(g="$", at="element_at", arr=f"array({_WORDS_SQL})")
SECTION_URL_DUCK = _SECTION_URL.format(g="\\", at="list_extract", arr=f"[{_WORDS_SQL}]")
_DUCK_PATH = "regexp_extract(section_url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
_DUCK_SEGMENTS = f"list_filter(string_split(lower({_DUCK_PATH}), '/'), lambda x: x <> '')"


def sectioned(t: EngineTables) -> DataFrame:
    return t.articles.withColumn("section_url", F.expr(SECTION_URL_SPARK))


# --- listings and data quality ---


@query("""
SELECT c.cluster_id, strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created, count(m.article_id) AS n_articles,
       array_to_string(list_sort(list_distinct(list(o.name))), '|') AS outlet_names, array_to_string(list_sort(list(m.article_id)), '|') AS article_ids
FROM clusters c LEFT JOIN members m USING (cluster_id) LEFT JOIN outlets o ON o.outlet_id = m.outlet_id
GROUP BY c.cluster_id, c.created_at ORDER BY c.created_at DESC, c.cluster_id DESC LIMIT 20
""")
def cluster_listing(t: EngineTables) -> DataFrame:
    found = search.list_clusters(t.clusters, t.membership, t.articles, t.outlets)
    ids = F.transform("articles", lambda a: a["article_id"].cast("string"))
    return found.select("cluster_id", stamp("created_at").alias("created"), "n_articles", joined("outlets").alias("outlet_names"), F.array_join(ids, "|").alias("article_ids"))


_BY_STATE = "CASE WHEN cluster_id % 3 = 0 THEN 'processed' WHEN cluster_id % 3 = 1 THEN 'discarded' ELSE state END"


@query(f"""
WITH chosen AS (SELECT * FROM (SELECT cluster_id, created_at, {_BY_STATE} AS kind FROM clusters) WHERE kind = 'processed' ORDER BY created_at DESC, cluster_id DESC LIMIT 7)
SELECT s.cluster_id, s.kind AS state, count(m.article_id) AS n_articles FROM chosen s LEFT JOIN members m USING (cluster_id) GROUP BY 1, 2
""")
def clusters_by_state(t: EngineTables) -> DataFrame:
    stated = t.clusters.withColumn("state", F.expr(_BY_STATE))
    return search.list_clusters(stated, t.membership, t.articles, t.outlets, "processed", 7).select("cluster_id", "state", "n_articles")


@query("SELECT o.outlet_id, o.name, count(a.article_id) AS n_articles FROM outlets o LEFT JOIN articles a USING (outlet_id) GROUP BY o.outlet_id, o.name")
def articles_per_outlet(t: EngineTables) -> DataFrame:
    counts = t.articles.groupBy("outlet_id").agg(F.count("*").alias("n_articles"))
    return t.outlets.join(counts, "outlet_id", "left").select("outlet_id", "name", F.coalesce("n_articles", F.lit(0)).alias("n_articles"))


@query("""
SELECT a.article_id, o.name, a.title, strftime(a.published_at, '%Y-%m-%d %H:%M:%S') AS published
FROM articles a JOIN outlets o USING (outlet_id) ORDER BY a.published_at DESC, a.article_id DESC LIMIT 10
""")
def latest_articles(t: EngineTables) -> DataFrame:
    top = t.articles.select("article_id", "outlet_id", "title", "published_at").orderBy(F.desc("published_at"), F.desc("article_id")).limit(10)
    return top.join(t.outlets, "outlet_id").select("article_id", "name", "title", stamp("published_at").alias("published"))


@query("SELECT 'article' AS kind, article_id AS id FROM articles WHERE body LIKE '%<%>%' UNION ALL SELECT 'page', page_id FROM pages WHERE html LIKE '%<%>%'")
def residual_html(t: EngineTables) -> DataFrame:
    marked = lambda df, kind, key, c: df.filter(F.col(c).like("%<%>%")).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return marked(t.articles, "article", "article_id", "body").unionByName(marked(t.pages, "page", "page_id", "html"))


@query("SELECT o.name, CAST(round(avg(length(a.body))) AS BIGINT) AS mean_length, min(length(a.body)) AS least_length FROM articles a JOIN outlets o USING (outlet_id) GROUP BY o.name ORDER BY 2")
def body_length_stats(t: EngineTables) -> DataFrame:
    lengths = t.articles.groupBy("outlet_id").agg(F.round(F.avg(F.length("body"))).cast("long").alias("mean_length"), F.min(F.length("body")).cast("long").alias("least_length"))
    return lengths.join(t.outlets, "outlet_id").select("name", "mean_length", "least_length").orderBy("mean_length")


@query("""
SELECT 'guid' AS kind, guid AS value, count(*) AS n FROM articles GROUP BY guid HAVING count(*) > 1
UNION ALL SELECT 'url', url, count(*) FROM articles GROUP BY url HAVING count(*) > 1
""")
def dup_urls(t: EngineTables) -> DataFrame:
    again = lambda c: t.articles.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(c).alias("kind"), "value", "n")
    return again("guid").unionByName(again("url"))


_LIVE_DUCK = "(contains(title, '🔴') OR contains(lower(title), 'vivo') OR contains(lower(title), 'minuto a minuto') OR contains(lower(title), 'en directo'))"
_LIVE_TITLE = "CASE article_id % 9 WHEN 0 THEN concat('🔴 ', title) WHEN 1 THEN concat(title, ' EN VIVO') WHEN 2 THEN concat('Sobrevivo: ', title) WHEN 3 THEN concat('Minuto a Minuto ', title) ELSE title END"


@query(f"SELECT article_id, {_LIVE_DUCK} AS live FROM (SELECT article_id, {_LIVE_TITLE} AS title FROM articles)")
def live_filter(t: EngineTables) -> DataFrame:
    titled = t.articles.select("article_id", F.expr(_LIVE_TITLE).alias("title"))
    return titled.select("article_id", text.is_live(F.col("title")).alias("live"))


@query(f"SELECT article_id, title FROM (SELECT article_id, {_LIVE_TITLE} AS title FROM articles) WHERE title ILIKE '%vivo%' OR title ILIKE '%minuto a minuto%' OR title ILIKE '%en directo%' OR title LIKE '%🔴%'")
def live_slipped_through(t: EngineTables) -> DataFrame:
    titled = t.articles.select("article_id", F.expr(_LIVE_TITLE).alias("title"))
    return titled.filter(text.is_live(F.col("title")))


_BAD_URL = """CASE page_id % 7 WHEN 1 THEN replace(url, '://', '://[') WHEN 2 THEN regexp_replace(url, '^https?:', '') WHEN 3 THEN replace(url, 'example', 'ex%5Bample')
    WHEN 4 THEN concat(url, '/con%20espacio') WHEN 5 THEN substring(url, 8, 100) ELSE url END"""
_HOST_DUCK = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(f"""
SELECT page_id, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AND NOT contains({_HOST_DUCK}, '[') AND NOT contains({_HOST_DUCK}, '%5B') AS usable
FROM (SELECT page_id, {_BAD_URL} AS u FROM pages)
""")
def url_usable(t: EngineTables) -> DataFrame:
    return t.pages.select("page_id", F.expr(_BAD_URL).alias("u")).select("page_id", urls.usable(F.col("u")).alias("usable"))


@query("SELECT o.name, count(*) FILTER (WHERE regexp_matches(a.url, '[.]com/')) AS n_com, count(*) FILTER (WHERE regexp_matches(a.url, '/(es|fr)/')) AS n_romance FROM articles a JOIN outlets o USING (outlet_id) GROUP BY o.name")
def url_countries(t: EngineTables) -> DataFrame:
    counts = t.articles.groupBy("outlet_id").agg(F.count_if(F.col("url").rlike("[.]com/")).alias("n_com"), F.count_if(F.col("url").rlike("/(es|fr)/")).alias("n_romance"))
    return counts.join(t.outlets, "outlet_id").select("name", "n_com", "n_romance")


@query("SELECT name, active, extract_from_page FROM outlets")
def outlet_activity(t: EngineTables) -> DataFrame:
    return t.outlets.select("name", "active", "extract_from_page")


@query(f"SELECT article_id, array_to_string({_DUCK_SEGMENTS}[1:2], '|') AS segments FROM (SELECT article_id, {SECTION_URL_DUCK} AS section_url FROM articles)")
def url_segments(t: EngineTables) -> DataFrame:
    return sectioned(t).select("article_id", F.array_join(urls.segments(F.col("section_url")), "|").alias("segments"))


@query(f"SELECT article_id, {sql_map(topics.SECTIONS, f'({_DUCK_SEGMENTS})[1]')} AS topic FROM (SELECT article_id, {SECTION_URL_DUCK} AS section_url FROM articles)")
def declared_topic(t: EngineTables) -> DataFrame:
    return sectioned(t).select("article_id", topics.declared_topic(F.col("section_url")).alias("topic"))


@query(f"""
SELECT article_id, coalesce({sql_map(topics.SUBSECTIONS, f'({_DUCK_SEGMENTS})[1]')}, {sql_map(topics.SUBSECTIONS, f'({_DUCK_SEGMENTS})[2]')}) AS subtopic
FROM (SELECT article_id, {SECTION_URL_DUCK} AS section_url FROM articles)
""")
def declared_subtopic(t: EngineTables) -> DataFrame:
    return sectioned(t).select("article_id", topics.declared_subtopic(F.col("section_url")).alias("subtopic"))


_TOPIC_LIST = ", ".join(f"'{x}'" for x in topics.TOPICS)
_SUB_LIST = ", ".join(f"'{x}'" for x in topics.PARENTS)
_NSUB = len(topics.PARENTS)


@query(f"""
WITH chosen AS (SELECT article_id, ([{_TOPIC_LIST}])[article_id % 10 + 1] AS topic, ([{_SUB_LIST}])[article_id % {_NSUB} + 1] AS s1, ([{_SUB_LIST}])[(article_id * 5) % {_NSUB} + 1] AS s2 FROM articles),
parents AS (SELECT article_id, topic, {sql_map(topics.PARENTS, 's1')} AS p1, {sql_map(topics.PARENTS, 's2')} AS p2 FROM chosen)
SELECT article_id, concat(topic, CASE WHEN p1 <> topic THEN '|' || p1 ELSE '' END, CASE WHEN p2 <> topic AND p2 <> p1 THEN '|' || p2 ELSE '' END) AS topics FROM parents
""")
def topic_parent_closure(t: EngineTables) -> DataFrame:
    pick = lambda words, n, by: F.element_at(F.array(*map(F.lit, words)), (F.expr(by) % n + 1).cast("int"))
    subs = F.array(pick(topics.PARENTS, _NSUB, "article_id"), pick(topics.PARENTS, _NSUB, "article_id * 5"))
    return t.articles.select("article_id", joined(topics.with_parents(F.array(pick(topics.TOPICS, 10, "article_id")), subs)).alias("topics"))


_NON_EVENT_DUCK = "CASE " + " ".join(f"WHEN regexp_matches(section_url, '(?i){p}') THEN '{k}'" for k, p in urls.NON_EVENT.items()) + " END"


@query(f"SELECT article_id, {_NON_EVENT_DUCK} AS category FROM (SELECT article_id, {SECTION_URL_DUCK} AS section_url FROM articles)")
def nonevent_category(t: EngineTables) -> DataFrame:
    return sectioned(t).select("article_id", urls.non_event(F.col("section_url")).alias("category"))


@query(f"SELECT coalesce({_NON_EVENT_DUCK}, 'event') AS category, count(*) AS n FROM (SELECT article_id, {SECTION_URL_DUCK} AS section_url FROM articles) GROUP BY 1")
def nonevent_counts(t: EngineTables) -> DataFrame:
    return sectioned(t).groupBy(F.coalesce(urls.non_event(F.col("section_url")), F.lit("event")).alias("category")).agg(F.count("*").alias("n"))


#: Mark-up added to every page, with entities that the pages don't have, and what it must read.
_PLANTED = "<p>inflaci&oacute;n &#8211; &#xe9;xito &hellip; &euro;5 &amp;lt; &#150; &Ntilde;and&uacute; &unknown; &#0; A&B</p>"
_READ = "inflación – éxito … €5 &lt; – Ñandú &unknown; \ufffd A&B"
#: Entities of the given pages.
_PAGE_ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _duck_text(html: str) -> str:
    out = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"
    out = f"regexp_replace({out}, '<(script|style|template)\\b[^>]*>.*?</(script|style|template)>', ' ', 'gis')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, character in _PAGE_ENTITIES:
        out = f"replace({out}, '{entity}', '{character}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


@query(f"SELECT page_id, concat_ws(' ', {_duck_text('html')}, '{_READ}') AS text FROM pages")
def html_to_text(t: EngineTables) -> DataFrame:
    return t.pages.select("page_id", text.html_to_text(F.concat("html", F.lit(_PLANTED))).alias("text"))


_DUCK_PART = "nullif(regexp_extract(html, '(?is)<{}\\b[^>]*>(.*)</{}>', 1), '')"
_DUCK_BODY = f"coalesce({_DUCK_PART.format('article', 'article')}, {_DUCK_PART.format('main', 'main')}, html)"
_DUCK_BODY = f"regexp_replace({_DUCK_BODY}, '<(nav|aside|form|footer|header)\\b[^>]*>.*?</(nav|aside|form|footer|header)>', ' ', 'gis')"


@query(f"SELECT page_id, CASE WHEN length(body) >= 500 THEN body END AS body FROM (SELECT page_id, {_duck_text(_DUCK_BODY)} AS body FROM pages)")
def page_body_floor(t: EngineTables) -> DataFrame:
    bodies = feeds.page_bodies(t.pages.select(F.col("page_id").cast("string").alias("url"), "html"))
    return bodies.select(F.col("url").cast(t.pages.schema["page_id"].dataType).alias("page_id"), F.col("page_body").alias("body"))


#: Pages without their article elements.
_DUCK_CLEAN = "regexp_replace(html, '(?i)<(/?)(article|main)\\b', '<\\1div', 'g')"
_DUCK_CLEAN = f"regexp_replace({_DUCK_CLEAN}, '<(nav|aside|form|footer|header)\\b[^>]*>.*?</(nav|aside|form|footer|header)>', ' ', 'gis')"
_DUCK_CLEAN = f"regexp_replace(regexp_replace({_DUCK_CLEAN}, '<!--.*?-->', ' ', 'gs'), '<(script|style|template)\\b[^>]*>.*?</(script|style|template)>', ' ', 'gis')"
_DUCK_LENGTH = "length(trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g')))"


@query(f"""
WITH blocks AS (SELECT page_id, generate_subscripts(b, 1) AS i, unnest(b) AS block FROM (SELECT page_id, regexp_split_to_array({_DUCK_CLEAN}, '{text._BLOCKS}') AS b FROM pages)),
scored AS (SELECT *, CASE WHEN {_DUCK_LENGTH.format("block")} = 0 THEN 0 ELSE 3 * {_DUCK_LENGTH.format("regexp_replace(block, '(?is)<a\\b[^>]*>.*?</a>', ' ', 'g')")} - 2 * {_DUCK_LENGTH.format("block")} - {text._BLOCK_COST} END AS x FROM blocks),
summed AS (SELECT *, sum(x) OVER (PARTITION BY page_id ORDER BY i) AS p FROM scored),
reached AS (SELECT *, p - least(0, coalesce(min(p) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM summed),
ends AS (SELECT page_id, arg_max(i, (best, -i)) AS last, max(best) AS best, arg_max(p, (best, -i)) AS p FROM reached GROUP BY 1),
windows AS (SELECT e.page_id, e.last, e.best, coalesce(max(s.i), 0) + 1 AS first FROM ends e LEFT JOIN summed s ON s.page_id = e.page_id AND s.i < e.last AND s.p = e.p - e.best GROUP BY 1, 2, 3),
bodies AS (SELECT w.page_id, string_agg(block, ' ' ORDER BY i) AS body FROM windows w JOIN blocks b ON b.page_id = w.page_id AND b.i BETWEEN w.first AND w.last WHERE w.best > 0 GROUP BY 1)
SELECT page_id, CASE WHEN length(text) >= 500 THEN text END AS body FROM pages LEFT JOIN (SELECT page_id, {_duck_text("body")} AS text FROM bodies) USING (page_id)
""")
def densest_block(t: EngineTables) -> DataFrame:
    return t.pages.select("page_id", text.main_content(F.regexp_replace("html", r"(?i)<(/?)(article|main)\b", "<$1div")).alias("body"))


_RULES = """SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, 1 AS rank, '/fr/' AS prefix, false AS allow FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), 2, '/', true FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), 3, '/en/', false FROM pages WHERE page_id % 5 = 0"""


@query(f"""
WITH rules AS ({_RULES}),
asked AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages),
found AS (SELECT a.url, arg_min(r.allow, r.rank) AS allow FROM asked a JOIN rules r ON a.host = r.host AND starts_with(a.path, r.prefix) GROUP BY a.url)
SELECT p.page_id, coalesce(f.allow, true) AS allowed FROM pages p LEFT JOIN found f USING (url)
""")
def crawl_permission(t: EngineTables) -> DataFrame:
    rules = t.spark.sql(_RULES.replace("FROM pages", "FROM {pages}"), pages=t.pages)
    judged = ingest.crawl_permission(t.pages.select("url").distinct(), rules)
    return t.pages.join(judged, "url").select("page_id", "allowed")


_UNREAD = "UNION ALL SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), 9, CAST(NULL AS STRING), true FROM pages WHERE page_id % 11 = 0"


@query(f"""
WITH rules AS ({_RULES} {_UNREAD}),
asked AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages),
found AS (SELECT a.url, arg_min(r.allow, r.rank) FILTER (WHERE r.prefix IS NOT NULL) AS allow, bool_or(r.prefix IS NULL) AS unread FROM asked a JOIN rules r ON a.host = r.host AND (r.prefix IS NULL OR starts_with(a.path, r.prefix)) GROUP BY a.url)
SELECT p.page_id, NOT coalesce(f.unread, false) AND coalesce(f.allow, true) AS allowed FROM pages p LEFT JOIN found f USING (url)
""")
def crawl_unreadable(t: EngineTables) -> DataFrame:
    """Hosts whose rules can't be read allow nothing, whatever else is known of them."""
    rules = t.spark.sql(f"{_RULES} {_UNREAD}".replace("FROM pages", "FROM {pages}"), pages=t.pages)
    return t.pages.join(ingest.crawl_permission(t.pages.select("url").distinct(), rules), "url").select("page_id", "allowed")


_BLANKS = "CASE WHEN article_id % 11 = 0 THEN '' WHEN article_id % 13 = 0 THEN NULL ELSE title END"


@query(f"SELECT article_id FROM (SELECT article_id, {_BLANKS} AS title, url, guid FROM articles) WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> '' AND coalesce(guid, '') <> ''")
def essential_fields(t: EngineTables) -> DataFrame:
    return t.articles.withColumn("title", F.expr(_BLANKS)).filter(ingest.essential("title", "url", "guid")).select("article_id")


# --- ingest ---


def _store(t: EngineTables) -> DataFrame:
    return t.articles.filter("article_id % 10 < 2").select("guid", "url")


@query("""
WITH rows AS MATERIALIZED (SELECT article_id, guid, url FROM articles), store AS MATERIALIZED (SELECT guid, url FROM rows WHERE article_id % 50 = 0),
by_guid AS MATERIALIZED (SELECT r.* FROM rows r ANTI JOIN store s ON s.guid = r.guid)
SELECT r.article_id FROM by_guid r ANTI JOIN store s ON s.url = r.url
""")
def or_antijoin_dedup(t: EngineTables) -> DataFrame:
    store = t.articles.filter("article_id % 50 = 0").select("guid", "url")
    return ingest.new_to_store(t.articles, store).select("article_id")


_GUID_OR_NULL = "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE concat('g', CAST(floor(doc_id * 7 % 1000 / 3) AS INT)) END AS guid"
_URL_OR_NULL = "CASE WHEN doc_id % 31 = 0 THEN NULL ELSE concat('u', CAST(floor(doc_id * 11 % 1000 / 2) AS INT)) END AS url"


@query(f"""
WITH RECURSIVE items AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, {_GUID_OR_NULL}, {_URL_OR_NULL} FROM documents),
walk AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS doc_id, false AS kept, ['']::VARCHAR[] AS guids, ['']::VARCHAR[] AS urls
  UNION ALL
  SELECT rn, doc_id, fresh, CASE WHEN fresh AND guid IS NOT NULL THEN list_append(guids, guid) ELSE guids END, CASE WHEN fresh AND url IS NOT NULL THEN list_append(urls, url) ELSE urls END
  FROM (SELECT i.rn, i.doc_id, i.guid, i.url, w.guids, w.urls, NOT coalesce(list_contains(w.guids, i.guid), false) AND NOT coalesce(list_contains(w.urls, i.url), false) AS fresh FROM walk w JOIN items i ON i.rn = w.rn + 1))
SELECT doc_id FROM walk WHERE kept
""")
def inbatch_dedup(t: EngineTables) -> DataFrame:
    return ingest.first_of_duplicates(t.documents.selectExpr("doc_id", _GUID_OR_NULL, _URL_OR_NULL), "doc_id").select("doc_id")


@query("""
WITH items AS (SELECT doc_id, md5(text) AS guid FROM documents) SELECT min(doc_id) AS doc_id FROM items GROUP BY guid
""")
def inbatch_dedup_one_key(t: EngineTables) -> DataFrame:
    items = t.documents.select("doc_id", F.md5("text").alias("guid")).withColumn("url", F.col("guid"))
    return ingest.first_of_duplicates(items, "doc_id").select("doc_id")


_ITEM_TITLE = "CASE WHEN article_id % 17 = 0 THEN concat(title, ' en vivo') WHEN article_id % 19 = 0 THEN '' ELSE title END"
_ITEM_BODY = "CASE WHEN article_id % 4 = 0 THEN '' ELSE body END"
_ITEM_URL = "CASE WHEN article_id % 23 = 0 THEN 'relative/url' ELSE concat(url, '&a=', CAST(article_id AS STRING)) END"
_ITEM_GUID = "concat('i', CAST(article_id - (article_id % 2) * CAST(article_id % 6 = 1 AS INT) AS STRING))"


def _items(t: EngineTables) -> DataFrame:
    return t.articles.select("article_id", "outlet_id", F.expr(_ITEM_TITLE).alias("title"), F.expr(_ITEM_BODY).alias("body"), F.expr(_ITEM_URL).alias("url"), F.expr(_ITEM_GUID).alias("guid"))


def _item_pages(t: EngineTables) -> DataFrame:
    return t.articles.filter("article_id % 8 = 0").select(F.expr(_ITEM_URL).alias("url"), F.concat(F.lit("page "), "title").alias("page_body"))


_ITEMS_DUCK = f"items AS (SELECT article_id, outlet_id, {_ITEM_TITLE} AS title, {_ITEM_BODY} AS body, {_ITEM_URL} AS url, {_ITEM_GUID} AS guid FROM articles)"
_VERDICTS_DUCK = f"""
{_ITEMS_DUCK},
store AS (SELECT guid FROM items WHERE article_id % 10 = 7),
page AS (SELECT DISTINCT {_ITEM_URL} AS url FROM articles WHERE article_id % 8 = 0),
early AS (
    SELECT i.*, o.extract_from_page, CASE WHEN coalesce(title, '') = '' OR coalesce(url, '') = '' OR coalesce(guid, '') = '' OR (coalesce(body, '') = '' AND NOT extract_from_page) THEN 'no_body'
        WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'bad_url' WHEN {_LIVE_DUCK} THEN 'live' END AS early
    FROM items i JOIN outlets o USING (outlet_id)
),
fresh AS (SELECT min(article_id) AS article_id FROM early WHERE early IS NULL AND guid NOT IN (SELECT guid FROM store) GROUP BY guid),
judged AS (
    SELECT e.article_id, e.outlet_id, e.extract_from_page, e.body, coalesce(early, CASE WHEN f.article_id IS NULL THEN 'duplicate' WHEN body = '' AND p.url IS NULL THEN 'extraction_failed' ELSE 'new' END) AS verdict
    FROM early e LEFT JOIN fresh f USING (article_id) LEFT JOIN page p ON p.url = e.url
)"""


def _judged(t: EngineTables) -> DataFrame:
    items = _items(t)
    store = items.filter("article_id % 10 = 7").select("guid", F.lit("none").alias("url"))
    return ingest.verdicts(items, t.outlets, store, _item_pages(t))


@query(f"WITH {_VERDICTS_DUCK} SELECT article_id, verdict FROM judged")
def ingest_verdicts(t: EngineTables) -> DataFrame:
    return _judged(t).select("article_id", "verdict")


#: Two feeds an outlet, some of which failed, also of outlets without items.
_FEEDS = "SELECT outlet_id, concat(base_url, f) AS feed, outlet_id % 4 = 1 AND f = '/atom' AS failed FROM (SELECT outlet_id, base_url FROM outlets UNION ALL SELECT 99, 'https://none') o CROSS JOIN (VALUES ('/rss'), ('/atom')) v(f)"


@query(f"""
WITH {_VERDICTS_DUCK},
counts AS (
  SELECT outlet_id, count(*) AS items, count(*) FILTER (WHERE verdict = 'new') AS "new", count(*) FILTER (WHERE verdict = 'duplicate') AS duplicate, count(*) FILTER (WHERE verdict = 'live') AS live,
       count(*) FILTER (WHERE verdict = 'no_body') AS no_body, count(*) FILTER (WHERE verdict = 'bad_url') AS bad_url, count(*) FILTER (WHERE verdict = 'extraction_failed') AS extraction_failed,
       count(*) FILTER (WHERE verdict = 'new' AND body = '') AS extracted
  FROM judged GROUP BY outlet_id),
read AS (SELECT outlet_id, count(*) AS feeds, count(*) FILTER (WHERE failed) AS feed_errors FROM ({_FEEDS}) GROUP BY 1)
SELECT outlet_id, coalesce(items, 0) AS items, coalesce("new", 0) AS "new", coalesce(duplicate, 0) AS duplicate, coalesce(live, 0) AS live, coalesce(no_body, 0) AS no_body, coalesce(bad_url, 0) AS bad_url,
  coalesce(extraction_failed, 0) AS extraction_failed, coalesce(extracted, 0) AS extracted, coalesce(feeds, 0) AS feeds, coalesce(feed_errors, 0) AS feed_errors
FROM counts FULL OUTER JOIN read USING (outlet_id)
""")
def ingest_counters(t: EngineTables) -> DataFrame:
    return ingest.counters(_judged(t), t.spark.sql(_FEEDS.replace("FROM outlets", "FROM {outlets}"), outlets=t.outlets))


_HEALTH = "CASE WHEN outlet_id % 4 = 1 OR article_id % 3 = 0 THEN 'no_body' WHEN outlet_id % 10 = 0 THEN 'extraction_failed' ELSE 'new' END"


@query(f"""
SELECT outlet_id, count(*) FILTER (WHERE v = 'no_body') = count(*) AS no_bodies,
       coalesce(count(*) FILTER (WHERE v <> 'no_body' AND extract_from_page) > 0 AND count(*) FILTER (WHERE v <> 'no_body' AND extract_from_page) = count(*) FILTER (WHERE v = 'extraction_failed'), false) AS no_extractions
FROM (SELECT article_id, outlet_id, extract_from_page, {_HEALTH} AS v FROM articles JOIN outlets USING (outlet_id)) GROUP BY outlet_id HAVING no_bodies OR no_extractions
""")
def feed_health(t: EngineTables) -> DataFrame:
    judged = t.articles.join(t.outlets, "outlet_id").withColumn("verdict", F.expr(_HEALTH))
    return ingest.silent_feeds(judged)


@query("""
WITH stored AS (SELECT name, base_url, [concat(base_url, '/rss')] AS feeds, active, extract_from_page FROM outlets WHERE outlet_id % 3 <> 0),
declared AS (SELECT name, concat(base_url, '/new') AS base_url, [concat(base_url, '/a'), concat(base_url, '/b')] AS feeds, false AS active, CASE WHEN outlet_id % 4 = 0 THEN NULL ELSE true END AS extract_from_page FROM outlets WHERE outlet_id % 2 = 0)
SELECT coalesce(s.name, d.name) AS name, CASE WHEN s.name IS NOT NULL THEN s.base_url ELSE d.base_url END AS base_url, array_to_string(CASE WHEN d.name IS NOT NULL THEN d.feeds ELSE s.feeds END, '|') AS feeds,
       CASE WHEN s.name IS NOT NULL THEN s.active ELSE d.active END AS active, CASE WHEN d.name IS NOT NULL THEN coalesce(d.extract_from_page, false) ELSE s.extract_from_page END AS extract_from_page
FROM stored s FULL OUTER JOIN declared d ON s.name = d.name
""")
def outlet_upsert(t: EngineTables) -> DataFrame:
    stored = t.outlets.filter("outlet_id % 3 <> 0").selectExpr("name", "base_url", "array(concat(base_url, '/rss')) AS feeds", "active", "extract_from_page")
    declared = t.outlets.filter("outlet_id % 2 = 0").selectExpr(
        "name", "concat(base_url, '/new') AS base_url", "array(concat(base_url, '/a'), concat(base_url, '/b')) AS feeds", "false AS active", "CASE WHEN outlet_id % 4 = 0 THEN NULL ELSE true END AS extract_from_page"
    )
    return feeds.upsert_outlets(stored, declared).withColumn("feeds", joined("feeds"))


@query("SELECT name, concat(base_url, f) AS feed FROM outlets, (VALUES ('/rss'), ('/atom')) v(f) WHERE active")
def feed_fan_out(t: EngineTables) -> DataFrame:
    fed = t.outlets.withColumn("feeds", F.array(F.concat("base_url", F.lit("/rss")), F.concat("base_url", F.lit("/atom"))))
    return feeds.fan_out(fed).join(fed, "outlet_id").select("name", "feed")


def feed_items(t: EngineTables) -> DataFrame:
    """Feeds written from the articles, RSS and Atom, one document for each outlet and group of 400, and read again."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit(" "))
    title, url, tag = esc(F.col("title")), esc(F.col("url")), lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name.split()[0]}>"))
    body = esc(F.concat(F.lit("<p>"), F.regexp_replace("title", "[^A-Za-z0-9]", ""), F.lit("</p><script>x</script> &oacute;")))
    date = F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    rss = F.concat(F.lit("<item>"), tag("title", title), tag("link", url), tag("guid", F.col("guid")), tag("pubDate", date), tag("content:encoded", body), F.lit("</item>"))
    link = F.concat(F.lit('<link rel="self" href="https://self"/><link rel="alternate" href="'), url, F.lit('"/>'))
    atom = F.concat(F.lit("<entry>"), tag("title", title), link, tag("id", F.col("guid")), tag("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), tag('content type="html"', body), F.lit("</entry>"))
    is_atom = F.col("outlet_id") % 2 == 1
    groups = t.articles.groupBy("outlet_id", F.floor(F.col("article_id") / 400).alias("feed")).agg(F.array_join(F.collect_list(F.when(is_atom, atom).otherwise(rss)), "").alias("items"))
    head = F.when(is_atom, F.lit("<feed>")).otherwise(F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'))
    tail = F.when(is_atom, F.lit("</feed>")).otherwise(F.lit("</channel></rss>"))
    xml = groups.select("outlet_id", F.col("feed").cast("string").alias("feed"), F.concat(head, "items", tail).alias("xml"))
    broken = xml.limit(1).select("outlet_id", F.lit("broken").alias("feed"), F.lit("<rss><channel><item>").alias("xml"))
    return feeds.items(xml.unionByName(broken), cluster.at(AS_OF)).select("outlet_id", "title", "url", "guid", "body", stamp("published_at").alias("published"))


QUERIES["feed_items"] = lambda spark, sf_dir: feed_items(EngineTables(spark, sf_dir))
ORACLES["feed_items"] = f"""WITH {ORACLE_VIEWS} SELECT outlet_id, trim(replace(title, chr(10), ' ')) AS title, url, guid, trim(regexp_replace(title, '[^A-Za-z0-9]', '', 'g') || ' ó') AS body,
    strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published FROM articles"""


@query("""
SELECT a.article_id, CAST(CAST(published_at AS DATE) AS VARCHAR) AS published_date FROM articles a WHERE article_id % 5 < 3 AND article_id % 4 <> 0 AND body <> ''
""")
def append_articles(t: EngineTables) -> DataFrame:
    """Two appends to a store of its own, articles without a body among them, and what a reader then sees."""
    store = Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    rows = t.articles.selectExpr("article_id", "published_at", "CASE WHEN article_id % 4 = 0 THEN '' ELSE body END AS body")
    feeds.append_articles(rows.filter("article_id % 5 = 0"), store)
    return feeds.append_articles(rows.filter("article_id % 5 IN (1, 2)"), store).select("article_id", F.col("published_date").cast("string").alias("published_date"))


# --- vectors ---


@query("SELECT a.article_id FROM articles a WHERE a.article_id NOT IN (SELECT article_id FROM vectors)")
def pending_vectors(t: EngineTables) -> DataFrame:
    return vectorise.pending(t.articles, t.vectors).select("article_id")


@query("SELECT a.article_id FROM articles a WHERE a.article_id NOT IN (SELECT article_id FROM vectors WHERE article_id % 2 = 0) ORDER BY 1 LIMIT 40")
def vectorise_limited(t: EngineTables) -> DataFrame:
    """The articles that a limited run takes, through the encoder and its batches."""
    waiting = vectorise.pending(t.articles, t.vectors.filter("article_id % 2 = 0"), 40)
    return vectorise.encoded(waiting, similarity.hashing_encoder(16)).filter("size(embedding) = 16").select("article_id")


@query("""
SELECT article_id FROM vectors WHERE article_id % 2 = 0 UNION ALL (SELECT article_id FROM articles WHERE article_id NOT IN (SELECT article_id FROM vectors WHERE article_id % 2 = 0) ORDER BY article_id LIMIT 70)
""")
def vector_write_back(t: EngineTables) -> DataFrame:
    """Two limited runs that add vectors to a store: each takes the next articles without one."""
    store = Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    store.replace(t.vectors.filter("article_id % 2 = 0"), "vectors")
    for limit in (40, 30):
        waiting = vectorise.pending(t.articles, store.read("vectors"), limit)
        store.append(vectorise.encoded(waiting, similarity.hashing_encoder(64)), "vectors")
    return store.read("vectors").select("article_id")


@query("SELECT count(*) AS waiting, least(count(*), 40) AS taken FROM articles WHERE article_id NOT IN (SELECT article_id FROM vectors)")
def pending_count(t: EngineTables) -> DataFrame:
    every, some = vectorise.pending_count(t.articles, t.vectors), vectorise.pending_count(t.articles, t.vectors, 40)
    return every.select(F.col("n").alias("waiting")).join(some.select(F.col("n").cast("long").alias("taken")))


@query("SELECT article_id, title || '. ' || substring(body, 1, 500) AS embed_text FROM articles")
def embed_text(t: EngineTables) -> DataFrame:
    return t.articles.select("article_id", text.lead(F.col("title"), F.col("body"), 500).alias("embed_text"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


@query(f"""
WITH q AS (SELECT embedding AS e FROM vectors WHERE article_id = 7),
top AS (SELECT v.article_id, round({_DOT.format(a='v.embedding', b='q.e')} / sqrt({_DOT.format(a='v.embedding', b='v.embedding')} * {_DOT.format(a='q.e', b='q.e')}), 4) AS similarity
        FROM vectors v, q ORDER BY similarity DESC, v.article_id LIMIT 10)
SELECT top.article_id, a.title, o.name AS outlet, strftime(a.published_at - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S-03:00') AS published, similarity
FROM top JOIN articles a USING (article_id) JOIN outlets o USING (outlet_id)
""")
def knn_top10(t: EngineTables) -> DataFrame:
    vector = t.vectors.filter("article_id = 7").first()["embedding"]
    found = search.search(t.articles, t.vectors, t.outlets, F.lit([float(x) for x in vector]), 10)
    return found.select("article_id", "title", "outlet", "published", "similarity")


@query(f"""
WITH q AS (SELECT embedding AS e FROM vectors WHERE article_id = 8),
top AS (SELECT v.article_id, round({_DOT.format(a='v.embedding', b='q.e')} / sqrt({_DOT.format(a='v.embedding', b='v.embedding')} * {_DOT.format(a='q.e', b='q.e')}), 4) AS similarity
        FROM vectors v, q WHERE v.article_id IN (SELECT article_id FROM membership WHERE cluster_id % 2 = 0) ORDER BY similarity DESC, v.article_id LIMIT 15)
SELECT top.article_id, o.name AS outlet, similarity FROM top JOIN articles a USING (article_id) JOIN outlets o USING (outlet_id)
""")
def knn_clustered(t: EngineTables) -> DataFrame:
    """Search among articles of some clusters alone."""
    vector = t.vectors.filter("article_id = 8").first()["embedding"]
    found = search.search(t.articles, t.vectors, t.outlets, F.lit([float(x) for x in vector]), 15, t.membership.filter("cluster_id % 2 = 0"))
    return found.select("article_id", "outlet", "similarity")


@query(f"""
WITH every AS (SELECT q.article_id AS query_id, v.article_id, round({_DOT.format(a='q.embedding', b='v.embedding')}, 12) AS sim FROM vectors q, vectors v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, article_id) AS rank FROM every)
SELECT query_id, article_id, round(sim, 4) AS similarity, rank FROM ranked WHERE rank <= 5
""")
def batch_knn(t: EngineTables) -> DataFrame:
    return search.batch_search(t.vectors.select(F.col("article_id").alias("id"), "embedding"), t.vectors, 5).select("query_id", "article_id", "similarity", F.col("rank").cast("long").alias("rank"))


_CENTROIDS_DUCK = """
parts AS (SELECT m.cluster_id, i AS pos, sum(CAST(v.embedding[i] AS DOUBLE)) AS x FROM membership m JOIN vectors v USING (article_id), range(1, 65) r(i) GROUP BY 1, 2),
lengths AS (SELECT cluster_id, sqrt(sum(x * x)) AS length FROM parts GROUP BY 1),
centroids AS (SELECT cluster_id, pos, x / length AS x FROM parts JOIN lengths USING (cluster_id))"""


@query(f"WITH {_CENTROIDS_DUCK} SELECT cluster_id, pos, round(x, 6) AS x FROM centroids")
def centroid(t: EngineTables) -> DataFrame:
    found = vectors.centroids(t.membership.join(t.vectors, "article_id"), "cluster_id")
    return found.select("cluster_id", F.posexplode("centroid").alias("p", "x")).select("cluster_id", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""
WITH {_CENTROIDS_DUCK},
loose AS (SELECT * FROM vectors WHERE article_id NOT IN (SELECT article_id FROM membership)),
sims AS (SELECT l.article_id, c.cluster_id, sum(CAST(l.embedding[c.pos] AS DOUBLE) * c.x) AS sim FROM loose l, centroids c GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(sim, 12) DESC, cluster_id) AS r FROM sims)
SELECT article_id, cluster_id, round(sim, 6) AS sim FROM best WHERE r = 1 AND sim >= 0.2
""")
def best_cluster_match(t: EngineTables) -> DataFrame:
    loose = t.vectors.join(t.membership, "article_id", "left_anti").select(F.col("article_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    found = similarity.best_match(loose, vectors.centroids(t.membership.join(t.vectors, "article_id"), "cluster_id"), 0.2)
    return found.select(F.col("id").alias("article_id"), "cluster_id", F.round("sim", 6).alias("sim"))


@query(f"""
WITH {_CENTROIDS_DUCK}
SELECT a.cluster_id AS a, b.cluster_id AS b, round(sum(a.x * b.x), 6) AS sim FROM centroids a JOIN centroids b ON a.pos = b.pos AND a.cluster_id < b.cluster_id GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.05
""")
def centroid_pairs(t: EngineTables) -> DataFrame:
    centres = vectors.centroids(t.membership.join(t.vectors, "article_id"), "cluster_id")
    return similarity.pairs_above(centres.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding")), 0.05).withColumn("sim", F.round("sim", 6))


@query(f"SELECT a.article_id AS a, b.article_id AS b, round({_DOT.format(a='a.embedding', b='b.embedding')}, 5) AS sim FROM vectors a JOIN vectors b ON a.article_id < b.article_id WHERE {_DOT.format(a='a.embedding', b='b.embedding')} >= 0.3")
def similar_pairs(t: EngineTables) -> DataFrame:
    return similarity.pairs_above(t.vectors.select(F.col("article_id").alias("id"), "embedding"), 0.3).withColumn("sim", F.round("sim", 5))


@query(f"SELECT a.article_id AS a, b.article_id AS b, round({_DOT.format(a='a.embedding', b='b.embedding')}, 5) AS sim FROM vectors a JOIN vectors b ON a.article_id < b.article_id WHERE {_DOT.format(a='a.embedding', b='b.embedding')} >= 0.5")
def similar_pairs_pruned(t: EngineTables) -> DataFrame:
    """By blocks so small that there are many, each of which only meets those within reach."""
    return similarity.pairs_above(t.vectors.select(F.col("article_id").alias("id"), "embedding"), 0.5, block=32).withColumn("sim", F.round("sim", 5))


@query(f"""
WITH every AS (SELECT q.article_id AS query_id, v.article_id, round({_DOT.format(a='q.embedding', b='v.embedding')}, 12) AS sim FROM vectors q, vectors v WHERE q.article_id IN (SELECT article_id FROM membership)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, article_id) AS rank FROM every)
SELECT query_id, article_id, round(sim, 4) AS similarity, rank FROM ranked WHERE rank <= 3
""")
def knn_pruned(t: EngineTables) -> DataFrame:
    """The nearest of each clustered article, over blocks that its third nearest so far doesn't rule out."""
    clustered = t.vectors.join(t.membership, "article_id", "left_semi").select(F.col("article_id").alias("id"), "embedding")
    found = similarity.nearest(clustered, t.vectors.select(F.col("article_id").alias("id"), "embedding"), 3, block=64)
    return found.select("query_id", F.col("id").alias("article_id"), F.round("sim", 4).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH sims AS (SELECT floor(({_DOT.format(a='a.embedding', b='b.embedding')} + 1) / 2 * 20000)::BIGINT AS bin FROM vectors a JOIN vectors b ON a.article_id < b.article_id),
counts AS (SELECT bin, count(*) AS n, sum(count(*)) OVER (ORDER BY bin) AS seen, (SELECT count(*) FROM sims) AS pairs FROM sims GROUP BY bin)
SELECT share::DOUBLE AS share, round(min(bin) * 2 / 20000 - 1, 6) AS sim, any_value(pairs) AS pairs FROM counts, (VALUES (0.5), (0.95), (0.99), (1.0)) v(share) WHERE seen >= share * pairs GROUP BY share
""")
def similarity_percentiles(t: EngineTables) -> DataFrame:
    return reports.similarity_percentiles(t.vectors.select(F.col("article_id").alias("id"), "embedding"), (0.5, 0.95, 0.99, 1.0))


# --- life of clusters ---


@query("""
WITH counts AS (SELECT cluster_id, count(DISTINCT outlet_id) AS outlets FROM members GROUP BY 1)
SELECT c.cluster_id, CASE WHEN created_at < TIMESTAMP '2024-01-01 12:20:00' - INTERVAL 12 HOUR THEN CASE WHEN coalesce(outlets, 0) >= 2 THEN 'processed' ELSE 'discarded' END ELSE state END AS state
FROM clusters c LEFT JOIN counts USING (cluster_id)
""")
def close_expired(t: EngineTables) -> DataFrame:
    return cluster.close_expired(t.clusters, t.membership, t.articles, cluster.at("2024-01-01 12:20:00")).select("cluster_id", "state")


@query("SELECT cluster_id, count(DISTINCT outlet_id) AS outlets, count(DISTINCT outlet_id) >= 2 AS publishable FROM members GROUP BY 1")
def min_outlets_rule(t: EngineTables) -> DataFrame:
    return reports.outlets_of_clusters(t.membership, t.articles)


@query("SELECT outlets, count(*) AS clusters FROM (SELECT cluster_id, count(DISTINCT outlet_id) AS outlets FROM members WHERE article_id % 7 < cluster_id % 5 GROUP BY 1) GROUP BY 1")
def outlets_histogram(t: EngineTables) -> DataFrame:
    return reports.outlets_histogram(t.membership.filter("article_id % 7 < cluster_id % 5"), t.articles)


@query("SELECT article_id % 10 + cluster_id * 10 AS angle_id, count(DISTINCT outlet_id) AS outlets, count(DISTINCT outlet_id) >= 2 AS publishable FROM members WHERE article_id % 3 = 1 GROUP BY 1")
def outlets_of_angles(t: EngineTables) -> DataFrame:
    links = t.membership.filter("article_id % 3 = 1").selectExpr("article_id % 10 + cluster_id * 10 AS angle_id", "article_id")
    return synthesis.outlets_of_angles(links, t.articles)


@query(f"""
WITH pairs AS (SELECT a.article_id AS u, b.article_id AS v, {_DOT.format(a='a.embedding', b='b.embedding')} AS sim FROM vectors a JOIN vectors b ON a.article_id < b.article_id WHERE {_DOT.format(a='a.embedding', b='b.embedding')} >= 0.3),
edges AS (SELECT u, v, t FROM pairs, (VALUES (0.3), (0.35), (0.4)) th(t) WHERE sim >= t UNION ALL SELECT v, u, t FROM pairs, (VALUES (0.3), (0.35), (0.4)) th(t) WHERE sim >= t),
reach AS (SELECT u AS node, u AS root, t FROM edges UNION SELECT e.v, r.root, e.t FROM reach r JOIN edges e ON e.u = r.node AND e.t = r.t),
parts AS (SELECT node, t, min(root) AS part FROM reach GROUP BY 1, 2),
counted AS (SELECT t, part, count(DISTINCT outlet_id) AS outlets FROM parts JOIN articles ON article_id = node GROUP BY 1, 2)
SELECT t::DOUBLE AS threshold, count(*) AS groups, count(*) FILTER (WHERE outlets >= 2) AS publishable FROM counted GROUP BY 1
""")
def threshold_sweep(t: EngineTables) -> DataFrame:
    return reports.threshold_sweep(t.vectors, t.articles, (0.3, 0.35, 0.4))


@query(f"SELECT coalesce(({_DUCK_SEGMENTS})[1], '') AS section, {sql_map(topics.SECTIONS, f'({_DUCK_SEGMENTS})[1]')} AS topic, count(*) AS articles FROM (SELECT article_id, {SECTION_URL_DUCK} AS section_url FROM articles) GROUP BY 1, 2")
def section_coverage(t: EngineTables) -> DataFrame:
    return reports.section_coverage(sectioned(t), F.col("section_url"))


@query("""
WITH angle_articles AS (SELECT article_id FROM membership WHERE article_id % 2 = 0),
sizes AS (SELECT cluster_id, count(*) AS n_articles FROM members GROUP BY 1),
fresh AS (SELECT cluster_id, count(DISTINCT outlet_id) AS fresh_outlets FROM members WHERE article_id NOT IN (SELECT article_id FROM angle_articles) GROUP BY 1)
SELECT c.cluster_id, n_articles, fresh_outlets FROM clusters c JOIN sizes USING (cluster_id) JOIN fresh USING (cluster_id)
WHERE state IN ('open', 'processed') AND created_at >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 72 HOUR AND (articles_at_synthesis IS NULL OR articles_at_synthesis = -1 OR n_articles > articles_at_synthesis) AND fresh_outlets >= 2
""")
def eligible_clusters(t: EngineTables) -> DataFrame:
    backing = t.membership.filter("article_id % 2 = 0").select("article_id")
    return synthesis.eligible(t.clusters, t.membership, t.articles, backing, cluster.at(AS_OF)).select("cluster_id", "n_articles", "fresh_outlets")


@query("""
WITH due AS (SELECT cluster_id FROM clusters WHERE created_at < TIMESTAMP '2024-01-04 00:30:00' - INTERVAL 72 HOUR AND articles_at_synthesis IS NULL),
counts AS (SELECT cluster_id, count(*) AS n, count(DISTINCT outlet_id) AS outlets FROM members GROUP BY 1)
SELECT c.cluster_id, CASE WHEN d.cluster_id IS NOT NULL THEN -1 ELSE articles_at_synthesis END AS mark, CASE WHEN d.cluster_id IS NOT NULL AND outlets >= 2 THEN n END AS alerted
FROM clusters c LEFT JOIN due d USING (cluster_id) LEFT JOIN counts USING (cluster_id)
""")
def expire_clusters(t: EngineTables) -> DataFrame:
    marked, alerts = synthesis.expire(t.clusters, t.membership, t.articles, cluster.at("2024-01-04 00:30:00"))
    return marked.join(alerts, "cluster_id", "left").select("cluster_id", F.col("articles_at_synthesis").alias("mark"), F.col("n_articles").alias("alerted"))


@query("""
WITH due AS (SELECT cluster_id, count(*) AS n FROM clusters c JOIN members USING (cluster_id) WHERE created_at < TIMESTAMP '2024-01-04 00:30:00' - INTERVAL 72 HOUR AND articles_at_synthesis IS NULL GROUP BY 1 HAVING count(DISTINCT outlet_id) >= 2)
SELECT count(*) AS n_clusters, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_articles FROM due
""")
def expired_totals(t: EngineTables) -> DataFrame:
    _, alerts = synthesis.expire(t.clusters, t.membership, t.articles, cluster.at("2024-01-04 00:30:00"))
    return synthesis.expired_totals(alerts)


@query("""
SELECT cluster_id, first_value(cluster_id) OVER (PARTITION BY cluster_id % 3 ORDER BY created_at, cluster_id) AS survivor FROM clusters
""")
def fusion_survivors(t: EngineTables) -> DataFrame:
    return cluster.fusion_survivors(t.clusters, t.clusters.selectExpr("cluster_id", "cluster_id % 3 AS component")).select("cluster_id", "survivor")


#: Articles in order, one after the other: the nearest cluster, or else the nearest loose article. founder: of new
#: clusters the matched article, of old ones -1 less their id. {start} gives the old clusters' sums.
_ASSIGN = """
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY published_at, article_id) AS rn, article_id, list_transform(embedding, lambda y: y::DOUBLE) AS x FROM vectors JOIN articles USING (article_id)
  WHERE published_at >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 48 HOUR{loose}),
near AS MATERIALIZED (SELECT a.rn AS i, b.rn AS j, list_dot_product(a.x, b.x) AS sim FROM v a JOIN v b ON a.rn <> b.rn WHERE list_dot_product(a.x, b.x) >= 0.3),
walk AS (
  SELECT 0::BIGINT AS rn, []::BIGINT[] AS taken, {start} AS cs, NULL::BIGINT AS article_id, NULL::BIGINT AS other, NULL::BIGINT AS founder
  UNION ALL
  SELECT n, CASE WHEN gone OR (hit IS NULL AND y IS NULL) THEN taken WHEN hit IS NOT NULL THEN list_append(taken, n) ELSE taken || [n, y] END,
    CASE WHEN gone OR (hit IS NULL AND y IS NULL) THEN cs
         WHEN hit IS NOT NULL THEN list_transform(cs, lambda c, k: CASE WHEN k = hit THEN {{'founder': c.founder, 's': list_transform(list_zip(c.s, x), lambda z: z[1] + z[2])}} ELSE c END)
         ELSE list_append(cs, {{'founder': y_id, 's': list_transform(list_zip(x, y_x), lambda z: z[1] + z[2])}}) END,
    CASE WHEN NOT gone AND (hit IS NOT NULL OR y IS NOT NULL) THEN id END, CASE WHEN NOT gone AND hit IS NULL THEN y_id END,
    CASE WHEN gone THEN NULL WHEN hit IS NOT NULL THEN cs[hit].founder ELSE y_id END
  FROM (
    SELECT st.*, CASE WHEN list_max(sims) >= 0.3 THEN list_position(sims, list_max(sims)) END AS hit, b.article_id AS y_id, b.x AS y_x
    FROM (
      SELECT w.taken, w.cs, v.rn AS n, any_value(v.article_id) AS id, any_value(v.x) AS x, list_contains(w.taken, v.rn) AS gone, arg_max(p.j, p.sim) FILTER (WHERE NOT list_contains(w.taken, p.j)) AS y,
        list_transform(w.cs, lambda c: list_dot_product(c.s, any_value(v.x)) / sqrt(list_dot_product(c.s, c.s))) AS sims
      FROM walk w JOIN v ON v.rn = w.rn + 1 LEFT JOIN near p ON p.i = v.rn GROUP BY w.taken, w.cs, v.rn
    ) st LEFT JOIN v b ON b.rn = st.y)),
placed AS (SELECT article_id, founder FROM walk WHERE article_id IS NOT NULL UNION ALL SELECT other, founder FROM walk WHERE other IS NOT NULL)"""
_ASSIGN_NEW = _ASSIGN.format(start="[]::STRUCT(founder BIGINT, s DOUBLE[])[]", loose="")
_OLD_SUMS = """(SELECT list({'founder': -1 - cluster_id, 's': s} ORDER BY cluster_id) FROM (SELECT cluster_id, list(x ORDER BY pos) AS s FROM
    (SELECT cluster_id, pos, sum(embedding[pos]::DOUBLE) AS x FROM membership JOIN vectors USING (article_id), range(1, 65) r(pos) GROUP BY 1, 2) GROUP BY 1))"""


def _grouped(placed: DataFrame) -> DataFrame:
    """article_id and the least article of its cluster: ids of new clusters are hashes."""
    return placed.select("article_id", F.min("article_id").over(Window.partitionBy("cluster_id")).alias("first_article"))


def _assigned(t: EngineTables, mode: str) -> tuple[DataFrame, DataFrame]:
    return cluster.assign(t.articles, t.vectors, t.membership.limit(0), t.clusters.limit(0), cluster.at(AS_OF), LOOSE, mode)


@query(f"WITH RECURSIVE {_ASSIGN_NEW} SELECT article_id, min(article_id) OVER (PARTITION BY founder) AS first_article FROM placed")
def assign_exact(t: EngineTables) -> DataFrame:
    return _grouped(_assigned(t, "exact")[0])


@query()
def assign_rounds(t: EngineTables) -> DataFrame:
    return _grouped(_assigned(t, "rounds")[0])


@query(f"""
WITH RECURSIVE {_ASSIGN.format(start=_OLD_SUMS, loose=" AND article_id NOT IN (SELECT article_id FROM membership)")}
SELECT article_id, CASE WHEN founder < 0 THEN -1 - founder END AS cluster_id, CASE WHEN founder >= 0 THEN min(article_id) OVER (PARTITION BY founder) END AS first_article FROM placed
""")
def assign_default(t: EngineTables) -> DataFrame:
    """The default mode, on the real membership: loose articles join open clusters or make new ones."""
    placed, born = cluster.assign(t.articles, t.vectors, t.membership, t.clusters, cluster.at(AS_OF), LOOSE)
    new = born.select("cluster_id", F.lit(True).alias("new"))
    first = F.min("article_id").over(Window.partitionBy("cluster_id"))
    return placed.withColumn("f", first).join(new, "cluster_id", "left").select("article_id", F.when(F.col("new").isNull(), F.col("cluster_id")).alias("cluster_id"), F.when(F.col("new"), F.col("f")).alias("first_article"))


@query(f"WITH RECURSIVE {_ASSIGN_NEW} SELECT article_id, min(article_id) OVER (PARTITION BY founder) AS first_article FROM placed")
def assign_windows(t: EngineTables) -> DataFrame:
    """The default mode where no component fits one task: windows of articles, in order."""
    none, params = t.membership.limit(0), replace(LOOSE, component_cap=1)
    return _grouped(cluster.assign(t.articles, t.vectors, none, t.clusters.limit(0), cluster.at(AS_OF), params)[0])


@query(f"""
WITH RECURSIVE {_ASSIGN.format(start=_OLD_SUMS, loose=" AND article_id NOT IN (SELECT article_id FROM membership)")}
SELECT count(*) AS attached, count(DISTINCT founder) FILTER (WHERE founder >= 0) AS created, any_value(n) AS evaluated, any_value(n) - count(*) AS unmatched FROM placed, (SELECT count(*) AS n FROM v)
""")
def cluster_run_counters(t: EngineTables) -> DataFrame:
    placed, born = cluster.assign(t.articles, t.vectors, t.membership, t.clusters, cluster.at(AS_OF), LOOSE)
    return cluster.run_counters(placed, born, cluster.clusterable(t.articles, t.vectors, t.membership, cluster.at(AS_OF), LOOSE))


#: One step a row: labels fall along the edges of one snapshot, and where they don't any more, groups become clusters.
_FUSE = """
sums AS (SELECT founder, pos, sum(embedding[pos]::DOUBLE) AS x FROM placed JOIN vectors USING (article_id), range(1, 65) r(pos) GROUP BY 1, 2),
groups AS (SELECT founder, list(x ORDER BY pos) AS s FROM sums GROUP BY 1),
whole AS (SELECT list({{'m': m, 's': s}} ORDER BY founder) AS cs FROM groups JOIN (SELECT founder, list(article_id) AS m FROM placed GROUP BY 1) USING (founder)),
fusion AS (
  SELECT cs, {edges} AS edges, range(1, len(cs) + 1)::BIGINT[] AS label, NULL::BIGINT[] AS before FROM whole
  UNION ALL
  SELECT cs, CASE WHEN moved THEN {edges} ELSE edges END, CASE WHEN moved THEN range(1, len(cs) + 1)::BIGINT[] ELSE list_transform(label, lambda l, i: list_min(list_concat([l], list_transform(list_filter(edges, lambda e: e.a = i OR e.b = i), lambda e: least(label[e.a], label[e.b]))))) END,
    CASE WHEN moved THEN NULL::BIGINT[] ELSE label END
  FROM (
    SELECT label = before AS settled, coalesce(label = before, false) AS moved, edges, label, before,
      CASE WHEN label = before THEN list_transform(list_sort(list_distinct(label)), lambda r: {{'m': flatten(list_transform(list_filter(range(1, len(cs) + 1), lambda i: label[i] = r), lambda i: cs[i].m)),
        's': list_reduce(list_transform(list_filter(range(1, len(cs) + 1), lambda i: label[i] = r), lambda i: cs[i].s), lambda x, y: list_transform(list_zip(x, y), lambda z: z[1] + z[2]))}}) ELSE cs END AS cs
    FROM fusion WHERE len(edges) > 0)),
final AS (SELECT unnest(cs).m AS m FROM fusion WHERE len(edges) = 0)
"""
_EDGES = """flatten(list_transform(range(1, len(cs) + 1), lambda i: list_transform(list_filter(range(i + 1, len(cs) + 1), lambda j: list_dot_product(cs[i].s, cs[j].s) >= 0.35 * sqrt(list_dot_product(cs[i].s, cs[i].s) * list_dot_product(cs[j].s, cs[j].s))), lambda j: {'a': i, 'b': j})))"""


@query(f"WITH RECURSIVE {_ASSIGN_NEW}, {_FUSE.format(edges=_EDGES)} SELECT unnest(m) AS article_id, list_min(m) AS first_article FROM final")
def fuse_fixed_point(t: EngineTables) -> DataFrame:
    placed, born = _assigned(t, "exact")
    _, members, _ = cluster.fuse(born, placed, t.vectors, None, cluster.at(AS_OF), LOOSE)
    return _grouped(members)


@query(f"WITH RECURSIVE {_ASSIGN_NEW}, {_FUSE.format(edges=_EDGES)} SELECT unnest(m) AS article_id, list_min(m) AS first_article FROM final")
def cycle_membership(t: EngineTables) -> DataFrame:
    """What a reader of the store sees after a whole cycle that finds no new items, but all articles loose."""
    store = Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    state = State.begin(store, t.outlets, feeds.page_bodies(t.pages), articles=t.articles, vectors=t.vectors, membership=t.membership.limit(0), clusters=t.clusters.limit(0))
    log = run_cycle(state, t.articles.limit(0), cluster.at(AS_OF), similarity.hashing_encoder(64), params=LOOSE, vector_limit=0)
    if failed := log.filter("status <> 'done'").collect():
        raise RuntimeError(failed[0]["trace"])
    return _grouped(store.read("membership"))


#: Open clusters' articles as they are, and the marks of those that fuse.
_FUSED_MARKS = f"""
placed AS (SELECT article_id, cluster_id AS founder FROM membership WHERE cluster_id IN (SELECT cluster_id FROM clusters WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR)),
{_FUSE.format(edges=_EDGES)},
fused AS (SELECT row_number() OVER () AS g, m FROM final),
parts AS (SELECT DISTINCT g, cluster_id FROM (SELECT g, unnest(m) AS article_id FROM fused) JOIN membership USING (article_id)),
heads AS (SELECT g, arg_min(cluster_id, (created_at, cluster_id)) AS cluster_id, max(articles_at_synthesis) AS mark FROM parts JOIN clusters USING (cluster_id) GROUP BY g)"""


@query(f"WITH RECURSIVE {_FUSED_MARKS} SELECT cluster_id, mark FROM heads UNION ALL SELECT cluster_id, articles_at_synthesis FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM parts)")
def fusion_marks(t: EngineTables) -> DataFrame:
    """The clusters that are left after fusion, each with the greatest mark of its group."""
    kept, _, _ = cluster.fuse(t.clusters, t.membership, t.vectors, None, cluster.at(AS_OF), LOOSE)
    return kept.select("cluster_id", F.col("articles_at_synthesis").alias("mark"))


@query("""
WITH RECURSIVE e AS (SELECT doc_id AS u, (SELECT min(doc_id) FROM documents d2 WHERE md5(d2.text) = md5(d.text)) AS v FROM documents d)
SELECT u AS node, v AS component FROM e WHERE u IN (SELECT u FROM e WHERE u <> v) OR u IN (SELECT v FROM e WHERE u <> v)
""")
def connected_copies(t: EngineTables) -> DataFrame:
    keyed = t.documents.select("doc_id", F.md5("text").alias("h"))
    nearest_copy = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    return components.connected_components(keyed.select(F.col("doc_id").alias("u"), nearest_copy.alias("v")))


@query("""
SELECT count(*) AS ingested, count(m.article_id) AS clustered, count(m.article_id) FILTER (WHERE m.article_id % 5 = 0) AS published FROM articles LEFT JOIN membership m USING (article_id)
""")
def funnel(t: EngineTables) -> DataFrame:
    return reports.funnel(t.articles, t.membership, t.articles.filter("article_id % 5 = 0").select("article_id"))


@query("""
WITH firsts AS (SELECT cluster_id, outlet_id, min(published_at) AS since FROM members GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY since, outlet_id) AS r FROM firsts)
SELECT cluster_id, CAST((epoch(max(since) FILTER (WHERE r = 2)) - epoch(max(since) FILTER (WHERE r = 1))) / 60 AS BIGINT) AS lag_minutes FROM ranked GROUP BY 1 HAVING count(*) > 1
""")
def second_outlet_lag(t: EngineTables) -> DataFrame:
    return reports.second_outlet_lag(t.membership, t.articles)


# --- evidence ---

_STOP = ", ".join(f"'{w}'" for w in evidence.STOP_WORDS)
_DUCK_WORDS = f"list_filter(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda w: w NOT IN ({_STOP}))"


def _duck_terms(column: str) -> str:
    words = _DUCK_WORDS.format(column)
    return f"list_concat({words}, list_transform(range(1, len({words})), lambda i: ({words})[i] || ' ' || ({words})[i + 1]))"


_TERMS = (
    "words AS (SELECT article_id, " + _DUCK_WORDS.format("body") + " AS w FROM articles), "
    "every_term AS (SELECT article_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words), "
    "n AS (SELECT count(*) AS n_docs FROM articles), "
    "vocabulary AS (SELECT term, count(DISTINCT article_id) AS df, any_value(n_docs) AS n_docs FROM every_term, n GROUP BY term HAVING any_value(n_docs) < 20 OR (count(DISTINCT article_id) >= 3 AND count(DISTINCT article_id) <= 0.4 * any_value(n_docs))), "
    "idf AS (SELECT term, df, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM vocabulary)"
)


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(t: EngineTables) -> DataFrame:
    return evidence.fit_vocabulary(t.articles.select("article_id", F.col("body").alias("text")), "article_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""
WITH {_TERMS}, tf AS (SELECT article_id, term, count(*) AS tf FROM every_term GROUP BY 1, 2),
raw AS (SELECT article_id, term, (1 + ln(tf)) * idf AS x FROM tf JOIN idf USING (term))
SELECT article_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY article_id)), 6) AS weight FROM raw
""")
def tfidf_weights(t: EngineTables) -> DataFrame:
    docs = t.articles.select("article_id", F.col("body").alias("text"))
    known = evidence.known_counts(docs, ["article_id"], evidence.parts_for(t.documents))  # articles' texts, before any join
    return evidence.unit_weights(known, ["_part", "article_id"]).select("article_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def vocabulary_by_day(t: EngineTables) -> DataFrame:
    """A store takes the counts of three batches of articles, and the vocabulary comes from these alone."""
    store = Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    docs = t.articles.select("article_id", "published_at", F.col("body").alias("text"))
    for batch in range(3):
        terms, days = evidence.day_terms(docs.filter(F.col("article_id") % 3 == batch), "article_id", F.col("published_at"))
        with store.commit("articles", batch) as c:
            c.append(terms, "day_terms")
            c.append(days, "day_docs")
    return evidence.merged_vocabulary(store.read("day_terms"), store.read("day_docs")).select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT count(*) AS n_docs, (SELECT count(*) FROM articles WHERE article_id % 5 > 0) AS trained_on, count(*) > (SELECT count(*) FROM articles WHERE article_id % 5 > 0) * 1.2 AS refit FROM articles")
def vocabulary_refit(t: EngineTables) -> DataFrame:
    docs = t.articles.select("article_id", F.col("title").alias("text"))
    return evidence.needs_refit(docs, evidence.fit_vocabulary(docs.filter("article_id % 5 > 0"), "article_id"))


_WEIGHTS = f"""{_TERMS},
outlet_terms AS (SELECT m.cluster_id, m.outlet_id, e.term, count(*) AS tf FROM members m JOIN every_term e USING (article_id) GROUP BY 1, 2, 3),
raw AS (SELECT cluster_id, outlet_id, term, (1 + ln(tf)) * idf AS x FROM outlet_terms JOIN idf USING (term)),
weights AS (SELECT cluster_id, outlet_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id, outlet_id)) AS weight FROM raw),
many AS (SELECT cluster_id, count(DISTINCT outlet_id) AS n_outlets FROM weights GROUP BY 1)"""


def _weights(t: EngineTables) -> DataFrame:
    """Weights of the terms of each outlet of a cluster, whose articles count together."""
    docs = t.articles.select("article_id", F.col("body").alias("text"))
    parts = evidence.parts_for(t.documents)
    members = evidence.in_parts(t.membership.join(t.articles.select("article_id", "outlet_id"), "article_id"), ["article_id"], parts)
    of_members = evidence.known_counts(docs, ["article_id"], parts).join(members.hint("shuffle_hash"), ["_part", "article_id"])
    of_outlets = of_members.groupBy("cluster_id", "outlet_id", "term").agg(F.sum("tf").alias("tf"), F.max("idf").alias("idf"))
    return written(evidence.unit_weights(of_outlets, ["cluster_id", "outlet_id"]), "weights")


_PLATFORM_TEST = " OR ".join(f"contains(term, '{p}')" for p in sorted(text.PLATFORMS))


@query(f"""
WITH {_WEIGHTS},
excess AS (SELECT w.cluster_id, outlet_id, term, round(weight - (sum(weight) OVER (PARTITION BY w.cluster_id, term) - weight) / (n_outlets - 1), 9) AS excess FROM weights w JOIN many USING (cluster_id) WHERE n_outlets > 1),
names AS (SELECT name FROM outlets WHERE length(name) > 3),
ok AS (SELECT * FROM excess WHERE excess > 0 AND NOT ({_PLATFORM_TEST}) AND NOT EXISTS (SELECT 1 FROM names WHERE contains(term, name))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, outlet_id ORDER BY excess DESC, term) AS rank FROM ok)
SELECT cluster_id, outlet_id, rank, round(excess, 5) AS excess FROM ranked WHERE rank <= 8
""")
def own_terms(t: EngineTables) -> DataFrame:
    return evidence.own_terms(_weights(t), t.outlets).select("cluster_id", "outlet_id", F.col("rank").cast("long").alias("rank"), F.round("excess", 5).alias("excess"))


#: Each article of a cluster ends with words of its own cluster, and with one that is too common to count.
_TOLD = "title || CASE WHEN cluster_id IS NULL THEN '' ELSE ' suceso' || cluster_id || ' acuerdo lugar' || (cluster_id % 5) END"


@query(f"""
WITH told AS (SELECT article_id, outlet_id, cluster_id, {_TOLD} AS body FROM articles LEFT JOIN membership USING (article_id)),
{_WEIGHTS.replace('FROM articles', 'FROM told')},
shared AS (SELECT w.cluster_id, term, round(min(weight), 9) AS least FROM weights w JOIN many USING (cluster_id) WHERE n_outlets > 1 GROUP BY w.cluster_id, term, n_outlets HAVING count(*) = n_outlets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY least DESC, term) AS rank FROM shared WHERE least > 0)
SELECT cluster_id, term, rank, round(least, 5) AS least FROM ranked WHERE rank <= 8
""")
def shared_terms(t: EngineTables) -> DataFrame:
    told = t.articles.join(t.membership, "article_id", "left").select("article_id", "outlet_id", "cluster_id", F.expr(_TOLD).alias("text"))
    vocabulary = evidence.fit_vocabulary(told, "article_id")
    weights = evidence.tfidf(told.filter("cluster_id IS NOT NULL"), ["cluster_id", "outlet_id"], vocabulary)
    return evidence.shared_terms(weights).select("cluster_id", "term", F.col("rank").cast("long").alias("rank"), F.round("least", 5).alias("least"))


_MISTAKEN = ", ".join(f"'{w}'" for w in sorted(text.MISTAKEN | text.PLATFORMS))
_CAPS = "CASE WHEN upper(raw) = raw AND contains(raw, ' ') THEN array_to_string(list_transform(string_split(lower(raw), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE raw END"
_MENTIONS = f"""
found AS (SELECT cluster_id, outlet_id, unnest(regexp_extract_all(title || '. ' || substring(body, 1, 4000), '\\p{{Lu}}\\p{{L}}+(?: \\p{{Lu}}\\p{{L}}+)*')) AS raw FROM members),
named AS (SELECT cluster_id, outlet_id, {_CAPS} AS entity FROM found),
mentions AS (SELECT cluster_id, outlet_id, entity, count(*) AS n FROM named WHERE length(entity) > 3 AND lower(entity) NOT IN ({_MISTAKEN}) AND NOT EXISTS (SELECT 1 FROM outlets WHERE contains(lower(entity), name)) GROUP BY 1, 2, 3)"""


@query(f"WITH {_MENTIONS} SELECT cluster_id, outlet_id, entity, n FROM mentions WHERE n >= 2")
def entity_counts(t: EngineTables) -> DataFrame:
    return evidence.mentions(t.membership.join(t.articles, "article_id"), t.outlets).filter("n >= 2")


@query(f"""
WITH {_MENTIONS},
kept AS (SELECT * FROM mentions WHERE n >= 2),
pairs AS (SELECT DISTINCT cluster_id, outlet_id FROM members),
many AS (SELECT cluster_id, count(*) AS n_outlets FROM pairs GROUP BY 1),
spread AS (SELECT cluster_id, entity, count(DISTINCT outlet_id) AS n FROM kept GROUP BY 1, 2)
SELECT p.cluster_id, p.outlet_id,
  (SELECT count(*) FROM spread s JOIN many m USING (cluster_id) WHERE s.cluster_id = p.cluster_id AND s.n = m.n_outlets) AS n_common,
  (SELECT coalesce(string_agg(k.entity, '|' ORDER BY k.entity), '') FROM kept k JOIN spread s USING (cluster_id, entity) WHERE k.cluster_id = p.cluster_id AND k.outlet_id = p.outlet_id AND s.n = 1) AS exclusive,
  (SELECT count(*) FROM spread s WHERE s.cluster_id = p.cluster_id AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.cluster_id = p.cluster_id AND k.outlet_id = p.outlet_id AND k.entity = s.entity)) AS n_omitted
FROM pairs p
""")
def entity_sets(t: EngineTables) -> DataFrame:
    members = t.membership.join(t.articles, "article_id")
    found = evidence.mentions(members, t.outlets).filter("n >= 2")
    sets = evidence.entity_sets(found, members.select("cluster_id", "outlet_id").distinct())
    return sets.select("cluster_id", "outlet_id", F.size("common").cast("long").alias("n_common"), joined("exclusive").alias("exclusive"), F.size("omitted").cast("long").alias("n_omitted"))


#: Forms in order, with the earlier ones that they match, and one step a form: is one of these canonical?
_CANONICAL = f"""{_MENTIONS},
forms AS MATERIALIZED (SELECT cluster_id, entity, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(entity) DESC, entity) AS rn, lower(entity) AS low,
  list_distinct(list_filter(regexp_extract_all(lower(entity), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3)) AS words FROM (SELECT cluster_id, entity, sum(n) AS n FROM mentions GROUP BY 1, 2)),
earlier AS MATERIALIZED (SELECT b.cluster_id, b.rn, list(a.rn) FILTER (WHERE a.rn IS NOT NULL) AS matches FROM forms b LEFT JOIN forms a ON a.cluster_id = b.cluster_id AND a.rn < b.rn
  AND (contains(a.low, b.low) OR contains(b.low, a.low) OR len(list_intersect(a.words, b.words)) > 1) GROUP BY 1, 2),
heads AS (
  SELECT cluster_id, 0::BIGINT AS rn, []::BIGINT[] AS chosen, NULL::BIGINT AS head FROM (SELECT DISTINCT cluster_id FROM forms)
  UNION ALL
  SELECT h.cluster_id, e.rn, CASE WHEN list_has_any(coalesce(e.matches, []), h.chosen) THEN h.chosen ELSE list_append(h.chosen, e.rn) END, coalesce(list_min(list_intersect(coalesce(e.matches, []), h.chosen)), e.rn)
  FROM heads h JOIN earlier e ON e.cluster_id = h.cluster_id AND e.rn = h.rn + 1),
canonical AS (SELECT f.cluster_id, f.entity, c.entity AS canonical FROM heads h JOIN forms f USING (cluster_id, rn) JOIN forms c ON c.cluster_id = h.cluster_id AND c.rn = h.head)"""


@query(f"WITH RECURSIVE {_CANONICAL} SELECT cluster_id, entity, canonical FROM canonical")
def canonical_entities(t: EngineTables) -> DataFrame:
    found = evidence.mentions(t.membership.join(t.articles, "article_id"), t.outlets)
    return evidence.canonical_entities(found.groupBy("cluster_id", "entity").agg(F.sum("n").alias("n")))


@query(f"WITH RECURSIVE {_CANONICAL} SELECT cluster_id, outlet_id, canonical AS entity, CAST(sum(n) AS BIGINT) AS n FROM mentions JOIN canonical USING (cluster_id, entity) GROUP BY 1, 2, 3 HAVING sum(n) >= 2")
def entities(t: EngineTables) -> DataFrame:
    """Counted over canonical names, and then kept if an outlet has enough of them."""
    return evidence.entities(t.membership.join(t.articles, "article_id"), t.outlets)


@query(f"""
WITH {_CENTROIDS_DUCK},
sims AS (SELECT m.cluster_id, m.article_id, m.outlet_id, round(sum(CAST(v.embedding[c.pos] AS DOUBLE) * c.x), 9) AS sim FROM members m JOIN vectors v USING (article_id) JOIN member_centroids c ON c.cluster_id = m.cluster_id GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, outlet_id ORDER BY sim DESC, article_id) AS rn, min(article_id) OVER (PARTITION BY cluster_id, outlet_id) AS f FROM sims),
ordered AS (SELECT *, dense_rank() OVER (PARTITION BY cluster_id ORDER BY f) AS ord, rn > 2 AS late FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY late, CASE WHEN late THEN rn ELSE ord END, CASE WHEN late THEN ord ELSE rn END) AS pos FROM ordered)
SELECT cluster_id, article_id, pos FROM placed WHERE NOT late OR pos <= 30
""".replace("member_centroids", "(SELECT p.cluster_id, p.pos, p.x / l.length AS x FROM mparts p JOIN (SELECT cluster_id, sqrt(sum(x * x)) AS length FROM mparts GROUP BY 1) l USING (cluster_id))").replace(
    "sims AS (", "mparts AS (SELECT m.cluster_id, i AS pos, sum(CAST(v.embedding[i] AS DOUBLE)) AS x FROM members m JOIN vectors v USING (article_id), range(1, 65) r(i) GROUP BY 1, 2), sims AS (", 1))
def select_representatives(t: EngineTables) -> DataFrame:
    members = t.membership.join(t.articles.select("article_id", "outlet_id"), "article_id").select("cluster_id", "article_id", "outlet_id")
    return evidence.select_representatives(members, t.vectors).select("cluster_id", "article_id", F.col("pos").cast("long").alias("pos"))


@query()
def cluster_evidence(t: EngineTables) -> DataFrame:
    docs = t.articles.select("article_id", F.col("body").alias("text"))
    members = t.membership.join(t.articles, "article_id").select("cluster_id", "article_id", "outlet_id")
    return evidence.evidence(members, t.vectors, t.outlets, lambda terms: evidence.fit_vocabulary(docs, "article_id", only=terms), articles=t.articles)


#: The chosen articles of each cluster, and what evidence says of the entities of its outlets.
_CHOSEN = ORACLES["select_representatives"].removeprefix(f"WITH RECURSIVE {ORACLE_VIEWS},").strip().removesuffix("SELECT cluster_id, article_id, pos FROM placed WHERE NOT late OR pos <= 30").strip()


@query(f"""
WITH RECURSIVE {_CHOSEN},
chosen AS (SELECT m.* FROM placed p JOIN members m USING (cluster_id, article_id) WHERE NOT p.late OR p.pos <= 30),
{_CANONICAL.replace("FROM members", "FROM chosen").replace("forms AS", "forms AS").replace("found AS", "raw_names AS").replace("FROM found", "FROM raw_names").replace("named AS", "named_entities AS").replace("FROM named ", "FROM named_entities ")},
kept AS (SELECT cluster_id, outlet_id, canonical AS entity FROM mentions JOIN canonical USING (cluster_id, entity) GROUP BY 1, 2, 3 HAVING sum(n) >= 2),
pairs AS (SELECT cluster_id, outlet_id, count(*) AS n_articles FROM chosen GROUP BY 1, 2),
many AS (SELECT cluster_id, count(*) AS n_outlets FROM pairs GROUP BY 1),
spread AS (SELECT cluster_id, entity, count(DISTINCT outlet_id) AS n FROM kept GROUP BY 1, 2)
SELECT p.cluster_id, p.outlet_id, p.n_articles,
  (SELECT count(*) FROM spread s JOIN many m USING (cluster_id) WHERE s.cluster_id = p.cluster_id AND s.n = m.n_outlets) AS n_core,
  (SELECT coalesce(string_agg(k.entity, '|' ORDER BY k.entity), '') FROM kept k JOIN spread s USING (cluster_id, entity) WHERE k.cluster_id = p.cluster_id AND k.outlet_id = p.outlet_id AND s.n = 1) AS exclusive,
  (SELECT count(*) FROM spread s WHERE s.cluster_id = p.cluster_id AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.cluster_id = p.cluster_id AND k.outlet_id = p.outlet_id AND k.entity = s.entity)) AS n_omitted
FROM pairs p
""")
def evidence_outlets(t: EngineTables) -> DataFrame:
    """cluster_evidence as a row an outlet: its chosen articles, and its entities beside those of the others."""
    each = cluster_evidence(t).select("cluster_id", F.size("core_entities").cast("long").alias("n_core"), F.explode("outlets").alias("o"))
    return each.select("cluster_id", "o.outlet_id", "o.n_articles", "n_core", joined("o.exclusive").alias("exclusive"), F.size("o.omitted").cast("long").alias("n_omitted"))


# --- synthesis ---


def _selected(t: EngineTables) -> DataFrame:
    members = t.membership.join(t.articles.select("article_id", "outlet_id"), "article_id")
    return members.withColumn("pos", F.row_number().over(Window.partitionBy("cluster_id").orderBy("article_id")).cast("long"))


@query("""
WITH selected AS (SELECT cluster_id, article_id, outlet_id, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS pos FROM members),
notes AS (SELECT DISTINCT cluster_id, cluster_id % 3 AS position, unnest([1, 2, 2, 3 + cluster_id, 999]) AS pos FROM clusters)
SELECT cluster_id, position, article_id, outlet_id FROM notes JOIN selected USING (cluster_id, pos)
""")
def note_join(t: EngineTables) -> DataFrame:
    angles = t.clusters.selectExpr("cluster_id", "cluster_id % 3 AS position", "array(1L, 2L, 2L, 3L + cluster_id, 999L) AS notes")
    return synthesis.noted_articles(angles, _selected(t))


def _responses(t: EngineTables) -> DataFrame:
    """One raw response a document: some fenced, some with a bad topic, too long a hook, or no list."""
    return t.documents.selectExpr(
        "doc_id",
        """CASE WHEN doc_id % 10 = 9 THEN '{"angles": "[1]"}' ELSE concat(CASE WHEN doc_id % 2 = 0 THEN '```json\n' ELSE '' END,
        to_json(named_struct('angles', array(named_struct('id_existing', CAST(NULL AS BIGINT), 'title', text, 'summary', text, 'key_points', array('a'),
            'topics', CASE doc_id % 5 WHEN 0 THEN array('politica') WHEN 1 THEN array('economia', 'sociedad') WHEN 2 THEN array('unknown') WHEN 3 THEN array('politica', 'ciencia', 'deportes') ELSE array('ciencia') END,
            'subtopics', CASE WHEN doc_id % 3 = 0 THEN array('futbol') ELSE array() END, 'relevant', true, 'hook', repeat('x', CAST(doc_id % 300 AS INT)), 'hashtags', array_repeat('t', CAST(doc_id % 8 AS INT)),
            'comparison', array(named_struct('outlet', source, 'highlighted', 'h', 'omitted', 'o', 'quote', 'q')), 'notes', array(1, 2))))), CASE WHEN doc_id % 2 = 0 THEN '\n```' ELSE '' END) END AS content""",
    )


@query("SELECT doc_id, doc_id % 10 <> 9 AND doc_id % 5 IN (0, 1, 4) AND doc_id % 300 <= 240 AND doc_id % 8 <= 6 AS valid FROM documents")
def angle_validation(t: EngineTables) -> DataFrame:
    raw = _responses(t).select("doc_id", F.to_json(F.struct("content")).alias("raw"))
    texts = raw.select("doc_id", synthesis.response_text(F.col("raw")).alias("text"))
    return synthesis.parsed(texts).select("doc_id", F.col("angles").isNotNull().alias("valid"))


@query("""
SELECT cluster_id AS key, name, max(pos) AS pos FROM (SELECT DISTINCT cluster_id, name, outlet_id, outlet_id AS pos FROM members JOIN outlets USING (outlet_id) UNION ALL
  SELECT DISTINCT cluster_id, name, outlet_id, outlet_id + 100 FROM members JOIN outlets USING (outlet_id) WHERE outlet_id % 2 = 0) GROUP BY 1, 2
""")
def comparison_name_fold(t: EngineTables) -> DataFrame:
    known = t.membership.join(t.articles, "article_id").join(t.outlets, "outlet_id").select(F.col("cluster_id").alias("key"), "name", "outlet_id").distinct()
    plain = known.select("key", F.col("outlet_id").cast("long").alias("pos"), F.concat(F.lit(" "), F.upper("name")).alias("outlet"))
    accented = known.filter("outlet_id % 2 = 0").select("key", (F.col("outlet_id") + 100).cast("long").alias("pos"), F.translate("name", "src", "śŕç").alias("outlet"))
    unknown = known.select("key", F.lit(999).cast("long").alias("pos"), F.concat("name", F.lit("x")).alias("outlet"))
    return synthesis.canonical_outlet(plain.unionByName(accented).unionByName(unknown), known.select("key", "name")).select("key", "name", "pos")


@query("""
SELECT doc_id, 'a=' || (CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END) || '|b=old' || (CASE WHEN doc_id % 3 = 0 THEN '|c=' || text ELSE '' END) AS merged FROM documents
""")
def map_merge(t: EngineTables) -> DataFrame:
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    new = F.map_filter(F.create_map(F.lit("a"), F.when(F.col("doc_id") % 2 == 0, "new"), F.lit("c"), F.when(F.col("doc_id") % 3 == 0, F.col("text"))), lambda k, v: v.isNotNull())
    entries = F.array_sort(F.map_entries(synthesis.merged_map(old, new)))
    return t.documents.select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("merged"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang ELSE source END AS topics, source AS back_first, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS back_second FROM documents")
def array_migration(t: EngineTables) -> DataFrame:
    moved = t.documents.select("doc_id", synthesis.as_list(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("list"))
    return moved.select("doc_id", joined("list").alias("topics"), synthesis.as_scalar(F.col("list"), 1).alias("back_first"), synthesis.as_scalar(F.col("list"), 2).alias("back_second"))


_EMOJI = "CASE WHEN doc_id % 3 = 0 THEN '🙂 ' || text ELSE text END"
_HEAVY = "length({t}) + length(regexp_replace({t}, '[\\x{{0}}-\\x{{10FF}}]', '', 'g'))"


@query(f"SELECT doc_id, {_HEAVY.format(t='t')} AS weight FROM (SELECT doc_id, {_EMOJI} AS t FROM documents)")
def weighted_length(t: EngineTables) -> DataFrame:
    return t.documents.select("doc_id", text.weight(F.expr(_EMOJI)).cast("long").alias("weight"))


@query(f"""
SELECT doc_id, {_HEAVY.format(t='t')} + {_HEAVY.format(t='tags')} + CASE WHEN tags <> '' THEN 2 ELSE 0 END + 24 AS weight
FROM (SELECT doc_id, {_EMOJI} AS t, CASE WHEN doc_id % 2 = 0 THEN '#' || lang || ' #' || source ELSE '' END AS tags FROM documents)
""")
def post_weight(t: EngineTables) -> DataFrame:
    tags = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return t.documents.select("doc_id", text.post_weight(F.expr(_EMOJI), tags).cast("long").alias("weight"))


#: Some texts short enough for a post, some with heavy characters, and all others whole. Tags: 0 to 5, some long.
_POST = "CASE WHEN doc_id % 4 = 1 THEN replace(text, 'e', '🙂') WHEN doc_id % 4 = 2 THEN replace(text, ' ', '') ELSE text END"
_CUT = """CASE WHEN {w} <= {limit} THEN t WHEN {limit} <= 2 THEN '' ELSE regexp_replace(
    CASE WHEN regexp_matches(substring(t, {n} + 1, 1), '^\\s') THEN substring(t, 1, {n}) ELSE regexp_replace(substring(t, 1, {n}), ' [^ ]*$', '') END, '[ ,;:.]+$', '') || '…' END"""


def _duck_cut(limit: str) -> str:
    """The longest prefix by trying all; ws: the weights of the first characters."""
    n = f"coalesce(list_max(list_filter(range(1, 300), lambda i: list_sum(ws[1:i]) <= {limit} - 2)), 0)"
    return _CUT.format(w=_HEAVY.format(t="t"), limit=limit, n=n)


def _duck_block(tags: str) -> str:
    return f"array_to_string(list_transform({tags}, lambda x: '#' || x), ' ')"


def _duck_whole(t: str, tags: str) -> str:
    return f"({_HEAVY.format(t=t)} + length({_duck_block(tags)}) + CASE WHEN len({tags}) > 0 THEN 2 ELSE 0 END + 24)"


@query(f"""
WITH posts AS (SELECT doc_id, {_POST} AS t, list_transform(range(0, doc_id % 6), lambda i: CASE WHEN doc_id % 7 = 0 THEN repeat(lang, 70) ELSE source || lang END || i) AS tags FROM documents),
weighed AS (SELECT *, list_transform(range(1, 300), lambda i: CASE WHEN unicode(substring(t, i, 1)) > 4351 THEN 2 ELSE 1 END) AS ws FROM posts),
kept AS (SELECT doc_id, t, ws, tags[1:greatest(coalesce(list_max(list_filter(range(1, len(tags) + 1), lambda k: {_duck_whole('t', 'tags[1:k]')} <= 280)), 0), least(len(tags), 2))] AS tags FROM weighed),
cut_ AS (SELECT doc_id, t, tags, {_duck_whole('t', 'tags')} AS w, {_duck_cut("(254 - length(" + _duck_block("tags") + "))")} AS beside, {_duck_cut("254")} AS alone FROM kept),
fit AS (SELECT doc_id, CASE WHEN w <= 280 THEN t WHEN beside <> '' AND {_duck_whole('beside', 'tags')} <= 280 THEN beside ELSE alone END AS hook,
  CASE WHEN w <= 280 OR (beside <> '' AND {_duck_whole('beside', 'tags')} <= 280) THEN tags ELSE [] END AS tags FROM cut_)
SELECT doc_id, hook, array_to_string(tags, '|') AS tags, {_duck_whole('hook', 'tags')} AS weight FROM fit
""")
def fit_post(t: EngineTables) -> DataFrame:
    tag = F.when(F.col("doc_id") % 7 == 0, F.repeat("lang", F.lit(70))).otherwise(F.concat("source", "lang"))
    tags = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < F.col("doc_id") % 6), lambda i: F.concat(tag, i.cast("string")))
    posts = t.documents.select("doc_id", F.expr(_POST).alias("t"), tags.alias("tags"))
    fitted = posts.select("doc_id", text.fitted_post(F.col("t"), F.col("tags")).alias("p"))
    return fitted.select("doc_id", F.col("p.text").alias("hook"), joined("p.tags").alias("tags"), text.post_weight(F.col("p.text"), F.col("p.tags")).cast("long").alias("weight"))


@query("""
SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S-03:00') AS iso, strftime(ts - INTERVAL 3 HOUR, '%d/%m %H:%M:%S') AS short, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS seconds FROM events
""")
def iso_times(t: EngineTables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", times.iso_local(ts).alias("iso"), times.short_local(ts).alias("short"), times.iso_utc(ts).alias("utc"), times.epoch(ts).alias("seconds"))


def _prompts(t: EngineTables) -> DataFrame:
    """Prompts from notes by article, terms of each outlet, and angles of even clusters."""
    selected = _selected(t).join(t.articles.select("article_id", F.expr("concat('T', article_id) AS title"), F.expr(SECTION_URL_SPARK).alias("url"), "body"), "article_id")
    outlets = t.membership.join(t.articles, "article_id").join(t.outlets, "outlet_id").select("cluster_id", "outlet_id", "name").distinct()
    entry = F.expr("named_struct('name', name, 'own_terms', array(concat('o', outlet_id), 'p'), 'exclusive', array(concat('e', outlet_id)), 'omitted', array('m', 'n'))")
    shown = outlets.groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("outlets")).selectExpr("cluster_id", "outlets", "array('t1', 't2') AS core_terms", "array('E') AS core_entities")
    angles = t.clusters.filter("cluster_id % 2 = 0").selectExpr("cluster_id", "explode(array(cluster_id + 50, cluster_id + 70)) AS angle_id", "title")
    return synthesis.prompts(shown, selected, t.outlets, angles)


@query(f"""
WITH chosen AS (SELECT cluster_id, article_id, outlet_id, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS pos, body, {SECTION_URL_DUCK} AS section_url FROM members),
said AS (SELECT c.*, o.name, {sql_map(topics.SECTIONS, f'({_DUCK_SEGMENTS})[1]')} AS topic, coalesce({sql_map(topics.SUBSECTIONS, f'({_DUCK_SEGMENTS})[1]')}, {sql_map(topics.SUBSECTIONS, f'({_DUCK_SEGMENTS})[2]')}) AS sub FROM chosen c JOIN outlets o USING (outlet_id)),
notes AS (SELECT cluster_id, string_agg('### Note ' || pos || ', ' || name || chr(10) || 'Title: T' || article_id || chr(10) || 'Section: ' || coalesce(nullif(concat_ws(' / ', topic, sub), ''), 'none') || chr(10) || body, chr(10) || chr(10) ORDER BY pos) AS notes FROM said GROUP BY 1),
lines AS (SELECT cluster_id, string_agg('- ' || name || ': own terms o' || outlet_id || ', p; only it names e' || outlet_id || '; it leaves out m, n', chr(10) ORDER BY name) AS lines FROM (SELECT DISTINCT cluster_id, outlet_id, name FROM said) GROUP BY 1)
SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'Angles already published (repeat an id to update it):' || chr(10) || '- ' || (cluster_id + 50) || ': event ' || cluster_id || chr(10) || '- ' || (cluster_id + 70) || ': event ' || cluster_id || chr(10) ELSE '' END
  || 'Split this coverage into angles.' || chr(10) || chr(10) || 'All outlets share: t1, t2, E' || chr(10) || lines || chr(10) || chr(10) || notes AS prompt
FROM notes JOIN lines USING (cluster_id)
""")
def prompt_assembly(t: EngineTables) -> DataFrame:
    return _prompts(t)


def _merged(t: EngineTables) -> dict[str, DataFrame]:
    """Each cluster answers with an angle on its first four notes, one on the fifth that updates the old angle of even
    clusters, and one that speaks of one outlet alone."""
    selected = _selected(t).select("cluster_id", "pos", "article_id", "outlet_id")
    first = selected.join(t.outlets, "outlet_id").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("names"))
    said = lambda names: F.transform(names, lambda n: F.struct(F.upper(n).alias("outlet"), F.lit("h").alias("highlighted"), F.lit("o").alias("omitted"), F.lit("q").alias("quote")))

    def angle(existing: Column, title: str, notes: list[int | Column], names: Column, hook: str) -> Column:
        fields = {"id_existing": existing, "title": F.lit(title), "summary": F.lit("s " + title), "key_points": F.array(F.lit("k")), "topics": F.array(F.lit("politica")), "subtopics": F.array(F.lit("futbol")), "relevant": F.lit(True)}
        fields |= {"hook": F.lit(hook), "hashtags": F.array(F.lit("x")), "comparison": said(names), "notes": F.array(*[(n if isinstance(n, Column) else F.lit(n)).cast("long") for n in notes])}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    old = F.when(F.col("cluster_id") % 2 == 0, F.col("cluster_id") + 1000)
    beyond = F.size("names") + 99  # no note, however many the cluster has
    answers = F.array(
        angle(F.lit(None).cast("long"), "new", [1, 2, 3, 4, 4, beyond], F.slice("names", 1, 4), "hook"),
        angle(old, "other", [5], F.slice("names", 5, 1), ""),
        angle(F.lit(7).cast("long"), "one voice", [1, 2, 3], F.slice("names", 1, 1), "hook"),
    )
    responses = first.select("cluster_id", F.lit("m").alias("model"), answers.alias("angles"))
    focus = "map('src0', named_struct('highlighted', 'h0', 'omitted', 'o0', 'quote', 'q0'))"
    angles = t.clusters.filter("cluster_id % 2 = 0").selectExpr(
        "cluster_id + 1000 AS angle_id", "cluster_id", "'old' AS title", "'s0' AS summary", "array('k0') AS key_points", f"{focus} AS comparison", "array('deportes') AS topics", "CAST(array() AS ARRAY<STRING>) AS subtopics",
        "created_at AS generated_at", "true AS delivered", "3 AS attempts", "'m0' AS model_used",
    )
    links = _selected(t).filter("cluster_id % 2 = 0 AND article_id % 3 = 1").selectExpr("cluster_id + 1000 AS angle_id", "article_id")
    social = angles.selectExpr("angle_id", "'old hook' AS hook", "array('y') AS hashtags", "generated_at")
    return synthesis.merge_angles(responses, selected, t.outlets, angles, links, social, t.clusters, t.membership, t.articles, cluster.at(AS_OF))


#: Outlets of the first four notes make the new angle, or none if there is but one; the old angles get the fifth note.
_MERGED = """
chosen AS (SELECT cluster_id, article_id, outlet_id, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS pos FROM members),
four AS (SELECT cluster_id, count(DISTINCT outlet_id) AS n, count(*) AS notes FROM chosen WHERE pos <= 4 GROUP BY 1 HAVING count(DISTINCT outlet_id) >= 2),
born AS (SELECT (SELECT max(cluster_id) + 1000 FROM clusters WHERE cluster_id % 2 = 0) + row_number() OVER (ORDER BY cluster_id) AS angle_id, cluster_id, n, notes FROM four),
old AS (SELECT cluster_id + 1000 AS angle_id, cluster_id FROM clusters WHERE cluster_id % 2 = 0),
backing AS (SELECT angle_id, article_id FROM old JOIN members USING (cluster_id) WHERE article_id % 3 = 1 UNION SELECT angle_id, article_id FROM old JOIN chosen USING (cluster_id) WHERE pos = 5),
compared AS (SELECT angle_id, 'src0' AS name FROM old UNION SELECT angle_id, name FROM old JOIN chosen USING (cluster_id) JOIN outlets USING (outlet_id) WHERE pos = 5)"""


@query(f"""
WITH {_MERGED}
SELECT angle_id, cluster_id, 'new' AS title, 's new' AS summary, 'politica|deportes' AS topics, n AS n_compared, notes AS n_sources, false AS delivered, 0 AS attempts, 'm' AS model_used, 'hook' AS hook FROM born
UNION ALL
SELECT angle_id, cluster_id, 'old', 's other', 'deportes', (SELECT count(*) FROM compared c WHERE c.angle_id = old.angle_id), (SELECT count(*) FROM backing b WHERE b.angle_id = old.angle_id), false, 0, 'm', 'old hook' FROM old
""")
def angle_merge(t: EngineTables) -> DataFrame:
    merged = _merged(t)
    counts = merged["angle_articles"].groupBy("angle_id").agg(F.count("*").alias("n_sources"))
    whole = merged["angles"].join(counts, "angle_id", "left").join(merged["social"].select("angle_id", "hook"), "angle_id", "left")
    return whole.select("angle_id", "cluster_id", "title", "summary", joined("topics").alias("topics"), F.size("comparison").cast("long").alias("n_compared"), "n_sources", "delivered", "attempts", "model_used", "hook")


@query(f"""
WITH {_MERGED}
SELECT 'created' AS fate, count(*) AS n FROM born UNION ALL SELECT 'updated', count(*) FROM old UNION ALL SELECT 'discarded', 3 * (SELECT count(*) FROM clusters) - (SELECT count(*) FROM born) - (SELECT count(*) FROM old)
""")
def angle_merge_counters(t: EngineTables) -> DataFrame:
    return _merged(t)["counters"]


# --- delivery ---

_ANGLES = "SELECT DISTINCT user_id AS angle_id, user_id % 7 = 0 AS delivered, CAST(user_id % 8 AS INT) AS attempts FROM events"


def _angles(t: EngineTables) -> DataFrame:
    return t.spark.sql(_ANGLES.replace("FROM events", "FROM {events}"), events=t.events)


@query(f"WITH angles AS ({_ANGLES}) SELECT angle_id, attempts FROM angles WHERE NOT delivered AND attempts < 5")
def outbox_pending(t: EngineTables) -> DataFrame:
    return delivery.pending(_angles(t)).select("angle_id", "attempts").orderBy("angle_id")


_FOLD = f"""angles AS ({_ANGLES}),
latest AS (SELECT angle_id, arg_max(status, event_id) AS status FROM results GROUP BY 1),
folded AS (
  SELECT a.angle_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered' WHEN status BETWEEN 400 AND 499 AND status NOT IN (408, 425, 429) THEN 'rejected' ELSE 'failed' END AS outcome,
         delivered OR status BETWEEN 200 AND 299 AS delivered, attempts + 1 AS attempts, NOT status BETWEEN 200 AND 299 AND attempts < 5 AND attempts + 1 >= 5 AS newly_exhausted
  FROM angles a JOIN latest USING (angle_id))"""


def _folded(t: EngineTables) -> DataFrame:
    latest = t.delivery_results.groupBy("angle_id").agg(F.max_by("status", "event_id").alias("status"))
    return delivery.fold(_angles(t).withColumn("delivered_at", F.lit(None).cast("timestamp")), latest, cluster.at(AS_OF))


@query(f"WITH {_FOLD} SELECT angle_id, outcome, delivered, attempts, newly_exhausted FROM folded")
def delivery_fold(t: EngineTables) -> DataFrame:
    return _folded(t).select("angle_id", "outcome", "delivered", "attempts", "newly_exhausted")


@query(f"""
WITH {_FOLD}
SELECT count(*) FILTER (WHERE NOT delivered) AS pending, count(*) FILTER (WHERE outcome = 'delivered') AS delivered, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'failed') AS failed,
       count(*) FILTER (WHERE newly_exhausted) AS newly_exhausted, count(*) FILTER (WHERE NOT delivered AND attempts >= 5) AS exhausted FROM folded
""")
def delivery_counters(t: EngineTables) -> DataFrame:
    return delivery.delivery_counters(_folded(t))


@query("""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, alert_id) AS rn FROM alerts),
walk AS (
  SELECT key, rn, alert_id, true AS sent, CASE WHEN delivered THEN ts END AS last FROM a WHERE rn = 1
  UNION ALL
  SELECT key, rn, alert_id, ok, CASE WHEN ok AND delivered THEN ts ELSE last END
  FROM (SELECT a.*, w.last, a.terminal OR w.last IS NULL OR a.ts - w.last >= INTERVAL 60 MINUTE AS ok FROM walk w JOIN a ON a.key = w.key AND a.rn = w.rn + 1))
SELECT alert_id, sent FROM walk
""")
def alert_throttle(t: EngineTables) -> DataFrame:
    return delivery.throttled(t.alerts).select("alert_id", "sent")


def _payload(t: EngineTables) -> DataFrame:
    members = t.membership.join(t.articles, "article_id").join(t.outlets, "outlet_id")
    focus = F.struct(F.lit("h").alias("highlighted"), F.lit("o").alias("omitted"), F.col("name").alias("quote"))
    comparison = members.select("cluster_id", "name").distinct().groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("name", focus))).alias("comparison"))
    angles = t.clusters.join(comparison, "cluster_id").selectExpr(
        "cluster_id + 100 AS angle_id", "cluster_id", "title", "'s' AS summary", "array('k') AS key_points", "comparison", "array('politica') AS topics", "CAST(array() AS ARRAY<STRING>) AS subtopics",
        "created_at AS generated_at", "false AS delivered", "CAST(NULL AS TIMESTAMP) AS delivered_at", "0 AS attempts", "CAST(NULL AS STRING) AS model_used",
    )
    links = t.membership.selectExpr("cluster_id + 100 AS angle_id", "article_id")
    social = angles.filter("angle_id % 2 = 0").selectExpr("angle_id", "'hook' AS hook", "array('x') AS hashtags")
    return delivery.payloads(angles, links, t.articles, t.outlets, t.clusters, social)


@query("""
SELECT c.cluster_id + 100 AS angle_id, 'created' AS event, true AS is_open, count(*) AS n_sources, count(DISTINCT outlet_id) AS n_compared, arg_min(m.article_id, (m.published_at, m.article_id)) AS first_source,
       CASE WHEN c.cluster_id % 2 = 0 THEN 'hook' END AS hook
FROM clusters c JOIN members m USING (cluster_id) GROUP BY c.cluster_id
""")
def payload_json(t: EngineTables) -> DataFrame:
    body = lambda p: F.get_json_object("body", p)
    size = lambda p: F.json_array_length(body(p)).cast("long")
    return _payload(t).select(
        "angle_id", body("$.event").alias("event"), body("$.cluster.open").cast("boolean").alias("is_open"), size("$.sources").alias("n_sources"), size("$.comparison").alias("n_compared"),
        body("$.sources[0].article_id").cast("long").alias("first_source"), body("$.social.hook").alias("hook"),
    )


def _pad(secret: str, byte: int) -> str:
    key = secret.encode() if len(secret) <= 64 else hashlib.sha256(secret.encode()).digest()
    return bytes(b ^ byte for b in key.ljust(64, b"\0")).hex()


@query(f"SELECT doc_id AS angle_id, '1704196800' AS timestamp, 'sha256=' || sha256(unhex('{_pad('secret', 0x5C)}') || unhex(sha256(unhex('{_pad('secret', 0x36)}') || encode('1704196800.' || text)))) AS signature FROM documents")
def hmac_sign(t: EngineTables) -> DataFrame:
    bodies = t.documents.select(F.col("doc_id").alias("angle_id"), F.col("text").alias("body"))
    return delivery.outbox(bodies, "secret", cluster.at(AS_OF)).select("angle_id", "timestamp", "signature")


@query("SELECT angle_id, attempts FROM (" + _ANGLES + ") WHERE NOT delivered")
def outbox_forced(t: EngineTables) -> DataFrame:
    return delivery.pending(_angles(t), force=True).select("angle_id", "attempts")


# --- rest ---


@query("SELECT l_suppkey AS model_id, l_quantity AS priority FROM (SELECT l_suppkey, min(l_quantity) AS l_quantity, bool_or(l_returnflag = 'R') AS active FROM lineitem GROUP BY 1) WHERE active ORDER BY 2, 1 LIMIT 1")
def model_priority(t: EngineTables) -> DataFrame:
    models = t.given("lineitem").groupBy(F.col("l_suppkey").alias("model_id")).agg(F.min("l_quantity").alias("priority"), F.bool_or(F.col("l_returnflag") == "R").alias("active"))
    return search.first_model(models).select("model_id", "priority")


@query("SELECT s_suppkey AS model_id, s_suppkey = 3 AS active, s_suppkey % 2 = 0 AS credential_configured FROM supplier")
def model_activation(t: EngineTables) -> DataFrame:
    models = t.given("supplier").selectExpr("s_suppkey AS model_id", "true AS active", "CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS api_key_env", "s_name AS base_url")
    return search.public_models(search.activate(models, 3))


@query("SELECT event_id AS run_id, round(value * 20 / 900, 6) AS utilisation, round(value * 20 / 900, 6) >= 0.5 AS warn FROM events")
def run_utilisation(t: EngineTables) -> DataFrame:
    from mosaiq.streaming.jobs import utilisation

    return utilisation(t.events.select(F.col("event_id").alias("run_id"), (F.col("value") * 20).alias("duration_seconds"))).select("run_id", "utilisation", "warn")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
