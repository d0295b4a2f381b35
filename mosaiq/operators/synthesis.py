"""Which clusters to synthesise, prompts out, responses in, and their merge into angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.text import fitted_post, folded
from mosaiq.functions.times import hours_before
from mosaiq.functions.topics import PARENTS, TOPICS, declared_subtopic, declared_topic, with_parents
from mosaiq.params import DEFAULTS, EXPIRED_MARK, Params

RESPONSE = (
    "angles ARRAY<STRUCT<id_existing: BIGINT, title: STRING, summary: STRING, key_points: ARRAY<STRING>, topics: ARRAY<STRING>, subtopics: ARRAY<STRING>, "
    "relevant: BOOLEAN, hook: STRING, hashtags: ARRAY<STRING>, comparison: ARRAY<STRUCT<outlet: STRING, highlighted: STRING, omitted: STRING, quote: STRING>>, notes: ARRAY<BIGINT>>>"
)


def eligible(clusters: DataFrame, membership: DataFrame, articles: DataFrame, angle_articles: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Clusters, open or processed and young enough, that grew since their last synthesis and whose articles
    without an angle come from enough outlets."""
    candidates = clusters.filter(F.col("state").isin("open", "processed") & (F.col("created_at") >= hours_before(as_of, params.max_unsynthesised_hours)))
    members = membership.join(articles.select("article_id", "outlet_id"), "article_id")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_articles"))
    fresh = members.join(angle_articles.select("article_id"), "article_id", "left_anti").groupBy("cluster_id").agg(F.count_distinct("outlet_id").alias("fresh_outlets"))
    grown = F.col("articles_at_synthesis").isNull() | (F.col("articles_at_synthesis") == EXPIRED_MARK) | (F.col("n_articles") > F.col("articles_at_synthesis"))
    found = candidates.join(sizes, "cluster_id").join(fresh, "cluster_id").filter(grown & (F.col("fresh_outlets") >= params.min_outlets))
    return found.select(*clusters.columns, "n_articles", "fresh_outlets")


def expire(clusters: DataFrame, membership: DataFrame, articles: DataFrame, as_of: Column, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """clusters with those marked that grew too old without synthesis, and of these the ones worth an alert
    (cluster_id, n_articles)."""
    due = F.col("state").isin("open", "processed") & (F.col("created_at") < hours_before(as_of, params.max_unsynthesised_hours)) & F.col("articles_at_synthesis").isNull()
    members = membership.join(articles.select("article_id", "outlet_id"), "article_id").groupBy("cluster_id").agg(F.count("*").alias("n_articles"), F.count_distinct("outlet_id").alias("outlets"))
    alerts = clusters.filter(due).join(members, "cluster_id").filter(F.col("outlets") >= params.min_outlets).select("cluster_id", "n_articles")
    return clusters.withColumn("articles_at_synthesis", F.when(due, F.lit(EXPIRED_MARK).cast("long")).otherwise(F.col("articles_at_synthesis"))), alerts


def expired_totals(alerts: DataFrame) -> DataFrame:
    """One row: how many publishable clusters expired, and with how many articles."""
    return alerts.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("n_articles"), F.lit(0)).alias("n_articles"))


def outlets_of_angles(angle_articles: DataFrame, articles: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """angle_id, outlets (how many back it) and publishable."""
    backed = angle_articles.join(articles.select("article_id", "outlet_id"), "article_id")
    return backed.groupBy("angle_id").agg(F.count_distinct("outlet_id").alias("outlets")).withColumn("publishable", F.col("outlets") >= params.min_outlets)


def as_list(first: Column, second: Column) -> Column:
    """Two scalar columns, as an older schema has them, as one list without nulls."""
    return F.array_compact(F.array(first, second))


def as_scalar(values: Column, place: int) -> Column:
    """The way back: the value at a place from 1, or an empty string."""
    return F.coalesce(F.try_element_at(values, F.lit(place)), F.lit(""))


def prompts(evidence: DataFrame, selected: DataFrame, outlets: DataFrame, angles: DataFrame) -> DataFrame:
    """cluster_id, prompt. selected: cluster_id, pos, outlet_id, title, url, body. angles: cluster_id, angle_id, title."""
    hint = F.concat_ws(" / ", declared_topic(F.col("url")), declared_subtopic(F.col("url")))
    named = selected.join(outlets.select("outlet_id", "name"), "outlet_id")
    note = F.format_string("### Note %d, %s\nTitle: %s\nSection: %s\n%s", F.col("pos").cast("int"), F.col("name"), F.col("title"), F.when(hint == "", "none").otherwise(hint), F.col("body"))
    notes = named.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", note.alias("note")))), lambda s: s["note"]), "\n\n").alias("notes"))
    known = angles.groupBy("cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("angle_id", "title"))), lambda s: F.concat(F.lit("- "), s["angle_id"].cast("string"), F.lit(": "), s["title"])), "\n").alias("known")
    )
    block = lambda o: F.concat(
        F.lit("- "), o["name"], F.lit(": own terms "), F.array_join(o["own_terms"], ", "), F.lit("; only it names "), F.array_join(o["exclusive"], ", "), F.lit("; it leaves out "), F.array_join(o["omitted"], ", ")
    )
    core = F.concat(F.lit("All outlets share: "), F.array_join(F.concat("core_terms", "core_entities"), ", "), F.lit("\n"), F.array_join(F.transform("outlets", block), "\n"))
    task = F.when(F.col("known").isNull(), F.lit("Split this coverage into angles.")).otherwise(
        F.concat(F.lit("Angles already published (repeat an id to update it):\n"), F.col("known"), F.lit("\nSplit this coverage into angles."))
    )
    whole = evidence.join(notes, "cluster_id").join(known, "cluster_id", "left")
    return whole.select("cluster_id", F.concat_ws("\n\n", task, core, F.col("notes")).alias("prompt"))


def response_text(raw: Column) -> Column:
    """The text of a provider's message, without a code fence: the first tool call's arguments (empty where it has
    none), and without a call the content, which is a string or a list of text blocks; nothing for anything else."""
    message = F.try_parse_json(raw)
    at = lambda path, kind: F.try_variant_get(message, path, kind)
    is_ = lambda path, kind: F.coalesce(F.schema_of_variant(at(path, "variant")).startswith(kind), F.lit(False))

    def text(path: str) -> Column:
        texts = F.transform(at(path, "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
        return F.when(is_(path, "STRING"), at(path, "string")).when(is_(path, "ARRAY"), F.array_join(texts, "")).otherwise("")

    whole = F.when(is_("$.tool_calls[0]", "OBJECT"), text("$.tool_calls[0].function.arguments")).otherwise(text("$.content"))
    return F.when(message.isNotNull(), F.regexp_replace(F.trim(whole), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))


def has_angles(text: Column) -> Column:
    """A JSON object whose `angles` is a list."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.angles", "variant")).startswith("ARRAY"), F.lit(False))


def valid_angle(a: Column) -> Column:
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    known = lambda x, words: F.forall(F.coalesce(x, F.array().cast("array<string>")), lambda t: t.isin(list(words)))
    given = [a[k].isNotNull() for k in ("title", "summary", "key_points", "topics", "relevant", "comparison", "notes")]
    out = size(a["topics"]).between(1, 2) & known(a["topics"], TOPICS) & known(a["subtopics"], PARENTS)
    out = out & (F.length(F.coalesce(a["hook"], F.lit(""))) <= 240) & (size(a["hashtags"]) <= 6)
    out = out & F.forall(F.coalesce(a["comparison"], F.array().cast(a_comparison())), lambda c: c["outlet"].isNotNull() & c["highlighted"].isNotNull() & c["omitted"].isNotNull() & c["quote"].isNotNull())
    for g in given:
        out = out & g
    return F.coalesce(out, F.lit(False))


def a_comparison() -> str:
    return "array<struct<outlet:string,highlighted:string,omitted:string,quote:string>>"


def parsed(responses: DataFrame, text: str = "text") -> DataFrame:
    """responses with angles: null where the response is no valid one; one bad angle fails all of it."""
    rows = responses.withColumn("_r", F.from_json(text, RESPONSE, {"mode": "PERMISSIVE"}))
    good = has_angles(F.col(text)) & F.coalesce(F.forall("_r.angles", valid_angle), F.lit(False))
    return rows.withColumn("angles", F.when(good, F.col("_r.angles"))).drop("_r")


def canonical_outlet(names: DataFrame, outlets: DataFrame) -> DataFrame:
    """names (key, pos, outlet) with the name of the outlet (key, name) that folds alike; without one they go, and of
    several for one outlet the last stays."""
    known = outlets.select("key", "name", folded(F.col("name")).alias("fold"))
    joined = names.withColumn("fold", folded(F.col("outlet"))).join(known, ["key", "fold"])
    last = F.row_number().over(Window.partitionBy("key", "name").orderBy(F.desc("pos")))
    return joined.withColumn("_r", last).filter("_r = 1").drop("_r", "fold")


def noted_articles(angles: DataFrame, selected: DataFrame) -> DataFrame:
    """cluster_id, position, article_id, outlet_id: the articles whose numbers an angle's notes give, once each."""
    numbers = angles.select("cluster_id", "position", F.explode("notes").alias("pos")).distinct()
    return numbers.join(selected.select("cluster_id", "pos", "article_id", "outlet_id"), ["cluster_id", "pos"]).select("cluster_id", "position", "article_id", "outlet_id")


def merged_map(old: Column, new: Column) -> Column:
    """Entries of both; the new one's win."""
    return F.map_zip_with(old, new, lambda k, o, n: F.coalesce(n, o))


def merge_angles(responses: DataFrame, selected: DataFrame, outlets: DataFrame, angles: DataFrame, angle_articles: DataFrame, social: DataFrame, clusters: DataFrame, membership: DataFrame, articles: DataFrame, as_of: Column, params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """angles, angle_articles, social and clusters after the responses, and counters.

    responses: cluster_id, model, angles (of parsed, not null). A published angle's title and topics are frozen,
    its articles are only added to, its comparison is merged; a new angle needs enough outlets in its notes and in
    its comparison. angles: angle_id, cluster_id, title, summary, key_points, comparison (map), topics, subtopics,
    generated_at, delivered, attempts, model_used."""
    each = responses.select("cluster_id", "model", F.posexplode("angles").alias("position", "a")).select("cluster_id", "model", "position", "a.*")
    known = angles.select("cluster_id", F.col("angle_id").alias("id_existing"), F.lit(True).alias("is_known"))
    each = each.join(known, ["cluster_id", "id_existing"], "left").withColumn("target", F.when(F.col("is_known"), F.col("id_existing")))
    notes = noted_articles(each, selected)
    names = outlets.select("outlet_id", "name")
    had = each.filter("target IS NOT NULL").select("cluster_id", "position", F.col("target").alias("angle_id")).join(angle_articles, "angle_id").join(
        articles.select("article_id", "outlet_id"), "article_id"
    )
    allowed = notes.select("cluster_id", "position", "outlet_id").unionByName(had.select("cluster_id", "position", "outlet_id")).distinct().join(names, "outlet_id")
    key = F.struct("cluster_id", "position")
    said = each.select(key.alias("key"), F.posexplode("comparison").alias("pos", "c")).select("key", "pos", F.col("c.outlet").alias("outlet"), "c.highlighted", "c.omitted", "c.quote")
    good = canonical_outlet(said, allowed.select(key.alias("key"), "name"))
    comparison = good.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("highlighted", "omitted", "quote").alias("v"))))).alias("new_comparison"), F.count("*").alias("n_compared"))
    noted = notes.groupBy("cluster_id", "position").agg(F.count_distinct("outlet_id").alias("n_outlets"))
    kind = "map<string,struct<highlighted:string,omitted:string,quote:string>>"
    whole = (
        each.join(noted, ["cluster_id", "position"], "left")
        .withColumn("key", key)
        .join(comparison, "key", "left")
        .withColumn("new_comparison", F.coalesce("new_comparison", F.create_map().cast(kind)))
    )
    enough = (F.coalesce("n_outlets", F.lit(0)) >= params.min_outlets) & (F.coalesce("n_compared", F.lit(0)) >= params.min_outlets)
    fate = F.when(F.col("target").isNotNull(), "updated").when(enough, "created").otherwise("discarded")
    first = angles.select(F.coalesce(F.max("angle_id"), F.lit(0)).alias("last_id"))
    whole = whole.withColumn("fate", fate).join(F.broadcast(first))
    # ids are given once, in order; only the new angles' keys meet for it
    order = F.row_number().over(Window.orderBy("cluster_id", "position"))
    numbers = whole.filter("fate = 'created'").select("cluster_id", "position").withColumn("n", order)
    whole = whole.join(numbers, ["cluster_id", "position"], "left")
    whole = whole.withColumn("angle_id", F.when(F.col("fate") == "created", F.col("last_id") + F.col("n")).otherwise(F.col("target")))
    kept = whole.filter("fate <> 'discarded'")
    full_topics = with_parents(F.col("topics"), F.coalesce("subtopics", F.array().cast("array<string>")))
    # of several answers for one angle the last one writes, over the comparisons of all
    last = F.row_number().over(Window.partitionBy("angle_id").orderBy(F.desc("position")))
    every = kept.groupBy("angle_id").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("position", F.map_entries("new_comparison").alias("c")))), F.create_map().cast(kind), lambda m, s: merged_map(m, F.map_from_entries(s["c"]))
        ).alias("all_comparisons")
    )
    top = kept.withColumn("r", last).filter("r = 1").join(every, "angle_id").select(
        "angle_id", "cluster_id", "title", "summary", "key_points", "all_comparisons", full_topics.alias("full_topics"), "subtopics", "model"
    )
    o, n = angles.alias("o"), top.alias("n")
    both = o.join(n, "angle_id", "full_outer")
    old, new = F.col("o.title").isNotNull(), F.col("n.title").isNotNull()
    fill = ~old | (F.coalesce(F.size("o.topics"), F.lit(0)) < 1) & new
    out = both.select(
        "angle_id",
        F.coalesce("o.cluster_id", "n.cluster_id").alias("cluster_id"),
        F.coalesce("o.title", "n.title").alias("title"),
        F.coalesce("n.summary", "o.summary").alias("summary"),
        F.coalesce("n.key_points", "o.key_points").alias("key_points"),
        F.when(old & new, merged_map(F.col("o.comparison"), F.col("n.all_comparisons"))).otherwise(F.coalesce("n.all_comparisons", "o.comparison")).alias("comparison"),
        F.when(fill, F.col("n.full_topics")).otherwise(F.col("o.topics")).alias("topics"),
        F.when(fill, F.col("n.subtopics")).otherwise(F.col("o.subtopics")).alias("subtopics"),
        F.when(new, as_of).otherwise(F.col("o.generated_at")).alias("generated_at"),
        F.when(new, F.lit(False)).otherwise(F.col("o.delivered")).alias("delivered"),
        F.when(new, F.lit(0)).otherwise(F.col("o.attempts")).alias("attempts"),
        F.when(new, F.col("n.model")).otherwise(F.col("o.model_used")).alias("model_used"),
    )
    sources = kept.select("cluster_id", "position", "angle_id").join(notes, ["cluster_id", "position"]).select("angle_id", "article_id")
    hook = F.trim(F.coalesce("hook", F.lit("")))
    copied = kept.filter(F.col("relevant") & (hook != "")).withColumn("r", last).filter("r = 1")
    copied = copied.withColumn("post", fitted_post(hook, F.coalesce("hashtags", F.array().cast("array<string>")), params))
    fresh = copied.select("angle_id", F.col("post.text").alias("hook"), F.col("post.tags").alias("hashtags"), as_of.alias("generated_at"))
    sizes = membership.groupBy("cluster_id").agg(F.count("*").alias("mark")).join(responses.select("cluster_id").distinct(), "cluster_id", "left_semi")
    marked = clusters.join(sizes, "cluster_id", "left").withColumn("articles_at_synthesis", F.coalesce("mark", "articles_at_synthesis")).select(*clusters.columns)
    return {
        "angles": out,
        "angle_articles": angle_articles.unionByName(sources).distinct(),
        "social": social.join(fresh, "angle_id", "left_anti").unionByName(fresh),
        "clusters": marked,
        "counters": whole.groupBy("fate").agg(F.count("*").alias("n")),
    }
