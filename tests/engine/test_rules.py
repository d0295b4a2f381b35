"""Rules on small fixtures: dedup chains, geometry of clusters, posts, angles, throttling, the cycle."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import text
from mosaiq.operators import cluster, components, delivery, evidence, ingest, similarity, synthesis
from mosaiq.operators.similarity import hashing_encoder
from mosaiq.params import Params
from mosaiq.plans.cycle import State, run_cycle
from mosaiq.sources.engine_tables import EngineTables
from mosaiq.sources.store import Store
from mosaiq.tables import written

NOW = datetime(2024, 1, 2, 12)


def greedy_dedup(rows):
    guids, urls, kept = set(), set(), []
    for o, g, u in rows:
        if (g is None or g not in guids) and (u is None or u not in urls):
            kept.append(o)
            guids.add(g)
            urls.add(u)
    return kept


@pytest.mark.parametrize("small", [0, 10_000])
def test_dedup_chains(spark, small):
    rng = random.Random(1)
    cases = [[(1, "g1", "u1"), (2, "g2", "u1"), (3, "g2", "u3")], [(1, None, None), (2, None, "u"), (3, "g", None), (4, "g", "u"), (5, None, None)]]
    any_of = lambda c: rng.choice([None, *[f"{c}{i}" for i in range(5)]])
    cases += [[(i, any_of("g"), any_of("u")) for i in range(12)] for _ in range(15)]
    own = lambda c, key: None if key is None else f"{c}{key}"
    rows = [(1000 * c + o, own(c, g), own(c, u)) for c, case in enumerate(cases) for o, g, u in case]
    batch = spark.createDataFrame([*rows, (None, "none", "none")], "o long, guid string, url string")
    found = ingest.first_of_duplicates(batch, "o", small)
    wanted = [1000 * c + o for c, case in enumerate(cases) for o in greedy_dedup(case)]
    assert sorted(r.o for r in found.collect()) == sorted(wanted)
    assert ingest.first_of_duplicates(batch.limit(0), "o", small).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    wanted = {x: find(x) for x in parent}
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    for small in (0, 10_000):
        assert {r.node: r.component for r in components.connected_components(df, small=small).collect()} == wanted


def test_first_independent(spark):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(100, 112)}
    chosen = set()
    for x in sorted({x for e in edges for x in e}):
        if not any((y, x) in edges for y in chosen):
            chosen.add(x)
    assert {r.node for r in components.first_independent(spark.createDataFrame(list(edges), "u long, v long")).collect()} == chosen
    assert components.first_independent(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest_links_as_all_pairs_do(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(80) - 10  # ten of negative id
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, embedding array<double>")
    sims = x @ x.T
    low = ids < 0
    for mixed, linked in ((None, sims >= 0.6), (0.7, np.where(low[:, None] & low, False, np.where(low[:, None] | low, sims >= 0.7, sims >= 0.6)))):
        found = similarity.linked_above(df, 0.6, mixed, block=16)
        got = {r.node: r.component for r in components.connected_components(found).collect()}
        u, v = np.nonzero(np.triu(linked, 1))
        label = components.least_labels(u, v, 80)
        assert got == {int(ids[i]): int(ids[label[i]]) for i in np.unique(np.concatenate([u, v]))}


def unit(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]


def tables(spark, articles, members=(), clusters=()):
    """articles: (id, outlet, degrees, hours ago)."""
    rows = [(i, o, f"title {i}", f"https://a.example/x/{i}", f"g{i}", "body", NOW - timedelta(hours=h)) for i, o, _, h in articles]
    a = spark.createDataFrame(rows, "article_id long, outlet_id int, title string, url string, guid string, body string, published_at timestamp")
    v = spark.createDataFrame([(i, unit(d)) for i, _, d, _ in articles], "article_id long, embedding array<float>")
    m = spark.createDataFrame(list(members), "article_id long, cluster_id long")
    c = spark.createDataFrame([(i, "t", NOW - timedelta(hours=h), "open", mark) for i, h, mark in clusters], "cluster_id long, title string, created_at timestamp, state string, articles_at_synthesis long")
    return a, v, m, c


@pytest.mark.parametrize("mode", ["exact", "hybrid", "rounds"])
def test_assignment_geometry(spark, mode):
    at = cluster.at(NOW)
    # a cluster is preferred over a closer loose article; 45 degrees apart is too far
    a, v, m, c = tables(spark, [(1, 1, 0, 5), (2, 2, 4, 5), (3, 1, 26, 2), (4, 2, 27, 1), (5, 1, 180, 3), (6, 2, 225, 1)], [(1, 7), (2, 7)], [(7, 6, None)])
    placed, born = cluster.assign(a, v, m, c, at, Params(), mode)
    assert sorted(map(tuple, placed.collect())) == [(3, 7), (4, 7)] and born.count() == 0
    # a pair becomes a cluster titled after the matched article
    a, v, m, c = tables(spark, [(1, 1, 0, 5), (2, 2, 5, 4)])
    placed, born = cluster.assign(a, v, m, c, at, Params(), mode)
    assert len({r.cluster_id for r in placed.collect()}) == 1 and placed.count() == 2
    assert [r.title for r in born.collect()] == ["title 2"]


def test_exact_assignment_is_sequential(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([centres[i % 6] + rng.normal(size=16) * 0.35 for i in range(60)]).reshape(60, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, i % 4, f"t{i}", f"https://a.example/{i}", f"g{i}", "b", NOW - timedelta(minutes=60 - i)) for i in range(60)]
    a = spark.createDataFrame(rows, "article_id long, outlet_id int, title string, url string, guid string, body string, published_at timestamp")
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "article_id long, embedding array<double>")
    _, _, m, c = tables(spark, [])
    placed, _ = cluster.assign(a, v, m, c, cluster.at(NOW), Params(), "exact")
    whole = cluster.sequential(np.arange(60), x, np.zeros(0, np.int64), np.zeros((0, 16)), 0.75)
    groups = lambda pairs: sorted(sorted(a for a, k in pairs if k == g) for g in {k for _, k in pairs})
    assert groups([tuple(r) for r in placed.collect()]) == groups([(a, f) for a, _, f in whole])


def test_fusion_and_closing(spark):
    a, v, m, c = tables(spark, [(1, 1, 0, 5), (2, 2, 4, 5), (3, 1, 6, 4), (4, 2, 10, 4), (5, 1, 90, 4), (6, 1, 94, 4)], [(1, 7), (2, 7), (3, 8), (4, 8), (5, 9), (6, 9)], [(7, 6, None), (8, 5, 4), (9, 13, None)])
    clusters, members, _ = cluster.fuse(c, m, v, None, cluster.at(NOW))
    assert {(r.cluster_id, r.articles_at_synthesis) for r in clusters.collect()} == {(7, 4), (9, None)}
    assert {(r.article_id, r.cluster_id) for r in members.collect()} == {(1, 7), (2, 7), (3, 7), (4, 7), (5, 9), (6, 9)}
    closed = {r.cluster_id: r.state for r in cluster.close_expired(clusters, members, a, cluster.at(NOW)).collect()}
    assert closed == {7: "open", 9: "discarded"}


def fit_plainly(text, tags):
    """Tries every prefix and every number of tags."""
    heavy = lambda t: sum(1 if ord(c) < 4352 else 2 for c in t)
    block = lambda g: " ".join("#" + x for x in g)
    whole = lambda t, g: heavy(t) + heavy(block(g)) + 24 + 2 * bool(g)

    def cut(limit):
        if heavy(text) <= limit:
            return text
        if limit < 3:
            return ""
        n = max(i for i in range(len(text)) if heavy(text[:i]) <= limit - 2)
        words = text[:n] if text[n].isspace() else text[:n].rpartition(" ")[0] if " " in text[:n] else text[:n]
        return words.rstrip(" ,;:.") + "…"

    real = [t for t in tags if t]
    kept = next(real[:k] for k in range(len(real), -1, -1) if k <= 2 or whole(text, real[:k]) <= 280)
    for t in (text, cut(254 - heavy(block(kept)))):
        if (t or not text) and whole(t, kept) <= 280:
            return t, kept
    return cut(254), []


def test_posts(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice(["word ", "x", "🙂", ", ", "ñandú", " ", "\u10ff", "\u1100"]) for _ in range(n))
    cases = [("short", ["t" * 130, "u" * 130]), ("fits", ["", "a", None]), ("", ["a"]), ("z" * 400, []), ("🙂" * 200, ["a", "b", "c"]), ("word " * 60, None)]
    cases += [(some(rng.randrange(150)), ["y" * rng.randrange(60) for _ in range(rng.randrange(6))]) for _ in range(60)]
    df = spark.createDataFrame(cases, "t string, tags array<string>")
    out = df.select(text.fitted_post(F.col("t"), F.col("tags")).alias("p")).select("p.*", text.post_weight(F.col("p.text"), F.col("p.tags")).alias("w")).collect()
    assert all(r.w <= 280 for r in out)
    assert [(r.text, r.tags) for r in out] == [fit_plainly(t, tags or []) for t, tags in cases]


def test_posts_cut_before_line_breaks(spark):
    """Marks before a last line break are no end of the text, so they stay."""
    cases = ["x" * 240 + ".\n\n" + "y" * 200, "a " + "x" * 200 + ";\n " + "z" * 100, "x" * 251 + ".\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    out = df.select(text.shortened(F.col("t"), F.lit(244)).alias("p")).collect()
    assert [r.p for r in out] == ["x" * 240 + ".\n…", "a " + "x" * 200 + ";\n…", "x" * 242 + "…"]


def test_entities_of_markup(spark):
    import html as plain

    cases = ["a &amp; b &lt;c&gt;", "&oacute;&ntilde;&hellip;", "&#243; &#x1F642; &#X41;", "&#128; &#150; &#0; &#xD800; &#x110000;", "&amp;lt; stays", "&nosuch; & &; &#; &#xZZ;", "no mark", "", None, "&NotEqualTilde;"]
    df = spark.createDataFrame([(x,) for x in cases], "t string").select(text.unescaped(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == [None if x is None else plain.unescape(x) for x in cases]


def test_canonical_names(spark):
    rng = random.Random(9)
    parts = ["Alda", "Brunos", "Corvel", "Dinar", "Estelar", "Fa", "Gorlan", "Al", "Vel"]
    names = lambda: " ".join(rng.choices(parts, k=rng.randrange(1, 4)))
    counted = {(c, names()): rng.randrange(1, 6) for c in range(4) for _ in range(25)} | {(9, "Only"): 1, (9, ""): 2}
    wanted = {}
    for c in {c for c, _ in counted}:
        chosen = []
        for name in sorted((n for k, n in counted if k == c), key=lambda n: (-counted[c, n], -len(n), n)):
            long = {w for w in name.lower().split() if len(w) > 3}
            same = [h for h in chosen if name.lower() in h.lower() or h.lower() in name.lower() or len(long & {w for w in h.lower().split() if len(w) > 3}) > 1]
            chosen += [] if same else [name]
            wanted[c, name] = (same or [name])[0]
    df = spark.createDataFrame([(c, n, k) for (c, n), k in counted.items()], "cluster_id long, entity string, n long")
    assert {(r.cluster_id, r.entity): r.canonical for r in evidence.canonical_entities(df).collect()} == wanted
    assert evidence.canonical_entities(df.limit(0)).count() == 0


def test_responses(spark):
    good = '{"angles": [{"title": "t", "summary": "s", "key_points": ["k"], "topics": ["politica"], "relevant": false, "comparison": [], "notes": [1]}]}'
    raw = [good, good.replace('"angles": [', '"angles": "[1]", "x": ['), good.replace("politica", "none"), "not json", '{"angles": []}', None]
    out = synthesis.parsed(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, text string")).orderBy("i").collect()
    assert [r.angles is not None for r in out] == [True, False, False, False, True, False]
    texts = ['{"content": "```json\\n{}\\n```"}', '{"content": [{"text": "a"}, {"text": "b"}, {"type": "x"}]}', '{"tool_calls": [{"function": {"arguments": "args"}}], "content": "c"}']
    texts += ['{"tool_calls": [{"function": {"arguments": ""}}], "content": "c"}', '{"tool_calls": [{}], "content": "c"}', '{"content": "[1] text"}', '{"tool_calls": [], "content": "c"}', '{"content": null}', '{"content": 5}', "not json", None]
    df = spark.createDataFrame([(x,) for x in texts], "raw string").select(synthesis.response_text(F.col("raw")).alias("t"))
    assert [r.t for r in df.collect()] == ["{}", "ab", "args", "", "", "[1] text", "c", "", "", None, None]


def test_merge_of_angles(spark):
    focus = "outlet string, highlighted string, omitted string, quote string"
    said = lambda *names: [(n, "h", "o", "q") for n in names]
    base = dict(summary="s", key_points=["k"], relevant=True, hook="hook", hashtags=["a"], subtopics=["futbol"])
    answers = [
        dict(base, id_existing=None, title="new", topics=["politica"], comparison=said("LA Uno", "dós"), notes=[1, 2, 2, 99]),
        dict(base, id_existing=None, title="one voice", topics=["politica"], comparison=said("la uno"), notes=[1, 2]),
        dict(base, id_existing=50, title="other title", topics=["ciencia"], comparison=said("dos", "unknown"), notes=[2]),
    ]
    kind = synthesis.RESPONSE.removeprefix("angles ")
    responses = spark.createDataFrame([(1, "m")], "cluster_id long, model string").withColumn("angles", F.from_json(F.lit(__import__("json").dumps(
        [{k: ([dict(zip(("outlet", "highlighted", "omitted", "quote"), c)) for c in v] if k == "comparison" else v) for k, v in a.items()} for a in answers])), kind))
    selected = spark.createDataFrame([(1, 1, 11, 1), (1, 2, 12, 2)], "cluster_id long, pos long, article_id long, outlet_id int")
    outlets = spark.createDataFrame([(1, "La Uno"), (2, "Dos")], "outlet_id int, name string")
    articles = spark.createDataFrame([(11, 1), (12, 2), (13, 1)], "article_id long, outlet_id int")
    angles = spark.createDataFrame(
        [(50, 1, "old", "s0", ["k0"], {"La Uno": ("h0", "o0", "q0")}, ["deportes"], [], NOW, True, 3, "m0")],
        f"angle_id long, cluster_id long, title string, summary string, key_points array<string>, comparison map<string,struct<{focus.replace('outlet string, ', '').replace(' string', ':string')}>>, topics array<string>, subtopics array<string>, generated_at timestamp, delivered boolean, attempts int, model_used string",
    )
    links = spark.createDataFrame([(50, 13)], "angle_id long, article_id long")
    social = spark.createDataFrame([], "angle_id long, hook string, hashtags array<string>, generated_at timestamp")
    _, _, _, clusters = tables(spark, [], clusters=[(1, 5, None)])
    members = spark.createDataFrame([(11, 1), (12, 1), (13, 1)], "article_id long, cluster_id long")
    out = synthesis.merge_angles(responses, selected, outlets, angles, links, social, clusters, members, articles, cluster.at(NOW))
    found = {r.angle_id: r for r in out["angles"].collect()}
    assert set(found) == {50, 51}
    assert found[51].title == "new" and set(found[51].comparison) == {"La Uno", "Dos"} and found[51].topics == ["politica", "deportes"]
    assert found[50].title == "old" and found[50].topics == ["deportes"] and set(found[50].comparison) == {"La Uno", "Dos"} and not found[50].delivered and found[50].attempts == 0
    assert {(r.angle_id, r.article_id) for r in out["angle_articles"].collect()} == {(50, 13), (50, 12), (51, 11), (51, 12)}
    assert {r.fate: r.n for r in out["counters"].collect()} == {"created": 1, "updated": 1, "discarded": 1}
    assert out["clusters"].first().articles_at_synthesis == 3


def test_signature(spark):
    import hashlib
    import hmac

    for key in ("key", "k" * 100):
        out = delivery.outbox(spark.createDataFrame([(1, '{"a":"ñ"}')], "angle_id long, body string"), key, cluster.at(NOW)).first()
        assert out.signature == "sha256=" + hmac.new(key.encode(), f"{out.timestamp}.{out.body}".encode(), hashlib.sha256).hexdigest()


def test_store(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    seen = lambda df: sorted(r.i for r in df.collect())
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    assert seen(store.append(rows(1), "t")) == [1]
    assert seen(store.append(rows(2), "t")) == [1, 2]
    assert seen(store.replace(rows(3), "t")) == [3]
    assert seen(store.append(rows(4), "t")) == [3, 4]
    # a write that no manifest names is never seen, and goes
    rows(5).write.parquet(f"file://{tmp_path}/store/data/t/unfinished")
    assert seen(store.read("t")) == [3, 4]
    assert seen(store.append(rows(6), "t")) == [3, 4, 6]
    store.tidy()
    assert seen(store.read("t")) == [3, 4, 6] and len(list((tmp_path / "store/data/t").iterdir())) == 3


def test_cycle(spark, tmp_path):
    a, v, m, c = tables(spark, [(1, 1, 0, 5)])
    outlets = spark.createDataFrame([(1, "uno", False), (2, "dos", False)], "outlet_id int, name string, extract_from_page boolean")
    pages = spark.createDataFrame([], "url string, page_body string")
    items = spark.createDataFrame([(i, i % 2 + 1, f"the same event {i // 4}", f"https://b.example/{i}", f"h{i}", f"the same words of event {i // 4} " * 20, NOW - timedelta(hours=1)) for i in range(2, 10)], a.schema)
    store = Store(spark, f"file://{tmp_path}/store")
    state = State.begin(store, outlets, pages, articles=a, vectors=spark.createDataFrame([], "article_id long, embedding array<float>"), membership=m, clusters=c)
    log = {r.step: r.status for r in run_cycle(state, items, cluster.at(NOW), hashing_encoder(64), synthesise=lambda s: None).collect()}
    assert set(log) == {"ingest", "vectorise", "close", "assign", "fuse", "expire", "synthesise", "deliver"} and set(log.values()) == {"done"}
    assert state.articles.count() == 9 and state.vectors.count() == 9 and state.membership.count() > 0
    # articles and vectors were only added to
    assert [x["level"] for x in store.parts("articles")] == [None, 0]
    # another process goes on from the store
    later = State(Store(spark, f"file://{tmp_path}/store"), outlets, pages)
    again = {r.step: r.detail for r in run_cycle(later, items, cluster.at(NOW), hashing_encoder(64), vector_limit=5).collect()}
    assert again["ingest"] == "0 new" and later.articles.count() == 9

    def broken(rows, key, text):
        raise RuntimeError("no model")

    failed = {r.step: r.status for r in run_cycle(later, items, cluster.at(NOW), broken).collect()}
    assert failed["vectorise"] == "failed" and failed["assign"] == failed["deliver"] == "done" and later.vectors.count() == 9


def test_throttle(spark, sf):
    alerts = EngineTables(spark, sf).alerts
    batch = delivery.throttled(alerts.withColumn("more", F.col("alert_id") + 1))
    clash = delivery.throttled(alerts.withColumn("_at", F.lit("x")).withColumn("micros0", F.lit("y"))).filter("_at = 'x' AND micros0 = 'y'")
    assert clash.count() == alerts.count()
    last, wanted = {}, set()
    for r in alerts.orderBy("ts", "alert_id").collect():
        if r.terminal or r.key not in last or r.ts - last[r.key] >= timedelta(minutes=60):
            if r.delivered:
                last[r.key] = r.ts
            wanted.add(r.alert_id)
    found = batch.collect()
    assert {r.alert_id for r in found if r.sent} == wanted and len(found) == alerts.count() and all(r.more == r.alert_id + 1 for r in found)
    # an alert that isn't delivered leaves the next one free to go
    rows = [(i, "k", NOW + timedelta(minutes=10 * i), False, i > 0) for i in range(4)] + [(9, None, NOW, False, True)]
    out = delivery.throttled(spark.createDataFrame(rows, "alert_id long, key string, ts timestamp, terminal boolean, delivered boolean"))
    assert {r.alert_id: r.sent for r in out.collect()} == {0: True, 1: True, 2: False, 3: False, 9: True}


def test_stream_of_items(spark, tmp_path):
    from mosaiq.streaming.jobs import ingest_stream, item_stream

    a, *_ = tables(spark, [(1, 1, 0, 5), (2, 1, 0, 4), (3, 1, 0, 3)])
    a.unionByName(a.filter("article_id = 1")).write.parquet(str(tmp_path / "in"))
    seen = []
    q = ingest_stream(item_stream(spark, str(tmp_path / "in"), a.schema), lambda df, i: seen.extend(r.article_id for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == [1, 2, 3]


def test_evidence_is_made_of_its_parts(spark, sf):
    t = EngineTables(spark, sf)
    members = t.membership.join(t.articles, "article_id").select("cluster_id", "article_id", "outlet_id", "title", "body").filter("cluster_id < 3")
    members = written(members, "members")
    vocabulary = written(evidence.fit_vocabulary(t.articles.select("article_id", F.col("body").alias("text")), "article_id"), "vocabulary")
    whole = {r.cluster_id: r for r in evidence.evidence(members, t.vectors, t.outlets, vocabulary).collect()}
    chosen = written(evidence.select_representatives(members, t.vectors), "chosen")
    texts = chosen.groupBy("cluster_id", "outlet_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "body"))).alias("notes")).collect()
    assert {c for c in whole} == {r.cluster_id for r in texts}
    found = {(c, o.outlet_id): o for c, r in whole.items() for o in r.outlets}
    assert {k: o.titles for k, o in found.items()} == {(r.cluster_id, r.outlet_id): [n.title for n in r.notes] for r in texts}
    docs = spark.createDataFrame([(r.cluster_id, r.outlet_id, "\n".join(f"{n.title}. {n.body}" for n in r.notes)) for r in texts], "cluster_id long, outlet_id int, text string")
    own = evidence.own_terms(evidence.tfidf(docs, ["cluster_id", "outlet_id"], vocabulary), t.outlets).orderBy("rank").collect()
    assert {k: o.own_terms for k, o in found.items()} == {k: [r.term for r in own if (r.cluster_id, r.outlet_id) == k] for k in found}
    sets = {(r.cluster_id, r.outlet_id): r for r in evidence.entity_sets(evidence.entities(chosen, t.outlets), docs.select("cluster_id", "outlet_id")).collect()}
    assert all((o.exclusive, o.omitted) == (sets[k].exclusive, sets[k].omitted) for k, o in found.items())
    assert all(r.core_entities == sets[c, r.outlets[0].outlet_id].common and r.outlets == sorted(r.outlets) for c, r in whole.items())
