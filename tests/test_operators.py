"""Operators on small inputs: nulls, blanks, ties, repeats."""

import random

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import chunks
from sieveworks.functions import scores as P
from sieveworks.functions import text as T
from sieveworks.operators import contradictions as C
from sieveworks.operators import graph as G
from sieveworks.operators import relations as R
from sieveworks.operators import stores as S
from sieveworks.operators import vectors as V
from sieveworks.sources import exports, feeds
from sieveworks.streaming import events as E
from sieveworks.streaming import limits


def one(df, name="x"):
    return [r[name] for r in df.collect()]


def test_blank_takes_default(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "v string")
    assert one(df.select(S.blank_as("v", "d").alias("x"))) == ["a", "d", "d"]


def test_noise_only_and_empty_flags(spark):
    df = spark.createDataFrame([(1, ["noise"]), (2, []), (3, ["noise", "fog"]), (4, None)], "fact_id long, dubious_flags array<string>")
    assert sorted(one(S.dubious(df), "fact_id")) == [3]
    assert sorted(one(S.dubious(df, False), "fact_id")) == [1, 3]
    assert one(S.verified(df), "fact_id") == [2]


def test_enriched_unmatched(spark):
    facts = spark.createDataFrame([(1,), (2,)], "fact_id long")
    cls = spark.createDataFrame([(1, "critical", ["fog"], 0.5, 0.1)], "fact_id long, impact_tier string, dubious_flags array<string>, credibility_score double, priority_score double")
    ver = spark.createDataFrame([], "fact_id long, status string")
    rows = {r.fact_id: (r.impact_tier, r.status) for r in S.enriched(facts, cls, ver).collect()}
    assert rows == {1: ("critical", "pending"), 2: ("unknown", "pending")}


def test_upsert_keeps_first_tenant(spark):
    old = spark.createDataFrame([("u", "a", 1)], "url string, investigation_id string, n int")
    new = spark.createDataFrame([("u", "b", 2), ("u", "c", 3), ("w", "d", 4)], "url string, investigation_id string, n int")
    got = {r.url: (r.investigation_id, r.n) for r in R.upserted(old, new, ["url"], [F.col("n")], ("investigation_id",)).collect()}
    assert got == {"u": ("a", 3), "w": ("d", 4)}


def test_consolidation_orders_variants(spark):
    facts = spark.createDataFrame([(9, 3, 1, "h"), (7, 1, 1, "h"), (8, 2, 1, "h")], "fact_id long, ord long, investigation_id long, content_hash string")
    row = R.consolidated(facts).first()
    assert (row.fact_id, row.variants) == (7, [8, 9])


def test_url_normalisation(spark):
    urls = ["HTTP://Www.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://e.org/", "relative/path?ref=1", "https://e.org:443/p?hsCtaTracking=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert one(df.select(T.normalised_url(F.col("u")).alias("x"))) == ["http://www.example.com/a?a=1&b=2", "https://e.org", "relative/path?ref=1", "https://e.org/p?hsCtaTracking=1"]  # the mixed-case name in the list never matches: kept as it is


def test_cosine_of_unequal_or_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert one(df.select(T.cosine(F.col("a"), F.col("b")).alias("x"))) == [1.0, 0.0, 0.0]


def test_flags_in_fixed_order(spark):
    df = spark.createDataFrame([(3, False, 0.1, 1, 0.1), (0, True, 0.9, 0, 0.9)], "h int, p boolean, c double, k int, s double")
    got = one(df.select(P.flags(F.col("h"), F.col("p"), F.col("c"), F.lit(False), F.col("k"), F.col("s")).alias("x")))
    assert got == [["phantom", "fog", "anomaly", "noise"], []]


def test_negations(spark):
    facts = spark.createDataFrame([(1, "troops crossed the border"), (2, "troops never crossed the border"), (3, "rain")], "fact_id long, claim_text string")
    rows = C.negations(facts).collect()
    assert [(r.a, r.b, round(r.confidence, 2)) for r in rows] == [(1, 2, 0.8)]


EDGES = [("E:1", "E:2", "T", 1.0), ("E:2", "E:3", "T", 1.0), ("E:3", "E:3", "T", 1.0), ("E:4", "E:5", "T", 0.5), ("E:4", "E:5", "T", 0.9)]


def test_graph(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, type string, weight double")
    assert {(r.id, r.hop) for r in G.neighbourhood(edges, "E:1", 2).collect()} == {("E:1", 0), ("E:2", 1), ("E:3", 2)}
    assert {r.id: r.component for r in G.clusters(edges).collect()} == {"E:1": "E:1", "E:2": "E:1", "E:3": "E:1", "E:4": "E:4", "E:5": "E:4"}
    assert one(G.path_length(edges, "E:1", "E:3"), "length") == [2]
    assert one(G.path_length(edges, "E:1", "E:1"), "length") == [0]
    assert one(G.path_length(edges, "E:1", "E:5"), "length") == []
    assert abs(sum(one(G.pagerank(edges), "rank")) - 1) < 1e-9
    assert {r.id: r.score for r in G.betweenness(edges, ["E:1"]).collect()} == {"E:2": 1.0, "E:3": 0.0}
    with pytest.raises(ValueError):
        G.run("nothing", edges)


def test_betweenness_of_all_vertices(spark, monkeypatch):
    monkeypatch.setattr(G, "PIVOTS", 7)
    rng = random.Random(2)
    pairs = [(f"F:{i}", f"F:{i + 1}") for i in range(12)] + [(f"F:{rng.randrange(30)}", f"F:{rng.randrange(30)}") for _ in range(30)] + [("X", "Y"), ("Z", "Z"), ("X", "Y")]
    ids = sorted({x for p in pairs for x in p})
    to = {x: {b for a, b in pairs if a == x and b != x} for x in ids}
    far, ways = {}, {}
    for s in ids:
        level, count, front = {s: 0}, {s: 1}, [s]
        while front:
            new = {}
            for x in front:
                for y in to[x]:
                    if y not in level:
                        new[y] = new.get(y, 0) + count[x]
            front = list(new)
            level |= dict.fromkeys(new, max(level.values()) + 1)
            count |= new
        far[s], ways[s] = level, count
    n = len(ids)
    want = {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in ids for t in far[s] if v not in (s, t) and s != t and v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t]) / ((n - 1) * (n - 2)) for v in ids}
    got = {r.id: r.score for r in G.betweenness_of_all(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert max(max(f.values()) for f in far.values()) > 6
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in ids)


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in V.nearest(v, v.where("vec_id = 1"), 1).collect()] == [(1, 2)]


def test_archive_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "x")], "fact_id long, investigation_id long, v string")
    exports.write_archive(rows, rows, rows, f"{tmp_path}/a", 5)
    assert exports.read_archive(spark, f"{tmp_path}/a").count() == 3
    spark.createDataFrame([('{"kind":"archive","value":"9"}',)], "value string").write.text(f"{tmp_path}/b")
    with pytest.raises(ValueError):
        exports.read_archive(spark, f"{tmp_path}/b")


def test_feeds(spark):
    text = "<rss><channel><item><title>A</title><link>l</link><pubDate>d</pubDate></item></channel></rss>"
    rows = feeds.parsed(spark.createDataFrame([("f", text), ("g", "<broken"), ("h", None)], "feed string, text string")).collect()
    assert [(r.feed, r.title, r.link, r.published) for r in rows] == [("f", "A", "l", "d")]


def test_feeds_of_both_kinds(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><link rel="self" href="s"/><link rel="alternate" href="a"/><author><name>N</name></author>
    <category term="x"/><category term=""/><summary>S</summary><content>C</content></entry></feed>"""
    rss = "<rss><channel><title>R</title><item><title>A</title><author>me</author><category>c</category><description>D</description><guid>g</guid></item></channel></rss>"
    landed = spark.createDataFrame([("a", atom), ("r", rss), ("b", "<broken"), ("n", None)], "feed string, text string")
    rows = {r.feed: r for r in feeds.parsed(landed).collect()}
    a, r = rows["a"], rows["r"]
    assert (a.title, a.link, a.author, a.source, a.tags, a.summary, a.content, a.id) == ("No title", "a", "N", "T", ["x"], "S", "C", "a")
    assert (r.title, r.link, r.author, r.source, r.tags, r.summary, r.id) == ("A", "", "me", "R", ["c"], "D", "g")
    assert {x.feed: (x.found, x.malformed) for x in feeds.reported(landed).collect()} == {"a": (1, False), "r": (1, False), "b": (0, True), "n": (0, True)}


def test_paged_source(spark):
    df = feeds.paged(spark, "numbers", "page int, n int", lambda p: [(p, p * 10)] if p < 3 else [], 3)
    assert sorted((r.page, r.n) for r in df.collect()) == [(1, 10), (2, 20)]


def test_chunks():
    assert chunks.pieces("a\n\nb", 10) == ["a\n\nb"]
    assert chunks.pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunks.pieces("One two. Three four.  Five\n\nsix\n\n" + "y" * 23, 20) == ["One two.", "Three four. Five", "six", "y" * 20, "yyy"]
    assert chunks.pieces(" \n\n ", 3) == [] and chunks.pieces("", 3) == []


def test_language(spark):
    texts = spark.createDataFrame([(1, "der Hund und die Katze"), (2, None), (3, "x"), (4, "the der")], "i int, t string")
    assert [r.language for r in chunks.detected(texts, "i", "t").orderBy("key").collect()] == ["de", "en", "en", "en"]


def test_dates(spark):
    texts = {"2024-05-01T10:00:00.250+02:00": 1714550400, "Wed, 01 May 2024 08:00:00 GMT": 1714550400, "May 1, 2024": 1714521600, "2024/05/01": 1714521600, "2024": 1704067200, "soon": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.unix_seconds(T.instant(F.col("t"))).alias("at")).collect()
    assert {r.t: r.at for r in rows} == texts


def test_token_bucket_equals_brute_force(spark):
    rng = random.Random(5)
    rows = sorted((rng.choice("ab"), round(rng.random() * 60, 3), rng.choice([1.0, 2.0])) for _ in range(80))
    want, level, last = [], {}, {}
    for k, at, cost in sorted(rows, key=lambda r: (r[0], r[1])):
        level[k] = min(3.0, level.get(k, 3.0) + (at - last.get(k, at)) * 0.5)
        last[k] = at
        want.append((k, at, cost, cost <= level[k]))
        level[k] -= cost if want[-1][3] else 0
    got = limits.admitted(spark.createDataFrame(rows, "k string, at double, cost double"), "k", 0.5, 3.0).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {w[3] for w in want} == {True, False}


def test_fan_out(spark, tmp_path):
    seen = {"a": 0, "b": 0}
    add = lambda name: lambda batch: seen.__setitem__(name, seen[name] + batch.count())
    limits.subscribed(E.stream(spark, "/root/testdata/sf0.001/events.parquet"), {n: add(n) for n in seen}, f"{tmp_path}/c").awaitTermination()
    assert seen["a"] == seen["b"] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_first_of_the_shortest_paths(spark):
    edges = spark.createDataFrame([("s", "b"), ("s", "a"), ("a", "d"), ("b", "c"), ("c", "g"), ("d", "g"), ("b", "d")], "src string, dst string")
    assert [tuple(r) for r in G.shortest_path(edges, "s", "g").collect()] == [(3, ["s", "a", "d", "g"])]
    assert G.shortest_path(edges, "s", "x").isEmpty() and G.shortest_path(edges, "s", "g", 2).isEmpty()


def test_lifecycle_equals_a_state_machine(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(6), i, rng.choice(["pending", "running", "failed"]), rng.choice(["running", "cancelled", "completed", "failed", "pending"])) for i in range(120)]
    state, want = {}, {}
    for k, i, expected, wanted in rows:
        fine = state.get(k, "pending") == expected and wanted in R.TRANSITIONS.get(expected, ())
        want[i] = "ok" if fine else "conflict"
        state[k] = wanted if fine else state.get(k, "pending")
    got = R.transitions(spark.createDataFrame(rows, "k int, i int, expected string, wanted string"), "k", "i").collect()
    assert {r.i: r.verdict for r in got} == want and "ok" in want.values()


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    got = E.drained(E.numbered(E.stream(spark, path)))
    assert got.count() == spark.read.parquet(path).count()
    assert got.where("number = 1").count() == spark.read.parquet(path).select("user_id").distinct().count()


def test_silence_counts_parts_of_a_second(spark):
    times = [("a", "2024-01-01 00:00:00.250000"), ("b", "2024-01-01 00:00:00.750000"), ("c", "2024-01-01 00:00:00.500000"), ("d", "2024-01-01 01:00:00.500000")]
    events = spark.createDataFrame(times, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.user_id for r in E.silent(events, 3600).collect()] == ["a"]


def test_nearest_over_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 3)
    monkeypatch.setattr(V, "STRIP", 2)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(90)] + [(90, [1.0, 2.0]), (100, [0.0, 0.0, 0.0]), (150, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)

    def cosine(x, y):
        dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
        return 0.0 if len(x) != len(y) or not dot(x, x) * dot(y, y) else max(-1.0, min(1.0, dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5))

    want = {(q, i, s) for q, e in rows if q % 10 == 0 for s, i in sorted(((cosine(x, e), i) for i, x in rows if i != q), key=lambda r: (-r[0], r[1]))[:4]}
    got = V.nearest(v, v.where("vec_id % 10 = 0"), 4)
    assert "Join" not in V.nearest(v.where("vec_id < 90"), v.where("vec_id % 10 = 0 AND vec_id < 90"), 4)._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.vec_id, r.score) for r in got.collect()} == want and len(want) == 48


def test_small_components_share_groups(spark, monkeypatch, tmp_path):
    taken = tmp_path / "taken"
    taken.mkdir()
    search = G._depended

    def counted(rows):
        import uuid

        (taken / uuid.uuid4().hex).touch()
        return search(rows)

    monkeypatch.setattr(G, "_depended", lambda rows: counted(rows))
    edges = spark.createDataFrame([(f"{i}:{j}", f"{i}:{j + 1}") for i in range(60) for j in range(2)], "src string, dst string")
    got = {r.id: r.score for r in G.betweenness_of_all(edges).collect()}
    assert 0 < len(list(taken.iterdir())) < 10
    assert len(got) == 180 and all(abs(s * 179 * 178 - (x.endswith(":1"))) < 1e-9 for x, s in got.items())
