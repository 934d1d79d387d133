"""Queries of the graph, vector, streaming and text operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.functions import chunks
from sieveworks.operators import graph as G
from sieveworks.operators import vectors as V
from sieveworks.plans.proxies import query
from sieveworks.sources import feeds
from sieveworks.streaming import events as E


@query("j01_upsert_node", "SELECT 'Entity:' || canonical AS id, arg_max(entity_type, ord) AS kind, arg_max(name, ord) FILTER (WHERE name <> '') AS name FROM p_mentions GROUP BY 1")
def _(v):
    rows = v.p_mentions.select(F.concat(F.lit("Entity:"), "canonical").alias("id"), "ord", F.create_map(F.lit("kind"), F.col("entity_type"), F.lit("name"), F.nullif(F.col("name"), F.lit(""))).alias("props"))
    return G.merged_vertices(rows).select("id", F.col("props")["kind"].alias("kind"), F.try_element_at("props", F.lit("name")).alias("name"))


@query("j02_batch_nodes", "SELECT split_part(id, ':', 1) AS label, count(*) AS n FROM (SELECT src AS id FROM p_edges UNION SELECT dst FROM p_edges) GROUP BY 1")
def _(v):
    e = v.p_edges
    return G.with_endpoints(e.select(F.col("src").alias("id")).distinct(), e).groupBy("label").agg(F.count("*").alias("n"))


@query("j03_upsert_edge", "SELECT src, dst, type, arg_max(weight, ord) AS weight FROM p_edges WHERE type = 'MENTIONS' GROUP BY 1, 2, 3")
def _(v):
    return G.merged_edges(v.p_edges.where("type = 'MENTIONS'"))


@query("j04_delete_node", "SELECT type, count(*) AS n FROM p_edges WHERE src <> 'Source:1' AND dst <> 'Source:1' GROUP BY 1")
def _(v):
    _vertices, edges = G.without_vertex(v.p_edges.select(F.col("src").alias("id")), v.p_edges, "Source:1")
    return edges.groupBy("type").agg(F.count("*").alias("n"))


@query("j05_fact_mapping", "SELECT type, count(*) AS n, count(DISTINCT dst) AS targets, max(weight) AS weight FROM (SELECT DISTINCT fact_id, investigation_id || ':' || canonical AS dst, 'MENTIONS' AS type, 1.0E0 AS weight FROM p_mentions UNION ALL SELECT fact_id, source_id, 'SOURCED_FROM', 0.8E0 FROM p_facts WHERE source_id <> '' UNION ALL SELECT fact_id, CAST(investigation_id AS STRING), 'PART_OF', 1.0E0 FROM p_facts UNION ALL SELECT fact_id, CAST(investigation_id AS STRING), 'VERIFIED_BY', 0.9E0 FROM p_ver) GROUP BY type")
def _(v):
    return G.mapped(v.p_facts, v.p_mentions, v.p_ver).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("targets"), F.max("weight").alias("weight"))


_STATED = "SELECT CAST(substr(src, 6) AS BIGINT) AS fact_id, CAST(substr(dst, 6) AS BIGINT) AS target_fact_id, CASE WHEN type = 'CONTRADICTS' THEN 'contradicts' WHEN weight < 0.5E0 THEN 'supports' ELSE 'elaborates' END AS type, weight AS confidence FROM p_pairs"
#: Every fourth of the facts with a related one counts as superseded in time.
_CHECKED = "SELECT fact_id, related_fact_id, CASE WHEN related_fact_id IS NOT NULL AND fact_id % 32 = 1 THEN 'superseded' ELSE status END AS status, CASE WHEN fact_id % 64 = 1 THEN 'temporal' ELSE 'other' END AS contradiction_type FROM p_ver"


@query("j06_semantic_edges", f"""
WITH ver AS ({_CHECKED}), rel AS ({_STATED}), ev AS (SELECT fact_id, supports_claim, greatest(0.0E0, least(1.0E0, 0.5E0 + 0.3E0 * avg(authority_score) + least(0.2E0, 0.05E0 * ln(1 + count(*))))) AS weight, count(*) AS items FROM p_evidence GROUP BY 1, 2),
names AS (SELECT DISTINCT fact_id, entity_type, 'Entity:' || investigation_id || ':' || coalesce(nullif(canonical, ''), name) AS id FROM p_mentions)
SELECT type, src, dst, round(weight, 6) AS weight FROM (
SELECT 'CORROBORATES' AS type, 'Fact:' || f.fact_id AS src, 'Fact:' || o.fact_id AS dst, ev.weight FROM ver JOIN ev ON ev.fact_id = ver.fact_id AND supports_claim AND items >= 2 JOIN p_facts f ON f.fact_id = ver.fact_id
  JOIN (SELECT a.fact_id AS x, b.fact_id FROM p_facts a JOIN p_facts b ON a.investigation_id = b.investigation_id AND a.content_hash = b.content_hash UNION SELECT a.fact_id, b.fact_id FROM p_facts a JOIN p_facts b ON a.investigation_id = b.investigation_id AND a.claim_text = b.claim_text) o ON o.x = f.fact_id AND o.fact_id <> f.fact_id WHERE ver.status = 'confirmed'
UNION ALL SELECT 'CONTRADICTS', 'Fact:' || ver.fact_id, 'Fact:' || related_fact_id, ev.weight FROM ver JOIN ev ON ev.fact_id = ver.fact_id AND NOT supports_claim WHERE status = 'refuted' AND related_fact_id IS NOT NULL
UNION ALL SELECT 'CONTRADICTS', 'Fact:' || fact_id, 'Fact:' || target_fact_id, confidence FROM rel WHERE type = 'contradicts'
UNION ALL SELECT 'SUPERSEDES', 'Fact:' || fact_id, 'Fact:' || related_fact_id, 0.9E0 FROM ver WHERE status = 'superseded' AND contradiction_type = 'temporal' AND related_fact_id IS NOT NULL
UNION ALL SELECT 'RELATED_TO', 'Fact:' || fact_id, 'Fact:' || target_fact_id, confidence FROM rel WHERE type IN ('supports', 'elaborates')
UNION ALL SELECT 'LOCATED_AT', a.id, b.id, CASE WHEN claim_type = 'state' THEN 0.8E0 ELSE 0.7E0 END FROM (SELECT DISTINCT fact_id, id FROM names WHERE entity_type IN ('PERSON', 'ORGANIZATION')) a JOIN (SELECT DISTINCT fact_id, id FROM names WHERE entity_type = 'LOCATION') b ON a.fact_id = b.fact_id JOIN p_facts f ON f.fact_id = a.fact_id)""")
def _(v):
    checked = v.spark.sql(_CHECKED.replace("FROM p_ver", "FROM {p_ver}"), p_ver=v.p_ver)
    stated = v.spark.sql(_STATED.replace("FROM p_pairs", "FROM {p_pairs}"), p_pairs=v.p_pairs)
    return G.semantic(v.p_facts, checked, v.p_evidence, v.p_mentions, stated).select("type", "src", "dst", F.round("weight", 6).alias("weight"))


_HOPS = "WITH RECURSIVE u AS (SELECT DISTINCT src AS a, dst AS b FROM p_edges UNION SELECT DISTINCT dst, src FROM p_edges), r AS (SELECT '{start}' AS id, 0 AS hop UNION SELECT u.b, r.hop + 1 FROM r JOIN u ON u.a = r.id WHERE r.hop < {hops})"


@query("j07_entity_network", _HOPS.format(start="Entity:1", hops=2) + " SELECT id, min(hop) AS hop FROM r GROUP BY id")
def _(v):
    return G.neighbourhood(v.p_edges, "Entity:1", 2)


_CLUSTERS = "WITH RECURSIVE e AS (SELECT investigation_id AS t, src AS a, dst AS b FROM p_pairs UNION SELECT investigation_id, dst, src FROM p_pairs), r AS (SELECT t, a, a AS b FROM e UNION SELECT r.t, r.a, e.b FROM r JOIN e ON e.t = r.t AND e.a = r.b), c AS (SELECT t, a, min(b) AS component FROM r GROUP BY t, a) "


@query("j08_clusters", _CLUSTERS + "SELECT investigation_id, src, dst, type, weight, component FROM p_pairs JOIN c ON t = investigation_id AND a = src WHERE type IN ('CORROBORATES', 'CONTRADICTS')")
def _(v):
    return G.tenant_clusters(v.p_pairs).orderBy("investigation_id", F.desc("weight"), "src", "dst")


@query("d31_graph_summary", _CLUSTERS + "SELECT investigation_id, count(*) AS edges, count(DISTINCT component) AS clusters, any_value(n) AS nodes FROM p_pairs JOIN c ON t = investigation_id AND a = src JOIN (SELECT t, count(*) AS n FROM c GROUP BY t) m ON m.t = investigation_id GROUP BY 1")
def _(v):
    found = v.p_pairs
    nodes = found.select("investigation_id", F.explode(F.array("src", "dst")).alias("id")).groupBy("investigation_id").agg(F.count_distinct("id").alias("nodes"))
    return G.tenant_clusters(found).groupBy("investigation_id").agg(F.count("*").alias("edges"), F.count_distinct("component").alias("clusters")).join(nodes, "investigation_id")


@query("j09_timeline", "SELECT DISTINCT f.fact_id, f.temporal_value FROM p_edges e JOIN p_facts f ON e.src = 'Fact:' || f.fact_id WHERE e.type = 'MENTIONS' AND e.dst = 'Entity:1' AND f.temporal_value IS NOT NULL")
def _(v):
    return G.timeline(v.p_edges, v.p_facts, "Entity:1").select("fact_id", "temporal_value")


_PATH = _HOPS.format(start="Entity:2", hops=4) + ", h AS (SELECT id, min(hop) AS hop FROM r GROUP BY id), w AS (SELECT id, hop, [id] AS path FROM h WHERE id = 'Entity:1' UNION ALL SELECT h.id, h.hop, list_append(w.path, h.id) FROM w JOIN u ON u.a = w.id JOIN h ON h.id = u.b AND h.hop = w.hop - 1) "


@query("j10_shortest_path", _PATH + "SELECT len(min(path)) - 1 AS length, array_to_string(min(path), ' > ') AS path FROM w WHERE hop = 0")
def _(v):
    return G.shortest_path(v.p_edges, "Entity:1", "Entity:2").select("length", F.concat_ws(" > ", "path").alias("path"))


@query("j11_pagerank", None)
def _(v):
    return G.pagerank(v.p_pairs)


@query("j12_communities", None)
def _(v):
    return G.communities(v.p_pairs)


@query("j13_betweenness", None)
def _(v):
    return G.betweenness_of_all(v.p_pairs)


@query("j15_dispatch", _PATH + "SELECT 'shortest_path' AS pattern, CAST(len(min(path)) - 1 AS BIGINT) AS n FROM w WHERE hop = 0 UNION ALL SELECT 'timeline', count(DISTINCT f.fact_id) FROM p_edges e JOIN p_facts f ON e.src = 'Fact:' || f.fact_id WHERE e.type = 'MENTIONS' AND e.dst = 'Entity:1' AND f.temporal_value IS NOT NULL UNION ALL SELECT 'pagerank', count(*) FROM (SELECT src FROM p_pairs UNION SELECT dst FROM p_pairs) UNION ALL SELECT 'corroboration', count(*) FROM (SELECT src FROM p_pairs UNION SELECT dst FROM p_pairs)")
def _(v):
    some = lambda pattern, value, edges, **more: G.run(pattern, edges, **more).select(F.lit(pattern).alias("pattern"), value.alias("n"))
    out = some("shortest_path", F.col("length").cast("long"), v.p_edges, start="Entity:1", goal="Entity:2")
    out = out.union(some("timeline", F.count("*"), v.p_edges, facts=v.p_facts, entity="Entity:1"))
    return out.union(some("pagerank", F.count("*"), v.p_pairs)).union(some("corroboration", F.count("*"), v.p_pairs))


@query("j17_node_name", "SELECT DISTINCT 'Entity:' || canonical AS id, coalesce(nullif(canonical, ''), 'Entity:' || canonical) AS shown FROM p_mentions")
def _(v):
    id_ = F.concat(F.lit("Entity:"), "canonical")
    return v.p_mentions.select(id_.alias("id"), F.coalesce(F.nullif(F.col("canonical"), F.lit("")), id_).alias("shown")).distinct()


@query("j18_single_ingest", "SELECT DISTINCT 'Fact:39' AS src, 'Entity:' || investigation_id || ':' || canonical AS dst FROM p_mentions WHERE fact_id = 39")
def _(v):
    return G.mapped(v.p_facts.where("fact_id = 39"), v.p_mentions.where("fact_id = 39")).where("type = 'MENTIONS'").select("src", "dst")


@query("j19_edge_decoding", "SELECT src, dst, CASE WHEN fact % 4 = 0 THEN 'RELATED_TO' ELSE type END AS type, coalesce(CASE WHEN fact % 5 = 0 THEN NULL ELSE weight END, 0.5) AS weight FROM (SELECT *, CAST(substr(src, 6) AS BIGINT) AS fact FROM p_pairs)")
def _(v):
    n = F.substring("src", 6, 20).cast("long")
    rows = v.p_pairs.select("src", "dst", F.when(n % 4 == 0, "ODD").otherwise(F.col("type")).alias("type"), F.when(n % 5 != 0, F.col("weight")).alias("weight"))
    return rows.select("src", "dst", F.when(F.col("type").isin(*G.TYPES), F.col("type")).otherwise("RELATED_TO").alias("type"), F.coalesce("weight", F.lit(0.5)).alias("weight"))


@query("j20_allow_list", "SELECT count(*) FILTER (WHERE type <> 'CONTRADICTS') AS kept, count(*) FILTER (WHERE type = 'CONTRADICTS') AS rejected FROM p_pairs")
def _(v):
    odd = v.p_pairs.withColumn("type", F.when(F.col("type") == "CONTRADICTS", "UNKNOWN").otherwise(F.col("type")))
    good, bad = G.accepted(odd)
    return good.agg(F.count("*").alias("kept")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@query("k02_nearest", "SELECT query_id, vec_id, score FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS k FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE k <= 5")
def _(v):
    e = v.table("embeddings").select("vec_id", "embedding")
    return V.nearest(e, e.where("vec_id % 50 = 0"), 5).withColumn("score", F.round("score", 6))


@query("k03_token_search", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'and'])")
def _(v):
    return V.matching(v.table("documents"), ["the", "and"]).select("doc_id")


@query("g06_semantic_consolidation", None)
def _(v):
    return V.leaders(v.table("embeddings"), "label")


@query("m01_event_log", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM events")
def _(v):
    return E.drained(E.numbered(E.stream(v.spark, f"{v.sf_dir}/events.parquet", 100)))


@query("m02_replay", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def _(v):
    return E.since(v.table("events"), 500).select("event_id", "event_type")


@query("m04_until_terminal", "SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS x FROM events WHERE event_type = 'error' GROUP BY 1) t USING (user_id) WHERE t.x IS NULL OR e.event_id <= t.x")
def _(v):
    return E.until_terminal(v.table("events")).select("event_id")


@query("m07_heartbeat", "SELECT user_id FROM (SELECT user_id, max(ts) AS l FROM events GROUP BY 1) WHERE epoch((SELECT max(ts) FROM events)) - epoch(l) > 3600")
def _(v):
    return E.silent(v.table("events").withColumn("ts", F.col("ts").cast("timestamp")), 3600)


@query("m09_stream_dedup", "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def _(v):
    once = E.drained(E.deduplicated(E.stream(v.spark, f"{v.sf_dir}/events.parquet", 100), ["user_id", "event_type"]).select("user_id", "event_type"))
    return once.withColumn("seen", F.lit(True))


@query("m09_windows", None)
def _(v):
    return E.drained(E.windows(E.stream(v.spark, f"{v.sf_dir}/events.parquet", 100)))


@query("m11_discoveries", "SELECT lower(trim(role)) AS entity, count(*) AS n, count(DISTINCT conv_id) AS topics FROM conversations GROUP BY 1")
def _(v):
    return v.table("conversations").groupBy(F.lower(F.trim("role")).alias("entity")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("topics"))


@query("m13_phase_times", "SELECT event_id, (lead(ts_us) OVER (PARTITION BY investigation_id ORDER BY event_id) - ts_us) // 1000 AS elapsed_ms FROM p_events")
def _(v):
    after = F.lead("ts_us").over(W.partitionBy("investigation_id").orderBy("event_id"))
    return v.p_events.withColumn("after", after).select("event_id", F.expr("(after - ts_us) div 1000").alias("elapsed_ms"))


@query("m14_request_response", "SELECT a.conv_id, a.turn AS request, b.turn AS response FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def _(v):
    c = v.table("conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("response"), F.col("turn").alias("request"))
    return asked.join(c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("response")), ["conv_id", "response"]).select("conv_id", "request", "response")


def _landed(v):
    """Feeds of 25 pages; every tenth is cut off in the middle."""
    text = lambda *parts: F.concat(*(F.lit(x) if x.startswith("<") else F.col(x).cast("string") for x in parts))
    link = F.regexp_replace("url", "&", "&amp;").alias("link")
    item = text("<item><title>", "page_id", "</title><link>", "link", "</link><author>", "writer", "</author><category>pages</category><category/><category>", "writer", "</category></item>")
    rows = v.table("pages").select("page_id", link, F.expr("'w' || page_id % 3").alias("writer"), F.expr("page_id div 25").alias("n"))
    feeds_ = rows.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))), lambda x: x["item"]), "").alias("items"))
    end = F.when(F.col("n") % 10 == 9, "").otherwise("</channel></rss>")
    return feeds_.select(F.concat(F.lit("feed"), "n").alias("feed"), F.concat(F.lit("<rss><channel><title>of "), "n", F.lit("</title>"), "items", end).alias("text"))


_ENTRIES = "SELECT 'feed' || page_id // 25 AS feed, row_number() OVER (PARTITION BY page_id // 25 ORDER BY page_id) - 1 AS number, CAST(page_id AS STRING) AS title, url AS link, 'w' || page_id % 3 AS author, 'of ' || page_id // 25 AS source, 'pages,w' || page_id % 3 AS tags, url AS id FROM pages WHERE page_id // 25 % 10 <> 9"


@query("a08_feed_entries", _ENTRIES)
def _(v):
    return feeds.parsed(_landed(v)).select("feed", "number", "title", "link", "author", "source", F.array_join("tags", ",").alias("tags"), "id")


@query("a08_feed_reports", "SELECT 'feed' || page_id // 25 AS feed, CASE WHEN page_id // 25 % 10 = 9 THEN 0 ELSE count(*) END AS found, page_id // 25 % 10 = 9 AS malformed FROM pages GROUP BY page_id // 25")
def _(v):
    return feeds.reported(_landed(v))


@query("a09_feed_poll", f"SELECT feed, number, title FROM ({_ENTRIES}) WHERE number < 20")
def _(v):
    return feeds.polled(feeds.parsed(_landed(v))).select("feed", "number", "title")


@query("a11_page_text", None)
def _(v):
    return feeds.page_texts(v.table("pages"))


_COUNT = "len(list_filter(w, lambda x: list_contains([{}], x)))"
_SCORES = ", ".join(f"{_COUNT.format(', '.join(repr(x) for x in sorted(known)))} AS {lang}" for lang, known in chunks.COMMON.items())


@query("h16_language", f"SELECT doc_id AS key, CASE greatest(en, de, fr, es) WHEN en THEN 'en' WHEN de THEN 'de' WHEN fr THEN 'fr' ELSE 'es' END AS language FROM (SELECT doc_id, {_SCORES} FROM (SELECT doc_id, regexp_split_to_array(lower(substr(coalesce(text, ''), 1, 500)), '[^\\p{{L}}\\p{{N}}_]+') AS w FROM documents))")
def _(v):
    return chunks.detected(v.table("documents"), "doc_id", "text")


@query("h17_chunks", None)
def _(v):
    return chunks.chunked(v.table("documents"), "doc_id", "text", 1000)


@query("n04_extraction", None)
def _(v):
    return chunks.extracted(v.table("documents"), "doc_id", "text")
