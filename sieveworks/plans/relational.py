"""Queries of the relational operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.operators import relations as R
from sieveworks.operators import stores as S
from sieveworks.plans.proxies import query

# --- A: scans ---------------------------------------------------------------


@query("a01_fact_scan", "SELECT fact_id, content_hash, (SELECT count(*) FROM p_facts WHERE investigation_id = 3) AS total_facts FROM p_facts WHERE investigation_id = 3 ORDER BY ord LIMIT 50 OFFSET 20")
def _(v):
    return S.scan(v.p_facts, 3, 50, 20).select("fact_id", "content_hash").crossJoin(F.broadcast(S.total(v.p_facts, 3).withColumnRenamed("total", "total_facts")))


@query("a02_article_scan", "SELECT ord, url FROM p_articles WHERE investigation_id = 'en' ORDER BY ord LIMIT 40 OFFSET 5")
def _(v):
    return S.scan(v.p_articles, "en", 40, 5).select("ord", "url")


@query("a03_point_lookup", "SELECT fact_id, impact_tier FROM p_class WHERE investigation_id = 1 AND fact_id = 33 UNION ALL SELECT fact_id, impact_tier FROM p_class WHERE fact_id = 7")
def _(v):
    return S.lookup(v.p_class, investigation_id=1, fact_id=33).union(S.lookup(v.p_class, fact_id=7)).select("fact_id", "impact_tier")


@query("a04_global_lookup", "SELECT fact_id, claim_text FROM p_facts WHERE fact_id = 39")
def _(v):
    return S.lookup(v.p_facts, fact_id=39).select("fact_id", "claim_text")


@query("a05_hash_lookup", "SELECT fact_id FROM p_facts WHERE content_hash = (SELECT content_hash FROM p_facts WHERE fact_id = 39) AND investigation_id = (SELECT investigation_id FROM p_facts WHERE fact_id = 39)")
def _(v):
    wanted = S.lookup(v.p_facts, fact_id=39).select("content_hash", "investigation_id")
    return v.p_facts.join(F.broadcast(wanted), ["content_hash", "investigation_id"], "left_semi").select("fact_id")


@query("a06_nested_path_lookup", "SELECT fact_id, hop_count FROM p_facts WHERE source_id = 'src-7'")
def _(v):
    nested = v.p_facts.select("fact_id", F.struct("source_id", "hop_count").alias("provenance"))
    return nested.where("provenance.source_id = 'src-7'").select("fact_id", "provenance.hop_count")


@query("a07_full_scan", "SELECT fact_id, status FROM p_ver WHERE investigation_id = 2")
def _(v):
    return S.of_tenant(v.p_ver, 2).select("fact_id", "status")


@query("a12_fallback_chain", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'primary' WHEN page_id % 3 = 1 THEN 'rendered' WHEN length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) >= 50 THEN 'summary' END AS used FROM p_pages")
def _(v):
    text = F.trim(F.regexp_replace("html", "<[^>]+>", ""))
    return v.p_pages.select("page_id", F.coalesce(F.when(F.expr("page_id % 3 = 0"), F.lit("primary")), F.when(F.expr("page_id % 3 = 1"), F.lit("rendered")), F.when(F.length(text) >= 50, F.lit("summary"))).alias("used"))


@query("a16_export_tables", "SELECT 'facts' AS name, count(*) AS n FROM p_facts WHERE investigation_id = 1 UNION ALL SELECT 'classifications', count(*) FROM p_class WHERE investigation_id = 1 UNION ALL SELECT 'verification_results', count(*) FROM p_ver WHERE investigation_id = 1 UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM p_facts WHERE investigation_id = 1 AND source_id <> '' UNION ALL SELECT 'entities', count(DISTINCT canonical || ':' || entity_type) FROM p_mentions WHERE investigation_id = 1")
def _(v):
    from sieveworks.sources.exports import tables

    out = tables(v.p_facts, v.p_class, v.p_ver, v.p_mentions, 1)
    parts = [out[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("facts", "classifications", "verification_results", "sources", "entities")]
    for p in parts[1:]:
        parts[0] = parts[0].union(p)
    return parts[0]


@query("a17_fact_flatten", "SELECT fact_id, claim_text, assertion_type, coalesce(source_id, '') AS source_id, coalesce(temporal_value, '') AS temporal_value FROM p_facts WHERE investigation_id = 4")
def _(v):
    from sieveworks.sources.exports import flat_facts

    return flat_facts(S.of_tenant(v.p_facts, 4)).select("fact_id", "claim_text", "assertion_type", "source_id", "temporal_value")


@query("a18_class_export", "SELECT fact_id, coalesce(impact_tier, 'less_critical') AS impact_tier, '[' || coalesce(array_to_string(list_transform(dubious_flags, lambda x: '\"' || x || '\"'), ','), '') || ']' AS flags FROM p_class WHERE investigation_id = 4")
def _(v):
    from sieveworks.sources.exports import flat_classes

    return flat_classes(S.of_tenant(v.p_class, 4)).select("fact_id", "impact_tier", "flags")


@query("a21_bulk_load", "SELECT fact_id FROM p_facts WHERE fact_id % 2 = 0")
def _(v):
    return R.inserted(v.p_facts.where("fact_id % 2 = 1"), v.p_facts, ["fact_id"], [F.col("ord")]).select("fact_id")


@query("a23_article_normalise", "SELECT ord, coalesce(nullif(CASE WHEN ord % 4 = 0 THEN '' ELSE url END, ''), nullif(title, '')) AS link, coalesce(nullif(source_name, ''), 'Unknown') AS source FROM p_articles")
def _(v):
    return v.p_articles.select("ord", F.coalesce(F.nullif(F.when(F.col("ord") % 4 == 0, "").otherwise(F.col("url")), F.lit("")), F.nullif(F.col("title"), F.lit(""))).alias("link"), S.blank_as("source_name", "Unknown").alias("source"))


@query("a24_source_registry", "SELECT s_suppkey AS id, coalesce(s_nationkey % 5 + 1, 3) AS level FROM supplier WHERE coalesce(s_nationkey % 5 + 1, 3) BETWEEN 3 AND 4 AND contains(lower(s_name), 'supplier#')")
def _(v):
    t = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.coalesce(F.expr("s_nationkey % 5 + 1"), F.lit(3)).alias("level"), "s_name")
    return t.where(F.col("level").between(3, 4) & F.lower("s_name").contains("supplier#")).select("id", "level")


@query("a25_graph_scan", "SELECT src, dst, type FROM p_edges WHERE type = 'PART_OF'")
def _(v):
    return v.p_edges.where("type = 'PART_OF'").select("src", "dst", "type")


@query("a26_article_content", "SELECT ord, coalesce(source_kind, nullif(source_name, ''), 'unknown') AS source_type, string_split(stored_at, 'T')[1] AS published, length(title || chr(10) || chr(10) || content) AS size FROM p_articles")
def _(v):
    return v.p_articles.select("ord", F.coalesce("source_kind", F.nullif(F.col("source_name"), F.lit("")), F.lit("unknown")).alias("source_type"), F.split("stored_at", "T")[0].alias("published"), F.length(F.concat_ws("\n\n", "title", "content")).alias("size"))


@query("a27_export_metadata", "SELECT 5 AS investigation_id, '' AS objective, count(*) AS fact_count FROM p_facts WHERE investigation_id = 5")
def _(v):
    return S.of_tenant(v.p_facts, 5).agg(F.count("*").alias("fact_count")).select(F.lit(5).alias("investigation_id"), F.lit("").alias("objective"), "fact_count")


@query("a28_top_comments", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 10 AND text <> '[deleted]' GROUP BY conv_id")
def _(v):
    top = v.table("conversations").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("k <= 10 AND text <> '[deleted]'")
    return top.groupBy("conv_id").agg(F.count("*").alias("n"))


@query("a31_redirects", "SELECT p.page_id, m.target FROM p_pages p JOIN (SELECT url, min(page_id) AS target FROM p_pages WHERE page_id % 2 = 0 GROUP BY url) m ON m.url = p.url")
def _(v):
    resolved = v.p_pages.where("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("target"))
    return v.p_pages.join(resolved, "url").select("page_id", "target")


# --- B: filters and projections -----------------------------------------------


@query("b01_flag_filter", "SELECT fact_id FROM p_class WHERE investigation_id = 1 AND list_contains(dubious_flags, 'fog')")
def _(v):
    return S.with_flag(S.of_tenant(v.p_class, 1), "fog").select("fact_id")


@query("b02_tier_status_filter", "SELECT fact_id, 'tier' AS kind FROM p_class WHERE investigation_id = 1 AND impact_tier = 'critical' UNION ALL SELECT fact_id, 'status' FROM p_ver WHERE investigation_id = 1 AND status = 'confirmed'")
def _(v):
    a = S.lookup(v.p_class, investigation_id=1, impact_tier="critical").select("fact_id", F.lit("tier").alias("kind"))
    return a.union(S.lookup(v.p_ver, investigation_id=1, status="confirmed").select("fact_id", F.lit("status")))


@query("b03_dubious_filter", "SELECT fact_id FROM p_class WHERE len(dubious_flags) > 0 AND NOT (len(dubious_flags) = 1 AND dubious_flags[1] = 'noise')")
def _(v):
    return S.dubious(v.p_class).select("fact_id")


@query("b04_critical_dubious", "SELECT fact_id FROM p_class WHERE impact_tier = 'critical' AND len(dubious_flags) > 0 AND NOT (len(dubious_flags) = 1 AND dubious_flags[1] = 'noise')")
def _(v):
    return S.critical_dubious(v.p_class).select("fact_id")


@query("b05_verified", "SELECT fact_id FROM p_class WHERE len(dubious_flags) = 0")
def _(v):
    return S.verified(v.p_class).select("fact_id")


@query("b06_pending_review", "SELECT fact_id FROM p_ver WHERE requires_human_review AND NOT human_review_completed")
def _(v):
    return S.pending_review(v.p_ver).select("fact_id")


@query("b07_hash_exists", "SELECT count(*) > 0 AS found FROM p_facts WHERE content_hash = md5('1|1-URGENT')")
def _(v):
    return S.exists(v.p_facts.where(F.col("content_hash") == F.md5(F.lit("1|1-URGENT").cast("binary"))))


@query("b08_url_exists", "SELECT url, min(investigation_id) AS investigation_id FROM p_articles GROUP BY url")
def _(v):
    return v.p_articles.groupBy("url").agg(F.min("investigation_id").alias("investigation_id"))


@query("b09_confidence_filter", "SELECT fact_id FROM p_facts WHERE coalesce(extraction_confidence, 1.0) >= 0.75")
def _(v):
    return S.confident(v.p_facts, 0.75).select("fact_id")


@query("b10_dashboard_filter", "SELECT f.fact_id, coalesce(c.impact_tier, 'unknown') AS impact_tier, coalesce(r.status, 'pending') AS status FROM p_facts f LEFT JOIN p_class c USING (fact_id) LEFT JOIN p_ver r USING (fact_id) WHERE coalesce(c.impact_tier, 'unknown') = 'critical' AND coalesce(r.status, 'pending') IN ('pending', 'in_progress', 'unverifiable')")
def _(v):
    return S.status_filter(S.enriched(v.p_facts, v.p_class, v.p_ver), "critical", "dubious").select("fact_id", "impact_tier", "status")


@query("b11_keyword_hits", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'that'))::INT + (contains(lower(text), 'con'))::INT + (contains(lower(text), 'der'))::INT >= 2")
def _(v):
    words = F.array(*map(F.lit, ("that", "con", "der")))
    return v.table("documents").where(F.size(F.filter(words, lambda k: F.contains(F.lower("text"), k))) >= 2).select("doc_id")


@query("b12_valid_author", "SELECT conv_id, turn FROM conversations WHERE role IS NOT NULL AND role NOT IN ('system', '[deleted]', 'AutoModerator')")
def _(v):
    return v.table("conversations").where(F.col("role").isNotNull() & ~F.col("role").isin("system", "[deleted]", "AutoModerator")).select("conv_id", "turn")


@query("b13_extraction_valid", "SELECT doc_id FROM documents WHERE length(text) >= 200 AND lang = 'en'")
def _(v):
    return v.table("documents").where((F.length("text") >= 200) & (F.col("lang") == "en")).select("doc_id")


@query("b14_ingest_gate", "SELECT fact_id, status FROM p_ver WHERE status IN ('confirmed', 'superseded', 'unverifiable')")
def _(v):
    return v.p_ver.where(F.col("status").isin(*S.INGESTIBLE)).select("fact_id", "status")


@query("b15_type_normalise", "SELECT fact_id, CASE lower(CASE WHEN fact_id % 4 = 0 THEN 'ASSERTION' WHEN fact_id % 4 = 1 THEN 'Forecast' WHEN fact_id % 4 = 2 THEN claim_type ELSE 'odd' END) WHEN 'assertion' THEN 'state' WHEN 'forecast' THEN 'prediction' WHEN 'event' THEN 'event' WHEN 'state' THEN 'state' WHEN 'relationship' THEN 'relationship' ELSE 'event' END AS claim_type FROM p_facts")
def _(v):
    raw = F.lower(F.expr("CASE WHEN fact_id % 4 = 0 THEN 'ASSERTION' WHEN fact_id % 4 = 1 THEN 'Forecast' WHEN fact_id % 4 = 2 THEN claim_type ELSE 'odd' END"))
    known = R.mapped({"assertion": "state", "forecast": "prediction"}, raw, None)
    return v.p_facts.select("fact_id", F.coalesce(known, F.when(raw.isin("event", "state", "relationship", "prediction", "planned"), raw), F.lit("event")).alias("claim_type"))


@query("b16_entity_normalise", "SELECT fact_id, ord, CASE substr(entity_type, 1, 3) WHEN 'PER' THEN 'PERSON' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'LOC' THEN 'LOCATION' ELSE 'PERSON' END AS kind, 'E' || row_number() OVER (PARTITION BY fact_id ORDER BY ord) AS id FROM p_mentions")
def _(v):
    kinds = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "GPE": "LOCATION"}
    held = v.p_mentions.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.substring("entity_type", 1, 3).alias("t")))).alias("e"))
    return held.select("fact_id", F.posexplode("e").alias("i", "x")).select("fact_id", "x.ord", R.mapped(kinds, "x.t", "PERSON").alias("kind"), F.concat(F.lit("E"), F.col("i") + 1).alias("id"))


@query("b17_defaults", "SELECT fact_id, coalesce(extraction_confidence, 0.8) AS confidence, length(claim_text) AS quote_end, coalesce(hop_count, 1) AS hop_count FROM p_facts")
def _(v):
    return v.p_facts.select("fact_id", F.coalesce("extraction_confidence", F.lit(0.8)).alias("confidence"), F.length("claim_text").alias("quote_end"), F.coalesce("hop_count", F.lit(1)).alias("hop_count"))


@query("b18_round_trip", "SELECT fact_id, claim_text, claim_type, source_id, hop_count FROM p_facts")
def _(v):
    nested = v.p_facts.select("fact_id", F.to_json(F.struct("claim_text", "claim_type")).alias("claim"), F.to_json(F.struct("source_id", "hop_count")).alias("provenance"))
    back = nested.select("fact_id", F.from_json("claim", "claim_text string, claim_type string").alias("c"), F.from_json("provenance", "source_id string, hop_count int").alias("p"))
    return back.select("fact_id", "c.*", "p.*")


@query("b19_search_gate", "SELECT fact_id FROM p_class WHERE len(dubious_flags) > 0 AND NOT (len(dubious_flags) = 1 AND dubious_flags[1] = 'noise') ORDER BY priority_score DESC, fact_id LIMIT 100")
def _(v):
    return S.dubious(S.priority_queue(S.dubious(v.p_class), 100)).select("fact_id")


@query("b20_length_filter", "SELECT page_id FROM pages WHERE length(trim(html)) >= 1000")
def _(v):
    return v.table("pages").where(F.length(F.trim("html")) >= 1000).select("page_id")


@query("b21_version_lookup", "SELECT content_hash FROM p_reports WHERE investigation_id = 8 AND version = (SELECT max(version) FROM p_reports WHERE investigation_id = 8)")
def _(v):
    return S.latest(S.of_tenant(v.p_reports, 8)).select("content_hash")


@query("b22_hash_fill", "SELECT fact_id, CASE WHEN fact_id % 3 = 0 THEN sha256(claim_text) ELSE content_hash END AS content_hash FROM p_facts")
def _(v):
    given = F.when(F.col("fact_id") % 3 == 0, F.lit("")).otherwise(F.col("content_hash"))
    return v.p_facts.select("fact_id", S.blank_as(given, F.sha2("claim_text", 256)).alias("content_hash"))


@query("b23_validate_gate", "SELECT fact_id FROM p_facts WHERE source_id <> '' AND (extraction_confidence IS NULL OR extraction_confidence >= 0.3)")
def _(v):
    return v.p_facts.where("source_id <> '' AND (extraction_confidence IS NULL OR extraction_confidence >= 0.3)").select("fact_id")


@query("b24_derived_predicates", "SELECT fact_id, len(dubious_flags) = 1 AND dubious_flags[1] = 'noise' AS is_noise, len(dubious_flags) > 0 AND NOT (len(dubious_flags) = 1 AND dubious_flags[1] = 'noise') AS requires_verification, impact_tier = 'critical' AND len(dubious_flags) > 0 AS critical_dubious FROM p_class")
def _(v):
    some = F.size("dubious_flags") > 0
    noise = F.coalesce(S.noise_only(), F.lit(False))
    return v.p_class.select("fact_id", noise.alias("is_noise"), (some & ~noise).alias("requires_verification"), ((F.col("impact_tier") == "critical") & some).alias("critical_dubious"))


@query("b25_state_media", "SELECT n_name AS name, CASE n_name WHEN 'RUSSIA' THEN 'high' WHEN 'CHINA' THEN 'medium' ELSE 'low' END AS risk FROM nation")
def _(v):
    return v.table("nation").select(F.col("n_name").alias("name"), R.mapped({"RUSSIA": "high", "CHINA": "medium"}, "n_name", "low").alias("risk"))


@query("b26_capability_index", "SELECT DISTINCT required_capability AS capability, source_type FROM p_tasks WHERE status <> 'failed' AND required_capability IS NOT NULL")
def _(v):
    agents = v.p_tasks.where("status <> 'failed'").groupBy("source_type").agg(F.collect_set("required_capability").alias("capabilities"))
    return agents.select(F.explode("capabilities").alias("capability"), "source_type")


# --- C: joins ---------------------------------------------------------------------

_ENRICHED = "SELECT f.fact_id, coalesce(c.impact_tier, 'unknown') AS impact_tier, coalesce(r.status, 'pending') AS status FROM p_facts f LEFT JOIN p_class c USING (fact_id) LEFT JOIN p_ver r USING (fact_id)"


@query("c01_enriched_facts", _ENRICHED)
def c01(v):
    return S.enriched(v.p_facts, v.p_class, v.p_ver).select("fact_id", "impact_tier", "status")


@query("c02_enriched_nulls", "SELECT f.fact_id, c.impact_tier, r.status FROM p_facts f LEFT JOIN p_class c USING (fact_id) LEFT JOIN p_ver r USING (fact_id)")
def _(v):
    return S.enriched(v.p_facts, v.p_class, v.p_ver, False).select("fact_id", "impact_tier", "status")


@query("c03_timeline_credibility", "SELECT f.fact_id, coalesce(c.credibility_score, 0.5) AS credibility, CASE WHEN coalesce(c.credibility_score, 0.5) > 0.7 THEN 'high' WHEN coalesce(c.credibility_score, 0.5) >= 0.4 THEN 'moderate' ELSE 'low' END AS level FROM p_facts f LEFT JOIN p_class c USING (fact_id)")
def _(v):
    c = F.coalesce("credibility_score", F.lit(0.5))
    return v.p_facts.join(v.p_class.select("fact_id", "credibility_score"), "fact_id", "left").select("fact_id", c.alias("credibility"), F.when(c > 0.7, "high").when(c >= 0.4, "moderate").otherwise("low").alias("level"))


@query("c04_context_lines", "SELECT fact_id, status FROM (SELECT f.fact_id, f.investigation_id, coalesce(r.status, 'unverified') AS status, coalesce(sum(length(f.claim_text)) OVER (PARTITION BY f.investigation_id ORDER BY f.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p_facts f LEFT JOIN p_ver r USING (fact_id)) WHERE b <= 2000")
def _(v):
    rows = v.p_facts.join(v.p_ver.select("fact_id", "status"), "fact_id", "left").fillna({"status": "unverified"})
    return R.budgeted(rows, F.length("claim_text"), 2000, "investigation_id", ["ord"]).select("fact_id", "status")


@query("c05_tier_join", "SELECT f.fact_id, coalesce(c.impact_tier, 'unknown') AS impact_tier FROM p_facts f LEFT JOIN p_class c USING (fact_id)")
def _(v):
    return v.p_facts.join(v.p_class.select("fact_id", "impact_tier"), "fact_id", "left").fillna({"impact_tier": "unknown"}).select("fact_id", "impact_tier")


@query("c06_ingest_join", "SELECT r.fact_id, r.status, c.impact_tier FROM p_ver r JOIN p_facts f USING (fact_id) LEFT JOIN p_class c USING (fact_id) WHERE r.status IN ('confirmed', 'superseded', 'unverifiable')")
def _(v):
    rows = v.p_ver.where(F.col("status").isin(*S.INGESTIBLE)).join(v.p_facts.select("fact_id"), "fact_id")
    return rows.join(v.p_class.select("fact_id", "impact_tier"), "fact_id", "left").select("fact_id", "status", "impact_tier")


@query("c07_report_appendix", "SELECT f.fact_id, coalesce(r.status, 'N/A') AS status, coalesce(printf('%.2f', c.credibility_score), 'N/A') AS credibility FROM p_facts f LEFT JOIN p_ver r USING (fact_id) LEFT JOIN p_class c USING (fact_id)")
def _(v):
    rows = S.enriched(v.p_facts, v.p_class, v.p_ver, False)
    shown = F.when(F.col("credibility_score").isNotNull(), F.format_string("%.2f", "credibility_score"))
    return rows.select("fact_id", F.coalesce("status", F.lit("N/A")).alias("status"), F.coalesce(shown, F.lit("N/A")).alias("credibility"))


@query("c08_corroboration", "WITH backed AS (SELECT fact_id FROM p_evidence WHERE supports_claim GROUP BY fact_id HAVING count(*) >= 2), a AS (SELECT f.* FROM p_facts f JOIN p_ver r USING (fact_id) JOIN backed USING (fact_id) WHERE r.status = 'confirmed') SELECT DISTINCT a.fact_id AS a, b.fact_id AS b FROM a JOIN p_facts b ON a.investigation_id = b.investigation_id AND a.fact_id <> b.fact_id AND (a.content_hash = b.content_hash OR a.claim_text = b.claim_text)")
def _(v):
    return R.corroborations(v.p_facts, v.p_ver, v.p_evidence)


@query("c10_conflicting_claims", "WITH n AS (SELECT DISTINCT fact_id, canonical FROM p_mentions) SELECT d.fact_id AS denial, s.fact_id AS statement, count(*) AS shared FROM p_facts d JOIN n nd ON nd.fact_id = d.fact_id JOIN n ns ON ns.canonical = nd.canonical JOIN p_facts s ON s.fact_id = ns.fact_id AND s.investigation_id = d.investigation_id WHERE d.assertion_type = 'denial' AND s.assertion_type = 'statement' GROUP BY ALL HAVING count(*) >= 2")
def _(v):
    return R.shared_entity_denials(v.p_facts, v.p_mentions)


@query("c11_relationship_edges", "SELECT p.src, p.dst, coalesce(f.claim_text, p.dst) AS target_text FROM p_pairs p LEFT JOIN p_facts f ON 'Fact:' || CAST(f.fact_id AS STRING) = p.dst WHERE p.type = 'CONTRADICTS'")
def _(v):
    texts = v.p_facts.select(F.concat(F.lit("Fact:"), F.col("fact_id").cast("string")).alias("dst"), "claim_text")
    return v.p_pairs.where("type = 'CONTRADICTS'").join(texts, "dst", "left").select("src", "dst", F.coalesce("claim_text", "dst").alias("target_text"))


@query("c12_refuted", "SELECT r.fact_id, r.related_fact_id, coalesce(f.claim_text, CAST(r.fact_id AS STRING)) AS claim_text, 'resolved' AS resolution FROM p_ver r LEFT JOIN p_facts f USING (fact_id) WHERE r.status = 'refuted'")
def _(v):
    return R.refuted(v.p_facts, v.p_ver)


@query("c13_resolution", "SELECT r.fact_id AS a, r.related_fact_id AS b, CASE WHEN (x.status = 'confirmed' AND y.status = 'refuted') OR (x.status = 'refuted' AND y.status = 'confirmed') THEN 'resolved' ELSE 'unresolved' END AS resolution FROM p_ver r LEFT JOIN p_ver x ON x.fact_id = r.fact_id LEFT JOIN p_ver y ON y.fact_id = r.related_fact_id WHERE r.related_fact_id IS NOT NULL")
def _(v):
    pairs = v.p_ver.where("related_fact_id IS NOT NULL").select(F.col("fact_id").alias("a"), F.col("related_fact_id").alias("b"))
    return R.resolution(pairs, v.p_ver, "a", "b").select("a", "b", "resolution")


@query("c14_actor_place", "WITH k AS (SELECT DISTINCT fact_id, canonical, entity_type FROM p_mentions) SELECT f.fact_id, a.canonical AS actor, l.canonical AS place, CASE WHEN f.claim_type = 'state' THEN 0.8E0 ELSE 0.7E0 END AS weight FROM k a JOIN k l USING (fact_id) JOIN p_facts f USING (fact_id) WHERE a.entity_type IN ('PERSON', 'ORGANIZATION') AND l.entity_type = 'LOCATION'")
def _(v):
    return R.located(v.p_facts, v.p_mentions)


@query("c15_cross_tenant", "WITH n AS (SELECT DISTINCT investigation_id, canonical FROM p_mentions) SELECT a.canonical, a.investigation_id, b.investigation_id AS other_id, 0.6E0 AS weight FROM n a JOIN n b USING (canonical) WHERE a.investigation_id <> b.investigation_id")
def _(v):
    return R.cross_tenant(v.p_mentions)


@query("c16_shared_entity", "SELECT DISTINCT m.fact_id FROM p_mentions m WHERE m.fact_id <> 39 AND EXISTS (SELECT 1 FROM p_mentions x WHERE x.fact_id = 39 AND x.canonical = m.canonical AND x.investigation_id = m.investigation_id) ORDER BY m.fact_id LIMIT 10")
def _(v):
    return R.sharing_facts(v.p_mentions, 39)


@query("c17_rejoin_by_url", "SELECT u.url, a.ord, a.title FROM (SELECT url, min(ord) AS ord FROM p_articles GROUP BY url) u JOIN p_articles a ON a.ord = u.ord")
def _(v):
    return S.first_per(v.p_articles, ["url"], [F.col("ord")]).select("url", "ord", "title")


@query("c19_cross_reference", "SELECT d.doc_id, k.word FROM documents d JOIN (VALUES ('that'), ('ción'), ('ung')) k(word) ON contains(lower(d.text), k.word)")
def _(v):
    words = F.array(*map(F.lit, ("that", "ción", "ung")))
    return v.table("documents").select("doc_id", F.explode(F.filter(words, lambda k: F.contains(F.lower("text"), k))).alias("word"))


@query("c20_fact_detail", f"SELECT * FROM ({_ENRICHED}) WHERE fact_id = 39")
def _(v):
    return S.enriched(S.lookup(v.p_facts, fact_id=39), v.p_class, v.p_ver).select("fact_id", "impact_tier", "status")


# --- D: aggregates ---------------------------------------------------------------------


@query("d01_count_by_tenant", "SELECT investigation_id, count(*) AS n FROM p_facts GROUP BY investigation_id")
def _(v):
    return v.p_facts.groupBy("investigation_id").agg(F.count("*").alias("n"))


@query("d02_conditional_count", "SELECT investigation_id, count(*) AS total, count(*) FILTER (WHERE len(dubious_flags) > 0) AS dubious FROM p_class GROUP BY investigation_id")
def _(v):
    return v.p_class.groupBy("investigation_id").agg(F.count("*").alias("total"), F.count_if(F.size("dubious_flags") > 0).alias("dubious"))


@query("d03_storage_stats", "SELECT count(*) AS n, count(DISTINCT investigation_id) AS tenants, count(DISTINCT content_hash) AS hashes, count(DISTINCT source_id) AS sources FROM p_facts")
def _(v):
    return v.p_facts.agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(n) for c, n in (("investigation_id", "tenants"), ("content_hash", "hashes"), ("source_id", "sources"))))


@query("d04_fact_stats", "SELECT t.*, coalesce(sources, 0) AS sources, coalesce(by_source, '') AS by_source FROM (SELECT investigation_id, sum(n) AS total, count(*) FILTER (WHERE h <> '') AS hashes, coalesce(sum(n) FILTER (WHERE n > 1 AND h <> ''), 0) AS with_variants FROM (SELECT investigation_id, coalesce(content_hash, '') AS h, count(*) AS n FROM p_facts GROUP BY 1, 2) GROUP BY 1) t LEFT JOIN (SELECT investigation_id, count(*) AS sources, string_agg(source_id || ':' || n, ',' ORDER BY source_id) AS by_source FROM (SELECT investigation_id, source_id, count(*) AS n FROM p_facts WHERE source_id <> '' GROUP BY 1, 2) GROUP BY 1) USING (investigation_id)")
def _(v):
    shown = F.expr("array_join(transform(array_sort(map_entries(by_source)), x -> x.key || ':' || x.value), ',')")
    return S.fact_statistics(v.p_facts).withColumn("by_source", F.coalesce(shown, F.lit("")))


@query("d05_article_stats", "SELECT investigation_id, coalesce(nullif(source_name, ''), 'Unknown') AS source, count(*) AS n FROM p_articles GROUP BY ALL")
def _(v):
    return S.source_counts(v.p_articles, "source_name", "Unknown")


@query("d06_class_stats", "SELECT investigation_id, count(*) AS total, count(*) FILTER (WHERE impact_tier = 'critical') AS critical, count(*) FILTER (WHERE impact_tier <> 'critical') AS less_critical, count(*) FILTER (WHERE len(dubious_flags) > 0) AS dubious, count(*) FILTER (WHERE len(dubious_flags) = 0) AS verified, count(*) FILTER (WHERE impact_tier = 'critical' AND len(dubious_flags) > 0) AS critical_dubious, round(avg(credibility_score), 6) AS average_credibility FROM p_class GROUP BY investigation_id")
def _(v):
    return S.classification_statistics(v.p_class).withColumn("average_credibility", F.round("average_credibility", 6))


@query("d06_flag_counts", "SELECT investigation_id, flag, count(*) AS n FROM (SELECT investigation_id, unnest(dubious_flags) AS flag FROM p_class) GROUP BY ALL")
def _(v):
    return S.flag_counts(v.p_class)


@query("d07_verification_stats", "SELECT investigation_id, coalesce(status, 'unknown') AS status, count(*) AS n, count(*) FILTER (WHERE requires_human_review AND NOT human_review_completed) AS pending_review FROM p_ver GROUP BY 1, 2")
def _(v):
    return S.verification_statistics(v.p_ver)


@query("d08_archive_stats", "SELECT investigation_id, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'refuted') AS refuted, count(*) FILTER (WHERE status IN ('pending', 'in_progress', 'unverifiable')) AS dubious FROM p_ver GROUP BY investigation_id")
def _(v):
    return v.p_ver.groupBy("investigation_id").agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "refuted").alias("refuted"), F.count_if(F.col("status").isin(*S.DOUBTFUL)).alias("dubious"))


@query("d09_export_sources", "SELECT investigation_id, source_id, coalesce(k, 'unknown') AS source_type, CASE k WHEN 'wire_service' THEN 0.9E0 WHEN 'official_statement' THEN 0.85E0 WHEN 'news_outlet' THEN 0.6E0 WHEN 'academic' THEN 0.85E0 WHEN 'social_media' THEN 0.3E0 ELSE 0.4E0 END AS authority, fact_count FROM (SELECT investigation_id, source_id, first(source_type ORDER BY ord) AS k, count(*) AS fact_count FROM p_facts WHERE source_id <> '' GROUP BY 1, 2)")
def _(v):
    return R.export_sources(v.p_facts)


@query("d10_export_entities", "SELECT investigation_id, coalesce(nullif(canonical, ''), name) || ':' || entity_type AS entity_key, first(name ORDER BY ord) AS name, count(DISTINCT fact_id) AS fact_count, first(fact_id ORDER BY ord) AS first_fact FROM p_mentions GROUP BY 1, 2")
def _(v):
    return R.export_entities(v.p_mentions)


@query("d10_entity_facts", "SELECT investigation_id, coalesce(nullif(canonical, ''), name) || ':' || entity_type AS entity_key, fact_id, min(ord) AS first_seen FROM p_mentions GROUP BY 1, 2, 3")
def _(v):
    return R.entity_facts(v.p_mentions)


@query("d11_article_sources", "SELECT source_name, first(source_kind ORDER BY ord) AS kind, max(authority_score) AS authority, count(*) AS n FROM p_articles GROUP BY source_name")
def _(v):
    g = v.p_articles.groupBy("source_name").agg(F.min_by(F.struct("source_kind"), "ord").alias("f"), F.max("authority_score").alias("authority"), F.count("*").alias("n"))
    return g.select("source_name", F.col("f.source_kind").alias("kind"), "authority", "n").orderBy(F.desc("n"), "source_name")


@query("d12_source_inventory", "WITH b AS (SELECT fact_id, max(authority_score) AS a FROM p_evidence GROUP BY fact_id) SELECT investigation_id, source_id, greatest(0.0E0, least(1.0E0, coalesce(max(a), 0.5E0))) AS authority, max(stored_at) AS last_seen, count(*) AS fact_count FROM p_facts LEFT JOIN b USING (fact_id) WHERE source_id <> '' GROUP BY 1, 2")
def _(v):
    return R.source_inventory(v.p_facts, v.p_evidence)


@query("d13_status_count", "SELECT status, count(*) AS n FROM p_ver GROUP BY status")
def _(v):
    return v.p_ver.groupBy("status").agg(F.count("*").alias("n"))


@query("d14_snapshot", "SELECT f.*, coalesce(c.n, 0) AS classified, coalesce(c.d, 0) AS dubious, coalesce(c.k, 0) AS critical, coalesce(r.n, 0) AS verified, coalesce(r.y, 0) AS confirmed, coalesce(r.x, 0) AS refuted, coalesce(i.n, 0) AS sources, i.best FROM (SELECT investigation_id, count(*) AS facts, count(*) FILTER (WHERE temporal_value <> '') AS dated, min(nullif(temporal_value, '')) AS earliest, max(nullif(temporal_value, '')) AS latest FROM p_facts GROUP BY 1) f LEFT JOIN (SELECT investigation_id, count(*) AS n, count(*) FILTER (WHERE len(dubious_flags) > 0) AS d, count(*) FILTER (WHERE impact_tier = 'critical') AS k FROM p_class GROUP BY 1) c USING (investigation_id) LEFT JOIN (SELECT investigation_id, count(*) AS n, count(*) FILTER (WHERE status = 'confirmed') AS y, count(*) FILTER (WHERE status = 'refuted') AS x FROM p_ver GROUP BY 1) r USING (investigation_id) LEFT JOIN (SELECT investigation_id, count(DISTINCT source_id) AS n, greatest(0.0E0, least(1.0E0, max(coalesce(a, 0.5E0)))) AS best FROM p_facts LEFT JOIN (SELECT fact_id, max(authority_score) AS a FROM p_evidence GROUP BY 1) USING (fact_id) WHERE source_id <> '' GROUP BY 1) i USING (investigation_id)")
def _(v):
    dated = F.nullif(F.col("temporal_value"), F.lit(""))
    f = v.p_facts.groupBy("investigation_id").agg(F.count("*").alias("facts"), F.count(dated).alias("dated"), F.min(dated).alias("earliest"), F.max(dated).alias("latest"))
    c = v.p_class.groupBy("investigation_id").agg(F.count("*").alias("classified"), F.count_if(F.size("dubious_flags") > 0).alias("dubious"), F.count_if(F.col("impact_tier") == "critical").alias("critical"))
    r = v.p_ver.groupBy("investigation_id").agg(F.count("*").alias("verified"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "refuted").alias("refuted"))
    i = R.source_inventory(v.p_facts, v.p_evidence).groupBy("investigation_id").agg(F.count("*").alias("sources"), F.max("authority").alias("best"))
    counts = ["classified", "dubious", "critical", "verified", "confirmed", "refuted", "sources"]
    return f.join(c, "investigation_id", "left").join(r, "investigation_id", "left").join(i, "investigation_id", "left").fillna(0, counts)


@query("d15_recurring_entities", "SELECT investigation_id, canonical, count(*) AS count, count(DISTINCT fact_id) AS facts, first(entity_type ORDER BY ord) AS entity_type FROM p_mentions GROUP BY 1, 2 HAVING count(DISTINCT fact_id) >= 3")
def _(v):
    return R.recurring_entities(v.p_mentions)


@query("d16_source_clusters", "SELECT investigation_id, coalesce(source_type, 'unknown') AS source_type, fact_id, count(*) OVER (PARTITION BY investigation_id, coalesce(source_type, 'unknown')) AS n FROM p_facts")
def _(v):
    rows = v.p_facts.select("investigation_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "fact_id")
    sizes = rows.groupBy("investigation_id", "source_type").agg(F.count("*").alias("n"))
    return rows.join(sizes, ["investigation_id", "source_type"])


@query("d17_day_clusters", "SELECT investigation_id, substring(temporal_value, 1, 10) AS day_key, count(*) AS n FROM p_facts WHERE temporal_value <> '' GROUP BY 1, 2 HAVING count(*) >= 2")
def _(v):
    return R.day_clusters(v.p_facts)


@query("d18_monitoring", "SELECT coalesce(CAST(investigation_id AS STRING), 'all') AS tenant, coalesce(status, 'all') AS status, count(*) AS n FROM p_ver GROUP BY ROLLUP (investigation_id, status)")
def _(v):
    g = v.p_ver.rollup("investigation_id", "status").agg(F.count("*").alias("n"))
    return g.select(F.coalesce(F.col("investigation_id").cast("string"), F.lit("all")).alias("tenant"), F.coalesce("status", F.lit("all")).alias("status"), "n")


_STATS = "SELECT f.investigation_id, f.n AS f, f.h, coalesce(c.n, 0) AS c, coalesce(c.k, 0) AS k, coalesce(c.d, 0) AS d, coalesce(r.n, 0) AS r, coalesce(r.y, 0) AS y, coalesce(r.p, 0) AS p FROM (SELECT investigation_id, count(*) AS n, count(DISTINCT content_hash) AS h FROM p_facts GROUP BY 1) f LEFT JOIN (SELECT investigation_id, count(*) AS n, count(*) FILTER (WHERE impact_tier = 'critical') AS k, count(*) FILTER (WHERE len(dubious_flags) > 0) AS d FROM p_class GROUP BY 1) c USING (investigation_id) LEFT JOIN (SELECT investigation_id, count(*) AS n, count(*) FILTER (WHERE status = 'confirmed') AS y, count(*) FILTER (WHERE requires_human_review AND NOT human_review_completed) AS p FROM p_ver GROUP BY 1) r USING (investigation_id)"


def _stats(v):
    """Per tenant: facts and hashes; classified, critical, dubious; verified, confirmed, awaiting review."""
    f = S.fact_statistics(v.p_facts).select("investigation_id", F.col("total").alias("f"), F.col("hashes").alias("h"))
    c = S.classification_statistics(v.p_class).select("investigation_id", F.col("total").alias("c"), F.col("critical").alias("k"), F.col("dubious").alias("d"))
    r = S.verification_statistics(v.p_ver).groupBy("investigation_id").agg(F.sum("n").alias("r"), F.sum(F.when(F.col("status") == "confirmed", F.col("n")).otherwise(0)).alias("y"), F.sum("pending_review").alias("p"))
    return f.join(c, "investigation_id", "left").join(r, "investigation_id", "left").fillna(0, list("ckdryp"))


@query("d19_dashboard", f"SELECT s.*, r.version FROM ({_STATS}) s LEFT JOIN (SELECT investigation_id, max(version) AS version FROM p_reports GROUP BY 1) r USING (investigation_id)")
def _(v):
    return _stats(v).join(v.p_reports.groupBy("investigation_id").agg(F.max("version").alias("version")), "investigation_id", "left")


_JSON = """'{"facts":{"total":' || f || ',"hashes":' || h || '},"classifications":{"total":' || c || ',"critical":' || k || ',"dubious":' || d || '},"verifications":{"total":' || r || ',"confirmed":' || y || ',"pending_review":' || p || '}}'"""


@query("d20_stats_json", f"SELECT investigation_id, {_JSON} AS stats FROM ({_STATS})")
def _(v):
    part = lambda **names: F.struct(*(F.col(c).alias(n) for n, c in names.items()))
    stats = F.struct(part(total="f", hashes="h").alias("facts"), part(total="c", critical="k", dubious="d").alias("classifications"), part(total="r", confirmed="y", pending_review="p").alias("verifications"))
    return _stats(v).select("investigation_id", F.to_json(stats).alias("stats"))


@query("d21_queue_stats", "SELECT status, count(*) AS n, count(DISTINCT source_type) AS sources FROM p_tasks GROUP BY status")
def _(v):
    return v.p_tasks.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("source_type").alias("sources"))


@query("d22_registry_stats", "SELECT required_capability, count(*) AS n FROM p_tasks GROUP BY required_capability")
def _(v):
    return v.p_tasks.groupBy("required_capability").agg(F.count("*").alias("n"))


@query("d23_report_count", "SELECT count(DISTINCT investigation_id) AS n FROM p_reports")
def _(v):
    return v.p_reports.agg(F.count_distinct("investigation_id").alias("n"))


@query("d24_report_rollup", "SELECT investigation_id, count(*) AS versions, max(version) AS last_version, arg_max(generated_at, version) AS generated_at, coalesce(arg_max_null(confidence_level, version), 'N/A') AS confidence_level FROM p_reports GROUP BY 1")
def _(v):
    g = v.p_reports.groupBy("investigation_id").agg(F.count("*").alias("versions"), F.max("version").alias("last_version"), F.max_by(F.struct("generated_at", "confidence_level"), "version").alias("l"))
    return g.select("investigation_id", "versions", "last_version", "l.generated_at", F.coalesce("l.confidence_level", F.lit("N/A")).alias("confidence_level"))


@query("d25_extraction_metrics", "SELECT source_type AS model, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS done, round(count(*) FILTER (WHERE status = 'completed')::DOUBLE / count(*), 6) AS success_rate FROM p_tasks GROUP BY 1")
def _(v):
    g = v.p_tasks.groupBy(F.col("source_type").alias("model")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("done"))
    return g.withColumn("success_rate", F.round(F.coalesce(F.try_divide(F.col("done").cast("double"), "runs"), F.lit(0.0)), 6))


@query("d26_combine_results", "SELECT source_type, count(*) AS n, count(DISTINCT required_capability) AS agents FROM (SELECT * FROM p_tasks WHERE status = 'completed' UNION ALL SELECT * FROM p_tasks WHERE status = 'pending') GROUP BY 1")
def _(v):
    both = v.p_tasks.where("status = 'completed'").unionByName(v.p_tasks.where("status = 'pending'"))
    return both.groupBy("source_type").agg(F.count("*").alias("n"), F.size(F.collect_set("required_capability")).cast("long").alias("agents"))


@query("d27_coverage", "SELECT investigation_id, least(count(DISTINCT source_id)::DOUBLE / 10, 1.0E0) AS sources, least(count(DISTINCT source_type)::DOUBLE / 5, 1.0E0) AS topics, least(date_diff('day', min(stored_at)::DATE, max(stored_at)::DATE)::DOUBLE / 30, 1.0E0) AS span FROM p_facts GROUP BY 1")
def _(v):
    days = F.date_diff(F.max(F.col("stored_at").cast("date")), F.min(F.col("stored_at").cast("date"))).cast("double")
    part = lambda c, n: F.least(c.cast("double") / n, F.lit(1.0))
    return v.p_facts.groupBy("investigation_id").agg(part(F.count_distinct("source_id"), 10).alias("sources"), part(F.count_distinct("source_type"), 5).alias("topics"), part(days, 30).alias("span"))


@query("d28_overall_confidence", "SELECT investigation_id, CASE WHEN a > 0.7 THEN 'high' WHEN a >= 0.4 THEN 'moderate' ELSE 'low' END AS level, round(coalesce(a, 0.0E0), 3) AS numeric_score, n, sources, authority FROM (SELECT t.investigation_id, avg(original_confidence) AS a, count(fact_id) AS n, coalesce(sum(s), 0) AS sources, coalesce(max(m), 0.0E0) AS authority FROM (SELECT investigation_id FROM p_reports UNION SELECT investigation_id FROM p_facts) t LEFT JOIN (SELECT p_ver.*, e.s, e.m FROM p_ver LEFT JOIN (SELECT fact_id, count(DISTINCT source_domain) AS s, max(authority_score) AS m FROM p_evidence GROUP BY 1) e USING (fact_id)) USING (investigation_id) GROUP BY 1)")
def _(v):
    tenants = v.p_reports.select("investigation_id").union(v.p_facts.select("investigation_id")).distinct()
    return R.overall_confidence(tenants, v.p_ver, v.p_evidence)


@query("d29_drop_reasons", "SELECT CASE WHEN k > 1 THEN 'duplicate' WHEN source_id IS NULL OR source_id = '' THEN 'no_source' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ord) AS k FROM p_facts) GROUP BY 1")
def _(v):
    firsts = v.p_facts.groupBy("content_hash").agg(F.min("ord").alias("f"))
    rows = v.p_facts.join(firsts, "content_hash")
    return rows.groupBy(F.when(F.col("ord") > F.col("f"), "duplicate").when(S.blank_as("source_id", "") == "", "no_source").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query("d30_pattern_bundle", "SELECT 'entity' AS pattern, count(*) AS n FROM (SELECT 1 FROM p_mentions GROUP BY investigation_id, canonical HAVING count(DISTINCT fact_id) >= 3) UNION ALL SELECT 'day', count(*) FROM (SELECT 1 FROM p_facts WHERE temporal_value <> '' GROUP BY investigation_id, substring(temporal_value, 1, 10) HAVING count(*) >= 2)")
def _(v):
    size = lambda df, name: df.agg(F.lit(name).alias("pattern"), F.count("*").alias("n"))
    return size(R.recurring_entities(v.p_mentions), "entity").union(size(R.day_clusters(v.p_facts), "day"))


@query("d32_synthesis_summary", "SELECT fact_id, len(dubious_flags)::BIGINT AS n_flags, coalesce(dubious_flags[1], 'none') AS first_flag FROM p_class")
def _(v):
    return v.p_class.select("fact_id", F.size("dubious_flags").cast("long").alias("n_flags"), F.coalesce(F.get("dubious_flags", 0), F.lit("none")).alias("first_flag"))


# --- E: windows ------------------------------------------------------------------------


@query("e01_escalation", "WITH r AS (SELECT DISTINCT m.fact_id, m.canonical, f.investigation_id, f.ord, coalesce(nullif(f.temporal_value, ''), f.stored_at) AS time_key, CASE c.impact_tier WHEN 'critical' THEN 2 WHEN 'less_critical' THEN 1 ELSE 0 END AS s FROM p_mentions m JOIN p_facts f USING (fact_id) LEFT JOIN p_class c USING (fact_id)), w AS (SELECT *, lead(s) OVER o AS s2, lead(fact_id) OVER o AS next_fact FROM r WINDOW o AS (PARTITION BY investigation_id, canonical ORDER BY time_key, ord)) SELECT investigation_id, canonical, fact_id, next_fact, time_key FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, canonical ORDER BY time_key, ord) AS k FROM w WHERE s2 > s AND s > 0) WHERE k = 1")
def _(v):
    return R.escalations(v.p_facts, v.p_mentions, v.p_class).withColumnRenamed("at", "time_key")


@query("e02_latest_version", "SELECT investigation_id, max(version) AS version, arg_max(content_hash, version) AS content_hash FROM p_reports GROUP BY 1")
def _(v):
    return S.latest(v.p_reports).select("investigation_id", "version", "content_hash")


@query("e03_has_changed", "SELECT investigation_id, arg_max(content_hash, version) <> md5('F1-URGENT') AS changed FROM p_reports GROUP BY 1")
def _(v):
    return S.latest(v.p_reports).select("investigation_id", (F.col("content_hash") != F.md5(F.lit("F1-URGENT").cast("binary"))).alias("changed"))


@query("e04_consecutive_dedup", "SELECT investigation_id, version, row_number() OVER (PARTITION BY investigation_id ORDER BY version) AS number FROM (SELECT *, lag(content_hash) OVER (PARTITION BY investigation_id ORDER BY version) AS b FROM p_reports) WHERE b IS NULL OR b <> content_hash")
def _(v):
    return S.numbered_changes(v.p_reports).select("investigation_id", "version", "number")


@query("e05_first_seen", "SELECT content_hash, min(fact_id) AS fact_id FROM p_facts GROUP BY 1")
def _(v):
    return S.first_per(v.p_facts, ["content_hash"], [F.col("ord")]).select("content_hash", "fact_id")


@query("e06_budget", "SELECT fact_id FROM (SELECT fact_id, coalesce(sum(length(claim_text)) OVER (PARTITION BY investigation_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p_facts) WHERE b <= 5000")
def _(v):
    return R.budgeted(v.p_facts, F.length("claim_text"), 5000, "investigation_id", ["ord"]).select("fact_id")


@query("e07_event_ids", "SELECT event_id, row_number() OVER (PARTITION BY investigation_id ORDER BY event_id) AS id FROM p_events")
def _(v):
    return v.p_events.select("event_id", F.row_number().over(W.partitionBy("investigation_id").orderBy("event_id")).cast("long").alias("id"))


@query("e08_recency", "SELECT event_id, greatest(0.0E0, 1 - (1800000000000000 - ts_us)::DOUBLE / (72 * 3600000000::DOUBLE)) AS recency FROM p_events")
def _(v):
    from sieveworks.functions.scores import recency

    return v.p_events.select("event_id", recency(F.col("ts_us"), F.lit(1_800_000_000_000_000)).alias("recency"))


@query("e09_diversity", "SELECT task_id, CASE WHEN source_type IS NULL THEN 0.5E0 WHEN row_number() OVER (PARTITION BY source_type ORDER BY task_id) = 1 THEN 1.0E0 ELSE 0.4E0 END AS diversity FROM p_tasks")
def _(v):
    return R.first_time(v.p_tasks, "source_type", [F.col("task_id")]).select("task_id", "diversity")


@query("e10_novelty", "WITH n AS (SELECT investigation_id, source_id, fact_id, row_number() OVER (PARTITION BY investigation_id, source_id ORDER BY fact_id) AS k FROM p_facts WHERE source_id <> '') SELECT investigation_id, count(*) FILTER (WHERE k = 1)::DOUBLE / count(*) AS new_share FROM n GROUP BY 1")
def _(v):
    # of each tenant, the share of facts that bring a source for the first time
    seen = v.p_facts.where("source_id <> ''").groupBy("investigation_id", "source_id").agg(F.count("*").alias("n"))
    return seen.groupBy("investigation_id").agg((F.count("*").cast("double") / F.sum("n")).alias("new_share"))


# --- F: order and pages ----------------------------------------------------------------


@query("f01_priority_queue", "SELECT fact_id, priority_score FROM p_class WHERE NOT (len(dubious_flags) = 1 AND dubious_flags[1] = 'noise') ORDER BY priority_score DESC, fact_id LIMIT 25")
def _(v):
    return S.priority_queue(v.p_class, 25).select("fact_id", "priority_score")


@query("f02_recent_first", "SELECT ord, stored_at FROM p_articles WHERE stored_at > '2024-03' ORDER BY stored_at DESC, ord LIMIT 30")
def _(v):
    return v.p_articles.where("stored_at > '2024-03'").orderBy(F.col("stored_at").desc_nulls_first(), "ord").limit(30).select("ord", "stored_at")


@query("f03_page", "SELECT fact_id FROM p_facts ORDER BY ord LIMIT 20 OFFSET 40")
def _(v):
    return S.page(v.p_facts, [F.col("ord")], 3, 20).select("fact_id")


@query("f04_versions_ascending", "SELECT version FROM p_reports WHERE investigation_id = 8 ORDER BY version")
def _(v):
    return S.of_tenant(v.p_reports, 8).orderBy("version").select("version")


@query("f05_newest_first", "SELECT task_id, created_at FROM p_tasks ORDER BY created_at DESC, task_id LIMIT 50")
def _(v):
    return v.p_tasks.orderBy(F.desc("created_at"), "task_id").limit(50).select("task_id", "created_at")


@query("f06_pending_tasks", "SELECT task_id, priority FROM p_tasks WHERE status = 'pending' ORDER BY priority DESC, created_at, task_id LIMIT 20")
def _(v):
    return v.p_tasks.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "task_id").limit(20).select("task_id", "priority")


@query("f07_next_task", "SELECT task_id FROM p_tasks WHERE status = 'pending' AND (required_capability IS NULL OR required_capability IN ('crawl', 'verify')) ORDER BY priority DESC, created_at, task_id LIMIT 1")
def _(v):
    able = F.col("required_capability").isNull() | F.col("required_capability").isin("crawl", "verify")
    return v.p_tasks.where((F.col("status") == "pending") & able).orderBy(F.desc("priority"), "created_at", "task_id").limit(1).select("task_id")


@query("f08_source_selection", "SELECT s_suppkey FROM supplier ORDER BY coalesce(s_nationkey % 5, 3) DESC, s_suppkey LIMIT 10")
def _(v):
    return v.table("supplier").orderBy(F.coalesce(F.expr("s_nationkey % 5"), F.lit(3)).desc(), "s_suppkey").limit(10).select("s_suppkey")


@query("f09_capability_ranking", "SELECT p_partkey, score FROM (SELECT p_partkey, (contains(lower(p_name), 'a'))::INT + 2 * (contains(lower(p_type), 'brass'))::INT AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 40")
def _(v):
    score = F.contains(F.lower("p_name"), F.lit("a")).cast("int") + 2 * F.contains(F.lower("p_type"), F.lit("brass")).cast("int")
    return v.table("part").select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(40)


@query("f10_timeline", "SELECT fact_id, temporal_value FROM p_facts WHERE temporal_value <> '' AND investigation_id = 2 ORDER BY temporal_value, ord")
def _(v):
    once = S.first_per(S.of_tenant(v.p_facts, 2), ["fact_id"], [F.col("ord")])
    return once.where("temporal_value <> ''").orderBy("temporal_value", "ord").select("fact_id", "temporal_value")


@query("f11_capped_entries", "SELECT ord FROM (SELECT min(ord) AS ord FROM p_articles GROUP BY regexp_replace(url, '[?#].*$', '')) ORDER BY ord LIMIT 100")
def _(v):
    return v.p_articles.groupBy(R.stripped_url().alias("u")).agg(F.min("ord").alias("ord")).orderBy("ord").limit(100).select("ord")


@query("f12_paged_list", "SELECT investigation_id FROM (SELECT DISTINCT investigation_id FROM p_reports) ORDER BY investigation_id LIMIT 50 OFFSET 50")
def _(v):
    return S.page(v.p_reports.select("investigation_id").distinct(), [F.col("investigation_id")], 2, 50)


# --- G: dedup and sets -----------------------------------------------------------------


@query("g01_article_dedup", "WITH a AS (SELECT *, lower(trim(content)) AS t FROM p_articles), x AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY t ORDER BY ord) = 1) SELECT ord FROM y QUALIFY row_number() OVER (PARTITION BY substr(t, 1, 500) ORDER BY ord) = 1")
def _(v):
    return R.article_dedup(v.p_articles).select("ord")


@query("g02_url_dedup", "SELECT ord FROM (SELECT ord, CASE WHEN ord % 7 = 0 THEN '' ELSE url END AS url FROM p_articles) QUALIFY url = '' OR row_number() OVER (PARTITION BY url ORDER BY ord) = 1")
def _(v):
    rows = v.p_articles.select("ord", F.when(F.col("ord") % 7 == 0, "").otherwise(F.col("url")).alias("url"))
    return S.first_per(rows.where("url <> ''"), ["url"], [F.col("ord")]).union(rows.where("url = ''")).select("ord")


@query("g03_plain_url_dedup", "SELECT min(ord) AS ord FROM p_articles GROUP BY regexp_replace(url, '[?#].*$', '')")
def _(v):
    return v.p_articles.groupBy(R.stripped_url().alias("u")).agg(F.min("ord").alias("ord")).select("ord")


@query("g04_canonical_urls", "SELECT investigation_id, regexp_replace(url, '[?#].*$', '') AS norm, count(*) AS crawl_count, arg_min(url, ord) AS original FROM p_articles GROUP BY 1, 2")
def _(v):
    return v.p_articles.groupBy("investigation_id", R.stripped_url().alias("norm")).agg(F.count("*").alias("crawl_count"), F.min_by("url", "ord").alias("original"))


@query("g05_consolidation", "SELECT investigation_id, content_hash, min(fact_id) AS fact_id, count(*) AS n, coalesce(array_to_string(list_transform(list(fact_id ORDER BY ord)[2:], lambda x: x::VARCHAR), ','), '') AS variants FROM p_facts GROUP BY 1, 2")
def _(v):
    return R.consolidated(v.p_facts).withColumn("variants", F.concat_ws(",", F.col("variants").cast("array<string>")))


@query("g05_additional_sources", "SELECT DISTINCT f.investigation_id, f.content_hash, m.fact_id, f.source_id FROM p_facts f JOIN (SELECT investigation_id, content_hash, arg_min(fact_id, ord) AS fact_id, min(ord) AS o FROM p_facts GROUP BY 1, 2) m ON m.investigation_id = f.investigation_id AND m.content_hash = f.content_hash WHERE f.ord > m.o AND f.source_id <> ''")
def _(v):
    return R.additional_sources(v.p_facts)


@query("g07_edge_dedup", "SELECT src, dst, type, max(weight) AS weight FROM p_edges GROUP BY 1, 2, 3")
def _(v):
    return R.heaviest_edges(v.p_edges)


@query("g08_pair_dedup", "SELECT a, b, min(detector) AS detector FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, 1 AS detector FROM p_pairs WHERE type = 'CONTRADICTS' UNION ALL SELECT least(src, dst), greatest(src, dst), 2 FROM p_pairs) GROUP BY 1, 2")
def _(v):
    pair = lambda df, k: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(k).alias("detector"))
    return pair(v.p_pairs.where("type = 'CONTRADICTS'"), 1).union(pair(v.p_pairs, 2)).groupBy("a", "b").agg(F.min("detector").alias("detector"))


@query("g09_evidence_urls", "SELECT source_url, min(ord) AS ord FROM p_evidence GROUP BY 1")
def _(v):
    return S.first_per(v.p_evidence, ["source_url"], [F.col("ord")]).select("source_url", "ord")


@query("g10_independent_sources", "SELECT fact_id, source_domain, authority_score, ord FROM p_evidence QUALIFY row_number() OVER (PARTITION BY fact_id, source_domain ORDER BY authority_score DESC, ord) = 1")
def _(v):
    return R.independent_sources(v.p_evidence).select("fact_id", "source_domain", "authority_score", "ord")


@query("g12_combinations", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def _(v):
    names = v.table("nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("k"))
    pairs = names.select(F.explode(F.expr("flatten(transform(k, (a, i) -> transform(slice(k, i + 2, size(k)), b -> struct(a.n_name AS x, b.n_name AS y))))")).alias("p"))
    return pairs.select("p.*")


@query("g13_variant_links", "SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM p_pairs UNION ALL SELECT dst, src FROM p_pairs) WHERE a <> b")
def _(v):
    return R.symmetric(v.p_pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a", "b")


@query("g14_token_overlap", "SELECT doc_id, len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of', 'und', 'de', 'que']))::BIGINT AS shared FROM documents")
def _(v):
    words = F.array(*map(F.lit, ("the", "of", "und", "de", "que")))
    return v.table("documents").select("doc_id", F.size(F.array_intersect(F.split(F.lower("text"), " "), words)).cast("long").alias("shared"))


# --- L: changes ------------------------------------------------------------------------


@query("l01_save_facts", "WITH t AS (SELECT * FROM p_facts WHERE fact_id % 3 = 0) SELECT count(*) AS total, count(*) FILTER (WHERE fact_id % 3 = 0) AS skipped, count(*) FILTER (WHERE fact_id % 3 <> 0) AS saved, count(*) FILTER (WHERE fact_id % 3 <> 0 AND EXISTS (SELECT 1 FROM t WHERE t.content_hash = p.content_hash AND t.investigation_id = p.investigation_id)) AS updated FROM p_facts p")
def _(v):
    table = v.p_facts.where("fact_id % 3 = 0")
    new = v.p_facts.join(table.select("fact_id", F.lit(True).alias("known")), "fact_id", "left").join(table.select("investigation_id", "content_hash", F.lit(True).alias("same")).distinct(), ["investigation_id", "content_hash"], "left")
    fresh = F.col("known").isNull()
    return new.agg(F.count("*").alias("total"), F.count_if(~fresh).alias("skipped"), F.count_if(fresh).alias("saved"), F.count_if(fresh & F.col("same").isNotNull()).alias("updated"))


@query("l01_variant_links", "WITH w AS (SELECT *, first(fact_id) OVER (PARTITION BY investigation_id, content_hash ORDER BY CASE WHEN fact_id % 3 = 0 THEN 0 ELSE 1 END, ord) AS head FROM p_facts), p AS (SELECT investigation_id, fact_id, head FROM w WHERE fact_id % 3 <> 0 AND fact_id <> head) SELECT investigation_id, fact_id, head AS variant_id FROM p UNION ALL SELECT investigation_id, head, fact_id FROM p")
def _(v):
    return R.variant_links(v.p_facts.where("fact_id % 3 = 0"), v.p_facts)


@query("l02_upsert_articles", "SELECT url, arg_min(investigation_id, ord) AS investigation_id, arg_max(title, ord) AS title FROM p_articles GROUP BY url")
def _(v):
    old, new = v.p_articles.where("ord < 300"), v.p_articles.where("ord >= 300")
    columns = ["url", "investigation_id", "title", "ord"]
    first = S.first_per(old, ["url"], [F.col("ord")]).select(*columns)
    table = R.upserted(first, old.select(*columns), ["url"], [F.col("ord")], ("investigation_id",))
    return R.upserted(table, new.select(*columns), ["url"], [F.col("ord")], ("investigation_id",)).select("url", "investigation_id", "title")


@query("l03_entity_touch", "SELECT investigation_id, canonical, arg_min(name, ord) AS name, max(ord) AS touched FROM p_mentions GROUP BY 1, 2")
def _(v):
    return v.p_mentions.groupBy("investigation_id", "canonical").agg(F.min_by("name", "ord").alias("name"), F.max("ord").alias("touched"))


@query("l04_upsert_class", "SELECT fact_id, CASE WHEN fact_id % 2 = 0 THEN 'critical' ELSE impact_tier END AS impact_tier FROM p_class WHERE fact_id % 2 = 0 OR fact_id % 3 = 0")
def _(v):
    table = v.p_class.where("fact_id % 3 = 0").select("fact_id", "impact_tier")
    new = v.p_class.where("fact_id % 2 = 0").select("fact_id", F.lit("critical").alias("impact_tier"))
    return R.upserted(table, new, ["fact_id"], [F.col("fact_id")])


@query("l05_upsert_verification", "SELECT fact_id, CASE WHEN fact_id % 5 = 0 THEN 'confirmed' ELSE status END AS status FROM p_ver")
def _(v):
    return R.upserted(v.p_ver.select("fact_id", "status"), v.p_ver.where("fact_id % 5 = 0").select("fact_id", F.lit("confirmed").alias("status")), ["fact_id"], [F.col("fact_id")])


@query("l06_mark_reviewed", "SELECT fact_id, human_review_completed OR fact_id % 9 = 0 AS human_review_completed FROM p_ver")
def _(v):
    held = v.p_ver.select("fact_id", F.struct("status", "human_review_completed").alias("doc"))
    marked = held.withColumn("doc", F.when(F.col("fact_id") % 9 == 0, F.col("doc").withField("human_review_completed", F.lit(True))).otherwise(F.col("doc")))
    return marked.select("fact_id", "doc.human_review_completed")


@query("l07_cascade_delete", "SELECT 'facts' AS name, count(*) AS n FROM p_facts WHERE investigation_id <> 2 UNION ALL SELECT 'entities', count(*) FROM p_mentions WHERE investigation_id <> 2")
def _(v):
    size = lambda df, n: R.without_tenant(df, 2).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return size(v.p_facts, "facts").union(size(v.p_mentions, "entities"))


@query("l08_insert_absent", "SELECT fact_id FROM p_class WHERE fact_id % 4 <> 1")
def _(v):
    return R.inserted(v.p_class.where("fact_id % 4 = 1"), v.p_class, ["fact_id"], [F.col("fact_id")]).select("fact_id")


#: Requests made of events: what state they expect and which they want.
_REQUESTS = "SELECT event_id, investigation_id, CASE WHEN event_id % 3 = 0 THEN 'pending' ELSE 'running' END AS expected, CASE event_id % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'running' END AS wanted FROM p_events"


@query("l09_lifecycle", f"WITH q AS ({_REQUESTS}), a AS (SELECT investigation_id, min(event_id) AS one, arg_min(wanted, event_id) AS became FROM q WHERE expected = 'pending' AND wanted IN ('running', 'cancelled') GROUP BY 1), b AS (SELECT q.investigation_id, min(event_id) AS two FROM q JOIN a ON a.investigation_id = q.investigation_id WHERE became = 'running' AND event_id > one AND expected = 'running' AND wanted IN ('completed', 'failed', 'cancelled') GROUP BY 1) SELECT event_id, expected, wanted, CASE WHEN event_id = one OR event_id = two THEN 'ok' ELSE 'conflict' END AS verdict FROM q LEFT JOIN a ON a.investigation_id = q.investigation_id LEFT JOIN b ON b.investigation_id = q.investigation_id")
def _(v):
    requests = v.spark.sql(_REQUESTS.replace("FROM p_events", "FROM {p_events}"), p_events=v.p_events)
    return R.transitions(requests, "investigation_id", "event_id").select("event_id", "expected", "wanted", "verdict")


@query("l10_metadata_touch", "SELECT count(*) > 0 AS found FROM p_class WHERE investigation_id = 6")
def _(v):
    return S.exists(S.of_tenant(v.p_class, 6))


@query("l11_registry_hydrate", "SELECT task_id, CASE WHEN status IN ('pending', 'completed') THEN status ELSE 'completed' END AS status FROM p_tasks")
def _(v):
    return v.p_tasks.select("task_id", F.when(F.col("status").isin("pending", "completed"), F.col("status")).otherwise("completed").alias("status"))


@query("l12_task_status", "SELECT source_type, arg_max(status, task_id) AS status, count(*) FILTER (WHERE status = 'failed') AS retries, greatest(0.0E0, least(1.0E0, max(priority) / 100000)) AS priority FROM p_tasks GROUP BY 1")
def _(v):
    return v.p_tasks.groupBy("source_type").agg(F.max_by("status", "task_id").alias("status"), F.count_if(F.col("status") == "failed").alias("retries"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("priority") / 100000)).alias("priority"))


@query("l14_clear_tenant", "SELECT count(*) FILTER (WHERE investigation_id = 'en') AS removed, count(*) FILTER (WHERE investigation_id <> 'en') AS left_over FROM p_articles")
def _(v):
    return v.p_articles.agg(F.count_if(F.col("investigation_id") == "en").alias("removed"), F.count_if(F.col("investigation_id") != "en").alias("left_over"))
