"""Queries of the scalar functions and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.functions import constants as C
from sieveworks.functions import scores as P
from sieveworks.functions import text as T
from sieveworks.operators import relations as R
from sieveworks.plans.proxies import query


def case(values: dict, column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


#: Small inputs for rules that the synthetic prose never meets; both engines read them.
SNIPPETS = (
    "Officials said there is no evidence of an attack", "Sources say the president may have left", "The report was REFUTED by Reuters", "Reportedly, insiders claim a coup in Paris and London",
    "Xi met Putin at the summit", "Nothing to see here", "", "It is believed that many think so", "NATO troops move; fact-check: this is false", "by Jane Doe, breaking news about the UN", "Officials said the attack began",
)
_VALUES = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SNIPPETS)) + ") s(id, text)"


def snippets(v):
    return v.spark.createDataFrame(list(enumerate(SNIPPETS)), "id int, text string")


# --- H ------------------------------------------------------------------------

_AUTH = "regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
_TRACK = "(" + ", ".join(f"'{p}'" for p in C.TRACKING_PARAMS) + ")"
_NORM = (
    "lower(regexp_extract({u}, '^([^:]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract({u}, '^[^:]+://([^/?#]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(regexp_replace({u}, '[?#].*$', ''), '^[^:]+://[^/]*(/.*)?$', 1), '/+$', '')"
    " || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_replace({u}, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN " + _TRACK + ")), '&'), ''), '')"
)


@query("h01_url_normalise", f"SELECT page_id, {_NORM.format(u='url')} AS norm FROM pages")
def _(v):
    return v.table("pages").select("page_id", T.normalised_url(F.col("url")).alias("norm"))


@query("h02_domain", f"SELECT page_id, {_AUTH.format(u='url')} AS domain FROM pages")
def _(v):
    return v.table("pages").select("page_id", T.authority_of(F.col("url")).alias("domain"))


@query("h03_category", f"SELECT page_id, CASE WHEN {contains_any('d', ('.gov', '.mil'))} THEN 'official' WHEN {contains_any('d', ('.edu', '.ac.'))} THEN 'academic' WHEN {contains_any('d', C.NEWS_DOMAINS)} THEN 'news' WHEN contains(d, '.org') THEN 'organization' WHEN {contains_any('d', C.SOCIAL_DOMAINS)} THEN 'social' ELSE 'unknown' END AS category FROM (SELECT page_id, {_AUTH.format(u='url')} AS d FROM pages)")
def _(v):
    return v.table("pages").select("page_id", T.category(T.authority_of(F.col("url"))).alias("category"))


@query("h04_source_type", f"SELECT DISTINCT d, CASE WHEN d IN ('reuters.com', 'apnews.com', 'afp.com') THEN 'wire_service' WHEN d IN ('reddit.com', 'twitter.com', 'x.com', 'facebook.com', 'telegram.org') THEN 'social_media' WHEN ends_with(d, '.gov') OR ends_with(d, '.mil') OR ends_with(d, '.edu') THEN 'official_statement' ELSE 'news_outlet' END AS kind FROM (SELECT {_AUTH.format(u='url')} AS d FROM pages UNION ALL SELECT unnest(['reuters.com', 'x.com', 'state.gov', 'mit.edu']))")
def _(v):
    d = v.table("pages").select(T.authority_of(F.col("url")).alias("d")).union(v.spark.createDataFrame([("reuters.com",), ("x.com",), ("state.gov",), ("mit.edu",)], "d string"))
    return d.distinct().select("d", T.source_type(F.col("d")).alias("kind"))


@query("h05_hashes", "SELECT doc_id, sha256(text) AS raw, sha256(lower(trim(text))) AS folded, substr(sha256(substr(lower(trim(text)), 1, 500)), 1, 16) AS prefix FROM documents")
def _(v):
    t = F.lower(F.trim("text"))
    return v.table("documents").select("doc_id", F.sha2("text", 256).alias("raw"), F.sha2(t, 256).alias("folded"), F.substring(F.sha2(F.substring(t, 1, 500), 256), 1, 16).alias("prefix"))


@query("h06_surrogate_key", "SELECT DISTINCT sha256(investigation_id || ':' || canonical || ':' || entity_type) AS entity_id FROM p_mentions")
def _(v):
    return v.p_mentions.select(F.sha2(F.concat_ws(":", F.col("investigation_id").cast("string"), "canonical", "entity_type"), 256).alias("entity_id")).distinct()


@query("h07_date_cascade", "SELECT fact_id, CASE WHEN fact_id % 7 = 0 THEN NULL ELSE CASE fact_id % 6 WHEN 0 THEN day WHEN 1 THEN CAST(epoch(date_trunc('month', CAST(stored_at AS DATE))) AS BIGINT) WHEN 2 THEN day + 37230 WHEN 5 THEN day ELSE day + 30030 END END AS at FROM (SELECT *, CAST(epoch(CAST(stored_at AS DATE)) AS BIGINT) AS day FROM p_facts)")
def _(v):
    day, form = F.to_date("stored_at"), F.col("fact_id") % 6
    said = (
        F.when(F.col("fact_id") % 7 == 0, "soon").when(form == 0, F.col("stored_at")).when(form == 1, F.substring("stored_at", 1, 7)).when(form == 2, F.concat("stored_at", F.lit("T10:20:30Z")))
        .when(form == 3, F.concat("stored_at", F.lit("T10:20:30+02:00"))).when(form == 4, F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 10:20:30 +0200"))).otherwise(F.date_format(day, "MMM d, yyyy"))
    )
    return v.p_facts.select("fact_id", F.unix_seconds(T.instant(said)).alias("at"))


@query("h08_age_hours", "SELECT event_id, (1800000000000000 - ts_us)::DOUBLE / 3600000000::DOUBLE AS hours FROM p_events")
def _(v):
    return v.p_events.select("event_id", ((F.lit(1_800_000_000_000_000) - F.col("ts_us")).cast("double") / F.lit(3.6e9)).alias("hours"))


@query("h09_locations", f"SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?i)' || '{C.LOCATIONS[0]}'), regexp_extract_all(text, '(?i)' || '{C.LOCATIONS[1]}')))), ',') AS places FROM {_VALUES}")
def _(v):
    found = F.concat(*(F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(0)) for p in C.LOCATIONS))
    return snippets(v).select("id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("places"))


@query("h10_author", f"SELECT id, nullif(regexp_extract(text, '(?i)by ([A-Z][a-z]+ [A-Z][a-z]+)', 1), '') AS author FROM {_VALUES}")
def _(v):
    return snippets(v).select("id", F.nullif(F.regexp_extract("text", "(?i)by ([A-Z][a-z]+ [A-Z][a-z]+)", 1), F.lit("")).alias("author"))


@query("h11_article_type", f"SELECT id, CASE WHEN regexp_matches(substr(text, 1, 500), '(?i)breaking') THEN 'breaking' WHEN regexp_matches(substr(text, 1, 500), '(?i)report') THEN 'report' ELSE 'article' END AS kind FROM {_VALUES}")
def _(v):
    t = F.substring("text", 1, 500)
    return snippets(v).select("id", F.when(F.rlike(t, F.lit("(?i)breaking")), "breaking").when(F.rlike(t, F.lit("(?i)report")), "report").otherwise("article").alias("kind"))


@query("h12_hashtags", "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '#([0-9A-Za-z_]+)')[1:10], lambda x: x[2:]), ',') AS tags FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("#([0-9A-Za-z_]+)"), F.lit(1)), 1, 10), ",").alias("tags"))


@query("h13_origin", f"SELECT page_id, CASE WHEN ends_with(d, '.uk') THEN 'UK' WHEN ends_with(d, '.de') THEN 'Germany' WHEN ends_with(d, '.com') THEN 'International' ELSE 'Unknown' END AS origin FROM (SELECT page_id, {_AUTH.format(u='url')} AS d FROM pages)")
def _(v):
    d = T.authority_of(F.col("url"))
    return v.table("pages").select("page_id", F.when(F.endswith(d, F.lit(".uk")), "UK").when(F.endswith(d, F.lit(".de")), "Germany").when(F.endswith(d, F.lit(".com")), "International").otherwise("Unknown").alias("origin"))


@query("h14_word_count", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n"))


@query("h15_html_meta", "SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)', 1) AS title FROM pages")
def _(v):
    return v.table("pages").select("page_id", F.regexp_extract("html", "(?i)<title>([^<]*)", 1).alias("title"))


@query("h18_json_repair", "SELECT * FROM (VALUES (1, 2), (2, 1), (3, 0)) t(id, n)")
def _(v):
    answers = ["<think>hm</think>```json\n[{\"a\": 1} {\"a\": 2},]\n```", "text [{\"a\": 3}] more", "nothing"]
    rows = v.spark.createDataFrame(list(enumerate(answers, 1)), "id int, text string")
    return rows.select("id", F.coalesce(F.size(F.from_json(T.repaired_json(F.col("text")), "array<struct<a:int>>")), F.lit(0)).alias("n")).select("id", F.greatest("n", F.lit(0)).alias("n"))


_VAGUE = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i)' || '{p}', 0), '')" for p in C.VAGUE_ATTRIBUTION) + ")"


@query("h19_vague", f"SELECT id, {_VAGUE} AS phrase FROM {_VALUES}")
def _(v):
    return snippets(v).select("id", T.vague(F.col("text")).alias("phrase"))


@query("h20_stance", f"SELECT id, NOT regexp_matches(text, '(?i)' || '{'|'.join(C.NEGATION_CUES)}') AS supports FROM {_VALUES}")
def _(v):
    return snippets(v).select("id", T.supports(F.col("text")).alias("supports"))


@query("h21_relevance", f"SELECT id, CASE WHEN text = '' THEN 0.3::DOUBLE ELSE least(1.0::DOUBLE, 0.3::DOUBLE + ((contains(lower(text), 'attack'))::INT + (contains(lower(text), 'coup'))::INT + (contains(lower(text), 'paris'))::INT)::DOUBLE / 3 * 0.7::DOUBLE) END AS relevance FROM {_VALUES}")
def _(v):
    return snippets(v).select("id", T.relevance(F.col("text"), F.array(*map(F.lit, ("attack", "coup", "paris")))).alias("relevance"))


@query("h22_density", "SELECT doc_id, CASE WHEN n < 20 THEN 1 WHEN n < 50 THEN 2 WHEN n < 150 THEN 3 WHEN n < 300 THEN 4 ELSE 5 END AS bucket FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)")
def _(v):
    n = F.size(T.words(F.col("text")))
    return v.table("documents").select("doc_id", F.when(n < 20, 1).when(n < 50, 2).when(n < 150, 3).when(n < 300, 4).otherwise(5).alias("bucket"))


@query("h23_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(v):
    e = v.table("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("h24_edge_weight", "SELECT fact_id, round(greatest(0.0, least(1.0, 0.5 + 0.3 * claim_clarity + least(0.2, 0.05 * ln(1 + hop_count)) - least(0.2, (fact_id % 400)::DOUBLE / 365 * 0.2))), 9) AS weight FROM p_facts")
def _(v):
    return v.p_facts.select("fact_id", F.round(P.edge_weight(F.col("hop_count"), F.col("claim_clarity"), (F.col("fact_id") % 400).cast("double")), 9).alias("weight"))


@query("h25_truncate", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 57) || '...' END AS short FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.truncated(F.col("text"), 60).alias("short"))


@query("h26_tag_strip", "SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ') AS text FROM pages")
def _(v):
    return v.table("pages").select("page_id", T.untagged(F.col("html")).alias("text"))


@query("h27_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.expr("length(text) div 4").alias("tokens"))


#: What pages show beside their own text, so that some are challenges.
_SHOWN = "html || CASE page_id % 4 WHEN 0 THEN '<form id=\"challenge-form\">Ray  ID: 1</form>' WHEN 1 THEN 'Ray ID' ELSE '' END"


@query("h28_challenge", f"SELECT page_id, length(h) <= 50000 AND {' + '.join(f'regexp_matches(substr(h, 1, 5000), {chr(39)}(?i){sign}{chr(39)})::INT' for sign in C.CHALLENGE_SIGNS)} >= 2 AS challenge FROM (SELECT page_id, {_SHOWN} AS h FROM pages)")
def _(v):
    return v.table("pages").select("page_id", T.challenged(F.expr(_SHOWN)).alias("challenge"))


@query("h29_query_text", "SELECT fact_id, flag, CASE flag WHEN 'phantom' THEN 'original source ' || substr(claim_text, 1, 100) WHEN 'fog' THEN 'official statement ' || substr(claim_text, 1, 80) ELSE substr(claim_text, 1, 60) END AS q FROM (SELECT fact_id, unnest(dubious_flags[1:5]) AS flag FROM p_class) JOIN p_facts USING (fact_id)")
def _(v):
    rows = v.p_class.select("fact_id", F.explode(F.slice("dubious_flags", 1, 5)).alias("flag")).join(v.p_facts.select("fact_id", "claim_text"), "fact_id")
    t = lambda n: F.substring("claim_text", 1, n)
    return rows.select("fact_id", "flag", F.when(F.col("flag") == "phantom", F.concat(F.lit("original source "), t(100))).when(F.col("flag") == "fog", F.concat(F.lit("official statement "), t(80))).otherwise(t(60)).alias("q"))


@query("h30_crawlers", f"SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'news|report') THEN 'newsfeed' END, CASE WHEN contains(lower(text), 'source') THEN 'social' END, 'web'], lambda x: x IS NOT NULL), ',') AS crawlers FROM {_VALUES}")
def _(v):
    low = F.lower("text")
    return snippets(v).select("id", F.concat_ws(",", F.array_compact(F.array(F.when(F.rlike(low, F.lit("news|report")), F.lit("newsfeed")), F.when(F.contains(low, F.lit("source")), F.lit("social")), F.lit("web")))).alias("crawlers"))


@query("h31_node_key", "SELECT DISTINCT src, split_part(src, ':', 1) AS label, substr(src, strpos(src, ':') + 1) AS k FROM p_edges")
def _(v):
    return v.p_edges.select("src").distinct().select("src", F.split("src", ":", 2)[0].alias("label"), F.split("src", ":", 2)[1].alias("k"))


@query("h32_url_authority", f"SELECT page_id, least(1.0::DOUBLE, coalesce({case(C.SOURCE_BASELINES, 'd', 'NULL')}, CASE WHEN ends_with(d, '.org') THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) + CASE WHEN page_id % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END) AS authority FROM (SELECT page_id, {_AUTH.format(u='url')} AS d FROM pages)")
def _(v):
    d = T.authority_of(F.col("url"))
    base = F.coalesce(P.table(C.SOURCE_BASELINES, d, F.lit(None)), F.when(F.endswith(d, F.lit(".org")), 0.7).otherwise(0.3))
    return v.table("pages").select("page_id", F.least(F.lit(1.0), base + F.when(F.expr("page_id % 2 = 0"), 0.05).otherwise(0.0)).alias("authority"))


@query("h33_llm_rows", "SELECT * FROM (VALUES (1, 'a', 'moderate'), (1, 'b', 'high'), (2, 'c', 'moderate')) t(id, judgment, confidence)")
def _(v):
    answers = [(1, '[{"judgment": "a"}, {"judgment": "b", "confidence": "high"}, {"x": 1}]'), (2, '[{"judgment": "c"}]'), (3, "broken")]
    rows = v.spark.createDataFrame(answers, "id int, text string")
    parsed = rows.select("id", F.explode(F.from_json("text", "array<struct<judgment:string,confidence:string>>")).alias("j")).where("j.judgment IS NOT NULL")
    return parsed.select("id", "j.judgment", F.coalesce("j.confidence", F.lit("moderate")).alias("confidence"))


@query("h34_tagged_union", "SELECT event_id, CASE event_type WHEN 'error' THEN 'terminal' ELSE 'progress' END AS kind, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def _(v):
    e = v.table("events")
    return e.select("event_id", F.when(F.col("event_type") == "error", "terminal").otherwise("progress").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- I --------------------------------------------------------------------------

_TYPE = case(C.SOURCE_TYPE_DEFAULTS, "source_type", "0.3::DOUBLE")
_DOMAIN = "CASE fact_id % 5 WHEN 0 THEN 'reuters.com' WHEN 1 THEN 'state.gov' WHEN 2 THEN 'charity.org' ELSE 'blog.net' END"
_BASE = f"coalesce({case(C.SOURCE_BASELINES, 'd', 'NULL')}, CASE WHEN ends_with(d, '.gov') THEN 0.85::DOUBLE WHEN ends_with(d, '.org') THEN 0.7::DOUBLE END, {_TYPE})"
_PREC = "least(1.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE + n * 0.233::DOUBLE) * 0.3::DOUBLE + CASE temporal_kind WHEN 'explicit' THEN 1.0::DOUBLE WHEN 'inferred' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * 0.3::DOUBLE + CASE WHEN fact_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE + CASE WHEN source_type IN ('official_statement', 'academic') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE)"
_SCORED = f"SELECT f.*, {_DOMAIN} AS d, coalesce(m.n, 0) AS n FROM p_facts f LEFT JOIN (SELECT fact_id, count(*) AS n FROM p_mentions GROUP BY 1) m USING (fact_id)"


def scored(v):
    """Facts with domain, number of entities, credibility and its parts."""
    n = v.p_mentions.groupBy("fact_id").agg(F.count("*").alias("n"))
    f = v.p_facts.join(n, "fact_id", "left").fillna({"n": 0}).withColumn("d", F.expr(_DOMAIN))
    official = F.coalesce(F.col("source_type").isin("official_statement", "academic"), F.lit(False))
    f = f.withColumns({"base": P.base_credibility(F.col("d"), F.col("source_type")), "near": P.proximity(F.col("hop_count")), "precise": P.precision(F.col("n"), F.col("temporal_kind"), F.expr("fact_id % 3 = 0"), official)})
    return f.withColumn("credibility", F.col("base") * F.col("near") * F.col("precise"))


_CRED = f"SELECT *, {_BASE} * pow(0.7, hop_count) * {_PREC} AS credibility FROM ({_SCORED})"


@query("i01_credibility", f"SELECT fact_id, round(credibility, 9) AS credibility FROM ({_CRED})")
def _(v):
    return scored(v).select("fact_id", F.round("credibility", 9).alias("credibility"))


@query("i02_proximity", "SELECT fact_id, round(pow(0.7, hop_count), 9) AS proximity FROM p_facts")
def _(v):
    return v.p_facts.select("fact_id", F.round(P.proximity(F.col("hop_count")), 9).alias("proximity"))


@query("i03_precision", f"SELECT fact_id, round({_PREC}, 9) AS score FROM ({_SCORED})")
def _(v):
    return scored(v).select("fact_id", F.round("precise", 9).alias("score"))


@query("i04_multi_source", "SELECT fact_id, max(authority_score) AS root, round(sum(authority_score) - max(authority_score), 6) AS echoes FROM p_evidence GROUP BY 1")
def _(v):
    return v.p_evidence.groupBy("fact_id").agg(F.max("authority_score").alias("root"), F.round(F.sum("authority_score") - F.max("authority_score"), 6).alias("echoes"))


@query("i05_echo", "WITH c AS (SELECT fact_id, source_domain, sum(authority_score) AS s FROM p_evidence GROUP BY 1, 2) SELECT fact_id, round(max(s), 6) AS root, round(0.2 * log10(1 + greatest(0.0, sum(s) - max(s))), 6) AS bonus FROM c GROUP BY 1")
def _(v):
    c = v.p_evidence.groupBy("fact_id", "source_domain").agg(F.sum("authority_score").alias("s"))
    return c.groupBy("fact_id").agg(F.round(F.max("s"), 6).alias("root"), F.round(P.echo(F.max("s"), F.sum("s")), 6).alias("bonus"))


@query("i06_circular", "SELECT fact_id, (count(DISTINCT source_domain) = 1 AND count(*) > 2) OR (count(*) FILTER (WHERE source_type = 'official_statement') = 0 AND count(*) > 3) AS circular FROM p_evidence GROUP BY 1")
def _(v):
    g = v.p_evidence.groupBy("fact_id").agg(F.count_distinct("source_domain").alias("d"), F.count("*").alias("n"), F.count_if(F.col("source_type") == "official_statement").alias("p"))
    return g.select("fact_id", (((F.col("d") == 1) & (F.col("n") > 2)) | ((F.col("p") == 0) & (F.col("n") > 3))).alias("circular"))


@query("i07_corroboration", "SELECT fact_id, CASE WHEN n <= 1 THEN 0.3::DOUBLE ELSE least(1.0, 0.3::DOUBLE + 0.175 * (n - 1)) * least(1.0, a + 0.2::DOUBLE) END AS strength FROM (SELECT fact_id, count(DISTINCT source_domain) AS n, max(authority_score) AS a FROM p_evidence GROUP BY 1)")
def _(v):
    g = v.p_evidence.groupBy("fact_id").agg(F.count_distinct("source_domain").alias("n"), F.max("authority_score").alias("a"))
    return g.select("fact_id", P.corroboration(F.col("n"), F.col("a")).alias("strength"))


_FLAGS = "list_filter([CASE WHEN hop_count > 2 AND source_classification <> 'primary' THEN 'phantom' END, CASE WHEN claim_clarity < 0.5 THEN 'fog' END, CASE WHEN fact_id % 7 = 0 THEN 'anomaly' END, CASE WHEN credibility < 0.15 THEN 'noise' END], lambda x: x IS NOT NULL)"


def doubted(v):
    f = scored(v)
    none = F.lit(False)
    return f.withColumn("flags", P.flags(F.col("hop_count"), F.col("source_classification") == "primary", F.col("claim_clarity"), none, F.expr("CASE WHEN fact_id % 7 = 0 THEN 1 ELSE 0 END"), F.col("credibility")))


@query("i08_dubious_gates", f"SELECT fact_id, array_to_string({_FLAGS}, ',') AS flags FROM ({_CRED})")
def _(v):
    return doubted(v).select("fact_id", F.array_join("flags", ",").alias("flags"))


@query("i09_has_primary", "SELECT fact_id, source_classification = 'primary' OR hop_count = 0 AS has_primary FROM p_facts")
def _(v):
    chain = F.array(F.struct(F.col("hop_count").alias("hop")))
    return v.p_facts.select("fact_id", ((F.col("source_classification") == "primary") | F.exists(chain, lambda h: h["hop"] == 0)).alias("has_primary"))


_FIX = "CASE WHEN len(dubious_flags) = 0 OR (len(dubious_flags) = 1 AND dubious_flags[1] = 'noise') THEN 0.0 ELSE least(1.0, CASE WHEN list_contains(dubious_flags, 'fog') THEN 0.9::DOUBLE WHEN list_contains(dubious_flags, 'phantom') THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END + credibility_score * 0.2::DOUBLE) END"


@query("i10_fixability", f"SELECT fact_id, {_FIX} AS fixability FROM p_class")
def _(v):
    return v.p_class.select("fact_id", P.fixability(F.col("dubious_flags"), F.col("credibility_score")).alias("fixability"))


@query("i11_priority", "SELECT fact_id, CASE WHEN impact_tier = 'critical' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN len(dubious_flags) = 0 OR (len(dubious_flags) = 1 AND dubious_flags[1] = 'noise') THEN 0.0::DOUBLE ELSE 0.3::DOUBLE + 0.7::DOUBLE * credibility_score END AS priority FROM p_class")
def _(v):
    return v.p_class.select("fact_id", P.priority(F.col("impact_tier"), F.col("dubious_flags"), F.col("credibility_score")).alias("priority"))


_EVENT = f"CASE WHEN {contains_any('lower(text)', C.MILITARY_EVENTS)} THEN 1.0::DOUBLE WHEN {contains_any('lower(text)', C.TREATY_EVENTS)} THEN 0.9::DOUBLE WHEN {contains_any('lower(text)', C.MAJOR_EVENTS)} THEN 0.6::DOUBLE WHEN {contains_any('lower(text)', C.MEETING_EVENTS)} THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END"
_ENTITY = f"CASE WHEN {contains_any('lower(text)', C.WORLD_LEADERS)} THEN 1.0::DOUBLE WHEN {contains_any('lower(text)', C.SENIOR_TITLES)} THEN 0.8::DOUBLE WHEN {contains_any('lower(text)', C.MAJOR_ORGANIZATIONS)} THEN 0.4::DOUBLE WHEN {contains_any('lower(text)', C.MILITARY_ENTITIES)} THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END"
_NAMED = "regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in C.CRITICAL_PATTERNS) + "')"


@query("i12_impact", f"SELECT id, round(0.5 * CASE WHEN {_NAMED} THEN greatest(0.8::DOUBLE, {_ENTITY}) ELSE {_ENTITY} END + 0.5 * {_EVENT}, 9) AS impact FROM {_VALUES}")
def _(v):
    who = P.entity_significance(F.col("text"), F.lit("PERSON"))
    return snippets(v).select("id", F.round(P.impact(who, F.col("text"), F.lit("event")), 9).alias("impact"))


@query("i13_context_boost", f"SELECT id, least(0.2::DOUBLE, CASE WHEN contains(lower(text), 'coup') OR contains(lower(text), 'summit') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'putin') THEN 0.1::DOUBLE ELSE 0 END) AS boost FROM {_VALUES}")
def _(v):
    low = F.lower("text")
    return snippets(v).select("id", F.least(F.lit(0.2), F.when(P.any_in(low, ("coup", "summit")), 0.1).otherwise(0.0) + F.when(P.any_in(low, ("putin",)), 0.1).otherwise(0.0)).alias("boost"))


def _arr(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("i14_negation", f"WITH w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM {_VALUES}), c AS (SELECT id, len(list_intersect(t, {_arr(C.NEGATION_WORDS)})) > 0 AS neg, list_filter(t, lambda x: NOT list_contains({_arr(C.NEGATION_WORDS + C.STOP_WORDS)}, x)) AS k FROM w) SELECT a.id AS a, b.id AS b, round(least(0.9, 0.5 + 0.1 * len(list_intersect(a.k, b.k))), 6) AS confidence FROM c a JOIN c b ON a.id < b.id AND a.neg <> b.neg AND len(list_intersect(a.k, b.k)) >= 1")
def _(v):
    from sieveworks.operators.contradictions import negations

    return negations(snippets(v).withColumnRenamed("text", "claim_text").withColumnRenamed("id", "fact_id"), least=1).select("a", "b", F.round("confidence", 6).alias("confidence"))


@query("i15_assertion", "WITH n AS (SELECT DISTINCT fact_id, lower(canonical) AS c FROM p_mentions) SELECT DISTINCT s.fact_id AS a, d.fact_id AS b, 0.8::DOUBLE AS confidence FROM p_facts s JOIN n x ON x.fact_id = s.fact_id JOIN n y ON y.c = x.c JOIN p_facts d ON d.fact_id = y.fact_id AND d.investigation_id = s.investigation_id WHERE s.assertion_type = 'statement' AND d.assertion_type = 'denial'")
def _(v):
    from sieveworks.operators.contradictions import assertions

    return assertions(v.p_facts, v.p_mentions)


@query("i16_numeric", "SELECT a.fact_id AS a, b.fact_id AS b, 0.8::DOUBLE AS confidence FROM p_facts a JOIN p_facts b ON a.investigation_id = b.investigation_id AND a.claim_text = b.claim_text AND a.fact_id < b.fact_id AND (a.high_value < b.low_value OR b.high_value < a.low_value)")
def _(v):
    from sieveworks.operators.contradictions import numeric

    return numeric(v.p_facts, ["investigation_id", "claim_text"])


@query("i17_temporal", "WITH n AS (SELECT DISTINCT fact_id, lower(canonical) AS c FROM p_mentions) SELECT DISTINCT a.fact_id AS a, b.fact_id AS b, 0.7::DOUBLE AS confidence FROM p_facts a JOIN n x ON x.fact_id = a.fact_id JOIN n y ON y.c = x.c JOIN p_facts b ON b.fact_id = y.fact_id AND b.investigation_id = a.investigation_id AND a.fact_id < b.fact_id WHERE a.temporal_kind = 'explicit' AND b.temporal_kind = 'explicit' AND a.temporal_precision = b.temporal_precision AND a.temporal_value <> b.temporal_value")
def _(v):
    from sieveworks.operators.contradictions import temporal

    return temporal(v.p_facts, v.p_mentions)


_BOOST = case(C.CONFIDENCE_BOOSTS, "source_type", "0.1::DOUBLE")


@query("i18_evidence_vote", f"WITH e AS (SELECT *, {_BOOST} AS boost FROM p_evidence), b AS (SELECT fact_id, bool_or(supports_claim AND authority_score >= 0.85) AS strong, count(DISTINCT source_domain) FILTER (WHERE supports_claim) AS domains, bool_or(NOT supports_claim AND relevance_score >= 0.7 AND authority_score >= 0.7) AS against FROM e GROUP BY 1) SELECT fact_id, CASE WHEN strong OR domains >= 2 THEN 'confirmed' WHEN against THEN 'refuted' ELSE 'pending' END AS status FROM b")
def _(v):
    e = v.p_evidence
    s = F.col("supports_claim")
    g = e.groupBy("fact_id").agg(F.bool_or(s & (F.col("authority_score") >= 0.85)).alias("strong"), F.count_distinct(F.when(s, F.col("source_domain"))).alias("domains"), F.bool_or(~s & (F.col("relevance_score") >= 0.7) & (F.col("authority_score") >= 0.7)).alias("against"))
    return g.select("fact_id", F.when(F.col("strong") | (F.col("domains") >= 2), "confirmed").when(F.col("against"), "refuted").otherwise("pending").alias("status"))


@query("i18_confidence_boost", f"SELECT fact_id, round(least(1.0, sum({_BOOST})), 6) AS boost FROM p_evidence WHERE supports_claim GROUP BY 1")
def _(v):
    return v.p_evidence.where("supports_claim").groupBy("fact_id").agg(F.round(F.least(F.lit(1.0), F.sum(P.table(C.CONFIDENCE_BOOSTS, F.col("source_type"), 0.1))), 6).alias("boost"))


@query("i19_finalise", "SELECT fact_id, CASE status WHEN 'pending' THEN 'unverifiable' ELSE status END AS status, least(1.0::DOUBLE, original_confidence + confidence_boost) AS final_confidence, coalesce(c.impact_tier = 'critical', false) AS review FROM p_ver LEFT JOIN p_class c USING (fact_id)")
def _(v):
    rows = v.p_ver.join(v.p_class.select("fact_id", "impact_tier"), "fact_id", "left")
    return rows.select("fact_id", F.when(F.col("status") == "pending", "unverifiable").otherwise(F.col("status")).alias("status"), F.least(F.lit(1.0), F.col("original_confidence") + F.col("confidence_boost")).alias("final_confidence"), F.coalesce(F.col("impact_tier") == "critical", F.lit(False)).alias("review"))


@query("i20_reclassify", "SELECT c.fact_id, 0::BIGINT AS n_flags, least(1.0::DOUBLE, c.credibility_score + r.confidence_boost) AS credibility, 1::BIGINT AS n_history FROM p_class c JOIN p_ver r USING (fact_id) WHERE r.status = 'confirmed'")
def _(v):
    rows = v.p_class.join(v.p_ver.where("status = 'confirmed'").select("fact_id", "confidence_boost"), "fact_id")
    rows = rows.withColumn("history", F.array_append(F.array().cast("array<struct<tier:string,flags:array<string>>>"), F.struct(F.col("impact_tier").alias("tier"), F.col("dubious_flags").alias("flags"))))
    return rows.select("fact_id", F.lit(0).cast("long").alias("n_flags"), F.least(F.lit(1.0), F.col("credibility_score") + F.col("confidence_boost")).alias("credibility"), F.size("history").cast("long").alias("n_history"))


@query("i21_anomaly_resolution", "SELECT src, dst, CASE WHEN weight > 0.5 THEN 'superseded' ELSE 'refuted' END AS loser FROM p_pairs WHERE type = 'CONTRADICTS'")
def _(v):
    return v.p_pairs.where("type = 'CONTRADICTS'").select("src", "dst", F.when(F.col("weight") > 0.5, "superseded").otherwise("refuted").alias("loser"))


@query("i22_task_priority", "SELECT task_id, round(greatest(0.0, least(1.0, 0.4 * least(1.0, priority / 500000) + 0.2 * 0.5 + 0.2 * (1 - retry_count * 0.25) + 0.2 * CASE WHEN row_number() OVER (PARTITION BY source_type ORDER BY task_id) = 1 THEN 1.0 ELSE 0.4 END)), 6) AS score FROM p_tasks")
def _(v):
    rows = R.first_time(v.p_tasks, "source_type", [F.col("task_id")])
    score = 0.4 * F.least(F.lit(1.0), F.col("priority") / 500000) + 0.2 * F.lit(0.5) + 0.2 * (1 - F.col("retry_count") * 0.25) + 0.2 * F.col("diversity")
    return rows.select("task_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


@query("i23_signal", "SELECT investigation_id, round(0.4 * least(count(*)::DOUBLE / 10, 1.0) + 0.6 * avg(coalesce(extraction_confidence, 0.5)), 6) AS signal FROM p_facts GROUP BY 1")
def _(v):
    return v.p_facts.groupBy("investigation_id").agg(F.round(0.4 * F.least(F.count("*").cast("double") / 10, F.lit(1.0)) + 0.6 * F.avg(F.coalesce("extraction_confidence", F.lit(0.5))), 6).alias("signal"))


@query("i24_routing", "SELECT investigation_id, CASE WHEN n >= 200 AND s >= 30 THEN 'synthesize' WHEN n >= 100 THEN 'refine' ELSE 'collect' END AS route FROM (SELECT investigation_id, count(*) AS n, count(DISTINCT source_id) AS s FROM p_facts GROUP BY 1)")
def _(v):
    g = v.p_facts.groupBy("investigation_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("s"))
    return g.select("investigation_id", F.when((F.col("n") >= 200) & (F.col("s") >= 30), "synthesize").when(F.col("n") >= 100, "refine").otherwise("collect").alias("route"))


@query("i25_classify", f"SELECT fact_id, array_to_string({_FLAGS}, ',') AS flags, round(credibility, 9) AS credibility, CASE WHEN 0.5 * 0.4 + 0.5 * {case(C.CLAIM_TYPE_SCORES, 'claim_type', '0.3::DOUBLE')} >= 0.6 THEN 'critical' ELSE 'less_critical' END AS tier FROM ({_CRED})")
def _(v):
    rows = doubted(v)
    impact = 0.5 * F.lit(0.4) + 0.5 * P.table(C.CLAIM_TYPE_SCORES, F.col("claim_type"), 0.3)
    return rows.select("fact_id", F.array_join("flags", ",").alias("flags"), F.round("credibility", 9).alias("credibility"), F.when(impact >= 0.6, "critical").otherwise("less_critical").alias("tier"))


@query("i26_echo_total", "SELECT fact_id, round(max(authority_score) + 0.2 * log10(1 + sum(authority_score)), 6) AS total FROM p_evidence GROUP BY 1")
def _(v):
    return v.p_evidence.groupBy("fact_id").agg(F.round(F.max("authority_score") + C.ECHO_ALPHA * F.log10(1 + F.sum("authority_score")), 6).alias("total"))


@query("i27_audit_trail", "SELECT c.fact_id, c.impact_tier AS old_tier, CASE WHEN r.status = 'confirmed' THEN 'critical' ELSE c.impact_tier END AS impact_tier, CASE WHEN r.status = 'confirmed' AND c.impact_tier <> 'critical' THEN 1 ELSE 0 END AS n_history FROM p_class c LEFT JOIN p_ver r USING (fact_id)")
def _(v):
    rows = v.p_class.join(v.p_ver.select("fact_id", "status"), "fact_id", "left")
    new = F.when(F.col("status") == "confirmed", F.lit("critical")).otherwise(F.col("impact_tier"))
    # what changes is kept with the reason for it
    history = F.filter(F.array(F.struct(F.col("impact_tier").alias("old"), new.alias("new"), F.col("status").alias("reason"))), lambda x: x["old"] != x["new"])
    return rows.withColumn("history", history).select("fact_id", F.col("impact_tier").alias("old_tier"), new.alias("impact_tier"), F.size("history").alias("n_history"))


@query("i28_single_classify", f"SELECT fact_id, round(credibility, 9) AS credibility FROM ({_CRED}) WHERE fact_id = 39")
def _(v):
    return scored(v).where("fact_id = 39").select("fact_id", F.round("credibility", 9).alias("credibility"))


@query("i29_gaps", "SELECT investigation_id, array_to_string(list_filter([CASE WHEN s < 30 THEN 'few sources' END, CASE WHEN a < 0.6 THEN 'low confidence' END, CASE WHEN n < 5 THEN 'few findings' END], lambda x: x IS NOT NULL)[1:2], '; ') AS gaps FROM (SELECT investigation_id, count(*) AS n, count(DISTINCT source_id) AS s, avg(extraction_confidence) AS a FROM p_facts GROUP BY 1)")
def _(v):
    g = v.p_facts.groupBy("investigation_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("s"), F.avg("extraction_confidence").alias("a"))
    gaps = F.array_compact(F.array(F.when(F.col("s") < 30, F.lit("few sources")), F.when(F.col("a") < 0.6, F.lit("low confidence")), F.when(F.col("n") < 5, F.lit("few findings"))))
    return g.select("investigation_id", F.array_join(F.slice(gaps, 1, 2), "; ").alias("gaps"))


@query("c09_contradictions", "SELECT a.fact_id AS a, b.fact_id AS b, 'numeric' AS kind FROM p_facts a JOIN p_facts b ON a.investigation_id = b.investigation_id AND a.claim_text = b.claim_text AND a.fact_id < b.fact_id AND (a.high_value < b.low_value OR b.high_value < a.low_value)")
def _(v):
    from sieveworks.operators.contradictions import numeric

    return numeric(v.p_facts, ["investigation_id", "claim_text"]).select("a", "b", F.lit("numeric").alias("kind"))


@query("c09_contradictions_all", None)
def _(v):
    from sieveworks.operators.contradictions import contradictions

    return contradictions(v.p_facts, v.p_mentions)


@query("i16_numeric_all", None)
def _(v):
    from sieveworks.operators.contradictions import values

    return values(v.p_facts, v.p_mentions)


@query("c18_authority_lookup", f"SELECT fact_id, {_BASE} AS authority FROM ({_SCORED})")
def _(v):
    return scored(v).select("fact_id", F.col("base").alias("authority"))


@query("g11_keywords", f"SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(map_entries(m), lambda e: {{'p': e.value, 'w': e.key}}))[1:10], lambda e: e.w), ',') AS words FROM (SELECT doc_id, map_from_entries(list_transform(list_distinct(w), lambda x: {{'k': x, 'v': list_position(w, x)}})) AS m FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 3 AND NOT list_contains({_arr(C.STOP_WORDS)}, x)) AS w FROM documents))")
def _(v):
    # distinct words in order of their first place, ten at most
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*C.STOP_WORDS)))
    return v.table("documents").select("doc_id", F.array_join(F.slice(w, 1, 10), ",").alias("words"))


