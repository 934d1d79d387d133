"""Queries of the remaining sources, sinks and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.operators import lineage
from sieveworks.plans.proxies import query
from sieveworks.sources import exports
from sieveworks.streaming import limits


@query("a14_extraction_chain", "SELECT page_id, CASE WHEN length(regexp_extract(html, '<article>([^<]*)', 1)) >= 500 THEN 'article' WHEN length(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ')) >= 500 THEN 'stripped' ELSE 'none' END AS used FROM pages")
def _(v):
    first = F.regexp_extract("html", "<article>([^<]*)", 1)
    return v.table("pages").select("page_id", F.when(F.length(first) >= 500, "article").when(F.length(T.untagged(F.col("html"))) >= 500, "stripped").otherwise("none").alias("used"))


@query("a15_post_filter", "SELECT conv_id, count(*) AS comments FROM conversations WHERE role IS NOT NULL GROUP BY conv_id HAVING count(*) >= 5 AND sum(length(text)) >= 100")
def _(v):
    g = v.table("conversations").where("role IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("comments"), F.sum(F.length("text")).alias("score"))
    return g.where("comments >= 5 AND score >= 100").select("conv_id", "comments")


@query("a19_archive", "SELECT 'fact' AS kind, count(*) AS n FROM p_facts WHERE investigation_id = 3 UNION ALL SELECT 'classification', count(*) FROM p_class WHERE investigation_id = 3 UNION ALL SELECT 'verification', count(*) FROM p_ver WHERE investigation_id = 3")
def _(v):
    import uuid

    path = f"{lineage.folder(v.spark)}/archive-{uuid.uuid4().hex}"
    exports.write_archive(v.p_facts, v.p_class, v.p_ver, path, 3)
    return exports.read_archive(v.spark, path).groupBy("kind").agg(F.count("*").alias("n"))


@query("a20_archive_rows", "SELECT fact_id, claim_text FROM p_facts WHERE investigation_id = 4")
def _(v):
    import uuid

    path = f"{lineage.folder(v.spark)}/archive-{uuid.uuid4().hex}"
    exports.write_archive(v.p_facts, v.p_class, v.p_ver, path, 4)
    rows = exports.read_archive(v.spark, path).where("kind = 'fact'")
    return rows.select(F.from_json("row", "fact_id long, claim_text string").alias("r")).select("r.*")


@query("a22_report_lines", "SELECT investigation_id, '# Investigation ' || investigation_id || chr(10) || count(*) || ' facts' AS markdown FROM p_facts GROUP BY investigation_id")
def _(v):
    g = v.p_facts.groupBy("investigation_id").agg(F.count("*").alias("n"))
    return g.select("investigation_id", F.concat(F.lit("# Investigation "), F.col("investigation_id"), F.lit("\n"), F.col("n"), F.lit(" facts")).alias("markdown"))


@query("a29_batch_results", "SELECT page_id, length(html) >= 1000 AS success FROM pages")
def _(v):
    pages = v.table("pages")
    done = pages.where(F.length("html") >= 1000).select("page_id", F.lit(True).alias("success"))
    return pages.select("page_id").join(done, "page_id", "left").fillna({"success": False})


@query("a30_documents", "SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' ELSE 'web' END AS branch FROM pages WHERE length(html) >= 500")
def _(v):
    branch = F.when(F.endswith(F.lower("url"), F.lit(".pdf")), "pdf").otherwise("web")
    return v.table("pages").where(F.length("html") >= 500).select("page_id", branch.alias("branch"))


@query("h35_table_rows", "SELECT '<tr><td>' || fact_id || '</td><td>' || claim_text || '</td></tr>' AS line FROM p_facts ORDER BY ord LIMIT 50")
def _(v):
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    return v.p_facts.orderBy("ord").limit(50).select(F.concat(F.lit("<tr>"), cell("fact_id"), cell("claim_text"), F.lit("</tr>")).alias("line"))


@query("l13_regenerate", "SELECT task_id, status = 'completed' AS allowed FROM p_tasks")
def _(v):
    return v.p_tasks.select("task_id", (F.col("status") == "completed").alias("allowed"))


@query("m05_topic_routing", "SELECT subscriber, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k LIKE 'events.%' THEN 'all' END, CASE WHEN k = 'events.error' THEN 'alerts' END], lambda x: x IS NOT NULL)) AS subscriber FROM (SELECT 'events.' || event_type AS k FROM events)) GROUP BY 1")
def _(v):
    messages = v.table("events").select(F.concat(F.lit("events."), "event_type").alias("key"))
    return limits.routed(messages, {"all": "events.*", "alerts": "events.error"}).groupBy("subscriber").agg(F.count("*").alias("n"))


@query("m06_stage_trigger", "SELECT investigation_id FROM p_class GROUP BY 1 HAVING count(*) FILTER (WHERE len(dubious_flags) > 0) > 0")
def _(v):
    return v.p_class.groupBy("investigation_id").agg(F.count_if(F.size("dubious_flags") > 0).alias("n")).where("n > 0").select("investigation_id")


@query("m08_token_bucket", None)
def _(v):
    requests = v.p_events.select(F.col("investigation_id").cast("string").alias("client"), (F.col("ts_us") / 1e6).alias("at"), F.lit(1.0).alias("cost"))
    return limits.admitted(requests, "client", 1 / 3600, 5)


@query("n09_round_robin", "SELECT task_id, (row_number() OVER (PARTITION BY source_type ORDER BY task_id) - 1) % 4 AS worker FROM p_tasks")
def _(v):
    from pyspark.sql import Window as W

    return v.p_tasks.select("task_id", F.pmod(F.row_number().over(W.partitionBy("source_type").orderBy("task_id")) - 1, F.lit(4)).alias("worker"))
