"""The queries of this subpackage; each reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import decontaminate, fuzzylines, licenses, minhash, mixing, quality, scratch, secrets, sharding, suffixes, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_spans")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.expr(f"bigint(size(filter(_spans, s -> s.kind = '{kind}')))").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(written(F.filter("_spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_read(spark, sf_dir, "documents"), f"{scratch.folder(spark)}/shards-{uuid.uuid4().hex}")
    return rows.select("doc_id", "shard", "shard_rows", "shard_bytes", "version")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")), "score")
    held_out = F.coalesce(toxicity.fold("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = mixing.thin_rows(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.decided(thin, mixing.plans(thin)).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, _read(spark, sf_dir, "labels"))
    found = quality.measured(docs).select("doc_id", "_counts", quality.base_failed().alias("base_failed"), quality.expression(rules).alias("rule"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *(F.col(f"_counts.{n}").alias(n) for n in names), "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, _read(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", F.col("_found.n_words").alias("n_words"), decontaminate.n_hit(F.col("_found")).alias("n_hit"), F.array_sort(F.col("_found.items").cast("array<string>")).alias("items"))
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), bad.alias("contaminated"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzylines.repeated_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_spans(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_licenses")
    written = F.transform("_licenses", lambda s: F.concat_ws(":", s["license"], s["start"], s["stop"], F.round(100 * s["coverage"]).cast("int")))
    return found.select("doc_id", F.size("_licenses").cast("long").alias("n_licenses"), F.array_join(written, ",").alias("licenses"))


#: Words between blanks after folding A-Z, empty ones dropped.
_WORDS = """list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""

OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT m.a, m.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) m JOIN sizes p ON p.doc_id = m.a JOIN sizes q ON q.doc_id = m.b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

_TOKENS = """regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"""

OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM sources
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (SELECT *, NOT (cap::DOUBLE / weight < level) AS free FROM levels),
aims AS (
  SELECT source, source_size, CASE WHEN free THEN least((SELECT arg_min(level, cap::DOUBLE / weight) FROM marked WHERE free) * weight, cap::DOUBLE) ELSE cap::DOUBLE END AS target FROM marked
), ratios AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS ratio FROM aims),
rests AS (SELECT *, floor(ratio) AS whole, greatest(0.0, target - floor(ratio) * source_size) AS words FROM ratios),
propensities AS (SELECT *, (CASE WHEN size < 50 THEN 0.5 ELSE 1.0 END)::DOUBLE AS p FROM docs),
-- two propensities: once the larger chance stops at 1, the other takes all that is left
firsts AS (SELECT r.source, r.words / nullif(sum(d.p * d.size), 0) AS c, max(d.p) AS most FROM rests r JOIN propensities d ON r.source IS NOT DISTINCT FROM d.source GROUP BY r.source, r.words),
scales AS (
  SELECT r.source, coalesce(CASE WHEN f.c * f.most >= 1 THEN greatest(f.c, coalesce((r.words - sum(CASE WHEN f.c * d.p >= 1 THEN d.size ELSE 0 END)) / nullif(sum(CASE WHEN f.c * d.p >= 1 THEN 0 ELSE d.p * d.size END), 0), f.c)) ELSE f.c END, 0) AS c
  FROM rests r JOIN firsts f ON r.source IS NOT DISTINCT FROM f.source JOIN propensities d ON r.source IS NOT DISTINCT FROM d.source GROUP BY r.source, r.words, f.c, f.most
), chances AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.words, least(1.0::DOUBLE, s.c * d.p) AS pi
  FROM propensities d JOIN rests p ON d.source IS NOT DISTINCT FROM p.source JOIN scales s ON d.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, CASE WHEN pi >= 1 THEN 0.0::DOUBLE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS rnk FROM chances
), summed AS (
  SELECT *, rnk IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= words AS chosen FROM ranked
), gaps AS (SELECT source, first(words) - coalesce(sum(size) FILTER (WHERE chosen), 0) AS gap FROM summed WHERE rnk IS NOT NULL GROUP BY source),
fills AS (
  SELECT s.source, arg_max(s.doc_id, {'a': s.size, 'b': -s.rnk, 'c': -s.doc_id}) AS fill
  FROM summed s JOIN gaps g ON s.source IS NOT DISTINCT FROM g.source WHERE s.rnk IS NOT NULL AND NOT s.chosen AND s.size > 0 AND s.size <= g.gap GROUP BY s.source
)
SELECT s.doc_id, s.size, s.source_size, s.target, (s.size * (s.whole + (s.chosen OR coalesce(s.doc_id = f.fill, false))::INT))::BIGINT AS taken
FROM summed s LEFT JOIN fills f ON s.source IS NOT DISTINCT FROM f.source
"""

OP7_SQL = f"""
WITH docs AS (SELECT doc_id, {_TOKENS.format(text="coalesce(text, '')")} AS w FROM documents),
items AS (SELECT item_id, {_TOKENS.format(text="coalesce(text, '')")} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0) t, unnest(range(1, len(w) - n + 2)) u(i)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM docs, lengths, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n
), hits AS MATERIALIZED (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) u(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op2_secrets": op2_secrets, "op3_sharding": op3_sharding, "op4_toxicity": op4_toxicity, "op5_mixing": op5_mixing, "op6_quality_rules": op6_quality_rules, "op7_decontaminate": op7_decontaminate, "op8_suffix_dedup": op8_suffix_dedup, "op9_fuzzy_lines": op9_fuzzy_lines, "op10_licenses": op10_licenses}
SQL: dict[str, str] = {"op1_minhash_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op7_decontaminate": OP7_SQL}
