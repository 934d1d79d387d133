"""Property graph as two DataFrames: vertices (id, label, props) and edges (src, dst, type, weight)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.scores import edge_weight
from sieveworks.operators.lineage import cut

#: Labels and edge types that the graph accepts.
LABELS = ("Fact", "Entity", "Source", "Investigation", "Classification")
TYPES = ("MENTIONS", "SOURCED_FROM", "PART_OF", "VERIFIED_BY", "CORROBORATES", "CONTRADICTS", "SUPERSEDES", "RELATED_TO", "LOCATED_AT", "ATTRIBUTED_TO", "CAUSES", "PRECEDES", "MEMBER_OF")


def label_of(column: str):
    return F.split(column, ":", 2)[0]


def merged_vertices(rows: DataFrame) -> DataFrame:
    """One vertex per id; of each property the last value that is not null (rows: id, ord, props map)."""
    props = rows.select("id", "ord", F.explode_outer("props").alias("k", "v"))
    last = props.where("v IS NOT NULL").groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    held = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))
    return rows.select("id").distinct().join(held, "id", "left").withColumn("label", label_of("id"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge per ends and type: the last one."""
    return edges.groupBy("src", "dst", "type").agg(F.max_by("weight", "ord").alias("weight"))


def with_endpoints(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of vertices and of ends of edges that have none yet."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices.select("id").union(ends.join(vertices, "id", "left_anti")).withColumn("label", label_of("id"))


def without_vertex(vertices: DataFrame, edges: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    return vertices.where(F.col("id") != id_), edges.where((F.col("src") != id_) & (F.col("dst") != id_))


def accepted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of known labels and types, and the rejected rest."""
    good = label_of("src").isin(*LABELS) & label_of("dst").isin(*LABELS) & F.col("type").isin(*TYPES)
    return edges.where(good), edges.where(~good)


def mapped(facts: DataFrame, mentions: DataFrame, ver: DataFrame | None = None) -> DataFrame:
    """Edges of facts: what they mention, where they come from, whom they belong to and, with ver, where they were verified."""
    fact = F.concat(F.lit("Fact:"), F.col("fact_id").cast("string"))
    part = lambda rows, to, kind, weight: rows.select(fact.alias("src"), to.alias("dst"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))
    names = mentions.select("fact_id", "investigation_id", "canonical").distinct()
    tenant = F.concat(F.lit("Investigation:"), F.col("investigation_id").cast("string"))
    out = (
        part(names, F.concat(F.lit("Entity:"), F.col("investigation_id").cast("string"), F.lit(":"), "canonical"), "MENTIONS", 1.0)
        .union(part(facts.where("source_id <> ''"), F.concat(F.lit("Source:"), "source_id"), "SOURCED_FROM", 0.8))
        .union(part(facts, tenant, "PART_OF", 1.0))
    )
    return out if ver is None else out.union(part(facts.join(ver.select("fact_id"), "fact_id", "left_semi"), tenant, "VERIFIED_BY", 0.9))


def semantic(facts: DataFrame, ver: DataFrame, evidence: DataFrame, mentions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges that follow from checks, stated relationships and names in one fact; all joins are on keys.

    A confirmed fact with two or more supporting items corroborates every fact of its tenant
    with the same hash or text; a refuted one contradicts its related fact, a superseded one
    whose contradiction is temporal supersedes it. relationships: fact_id, target_fact_id,
    type, confidence. People and organisations are located at the places of their fact.
    """
    node = lambda c: F.concat(F.lit("Fact:"), F.col(c).cast("string"))
    edge = lambda rows, src, dst, kind, weight: rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), weight.alias("weight"))
    given = evidence.groupBy("fact_id", "supports_claim").agg(F.count("*").alias("items"), F.avg("authority_score").alias("authority"))
    strength = edge_weight(F.col("items"), F.col("authority"), F.lit(0))
    sure = ver.where("status = 'confirmed'").select("fact_id").join(given.where("supports_claim AND items >= 2"), "fact_id").select("fact_id", strength.alias("weight"))
    keyed = facts.select("fact_id", "investigation_id", F.explode(F.array(F.concat(F.lit("h"), "content_hash"), F.concat(F.lit("t"), "claim_text"))).alias("key"))
    others = keyed.select(F.col("fact_id").alias("other"), "investigation_id", "key")
    same = keyed.join(sure, "fact_id").join(others, ["investigation_id", "key"]).where("fact_id <> other").select("fact_id", "other", "weight").distinct()
    against = ver.where("status = 'refuted' AND related_fact_id IS NOT NULL").join(given.where("NOT supports_claim"), "fact_id")
    newer = ver.where("status = 'superseded' AND contradiction_type = 'temporal' AND related_fact_id IS NOT NULL")
    said = lambda *kinds: relationships.where(F.col("type").isin(*kinds))
    names = mentions.select("fact_id", "investigation_id", "entity_type", F.coalesce(F.nullif(F.col("canonical"), F.lit("")), "name").alias("shown")).distinct()
    entity = F.concat(F.lit("Entity:"), F.col("investigation_id").cast("string"), F.lit(":"), "shown")
    actors = names.where("entity_type IN ('PERSON', 'ORGANIZATION')").select("fact_id", entity.alias("src")).distinct()
    places = names.where("entity_type = 'LOCATION'").select("fact_id", entity.alias("dst")).distinct()
    met = actors.join(places, "fact_id").join(facts.select("fact_id", "claim_type"), "fact_id")
    return (
        edge(same, node("fact_id"), node("other"), "CORROBORATES", F.col("weight"))
        .union(edge(against, node("fact_id"), node("related_fact_id"), "CONTRADICTS", strength))
        .union(edge(said("contradicts"), node("fact_id"), node("target_fact_id"), "CONTRADICTS", F.col("confidence")))
        .union(edge(newer, node("fact_id"), node("related_fact_id"), "SUPERSEDES", F.lit(0.9)))
        .union(edge(said("supports", "elaborates"), node("fact_id"), node("target_fact_id"), "RELATED_TO", F.col("confidence")))
        .union(edge(met, F.col("src"), F.col("dst"), "LOCATED_AT", F.when(F.col("claim_type") == "state", 0.8).otherwise(0.7)))
    )


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def neighbourhood(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(id, hop) of all vertices within 1..10 hops of start, by frontier joins."""
    both = cut(undirected(edges))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hop int")
    frontier = seen
    for hop in range(1, max(1, min(hops, 10)) + 1):
        new = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def network(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """Edges whose ends are both within reach, except those between two vertices of the last ring."""
    near = cut(neighbourhood(edges, start, hops))
    a, b = near.select(F.col("id").alias("src"), F.col("hop").alias("hop_src")), near.select(F.col("id").alias("dst"), F.col("hop").alias("hop_dst"))
    inside = edges.join(a, "src").join(b, "dst").where((F.col("hop_src") < hops) | (F.col("hop_dst") < hops))
    return inside.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 10) -> DataFrame:
    """(length, path) of the shortest undirected path, the first by its ids among equals; no row without one, length 0 for one vertex.

    Both ends are searched in turns. A vertex carries the first of the shortest paths to it,
    at most `most` + 1 ids, so that no step looks back.
    """
    spark, schema = edges.sparkSession, "length int, path array<string>"
    if start == goal:
        return spark.createDataFrame([(0, [start])], schema)
    both = cut(undirected(edges))
    fronts = [spark.createDataFrame([(x, [x])], "id string, path array<string>") for x in (start, goal)]
    seen = [f.select("id") for f in fronts]
    for length in range(1, most + 1):
        k = 0 if length % 2 else 1  # the two ends take turns
        grown = F.concat("path", F.array("dst")) if k == 0 else F.concat(F.array("dst"), "path")
        new = both.join(fronts[k].withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(grown).alias("path"))
        fronts[k] = cut(new.join(seen[k], "id", "left_anti"))
        if fronts[k].isEmpty():
            break
        seen[k] = seen[k].union(fronts[k].select("id"))
        met = fronts[0].join(fronts[1].withColumnRenamed("path", "rest"), "id").select(F.concat("path", F.expr("slice(rest, 2, size(rest))")).alias("path"))
        found = met.agg(F.min("path").alias("path")).where("path IS NOT NULL")
        if not found.isEmpty():
            return found.select(F.lit(length).alias("length"), "path")
    return spark.createDataFrame([], schema)


def path_length(edges: DataFrame, start: str, goal: str, most: int = 10) -> DataFrame:
    """(length) of the shortest undirected path."""
    return shortest_path(edges, start, goal, most).select("length")


def tenant_clusters(edges: DataFrame) -> DataFrame:
    """Corroborating and contradicting edges (investigation_id, src, dst, weight) with the component that they form in their tenant."""
    mine = edges.where("type IN ('CORROBORATES', 'CONTRADICTS')")
    tag = lambda c: F.concat(F.col("investigation_id").cast("string"), F.lit("|"), c)
    found = clusters(mine.select(tag("src").alias("src"), tag("dst").alias("dst"))).select(F.split("id", "\\|", 2)[0].alias("_t"), F.split("id", "\\|", 2)[1].alias("src"), F.split("component", "\\|", 2)[1].alias("component"))
    return mine.withColumn("_t", F.col("investigation_id").cast("string")).join(found, ["_t", "src"]).select("investigation_id", "src", "dst", "type", "weight", "component")


def clusters(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable; labels spread to neighbours and jump over what they point to."""
    both = cut(undirected(edges))
    labels = cut(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("component", "m").alias("component"))
        jump = step.alias("s").join(step.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left")
        new = cut(jump.select("id", F.least("component", "further").alias("component")))
        if new.join(labels, ["id", "component"], "left_anti").isEmpty():
            return new
        labels = new


def timeline(edges: DataFrame, facts: DataFrame, entity: str) -> DataFrame:
    ids = edges.where((F.col("type") == "MENTIONS") & (F.col("dst") == entity)).select(F.split("src", ":", 2)[1].cast("long").alias("fact_id")).distinct()
    return facts.join(ids, "fact_id", "left_semi").where("temporal_value IS NOT NULL").orderBy("temporal_value", "fact_id")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank); what ends in sinks is spread over all vertices."""
    links = cut(edges.select("src", "dst").distinct())
    out = links.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = cut(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(out.withColumnRenamed("src", "id"), "id", "left"))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        sunk = ranks.where("degree IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = links.join(ranks.select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        ranks = cut(nodes.join(got, "id", "left").withColumn("rank", (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + sunk / n)).drop("got"))
    return ranks.select("id", "rank")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by label propagation: the most frequent label around, the smallest among equals."""
    both = cut(undirected(edges))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy(F.col("src").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
    return labels


#: Pivots whose searches run in one task over the edges of their component; small components share a task up to as many vertices, BATCH times.
PIVOTS = 256
BATCH = 64


def _depended(rows: pd.DataFrame) -> pd.DataFrame:
    """Brandes from the pivots of one group over the edges of their components; rows: src, dst, and pivots as src without a dst."""
    links: dict[str, list[str]] = {}
    pivots = rows["src"][rows["dst"].isna()].tolist()
    for src, dst in rows[["src", "dst"]].dropna().itertuples(index=False):
        links.setdefault(src, []).append(dst)
    score: dict[str, float] = {}
    for pivot in pivots:
        order, level, paths, before = [pivot], {pivot: 0}, {pivot: 1.0}, {}
        for at in order:
            for to in links.get(at, ()):
                if to not in level:
                    level[to], paths[to], before[to] = level[at] + 1, 0.0, []
                    order.append(to)
                if level[to] == level[at] + 1:
                    paths[to] += paths[at]
                    before[to].append(at)
        depend = dict.fromkeys(order, 0.0)
        for at in reversed(order[1:]):
            for up in before[at]:
                depend[up] += paths[up] / paths[at] * (1 + depend[at])
            score[at] = score.get(at, 0.0) + depend[at]
    return pd.DataFrame({"id": list(score), "d": list(score.values())}, columns=["id", "d"])


def betweenness_of_all(edges: DataFrame) -> DataFrame:
    """(id, score) of every vertex: directed shortest paths between all others through it, divided by (n - 1)(n - 2).

    Every vertex is a pivot; blocks of about PIVOTS of one component are searched in one task each.
    Components of PIVOTS vertices or fewer are searched many to a group: a search never leaves its own.
    """
    links = cut(edges.select("src", "dst").where("src <> dst").distinct())
    vertices = cut(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    placed = cut(vertices.join(clusters(links), "id"))
    n = vertices.count()
    bins = max(1, -(-n // (PIVOTS * BATCH)))
    blocks = placed.groupBy("component").agg(F.ceil(F.count("*") / PIVOTS).alias("blocks"))
    small = F.col("blocks") == 1
    group = F.when(small, F.pmod(F.xxhash64("component"), F.lit(bins)).cast("string")).otherwise(F.concat(F.lit("="), "component")).alias("group")
    pivots = placed.join(blocks, "component").select(group, F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"))
    inside = links.join(placed.withColumnRenamed("id", "src"), "src").join(blocks, "component")
    inside = inside.select(group, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "src", "dst")
    sums = pivots.union(inside).groupBy("group", "block").applyInPandas(_depended, "id string, d double").groupBy("id").agg(F.sum("d").alias("d"))
    return vertices.join(sums, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) / max(1, (n - 1) * (n - 2))).alias("score"))


def betweenness(edges: DataFrame, pivots: list[str], most: int = 6) -> DataFrame:
    """(id, score): share of shortest paths from the pivots through each vertex, by levels of joins."""
    both = cut(undirected(edges))
    spark = edges.sparkSession
    front = spark.createDataFrame([(p, p, 1.0, 0) for p in pivots], "pivot string, id string, paths double, level int")
    seen, levels = front, [front]
    for level in range(1, most + 1):
        new = both.join(front.select("pivot", F.col("id").alias("src"), "paths"), "src").groupBy("pivot", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = cut(new.join(seen, ["pivot", "id"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.union(front)
    depend = levels[-1].select("pivot", "id", "paths", F.lit(0.0).alias("d"))
    total = depend
    for upper in reversed(levels[:-1]):
        back = both.join(depend.select("pivot", F.col("id").alias("dst"), F.col("paths").alias("below"), "d"), "dst")
        back = back.join(upper.select("pivot", F.col("id").alias("src"), "paths"), ["pivot", "src"]).groupBy("pivot", F.col("src").alias("id")).agg(F.sum(F.col("paths") / F.col("below") * (1 + F.col("d"))).alias("d"))
        depend = cut(upper.join(back, ["pivot", "id"], "left").select("pivot", "id", "paths", F.coalesce("d", F.lit(0.0)).alias("d")))
        total = total.union(depend)
    return total.where("id <> pivot").groupBy("id").agg(F.sum("d").alias("score"))


def run(name: str, edges: DataFrame, facts: DataFrame | None = None, **options) -> DataFrame:
    """A graph query by name."""
    known = {"entity_network": network, "corroboration_clusters": clusters, "corroboration": clusters, "shortest_path": shortest_path, "pagerank": pagerank, "communities": communities}
    if name == "timeline":
        return timeline(edges, facts, **options)
    if name not in known:
        raise ValueError(f"unknown graph query {name}; known: {', '.join(sorted([*known, 'timeline']))}")
    return known[name](edges, **options)


