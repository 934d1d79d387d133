"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. The whole part of target / size is taken as
certain copies of all its documents; for the rest, documents are ranked by random odds
divided by the odds of their inclusion, and the first of them that fit the remaining
words get one more copy. A last document of the size nearest below the gap fills it.
Inclusion is proportional to a propensity (short documents have a smaller one) and is
calibrated, so that the expected words are those asked for where chances stop at 1.
Rows of one id are ranked side by side and told apart by their text and their place.

Ranks are never sorted over a source: rows are counted into slices of the rank, the
slice where the words run out is found on the sums, and only that slice is ordered. The
decision is a few numbers per source, so texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.llm import scratch

#: Fixed by the mix: weights of the sources in turn, words asked for, copies at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Documents of fewer words are half as likely to get one more copy.
SHORT, SHORT_PROPENSITY = 50, 0.5
#: Rows in a slice of the rank, on average.
SLICE = 2048
#: Sources whose numbers are sent to every executor at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def chance(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (key, source, source_size) with target: sources by code point, null last.

    Sources stop at most times their size; those that do are the first by size for their
    weight, so one pass in that order finds the level of all others.
    """
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    asked = F.lit(share) * F.sum("source_size").over(everything)
    level = (asked - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("free", ~(F.col("cap") / F.col("weight") < F.col("level")))
    s = s.withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(everything))
    return s.select("key", "source", "source_size", F.when(F.col("free"), F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double")).alias("target"))


def usual_propensity() -> Column:
    return F.when(F.col("_size") < SHORT, F.lit(SHORT_PROPENSITY)).otherwise(F.lit(1.0))


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "_key", "left")


def _ranked(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """rows with the plan of their source, inclusion probability, rank and slice of the rank; certain ones are in slice -1."""
    u = chance(F.col("_id"), seed)
    pi = F.least(F.lit(1.0), F.col("_scale") * F.col("_propensity"))
    odds = F.when(pi >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (pi / (1 - pi)))
    out = _beside(rows, plan).withColumn("_rank", F.when(pi > 0, odds))
    return out.withColumn("_slice", F.when(F.col("_rank") == 0, -1).otherwise(F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * F.col("_slices")), F.col("_slices") - 1)))


def _prepared(docs: DataFrame, propensity: Column | None) -> DataFrame:
    sized = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_key": _key(F.col("source")), "_size": words(), "_tie": F.xxhash64(F.col("text").cast("string"))})
    return sized.withColumn("_propensity", (usual_propensity() if propensity is None else propensity).cast("double"))


def _scaled(thin: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with _scale, by which propensities become chances: those above 1 are cut there and the others raised until nothing changes."""
    sums = thin.groupBy("_key").agg(F.sum(F.col("_propensity") * F.col("_size")).alias("s"), F.max("_propensity").alias("most"))
    plan = scratch.table(plan.join(sums, "_key").withColumn("_scale", F.coalesce(F.try_divide("_words", "s"), F.lit(0.0))).drop("s"))
    while plan.where(F.col("_scale") * F.col("most") >= 1).limit(1).count():
        over = F.col("_scale") * F.col("_propensity") >= 1
        sums = _beside(thin.select("_key", "_size", "_propensity"), plan).groupBy("_key").agg(F.sum(F.when(over, F.col("_size")).otherwise(0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("_propensity") * F.col("_size"))).alias("s"))
        new = scratch.table(plan.join(sums, "_key").withColumn("_new", F.greatest(F.col("_scale"), F.coalesce(F.try_divide(F.col("_words") - F.col("full"), "s"), F.col("_scale")))).drop("full", "s"))
        done = not new.where("_new > _scale").limit(1).count()
        plan = new.drop("_scale").withColumnRenamed("_new", "_scale")
        if done:
            break
    return plan.drop("most")


def _at() -> Column:
    return F.struct(F.col("_rank").alias("rank"), F.coalesce("_id", F.lit(-(2**63))).alias("id"), F.coalesce("_tie", F.lit(0)).alias("tie"), F.col("_row").alias("row"))


def plans(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The decision per source over thin rows: _id, _key, source, _size, _propensity, _tie and _row, which no two rows share."""
    sizes = scratch.table(thin.groupBy(F.col("_key").alias("key")).agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"), F.count("*").alias("n")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(sizes.select("key", "source", "source_size"), weights, share, most).join(sizes.select("key", "n"), "key")
    plan = plan.select(F.col("key").alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.floor(ratio).alias("_whole"), F.greatest(F.lit(0.0), F.col("target") - F.floor(ratio) * F.col("source_size")).alias("_words"), F.ceil(F.col("n") / SLICE).alias("_slices"))
    plan = _scaled(thin, plan)
    thin = thin.drop("source")
    rows = _ranked(thin, plan, seed)
    slices = rows.where("_rank is not null").groupBy("_key", "_slice").agg(F.sum("_size").alias("s"), F.first("_words").alias("w"))
    upto = F.sum("s").over(W.partitionBy("_key").orderBy("_slice"))
    edge = slices.withColumn("upto", upto).where("upto > w").groupBy("_key").agg(F.min_by(F.struct(F.col("_slice").alias("slice"), (F.col("upto") - F.col("s")).alias("before")), "_slice").alias("edge"))
    edge = scratch.table(plan.join(edge, "_key", "left").select(*plan.columns, F.col("edge.slice").alias("_edge"), F.col("edge.before").alias("_before")))
    rows = _ranked(thin, edge, seed)
    order = W.partitionBy("_key").orderBy(_at()).rowsBetween(W.unboundedPreceding, 0)
    last = rows.where("_slice = _edge").withColumn("sum", F.col("_before") + F.sum("_size").over(order)).where("sum <= _words")
    last = last.groupBy("_key").agg(F.max(_at()).alias("_last"), F.max("sum").alias("_sum"))
    full = scratch.table(edge.join(last, "_key", "left"))
    rows = _ranked(thin, full, seed)
    # without an edge all ranked rows fit, and nothing is left to fill the gap
    gap = F.when(F.col("_edge").isNotNull(), F.col("_words") - F.coalesce("_sum", "_before"))
    larger = F.struct("_size", -F.col("_rank"), -F.coalesce("_id", F.lit(0)), "_tie", "_row")
    fill = rows.where(F.col("_rank").isNotNull() & ~_first() & (F.col("_size") > 0) & (F.col("_size") <= gap)).groupBy("_key").agg(F.max_by("_row", larger).alias("_fill"))
    return scratch.table(full.join(fill, "_key", "left"))


def _first() -> Column:
    """The row is among the first of its source that fit the remaining words."""
    return F.coalesce(F.col("_rank").isNotNull() & (F.col("_edge").isNull() | (F.col("_slice") < F.col("_edge")) | ((F.col("_slice") == F.col("_edge")) & (_at() <= F.col("_last")))), F.lit(False))


def decided(rows: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (thin ones, or with more columns) with _copies, _source_size and _target."""
    more = _first() | F.coalesce(F.col("_row") == F.col("_fill"), F.lit(False))
    out = _ranked(rows, plan, seed).withColumn("_copies", (F.col("_whole") + more.cast("int")).cast("long"))
    return out.select(*rows.columns, "_copies", "_source_size", "_target")


def thin_rows(docs: DataFrame, propensity: Column | None = None) -> DataFrame:
    """What the mix needs of each row, stored once; _row is the place in that store."""
    rows = _prepared(docs, propensity).select("_id", "_key", F.col("source").cast("string").alias("source"), "_size", "_propensity", "_tie", F.monotonically_increasing_id().alias("_row"))
    return scratch.table(rows)


def mixed(docs: DataFrame, seed: str = SEED, propensity: Column | None = None, **options) -> DataFrame:
    """docs with _copies, the copies that the mix takes of each row, and _size, _source_size, _target.

    Null texts have size 0, a null source is a source of its own and comes last, an empty
    table has no rows. Rows of one id have one random number, so repeats rank side by side;
    each is taken or not on its own. propensity may read _size. docs needs doc_id, text and
    source; columns with one of the names added give way to them, other names beginning
    with an underscore are reserved. docs that is not a plain file is stored first.
    """
    clear = docs.drop("_copies", "_size", "_source_size", "_target")
    placed = _prepared(scratch.placed(clear), propensity)
    thin = scratch.table(placed.select("_id", "_key", F.col("source").cast("string").alias("source"), "_size", "_propensity", "_tie", "_row"))
    return decided(placed, plans(thin, seed=seed, **options), seed).select(*clear.columns, "_copies", "_size", "_source_size", "_target")
