"""Contradiction rules over all facts and mentions, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import constants
from sieveworks.operators import contradictions
from sieveworks.plans import catalog
from sieveworks.plans.proxies import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    v = Views(spark, SF)
    names = {}
    for r in v.p_mentions.select("fact_id", "canonical").distinct().collect():
        names.setdefault(r.fact_id, set()).add(r.canonical.lower())
    rows = [r.asDict() for r in v.p_facts.collect()]
    return [(r, names.get(r["fact_id"], set())) for r in rows]


def found(spark, name):
    return {(r.a, r.b) for r in catalog.queries()[name](spark, SF).collect()}


def test_assertions_of_all_mentions(spark, facts):
    said = [x for x in facts if x[0]["assertion_type"] == "statement"]
    denied = [x for x in facts if x[0]["assertion_type"] == "denial"]
    want = {(a["fact_id"], b["fact_id"]) for a, m in said for b, n in denied if a["investigation_id"] == b["investigation_id"] and m & n}
    assert any(a % 5 or b % 5 for a, b in want) and found(spark, "i15_assertion") == want


def test_times_of_all_mentions(spark, facts):
    timed = [x for x in facts if x[0]["temporal_kind"] == "explicit" and x[0]["temporal_value"]]
    want = {
        (a["fact_id"], b["fact_id"])
        for a, m in timed
        for b, n in timed
        if a["fact_id"] < b["fact_id"] and a["investigation_id"] == b["investigation_id"] and a["temporal_precision"] == b["temporal_precision"] and a["temporal_value"] != b["temporal_value"] and m & n
    }
    assert any(a % 4 or b % 4 for a, b in want) and found(spark, "i17_temporal") == want


def test_contradictions_first_rule_wins(spark):
    rng = random.Random(3)
    texts = ["troops crossed the border", "troops never crossed the border", "rain fell", "no rain fell today"]
    rows, names = [], {}
    for i in range(150):
        low = rng.choice([None, 0.0, 5.0, 10.0])
        kind = rng.choice(["statement", "denial", "prediction"])
        rows.append((i, rng.randrange(2), rng.choice(texts), kind, low, None if low is None else low + rng.choice([0.0, 6.0]), rng.choice(["", None, "10", "20"]), rng.choice(["explicit", "inferred"]), rng.choice(["day", "month"]), rng.choice([None, "1", "2"])))
        names[i] = {rng.choice("abc")}
    schema = "fact_id long, investigation_id long, claim_text string, assertion_type string, low_value double, high_value double, value_original string, temporal_kind string, temporal_precision string, temporal_value string"
    mentions = spark.createDataFrame([(i, x.upper()) for i, n in names.items() for x in n], "fact_id long, canonical string")

    def rule(x, y):
        shared = names[x[0]] & names[y[0]]
        if {x[3], y[3]} == {"statement", "denial"} and shared:
            return "assertion", 0.8
        a, b = (set(t[2].split()) for t in (x, y))
        agree = (a & b) - set(constants.NEGATION_WORDS) - set(constants.STOP_WORDS)
        if bool(a & set(constants.NEGATION_WORDS)) != bool(b & set(constants.NEGATION_WORDS)) and len(agree) >= 2:
            return "negation", min(0.9, 0.5 + 0.1 * len(agree))
        if x[4] is not None and y[4] is not None:
            if x[5] < y[4] or y[5] < x[4]:
                return "numeric", 0.8
        elif x[6] and y[6] and x[6] != y[6] and shared:
            return "numeric", 0.6
        if x[7] == y[7] == "explicit" and x[8] == y[8] and x[9] and y[9] and x[9] != y[9] and shared:
            return "temporal", 0.7
        return None

    want = {(x[0], y[0]): r for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and (r := rule(x, y))}
    got = {(r.a, r.b): (r.kind, round(r.confidence, 9)) for r in contradictions.contradictions(spark.createDataFrame(rows, schema), mentions).collect()}
    assert {k for k, _ in want.values()} == {"assertion", "negation", "numeric", "temporal"} and {c for k, c in want.values() if k == "numeric"} == {0.6, 0.8}
    assert got == {p: (k, round(c, 9)) for p, (k, c) in want.items()}


def _regrouped(rows):
    """How often the executed plan groups found pairs."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"HashAggregate\(keys=\[(?:a|denial)#", plan))


def test_pairs_are_not_shuffled_again(spark):
    for name in ("c10_conflicting_claims", "i15_assertion", "i17_temporal", "i16_numeric_all", "c09_contradictions_all"):
        found = catalog.queries()[name](spark, SF)
        assert not _regrouped(found), name
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan, name
        rows = [(r[0], r[1]) for r in found.select(found.columns[0], found.columns[1]).collect()]
        assert len(rows) == len(set(rows)) > 0, name


def test_shared_names_counted_once(spark):
    from sieveworks.operators import relations

    rng = random.Random(5)
    rows = [(i, rng.randrange(2), rng.choice(["statement", "denial", "prediction"])) for i in range(120)]
    names = {i: set(rng.sample("abcdefg", rng.randrange(1, 6))) for i, *_ in rows}
    want = {(d[0], s[0], len(names[d[0]] & names[s[0]])) for d in rows for s in rows if d[1] == s[1] and d[2] == "denial" and s[2] == "statement" and len(names[d[0]] & names[s[0]]) >= 3}
    facts = spark.createDataFrame(rows, "fact_id long, investigation_id long, assertion_type string")
    mentions = spark.createDataFrame([(i, x) for i, n in names.items() for x in n] * 2, "fact_id long, canonical string")
    got = [tuple(r) for r in relations.shared_entity_denials(facts, mentions, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_ranges_the_wrong_way_round_are_one_pair(spark):
    rows = [(i, 1, low, high) for i, (low, high) in enumerate([(5.0, 1.0), (6.0, 2.0), (3.0, 4.0), (9.0, 9.0), (None, 1.0)])]
    facts = spark.createDataFrame(rows, "fact_id long, investigation_id long, low_value double, high_value double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and None not in a + b and (a[3] < b[2] or b[3] < a[2])}
    got = [(r.a, r.b) for r in contradictions.disjoint(facts).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_tenant_are_dealt_evenly(spark):
    rows = [(i, 1, float(i), float(i)) for i in range(600)]
    facts = spark.createDataFrame(rows, "fact_id long, investigation_id long, low_value double, high_value double")
    pairs = contradictions.disjoint(facts)
    each = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert sum(each) == 600 * 599 // 2 and len(each) >= 48 and max(each) <= 4 * sum(each) / len(each)


@pytest.mark.parametrize("nth", [1, 2])
def test_common_and_rare_names_make_each_pair_once(spark, monkeypatch, nth):
    monkeypatch.setattr(contradictions, "COMMON", 3)
    rng = random.Random(7)
    names = {i: set(rng.sample("abcdefgh", rng.randrange(0, 5))) for i in range(80)}
    facts = spark.createDataFrame([(i, i % 2) for i in names], "fact_id long, investigation_id long")
    mentions = spark.createDataFrame([(i, x.upper()) for i, n in names.items() for x in n] * 2, "fact_id long, canonical string")
    rows = contradictions.listed(facts, mentions)
    got = [(r[0], r[1]) for r in contradictions.sharing(rows, rows, ["investigation_id"], nth).select("p.fact_id", "q.fact_id").collect()]
    want = {(a, b) for a in names for b in names if a % 2 == b % 2 and len(names[a] & names[b]) >= nth}
    assert len(got) == len(set(got)) and set(got) == want and rows.where("common <> 0 AND size(names) > 0").count()
