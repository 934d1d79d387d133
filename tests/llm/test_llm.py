"""The training-data operators: brute force on small tables, and odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import decontaminate, fuzzylines, graph, licenses, linking, minhash, mixing, quality, queries, scratch, secrets, sharding, suffixes, textkit, toxicity

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, "en", "s1"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, "en", "s1"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, "en", "s1"),
    (3, None, None, None),
    (4, "", "en", ""),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, None, "s2"),
    (5, LONG, "en", "s1"),
    (6, " \n\t ", "de", None),
    (7, "two words", "fr", "s2"),
    (8, "ÄÖ ß 漢字 password=abcdef0123456789 \n\nx", "de", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASH = ("node", "sig", "batch", "kept", "score", "target", "shard", "token", "size", "rep", "label")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def arrow(parts):
    raw = [p.encode() for p in parts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_hashes_of_words_that_defeat_wrapping_ones():
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = one.translate({97: 98, 98: 97})
    data, offsets = arrow([f"{one} {other}", f"{one}\n{other}"])
    assert len(np.unique(textkit.Words(data, offsets, textkit.BLANK_WORDS).hashes())) == 2
    assert quality.counts(data, offsets)[1, quality.COUNTS.index("n_dup_lines")] == 0
    symbols = np.array([[7, 9][bin(i).count("1") & 1] for i in range(4096)], np.uint64)
    whole = textkit.Prefix(np.concatenate([symbols, np.uint64(16) - symbols]))
    assert len(np.unique(whole.of(np.array([0, 4096]), np.array([4096, 8192])))) == 2


def test_prefix_hashes_of_long_data():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, (1 << 24) + 5000).astype(np.uint8)
    at = np.array([5, (1 << 24) - 40, (1 << 24) - 4])
    data[at[1] : at[1] + 90] = data[at[0] : at[0] + 90]
    got = textkit.Prefix(data).of(at, at + 90)
    short = textkit.Prefix(data[at[0] : at[0] + 90].copy()).of(np.array([0]), np.array([90]))
    assert got[0] == got[1] == short[0] != got[2]


def test_words_of_neighbouring_texts():
    data, offsets = arrow(["ab c", "d", "", "é f"])
    words = textkit.Words(data, offsets, textkit.BLANK_WORDS)
    assert words.counts.tolist() == [2, 1, 0, 2]
    assert len(np.unique(words.hashes())) == 5


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (9, 8), (None, 1)], "a long, b long")
    assert rows(graph.components(links), "node", "component") == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


def test_near_duplicates_odd(odd, none):
    got = rows(minhash.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert len(got) == len(ODD)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == (10, 1, True) and by[2] == (10, 1, False) and by[None] == (10, 1, False)
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[6] == (0, 6, True) and by[7] == (1, 7, True)
    assert by[5] == (2, 5, True)
    assert minhash.near_duplicates(none).count() == 0


def test_linking_meets_each_pair_once():
    import pyarrow as pa

    table = pa.table({"token": [7] * 3 + [9] * 3, "p": [0] * 6, "q": [0] * 6, "node": [1, 2, 3] * 2, "own": [0] * 6, "component": [1, 2, 3] * 2, "tokens": [[7, 9]] * 6, "sketch": pa.array([[1]] * 6, pa.list_(pa.int64())), "text": ["a", "b", "c"] * 2})
    got = linking._resolved(str, lambda a, b: {a, b} != {"a", "c"}, 0)(table).to_pylist()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2), (2, 3)]


def test_secret_base_spans_and_tags(odd, none):
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r._spans] for r in secrets.secret_spans(odd).collect()}
    assert [s for s in found[8] if s[0] != "crf"] == [("assign", 8, 33), ("hex", 17, 33)]
    assert found[3] == found[4] == found[5] == []
    assert secrets.secret_spans(none).count() == 0


def test_secret_field_on_unseen_lines():
    field, right, wrong, missed = secrets.trained(), 0, 0, 0
    for text, tags in secrets.generated(300, seed=99):
        data, offsets = arrow([text])
        tokens, x = secrets.features(data, offsets)
        got = {t for a, b in field.tag(tokens, x) for t in range(a, b + 1)}
        want = {i for i, t in enumerate(tags) if t != secrets.OUT}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.9


def test_secret_pruning_is_exact():
    field = secrets.trained()
    whole = secrets.Field(field.weights, field.moves, field.begin)
    whole.reach = 1e9  # decodes everything
    for text, _ in secrets.generated(40, seed=5):
        data, offsets = arrow([text])
        tokens, x = secrets.features(data, offsets)
        assert field.tag(tokens, x) == whole.tag(tokens, x)


def test_secret_patterns_brute_force(docs, texts):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: [(s.start, s.kind, s.stop) for s in r._spans if s.kind != "crf"] for r in secrets.secret_spans(docs).collect()}
    for i, t in texts:
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got[i] == [(a, secrets.KINDS[k], b) for a, k, b in sorted(want)]


def test_shards_hold_all_rows(spark, odd, none, tmp_path):
    out = sharding.sharded(odd, f"{tmp_path}/a", target=1000)
    assert rows(out, "doc_id", "text") == rows(odd, "doc_id", "text")
    assert set(odd.columns) - {"shard"} <= set(out.columns)
    assert sharding.sharded(none, f"{tmp_path}/b").count() == 0


def test_shards_grow_and_versions_stay(spark, docs, tmp_path):
    store = sharding.Store(spark, f"{tmp_path}/s")
    for part in range(4):
        store.append(docs.where(F.col("doc_id") % 4 == part).repartition(3))
    before = store.manifest()
    assert store.version() == 4 and before.count() == 12
    target = 300_000
    after = store.manifest(store.compact(target))
    assert store.version() == 5 and after.count() < 12
    assert after.agg(F.sum("n_rows"), F.sum("n_bytes")).first() == before.agg(F.sum("n_rows"), F.sum("n_bytes")).first()
    assert store.read(store.manifest(4)).count() == store.read().count() == docs.count()
    with pytest.raises(RuntimeError):
        store.commit(before, 3)


def test_of_two_writers_one_wins(spark, docs, tmp_path, monkeypatch):
    """Both have passed every check of the version; the loser is told and nothing of the winner changes."""
    store = sharding.Store(spark, f"{tmp_path}/w")
    store.append(docs.limit(50))
    first, second = (sharding.Store(spark, f"{tmp_path}/w") for _ in range(2))
    monkeypatch.setattr(second, "version", lambda: 1)
    assert first.append(docs.limit(20)) == 2
    won = rows(store.manifest(2), "shard", "n_rows")
    with pytest.raises(RuntimeError):
        second.append(docs.limit(10))
    assert store.version() == 2 and rows(store.manifest(2), "shard", "n_rows") == won and store.read().count() == 70


@pytest.mark.parametrize("planned", [3, 4096])
def test_compaction_plan_brute_force(spark, tmp_path, monkeypatch, planned):
    """Runs by the rule, whatever the number of tasks: tiers by size, cut at multiples of the target, until nothing merges."""
    monkeypatch.setattr(sharding, "PLANNED", planned)
    rng = np.random.default_rng(8)
    known = [(f"s{i:03}", int(rng.choice([5, 30, 200, 900, 2500])), None if i % 17 == 0 else int(rng.integers(1000))) for i in range(60)]
    target = 2000
    run = {s: s for s, _, _ in known}
    while True:
        size, at = Counter(), {}
        for s, n, first in known:
            size[run[s]] += n
            at[run[s]] = min(at.get(run[s], (2, 0)), (2, 0) if first is None else (1, first))
        tiers, to = {}, {}
        for r in sorted((r for r in size if size[r] < target // 2), key=lambda r: ((0, 0) if at[r] == (2, 0) else at[r], r)):
            tier = tiers.setdefault(int(np.floor(np.log(size[r]) / np.log(sharding.TIER))), [0, {}])
            tier[1].setdefault(tier[0] // target, []).append(r)
            tier[0] += size[r]
        for _, bins in tiers.values():
            to |= {r: min(group) for group in bins.values() if len(group) > 1 for r in group}
        if not to:
            break
        run = {s: to.get(r, r) for s, r in run.items()}
    members = Counter(run.values())
    shards = spark.createDataFrame(known, "shard string, n_bytes long, first_id long")
    got = {r.shard: r.run for r in sharding.Store(spark, f"{tmp_path}/p").plan(shards, target).collect()}
    assert got == {s: r if members[r] > 1 else None for s, r in run.items()}


def test_levenshtein_automaton_brute_force():
    lexicon = toxicity.Lexicon(["idiot", "scum", "stupid"], ["lowei"], ["idiot", "stupid"])
    words = ["idiot", "idiott", "idot", "1diot", "idito", "scum", "scun", "stupd", "lowei", "loweixyz", "lowe", "xidiot", "stupids", "", "i", "idiots"]
    swapped = lambda t: {t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1)}
    for w in words:
        exact = w if w in lexicon.terms else "lowei" if w.startswith("lowei") else None
        near = [t for t in ("idiot", "stupid") if fuzzylines.edit_distance(w, t) <= 1 or w in swapped(t)]
        want = (exact, False) if exact else (near[0], True) if near else None
        assert lexicon.match(w) == want, w


def test_terms_of_other_letters():
    """Any case, a misspelling and a sign of four bytes: what the automaton would take is not lost before it."""
    lexicon = toxicity.Lexicon(["übel", "schwachsinnig", "écœurant"], [], ["schwachsinnig", "écœurant"])
    words = ["Übel", "ÜBEL", "übel", "Schwachsinnnig", "SCHWACHSINIG", "Écœurant", "ÉCŒURAMT", "éccœurant", "cœurant", "😀schwachsinnig", "schwachsinngi", "harmlos"]
    data, offsets = arrow([" ".join(words)])
    assert [words[w] for _, w, _, _ in toxicity.hits(data, offsets, lexicon)[1]] == words[:-1]


def test_quotation_scores_lower():
    lexicon = toxicity.Lexicon(["idiot"], [], [])
    data, offsets = arrow(["you are an idiot", 'she said the word "idiot" is rude', "", "nothing here"])
    x = toxicity.text_features(data, offsets, lexicon)
    opened, quoted = toxicity.FEATURES.index("log open hits"), toxicity.FEATURES.index("log quoted hits")
    assert x[0, opened] > x[1, opened] and x[1, quoted] > x[0, quoted] and not x[2:].any()


def test_toxicity_held_out(spark):
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and all(0 <= r.score <= 1 for r in got)
    hit = [r for r in held if labels[r.doc_id] == 1]
    assert sum(r.predicted for r in hit) >= 0.7 * len(hit)
    assert sum(r.predicted for r in held if labels[r.doc_id] == 0) <= 2


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).where("_score between 0 and 1").count() == len(ODD)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_toxicity_means_the_same_on_a_capped_sample(spark):
    docs = spark.createDataFrame([(i, "the idiot came home" if i < 300 or i % 10 == 0 else "the man came home") for i in range(2700)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 300).cast("int").alias("toxic"))
    for rows in (100_000, 400, 100):
        got = toxicity.score(docs, toxicity.fit(docs, labels, rows)).where("doc_id < 3").agg(F.max("_score")).first()[0]
        assert 0.35 < got < toxicity.REJECT, (rows, got)


def test_mix_odd(spark, odd, none):
    got = mixing.mixed(odd)
    assert got.count() == len(ODD)
    assert got.where("_copies < 0 OR _copies > 2").count() == 0
    assert got.where("source is null").select("_source_size").distinct().count() == 1
    assert mixing.mixed(none).count() == 0


def test_mix_is_near_its_targets(docs):
    got = mixing.mixed(docs).groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("t"), F.first("_target").alias("g"), F.max(F.col("_copies")).alias("m")).collect()
    assert all(r.t <= r.g + 1e-6 and r.m <= 2 for r in got)
    assert sum(r.t for r in got) > 0.95 * sum(r.g for r in got)


def test_mix_with_unequal_probabilities(docs):
    got = mixing.mixed(docs, propensity=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0), share=0.3).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg((F.col("_copies") > 0).cast("int")).alias("share")).collect()
    share = {r.odd: r.share for r in got}
    assert share[0] > share[1] > 0


@pytest.mark.parametrize("one", ["id", "null", "row"])
def test_mix_meets_targets_with_repeated_ids(spark, one):
    """Rows of one id, without an id, or equal in all: each source comes within a document of its target."""
    same = {"id": 7, "null": None, "row": 7}[one]
    rows = [(same if s == "b" else i, " ".join(f"w{0 if one == 'row' else i}" for _ in range(10)), s) for i in range(100) for s in "ab"]
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, source string").withColumn("_size", F.lit("x"))
    found = scratch.table(mixing.mixed(docs))
    assert found.count() == 201 and found.columns[:3] == ["doc_id", "text", "source"]
    got = {r.source: r for r in found.groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("t"), F.first("_target").alias("g")).collect()}
    assert all(0 <= got[s].g - got[s].t <= 10 for s in "ab")
    thin = mixing.thin_rows(docs)
    again = {r.source: r.t for r in mixing.decided(thin, mixing.plans(thin)).groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("t")).collect()}
    assert {s: got[s].t for s in "ab"} == {s: again[s] for s in "ab"}


def test_mix_chances_stop_at_one(spark):
    """Where the larger propensity reaches a chance of 1, the others are raised."""
    docs = spark.createDataFrame([(i, "w " * (100 if i % 2 else 10), "a") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, share=0.95, propensity=F.when(F.col("doc_id") % 2 == 1, 4.0).otherwise(1.0)).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("_copies").alias("share")).collect()
    share = {r.odd: r.share for r in got}
    assert share[1] == 1.0 and 0.4 < share[0] < 0.5


def test_counts_brute_force(docs, texts, odd):
    def count(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice, seen, dup = Counter(runs), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len({j for i, r in enumerate(runs) if twice[r] > 1 for j in (i, i + 1, i + 2)})

    names = quality.COUNTS[:5]
    for table, known in ((docs, texts), (odd, [(i, t or "") for i, t, _, _ in ODD])):
        want = sorted(((i, *count(t)) for i, t in known), key=str)
        assert rows(quality.measured(table).select("doc_id", *(F.col(f"_counts.{n}").alias(n) for n in names)), "doc_id", *names) == want


def test_decision_list_finds_planted_rule(spark):
    rng = np.random.default_rng(1)
    x = {name: rng.random(3000) for name in quality.STATISTICS}
    low = (x["upper_share"] > 0.7) & (x["n_words"] <= 0.5)
    rules = quality.learn(x, low)
    assert rules
    got = np.zeros(3000, bool)
    for rule in rules:
        got |= quality.covers(rule, x, 3000)
    assert (got & low).sum() > 0.85 * low.sum() and (got & ~low).sum() < 0.05 * low.sum()
    assert quality.learn(x, np.zeros(3000, bool)) == []
    spark.range(1).select(quality.expression([], "c"))


def test_contamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "Zeta eta theta iota!"), (1, "Zeta eta theta iota!"), (2, None), (3, ""), (None, "two words"), (4, "two WORDS"), (5, " ".join(["alpha"] * 20))], "item_id long, text string")
    got = {r.doc_id: (r._found["n_words"], r.n, list(r._found["items"])) for r in decontaminate.matches(odd, bench).withColumn("n", decontaminate.n_hit(F.col("_found"))).collect()}
    assert got[1] == (30, 12, ["1"]) and got[7] == (2, 2, ["4"]) and got[3] == (0, 0, []) and got[5][1] == 0
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(odd, bench.limit(0)).where("size(_found.spans) > 0").count() == 0


def test_contamination_with_ids_of_letters(spark, odd):
    bench = spark.createDataFrame([("item-10", "two WORDS"), ("item-9", "two words")], "item_id string, text string")
    got = {r.doc_id: r._found["items"] for r in decontaminate.matches(odd, bench).collect()}
    assert got[7] == ["item-10", "item-9"] and got[1] == []


def test_contamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = rows(decontaminate.matches(docs, bench).select("doc_id", decontaminate.n_hit(F.col("_found")).alias("n"), F.array_sort("_found.items").cast("string").alias("i")), "doc_id", "n", "i")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    parts = rows(decontaminate.matches(docs, bench).select("doc_id", decontaminate.n_hit(F.col("_found")).alias("n"), F.array_sort("_found.items").cast("string").alias("i")), "doc_id", "n", "i")
    assert whole == parts


def by_bytes(known):
    """Brute force of removed bytes: strings of 50 bytes that start in a smaller document."""
    first, out = {}, {}
    for i, t in known:
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if first.setdefault(raw[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        out[i] = (len(raw), sum(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_brute_force(docs, texts):
    want = by_bytes(texts)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    got = suffixes.repeats(docs, batch_bytes=50_000).select("doc_id", "n_bytes", removed.alias("n"), "kept_sha256")
    assert {r.doc_id: (r.n_bytes, r.n, r.kept_sha256) for r in got.collect()} == want


def test_repeats_odd(odd, none):
    got = rows(suffixes.repeats(odd, with_kept=True).select("doc_id", "n_bytes", F.octet_length("kept").alias("k")), "doc_id", "n_bytes", "k")
    size = len(ODD[0][1])
    by = {r[0]: r[1:] for r in got}
    assert by[1] == (size, size) and by[2] == (size, 0) and by[None] == (size, 0) and by[3] == (0, 0) and by[5] == (len(LONG), len(LONG))
    assert suffixes.repeats(none).count() == 0


def crowded_texts(n: int) -> list[tuple[int, str]]:
    """A passage in n different surroundings, and a line of one word that is longer in each text."""
    rng = np.random.default_rng(5)
    passage, drawn = "the committee shall publish its findings within thirty days of the hearing", lambda k: "".join(rng.choice(list("abcdefgh "), size=k))
    return [(i, drawn(60) + passage + drawn(60) + "\n" + "na " * (30 + i) + drawn(10)) for i in range(n)]


def test_repeats_crowded_key(spark):
    known = crowded_texts(60)
    docs = spark.createDataFrame(known, "doc_id long, text string")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    got = suffixes.repeats(docs, batch_bytes=2_000, crowd=4).select("doc_id", "n_bytes", removed.alias("n"), "kept_sha256")
    assert {r.doc_id: (r.n_bytes, r.n, r.kept_sha256) for r in got.collect()} == by_bytes(known)


def test_repeats_deal_a_crowded_key_to_all_tasks():
    known, buckets = crowded_texts(300), 8
    docs = pa.table({"doc_id": [i for i, _ in known], "text": [t for _, t in known], "batch": [0] * len(known)})
    sent = pa.Table.from_batches(suffixes._send_keys(buckets, 50, 24)(iter(docs.to_batches())))
    parts = [suffixes._survive(50)(sent.filter(pc.equal(sent["bucket"], b))) for b in sorted(set(sent["bucket"].to_pylist()))]
    blobs = suffixes._send_blocks(buckets, 50, 24)(docs, pa.concat_tables(parts))["blob"].to_pylist()
    sizes = [int.from_bytes(b[:8], "little") for b in blobs]
    # the passage and the line have a handful of keys, whose blocks filled as many buckets
    assert len(sizes) == buckets and max(sizes) < 2 * min(sizes), sizes


def test_suffix_sort_brute_force():
    rng = np.random.default_rng(2)
    blocks = list(dict.fromkeys(bytes(rng.choice(list(b"ab"), size=int(rng.integers(50, 90)))) for _ in range(25)))
    holders, group = rng.integers(0, 99, len(blocks)), np.sort(rng.integers(0, 4, len(blocks)))
    for i, found in enumerate(suffixes.smallest_holders(blocks, holders, group, 50)):
        for j, least in enumerate(found):
            piece = blocks[i][j : j + 50]
            assert least == min(h for b, h, g in zip(blocks, holders, group, strict=True) if g == group[i] and piece in b)


def test_edit_distance_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), size=int(rng.integers(0, 9)))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert fuzzylines.edit_distance(a, b) == row[-1]
        for most in (0, 1, 3):
            assert (fuzzylines.edit_distance(a, b, most) <= most) == (row[-1] <= most)
    alike = fuzzylines.Alike(0.75)
    for _ in range(500):
        a, b = (" ".join("".join(rng.choice(list("ab"), size=int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 8)))) for _ in range(2))
        assert alike(a, b) == (fuzzylines.edit_distance(a, b) <= 0.25 * max(len(a), len(b)) + 1e-9), (a, b)


def test_quality_rules_mean_the_same_on_a_capped_sample(spark):
    docs = spark.createDataFrame([(i, "AA BB CC DD" if i < 300 or i % 33 == 0 else "aa bb cc dd") for i in range(3600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 300).cast("int").alias("quality"))
    for rows in (100_000, 600):
        assert quality.fit(docs, labels, rows) == [], rows
    sure = docs.withColumn("text", F.when(F.col("doc_id") < 300, F.col("text")).otherwise("aa bb cc dd"))
    assert quality.fit(sure, labels, 600)


def test_forms_of_all_lines():
    for raw in ([b"One, 2 words\n\n  \xc3\xa9t\xc3\xa9-now.", b"", b"x"], [b"bad \xff byte", b"a b"], [b"", b"..."]):
        lines = fuzzylines.Lines(*textkit.buffers(pa.array(raw, pa.binary())))
        assert lines.forms().to_pylist() == [lines.form(i) for i in range(len(lines.begin))]


def test_fuzzy_lines(spark, odd, none):
    line = "this is a line of text with many plain words in it and some more words to follow number "
    docs = spark.createDataFrame([(1, f"{line}1\nunique here\n\n{line}2"), (2, f"other\n{line}34\r\nunique here"), (3, None), (None, "other")], "doc_id long, text string")
    found = scratch.table(fuzzylines.repeated_lines(docs))
    by = {r.doc_id: list(r.removed) for r in found.collect()}
    assert by[1] == [3] and 2 in by[2] and by[3] == [] and by[None] == [0]
    kept = {r.doc_id: r.text for r in fuzzylines.cleaned(docs, found).collect()}
    assert kept[1] == f"{line}1\nunique here\n" and kept[3] is None and kept[None] == ""
    assert fuzzylines.repeated_lines(odd).count() == len(ODD) and fuzzylines.repeated_lines(none).count() == 0


def _edited(rng, form):
    """form with one or two words replaced or misspelt."""
    words = form.split(" ")
    for i in rng.choice(len(words), size=min(len(words), int(rng.integers(1, 3))), replace=False):
        at = int(rng.integers(len(words[i])))
        words[i] = "".join(rng.choice(list("bdfgklmn"), size=len(words[i]))) if rng.random() < 0.5 else words[i][:at] + "z" + words[i][at + 1 :]
    return " ".join(words)


def test_fuzzy_lines_recall(spark):
    rng = np.random.default_rng(4)
    forms = []
    for _ in range(400):
        forms.append(" ".join("".join(rng.choice(list("abcdefghijklmnoprstuvwxy"), size=int(rng.integers(2, 9)))) for _ in range(int(rng.choice([1, 2, 3, 5, 8, 10, 20, 30, 50])))))
        forms.append(_edited(rng, forms[-1]))
    alike = fuzzylines.Alike(0.75)
    pairs = [(i, i + 1) for i in range(0, 800, 2) if forms[i] != forms[i + 1] and alike(forms[i], forms[i + 1])]
    assert len(pairs) > 250
    docs = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "doc_id long, text string")
    gone = {r.doc_id for r in fuzzylines.repeated_lines(docs).where("size(removed) > 0").collect()}
    missed = [p for p in pairs if p[1] not in gone]
    assert len(missed) <= 0.02 * len(pairs), [(forms[a], forms[b]) for a, b in missed]


@pytest.mark.parametrize("words", [5, 8, 12, 20, 40])
def test_fuzzy_lines_find_one_edit(spark, words):
    """One word replaced, or one letter changed, dropped or put in: all that the verifier accepts meet."""
    rng = np.random.default_rng(words)
    letters = list("abcdefghijklmnoprstuvwxy")
    make = lambda: "".join(rng.choice(letters, size=int(rng.integers(2, 9))))
    forms = []
    for i in range(300):
        line = [make() for _ in range(words)]
        at = int(rng.integers(words))
        place = int(rng.integers(len(line[at])))
        w = line[at]
        new = (make(), w[:place] + "z" + w[place + 1 :], w[:place] + w[place + 1 :], w[:place] + "z" + w[place:])[i % 4]
        forms += [" ".join(line), " ".join([*line[:at], new, *line[at + 1 :]])]
    alike = fuzzylines.Alike(0.75)
    pairs = [i for i in range(0, 600, 2) if alike(forms[i], forms[i + 1])]
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    gone = {r.doc_id for r in fuzzylines.repeated_lines(docs).where("size(removed) > 0").collect()}
    assert len(pairs) > 250 and len([i for i in pairs if i + 1 not in gone]) <= 0.02 * len(pairs)


def by_components(forms, alike):
    """Brute force over all pairs of forms; a bag of letters spares most edit distances."""
    bags = np.zeros((len(forms), 256), np.int32)
    for i, f in enumerate(forms):
        np.add.at(bags[i], [ord(c) % 256 for c in f], 1)
    size = np.array([len(f) for f in forms])
    return [(i, int(j)) for i in range(len(forms)) for j in i + 1 + np.flatnonzero(np.maximum(size[i], size[i + 1 :]) * 0.25 >= np.abs(bags[i + 1 :] - bags[i]).sum(axis=1) / 2) if alike(forms[i], forms[j])]


def test_fuzzy_lines_brute_force(spark, docs):
    """Of the pairs of similar lines of a table, nine in ten are in one group; no group joins what pairs would not."""
    signed = docs.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("row"), F.col("text")).orderBy("doc")
    forms = {}
    for r in signed.collect():
        data, offsets = arrow([r.text or ""])
        lines = fuzzylines.Lines(data, offsets)
        for i, number in enumerate(lines.number.tolist()):
            forms.setdefault(lines.form(i), []).append((r.doc, number))
    found = {r.doc_id: set(r.removed) for r in fuzzylines.repeated_lines(docs).collect()}
    names = list(forms)
    pairs = by_components(names, fuzzylines.Alike(0.75))
    hit = 0
    for i, j in pairs:  # of two similar lines all but one occurrence go
        places = sorted(forms[names[i]] + forms[names[j]])
        hit += all(n in found[d] for d, n in places[1:])
    assert len(pairs) > 40 and hit >= 0.9 * len(pairs), (hit, len(pairs))
    alone = set(range(len(names))) - {x for p in pairs for x in p}
    assert all(n not in found[d] for i in alone for d, n in sorted(forms[names[i]])[:1])


def test_pairs_side_by_side():
    rng = np.random.default_rng(11)
    letters = list("abcdefgh äß漢")
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(letters, int(rng.integers(1, 300))))
        b = list(a)
        for _ in range(int(rng.integers(0, 0.5 * len(a) + 1))):
            at, how = int(rng.integers(len(b) + 1)), int(rng.integers(3))
            b[at : at + (how > 0)] = [str(rng.choice(letters))] * (how < 2)
        pairs.append((a, "".join(b)))
    pairs += [("", ""), ("", "a"), ("a" * 64, "a" * 63 + "b"), ("x" * 700, "y" * 700), ("ab" * 320, "ba" * 320)]
    want = [abs(len(a) - len(b)) <= 0.25 * max(len(a), len(b)) and fuzzylines.edit_distance(a, b) <= 0.25 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert fuzzylines.Alike(0.75).many(pairs) == want and 100 < sum(want) < 350


@pytest.mark.parametrize("folded", [fuzzylines.FOLDED, 64])
def test_tokens_meet_in_runs(monkeypatch, folded):
    monkeypatch.setattr(fuzzylines, "FOLDED", folded)
    rng = np.random.default_rng(12)
    token, node = rng.integers(0, 300, 600).astype(np.uint64), rng.integers(0, 40, 600).astype(np.uint64)
    token[::7] = 5  # one that very many share
    blobs = [pa.array([x[i : i + 20].tobytes() for i in range(0, 600, 20)], pa.binary()) for x in (token, node)]
    got = [r for b in fuzzylines._met(iter([pa.RecordBatch.from_arrays(blobs, ["tokens", "highs"])])) for r in b.to_pylist()]
    nodes = {}
    for t, n in zip(token.tolist(), node.tolist(), strict=True):
        nodes.setdefault(t, set()).add(n)
    want = {t: x for t, x in nodes.items() if len(x) > 1}
    found, leads = {}, {}
    for r in got:
        found.setdefault(r["token"], set()).add(r["node"])
        leads.setdefault(r["token"], set()).add(r["lead"])
        assert min(3, r["n"]) >= min(3, len(want[r["token"]])) and (folded == 64 or r["n"] == len(want[r["token"]]))
    assert found == want and all(len(x) == 1 and x <= want[t] for t, x in leads.items())


def test_tokens_become_rows_only_where_lines_meet(spark):
    parts = 3
    docs = spark.createDataFrame([(i, i, f"these are twelve words of line number {w} and its own {w}{w} end") for i, w in enumerate(["one", "two", "two", "sixteen"])], "doc long, row long, text string").coalesce(1)
    rows = docs.mapInArrow(fuzzylines._lined(parts), fuzzylines._LINED).collect()
    posted = [r for r in rows if r.part is not None]
    highs = {h for r in posted for h in np.frombuffer(r.highs, np.int64).tolist()}
    lines = [h for r in rows if r.part is None for h in r.high]
    # one row for each part, and a line that comes again posts once
    assert len(posted) <= parts and highs == set(lines) and len(lines) == 4 and len(highs) == 3
    tokens = [(t, h) for r in posted for t, h in zip(np.frombuffer(r.tokens, np.uint64).tolist(), np.frombuffer(r.highs, np.int64).tolist(), strict=True)]
    assert len(tokens) == sum(len(fuzzylines.Lines(*arrow([r.text])).tokens()[1]) for r in docs.dropDuplicates(["text"]).collect())


def test_tiny_lines_brute_force(spark):
    rng = np.random.default_rng(6)
    forms = sorted({"".join(rng.choice(list("abc "), size=int(rng.integers(1, fuzzylines.TINY)))).strip() for _ in range(300)} - {""})
    alike = fuzzylines.Alike(0.75)
    want = {(i, j) for i, a in enumerate(forms) for j, b in enumerate(forms) if i < j and alike(a, b)}
    tiny = spark.createDataFrame(list(enumerate(forms)), "node long, form string")
    assert {tuple(r) for r in fuzzylines.tiny_links(tiny, 0.75).collect()} == want


def test_licenses(spark, odd, none):
    name, notice = licenses.TEMPLATES[2]
    changed = notice.replace("hereby", "now").replace("sublicense, ", "")
    docs = spark.createDataFrame([(1, f"ä # {changed} end"), (2, "Released under the\nMIT license."), (3, "license to kill")], "doc_id long, text string")
    got = {r.doc_id: [(s.license, s.start, s.coverage) for s in r._licenses] for r in licenses.license_spans(docs).collect()}
    assert got[1][0][:2] == (name, 4) and 0.9 < got[1][0][2] < 1 and got[2] == [("MIT", 0, 1.0)] and got[3] == []
    assert licenses.license_spans(odd).where("size(_licenses) = 0").count() == len(ODD) and licenses.license_spans(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_a_row_for_each_document(spark, docs, name):
    assert queries.QUERIES[name](spark, SF).select("doc_id").distinct().count() == docs.count()
