"""The pipeline's stages, each judged on its own input."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from sieveworks.llm import scratch

    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(scratch.table(stage(spark, docs[-1], SF)))
    return docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert stages[-1].columns[: len(stages[0].columns)] == stages[0].columns


def test_toxic_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in stages[1].select("doc_id").collect()}
    gone = {r.doc_id for r in stages[0].select("doc_id").collect()} - left
    assert gone and not [i for i in gone if labels.get(i) == 0]


def test_near_duplicates_brute_force(stages):
    sets = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == {i for i in sets if find(i) == i}


def test_contaminated_go(spark, stages):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    left = set()
    for r in stages[2].collect():
        w, hit = cut(r.text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            left.add(r.doc_id)
    assert {r.doc_id for r in stages[3].select("doc_id").collect()} == left


def test_mix_and_shards(stages):
    assert stages[4].count() > stages[3].count()
    assert stages[5].select("doc_id").exceptAll(stages[4].select("doc_id")).count() == 0 and stages[5].count() == stages[4].count()
