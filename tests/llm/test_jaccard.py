"""Near-dedup of the pipeline against all pairs."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from tallyspark.llm import jaccard, simhash


def plain_set(text, n=5):
    words = (text or "").encode().translate(simhash.LOWER).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def plain_kept(texts):
    """texts: by id. The smallest id of each connected part."""
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


def cases():
    dice = random.Random(11)
    word = lambda: f"w{dice.randrange(3000)}"
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for changed in range(1, 12):  # from well over the bound to well under it
        for _ in range(6):
            own = list(base)
            for p in dice.sample(range(200), changed):
                own[p] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(100)]
    for k in range(30):  # the ends of the chain share nothing
        texts.append(" ".join(chain[-100:]))
        chain += [word() for _ in range(8)]
    passage = [word() for _ in range(40)]
    texts += [" ".join([*passage, *(word() for _ in range(tail))]) for tail in (2, 5, 9, 11, 30, 60) for _ in range(4)]
    return texts + ["", None, " \n", "one two", "One  two", "one two three", texts[0].upper()] + [" ".join(word() for _ in range(80)) for _ in range(20)]


def test_near_dedup_equals_all_pairs(spark):
    texts = dict(enumerate(cases()))
    wanted = plain_kept(texts)
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n int").repartition(3)
    kept = jaccard.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    assert len(wanted) < len({r.root for r in simhash.near_groups(docs).collect()})
    assert jaccard.near_dedup(docs.limit(0)).count() == 0
    again = docs.union(docs).union(spark.createDataFrame([(None, texts[0], 0), (None, None, 0)], docs.schema))
    assert sorted(r.doc_id for r in jaccard.near_dedup(again).collect()) == sorted(wanted)


def test_parts_of_one_block():
    dice = np.random.default_rng(3)
    sets = [np.unique(dice.integers(0, 60, dice.integers(1, 50))) for _ in range(150)]
    sets += [np.delete(s, 0) for s in sets if len(s) > 5]
    sizes = np.array([len(s) + (k % 4 == 0) for k, s in enumerate(sets)])
    root = jaccard.parts(sizes, sets)
    near = lambda a, b: 5 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (sizes[a] + sizes[b] - c)
    graph = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            if near(a, b):
                graph[a].add(b), graph[b].add(a)
    for a in range(len(sets)):
        seen, todo = {a}, [a]
        while todo:
            new = graph[todo.pop()] - seen
            seen |= new
            todo += new
        assert {b for b in range(len(sets)) if root[b] == root[a]} == seen


def test_pipeline_keeps_one_of_all_near_copies(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    stage = corpus_pipeline.exact(spark, corpus_pipeline.quality_rules(spark, given, folder), folder).cache()
    texts = {r.doc_id: r.text for r in stage.collect()}
    wanted = plain_kept(texts)
    assert len(wanted) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.near(spark, stage, folder).collect()} == wanted
