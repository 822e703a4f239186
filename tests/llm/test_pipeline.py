"""The corpus pipeline stage by stage against plain versions, and its stages on awkward tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import bpe, quality

tokenizers_files = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else raw).split()


def passes(text):
    """Policy v1 by plain counting."""
    ws = [w.decode() for w in words(text)]
    spots = defaultdict(list)
    for i in range(len(ws) - 2):
        spots[tuple(ws[i : i + 3])].append(i)
    repeated = len({p for s in spots.values() if len(s) > 1 for i in s for p in (i, i + 1, i + 2)})
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars, symbols = sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text or "")
    return not (
        len(ws) < 50 or 100 * repeated > 50 * len(ws) or symbols * 100 > chars * 30 or (len(lines) >= 4 and (len(lines) - len(set(lines))) * 100 > len(lines) * 80) or chars > len(ws) * 40
    )


def nearest_roots(texts):
    """The smallest id of each group of texts that pairs with a Jaccard similarity of 0.8 or more of their 5-word
    shingles chain together, by all pairs."""
    sets = {}
    for i, t in texts.items():
        ws = words(t, True)
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) > 5 else {tuple(ws)}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (common := len(sets[i] & sets[j])) and 5 * common >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def filled(budget, nodes):
    """Shares of a budget over nodes (name: capacity, weight), those with least room for their weight first."""
    order = sorted(nodes, key=lambda n: (nodes[n][0] / nodes[n][1], n))
    given, left, weight = {}, budget, sum(w for _, w in nodes.values())
    while order and nodes[order[0]][0] * weight <= nodes[order[0]][1] * left:
        name = order.pop(0)
        given[name] = nodes[name][0]
        left, weight = left - nodes[name][0], weight - nodes[name][1]
    upto = 0
    for name in order:
        before, upto = upto, upto + nodes[name][1]
        given[name] = upto * left // weight - before * left // weight
    return given


def plainly_mixed(rows, mixture):
    """Ids that a mixture of one epoch takes from (id, text, lang, source) rows."""
    leaf, size = {}, {}
    for i, text, lang, source in rows:
        number = re.search("([0-9]+)$", source or "")
        n = int(number.group(1)) if number else -1
        leaf[i] = ("other" if n < 0 else "web" if n < 5 else "books" if n < 12 else "code", lang or "(none)", source or "(none)")
        size[i] = len(words(text))
    held = Counter()
    for i, path in leaf.items():
        held[path] += size[i]
    budget = {(): sum(held.values()) * mixture.budget // 1000}
    for depth, level in enumerate(("domain", "lang", "source")):
        for above in {path[:depth] for path in held}:
            nodes = {}
            for path, n in held.items():
                if path[:depth] == above:
                    nodes[path[depth]] = (nodes.get(path[depth], (0, 0))[0] + n, mixture.weights.get(level, {}).get(path[depth], mixture.default))
            for name, share in filled(budget[above], nodes).items():
                budget[(*above, name)] = share
    taken = set()
    for path, n in held.items():
        own = [i for i in leaf if leaf[i] == path]
        if n and budget[path] >= n:
            taken |= set(own)
            continue
        upto = 0
        for i in sorted(own, key=lambda i: hashlib.md5(f"{mixture.seed}-0-{i}".encode()).hexdigest()):
            upto += size[i]
            if upto > budget[path]:
                break
            taken.add(i)
    return taken


def test_stages_equal_plain_versions(spark):
    tiktoken = pytest.importorskip("tiktoken")
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    row = {r.doc_id: (r.doc_id, r.text, r.lang, r.source) for r in given.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    stage = corpus_pipeline.quality_rules(spark, given, FOLDER)
    kept = {i for i, r in row.items() if passes(r[1])}
    assert ids(stage) == kept and stage.columns == given.columns

    stage = corpus_pipeline.exact(spark, stage, FOLDER)
    last = {}
    for i in kept:
        last[row[i][1]] = max(i, last.get(row[i][1], i))
    kept = set(last.values())
    assert ids(stage) == kept and stage.columns == given.columns

    stage = corpus_pipeline.near(spark, stage, FOLDER)
    kept = set(nearest_roots({i: row[i][1] for i in kept}).values())
    assert ids(stage) == kept and stage.columns == given.columns

    stage = corpus_pipeline.mixed(spark, stage, FOLDER)
    kept = plainly_mixed([row[i] for i in sorted(kept)], corpus_pipeline.MIXTURE)
    assert ids(stage) == kept and stage.columns == given.columns

    plain = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizers_files.path("byte_bpe_50k.tiktoken")), special_tokens={})
    tokens = {i: plain.encode_ordinary(row[i][1] or "") for i in kept}
    wanted = {(i, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest()) for i, t in tokens.items()}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()} == wanted


def test_stages_take_awkward_tables(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns named like what stages make."""
    prose = " ".join(f"word{k}" for k in range(120))
    rows = [
        (1, prose, "en", "src1"), (1, prose, "en", "src1"), (2, prose, None, None), (None, prose + " end", "en", "src2"), (None, None, None, None), (4, "", "en", "src1"), (5, "  \n ", "de", "src9"),
        (6, " ".join(f"long{k}" for k in range(60_000)), "en", "src1"), (7, prose.upper(), "en", "src1"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.lit("x").alias(c) for c in ("key", "node", "hash", "n", "root", "__key2", "a.b")])
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns, name
        texts = Counter(r.text for r in found.collect())
        if name == "quality rules":
            assert texts == {prose: 3, prose + " end": 1, prose.upper(): 1, rows[7][1]: 1}
        if name == "exact dedup":
            assert len(texts) == 6 or set(texts.values()) == {1}
        if name == "near dedup":
            assert sum(texts.values()) == 3  # one of the prose, one without words, the long one
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    assert corpus_pipeline.encoded(spark, docs, FOLDER).count() == len(rows) and corpus_pipeline.encoded(spark, docs.limit(0), FOLDER).count() == 0
