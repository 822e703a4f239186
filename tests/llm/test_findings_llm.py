"""What the findings of round 3 asked of the numbered operators and the pipeline."""

import random

import pytest

import corpus_pipeline
from tallyspark.llm import bpe, common, jaccard, simhash


def prose(seed, n=400):
    dice = random.Random(seed)
    return [f"w{dice.randrange(5000)}" for _ in range(n)]


def test_pipeline_links_near_copies_by_fingerprints(spark, monkeypatch):
    texts = [prose(k) for k in range(12)]
    texts += [[*t[:-1], "changed"] for t in texts]  # a shingle in 400 differs
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    prints = [jaccard.fingerprint(jaccard.shingles(" ".join(t).encode())) for t in texts]
    close = {k for k in range(12) if (prints[k] ^ prints[k + 12]).bit_count() <= simhash.DISTANCE}
    assert len(close) > 6
    monkeypatch.setattr(jaccard, "rare", lambda able: able.select(able.node.alias("a"), able.node.alias("b")).limit(0))
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(range(24)) - {k + 12 for k in close}


def test_near_dedup_writes_whole_sets_of_texts_that_may_have_partners_alone(spark, monkeypatch):
    texts = [prose(k) for k in range(40)]
    texts.append(texts[0][:-1])
    written, save = {}, common.Scratch.save

    def saved(self, df, label):
        made = save(self, df, label)
        if "hashes" in made.columns:
            written[label] = sum(len(r.hashes) for r in made.select("hashes").collect())
        return made

    monkeypatch.setattr(common.Scratch, "save", saved)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert jaccard.near_dedup(docs).count() == 40
    assert written and sum(written.values()) < 0.4 * sum(len(jaccard.shingles(" ".join(t).encode())) for t in texts)


def test_merges_look_no_pair_up_in_the_hash(monkeypatch):
    tiktoken, files = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(files.path("byte_bpe_50k.tiktoken"))
    codec = bpe.Codec(bpe.Vocabulary(ranks, files.PATTERN))
    plain = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(5)
    pieces = [w for w in ("q", "aa" * 40, "unbelievablenesses", "été" * 9, "12" * 60, "x" * 3000) + tuple("".join(dice.choices("etaonrish é", k=dice.randrange(1, 60))) for _ in range(300))]
    monkeypatch.setattr(bpe.PerfectHash, "slot", None)
    for piece in pieces:
        assert codec.merged(piece.encode()) == plain.encode_ordinary(piece), piece
