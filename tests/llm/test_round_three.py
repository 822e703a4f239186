"""Resampling, packing and the filter audit against plain versions, and on nulls, empty and long texts, ties, repeats,
empty tables and extra columns whose names clash with their own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import filter_audit, packing, resampling

tokenizers_files = pytest.importorskip("public_tokenizers")
WORDS = tokenizers_files.path("word_bpe_49k.json")
random.seed(11)
VOCABULARY = ["Ab", "cd", "the", "é", "x1", "of", "ürz", "(a)", "ME", "7"]
PROSE = [" ".join(random.choice(VOCABULARY) for _ in range(random.randint(1, 500))) for _ in range(60)]
TEXTS = [None, "", "  \n\t ", "one", "one two", PROSE[0], PROSE[0], *PROSE, "x # y", "A" * 50, "你好世界 naïve \U0001f600", " ".join(random.choice(VOCABULARY) for _ in range(30_000)), "a" * 20_000]
ROWS = [(k, t, None if k % 11 == 0 else f"src{k % 3}") for k, t in enumerate(TEXTS)] + [(5, PROSE[0], "src2"), (9, TEXTS[9], "src0"), (None, "no id", None), (None, None, None), (None, PROSE[0], "src1")]
CLASH = ("part", "queue", "before", "n", "ids", "base", "at", "mask", "own", "sha", "first", "repeated", "good", "toxic", "score", "rank", "weight", "range", "run", "seq", "head", "least", "bucket", "name", "n_words", "step", "s", "hit")


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(5)
    return made.select("*", *[F.lit("x").alias(c) for c in CLASH])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def features(text):
    own = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    return own, [zlib.crc32(w) % 10_000 for w in own] + [zlib.crc32(a + b" " + b) % 10_000 for a, b in zip(own, own[1:])]


def plain_resampling(rows, target):
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for i, own, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(own) >= 20])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    ranks = Counter()
    for k, x in enumerate(able[: 25 * len(able) // 100]):
        ranks[(*x[:4], k + 1)] += 1
    return ranks, Counter(tuple(x[:4]) for x in out)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_resampling(spark, docs, block):
    target = spark.createDataFrame([(PROSE[3],), (None,), ("the x1 é",)], "text string")
    got = [tuple(r) for r in resampling.resampled(docs, target, block=block).collect()]
    ranks, all_ = plain_resampling([(i, t) for i, t, _ in ROWS], [PROSE[3], None, "the x1 é"])
    assert Counter(r for r in got if r[4] is not None) == ranks and len(ranks) > 10
    assert Counter(r[:4] for r in got) == all_


def test_resampling_of_little(spark, docs):
    target = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.limit(0), target).count() == 0
    few = resampling.resampled(docs.filter("doc_id < 5"), target)
    assert few.count() == 5 and few.filter("rank is not null").count() == 0


def test_resampling_breaks_ties_by_id_and_takes_other_ids(spark):
    text = " ".join(map(str, range(30)))
    one = spark.createDataFrame([(f"é{k % 3}", text) for k in range(40)], "doc_id string, text string").repartition(7)
    settings = resampling.Resampling(share=(1, 1))
    got = sorted(resampling.resampled(one, one, settings, block=3).collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1, 41))
    assert got == sorted(got, key=lambda r: (-r.score, r.doc_id, r.rank))


def test_resampling_prefers_what_looks_like_the_target(spark):
    rows = [(k, " ".join(f"{'t' if k % 4 == 0 else 'c'}{random.randrange(50)}" for _ in range(60))) for k in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(f"t{random.randrange(50)}" for _ in range(2000)),)], "text string")
    drawn = [r.doc_id for r in resampling.resampled(made, target).filter("rank is not null").collect()]
    # a draw without weights would hold 25 of them; smoothed gains and noise keep some of the others in
    assert len(drawn) == 100 and sum(i % 4 == 0 for i in drawn) > 50


def test_tournament_merges_runs_as_they_come():
    runs = [sorted(random.randrange(50) for _ in range(random.randrange(1, 40))) for _ in range(9)]
    blocks = [(r, run[k : k + 4], run[k : k + 4]) for r, run in enumerate(runs) for k in range(0, len(run), 4)]
    assert list(resampling.merged(iter(sorted(blocks, key=lambda b: (b[1][0], b[0]))))) == sorted(x for r in runs for x in r)


def plain_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(pieces, rows, window):
    """Every id once, sequences without gaps, none longer than a window, padding nowhere."""
    ids = plain_ids()
    want = Counter((i, tuple(ids(t))) for i, t, *_ in rows)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id, p.doc_tokens].append(p)
        assert p.length == len(p.ids) > 0 and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) == p.ids_crc32
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    lengths = [sum(p.length for p in own) for own in sequences.values()]
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == window or n & (n - 1) == 0 and n < window for n in lengths)
    assert sum(lengths) == sum(len(t) * n for (_, t), n in want.items())
    for (i, n), own in by_doc.items():
        copies = {t: c for (j, t), c in want.items() if j == i and len(t) == n}
        assert sum(copies.values()) * n == sum(p.length for p in own)
        if len(copies) == 1:
            (whole, times), = copies.items()
            held = Counter()
            for p in own:
                assert tuple(p.ids) == whole[p.start : p.start + p.length]
                held.update(range(p.start, p.start + p.length))
            assert set(held.values()) == {times} and len(held) == n
    return sequences


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(docs, window):
    sequences = check_packing(packing.pack(docs, WORDS, window=window).collect(), ROWS, window)
    ids = plain_ids()
    totals = Counter()
    for _, t, s in ROWS:
        totals[s] += len(ids(t))
    shares = {n / sum(totals.values()) for n in totals.values()}
    for k, own in sequences.items():
        if k < len(sequences) - 12 - 8:  # the last windows hold what is left, the last one in powers of two
            held = Counter()
            for p in own:
                held[p.queue] += p.length
            assert len(held) == 4
            assert all(min(abs(n - s * window) for s in shares) <= 4 for n in held.values())


def test_packing_to_targets(docs):
    weights = {"src0": 0.5, "src1": 0.25, "src2": 0.25}
    sequences = check_packing(packing.pack(docs, WORDS, weights, 128).collect(), ROWS, 128)
    first = Counter()
    for k in range(20):
        for p in sequences[k]:
            first[p.queue] += p.length
    assert first == {0: 20 * 64, 1: 20 * 32, 2: 20 * 32}
    last_queue = [k for k, own in sequences.items() if any(p.queue == 3 for p in own)]
    assert min(last_queue) > max(k for k, own in sequences.items() if {p.queue for p in own} == {0, 1, 2})


def test_packing_of_nothing_and_of_nulls(docs):
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    nulls = packing.pack(docs.filter("doc_id is null and text is null"), WORDS).collect()
    assert [(p.doc_id, p.start, p.length, p.sequence_id, p.offset, p.ids) for p in nulls] == [(None, 0, 1, 0, 0, [2])]


def test_plan_drains_queues_in_proportion():
    for _ in range(200):
        n = random.randint(1, 8)
        tokens = [random.choice((0, 1, 5, random.randrange(5000))) for _ in range(n)]
        weights = [random.choice((0, 1, 3, random.randrange(1, 1000))) for _ in range(n)]
        window = random.choice((64, 256))
        phases = packing.plan(tokens, weights, window)
        assert len(phases) <= 2 * n + 2
        layout, taken = packing.Layout(phases, n, window), set()
        for q, t in enumerate(tokens):
            own = [piece for a in range(0, t, 37) for piece in layout.pieces(q, a, min(37, t - a))]
            assert sum(p[1] for p in own) == t
            for _, length, sequence, offset in own:
                spots = {(sequence, o) for o in range(offset, offset + length)}
                assert not spots & taken
                taken |= spots
        held = Counter(s for s, _ in taken)
        assert all(max(o for s, o in taken if s == k) + 1 == c for k, c in list(held.items())[:20])
        assert all(c == window or c & (c - 1) == 0 for c in held.values())


def plain_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fates = []
    for i, t, s in rows:
        t, own = t or "", words(t)
        fails = {"A": len(own) < 200, "B": 100 * len(set(own)) < 50 * len(own), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fates.append((s or "", fails, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in fates}:
            left = [f for f in fates if f[0] == part]
            gone = []
            for k, x in enumerate(order):
                hit = [f for f in left if f[1][x]]
                redundant = sum(f[1][x] for f in gone)
                left, gone = [f for f in left if not f[1][x]], gone + hit
                only = sum(f[1][x] and sum(f[1].values()) == 1 for f in fates if f[0] == part)
                out[part, order, k + 1] = (len(left), len(hit), redundant, only, sum(f[2] for f in hit), sum(f[3] for f in hit))
                shapley[part, x] += len(hit)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit(spark, docs):
    labels = [(k, k % 2, k % 3) for k in range(0, 40, 2)] + [(3, 1, None), (3, None, 1), (None, 1, 1), (7, 0, 1), (7, 1, 0)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    got = filter_audit.filter_audit(docs, told).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(ROWS, labels)
    assert len(got) == 4 * 600
    assert filter_audit.filter_audit(docs.limit(0), told).count() == 0
    assert filter_audit.filter_audit(docs, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_encoder_gives_the_ids_of_whole_texts():
    ids = plain_ids()
    rng = random.Random(2)
    pieces = ["Foo", "BAR,", "it's", "'S", "x2.", "<|endoftext|>", "<|EndOfText|>", "<|", "é!", "É", "ΑΣ.", "ΑΣ", "a,b.", "...", "&&&", "q&&&", "I'LL.", "'", "don't!", "7.", "½.", "²)", "ﬁ,", "\u0130.", "e\u0301.", "\u037e", "a_", "_a_", "#1", "A\u00a0b.", "x\u2003Y,", "ß."]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(300)] + pieces
    with open(WORDS) as file:
        encoder = packing.Encoder(file.read())
    assert encoder.by_words and encoder.lowers and encoder.apart
    for _ in range(2):  # the second time from memory
        got = [list(memoryview(x).cast("H")) for x in encoder.encode([t.encode() for t in texts])]
        assert got == [ids(t)[:-1] for t in texts]
        encoder.held = packing.REMEMBERED + 1


def test_words_of_letters_are_encoded_many_to_a_text_as_by_themselves():
    from tokenizers import Tokenizer

    with open(WORDS) as file:
        encoder = packing.Encoder(file.read())
    assert encoder.ends is not None
    plain, dice = Tokenizer.from_file(WORDS), random.Random(3)
    letters = [chr(c) for c in range(0x20, 0x3000) if chr(c).isalpha()]
    texts = ["क़क İx abc", "café don't it's", "가 x̀y ǅa ﬁx", "a<|endoftext|>b <|EndOfText|> c", "中文 12ab ab12 ..a a.. '", ""]
    texts += [" ".join("".join(dice.choices(letters, k=dice.randrange(1, 6))) for _ in range(500)) for _ in range(20)]
    assert encoder.encode([t.encode() for t in texts]) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
