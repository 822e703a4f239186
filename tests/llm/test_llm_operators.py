"""Every operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and extra
columns whose names clash with its own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, exact_dedup, mixing, pii, ppm, quality, simhash, substring_dedup, token_counts

tokenizers_files = pytest.importorskip("public_tokenizers")
RANKS, WORDS = tokenizers_files.path("byte_bpe_50k.tiktoken"), tokenizers_files.path("word_bpe_49k.json")
random.seed(7)
VOCABULARY = ["Ab", "cd", "the", "é", "x1", "of", "ürz", "(a)", "##"]
PROSE = " ".join(random.choice(VOCABULARY) for _ in range(400))
TEXTS = [
    None, "", "  \n\t ", "one", "one two", PROSE, PROSE, PROSE + " end", "lead in " + PROSE[:700], "the the the the\nthe the the the\n" * 20,
    "a" * 5000, "mail me at jo.e@mail.example.com or +1 (555) 010-9999, 10.1.2.3 or 4111 1111 1111 1111", "Σίσυφος naïve 你好世界 \U0001f600 </turn> ### x",
    " ".join(random.choice(VOCABULARY) for _ in range(30_000)),
]
ROWS = [(k, t, "en" if k % 2 else None, f"src{k % 3}") for k, t in enumerate(TEXTS)] + [(5, PROSE, "en", "src2"), (None, "no id", None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns beside id, text, lang and source are named like what operators make."""
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    clash = ("row_id", "kept", "score", "n_words", "name", "level", "print", "rid", "blocks", "spans", "key", "n", "domain", "budget", "bucket", "ids", "w", "l", "c")
    return made.select("*", *[F.lit("x").alias(c) for c in clash])


def empty(docs):
    return docs.limit(0)


def by_row(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(simhash.LOWER) if lower else raw).split()


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(i)
    got = exact_dedup.exact_groups(docs, block_bytes=64).collect()
    assert len(got) == len(ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS
    )
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_exact_dedup_when_fingerprints_collide(docs):
    weak = lambda b: F.struct((F.length(b) % 3).alias("h1"), F.lit(0).alias("h2"))
    names = ("doc_id", "keep_id", "group_size", "text_sha256")
    assert by_row(exact_dedup.exact_groups(docs, block_bytes=64, fingerprint=weak), *names) == by_row(exact_dedup.exact_groups(docs), *names)


def plain_quality(text):
    text = text or ""
    ws = [w.decode() for w in words(text)]
    spots = defaultdict(list)
    for i in range(len(ws) - 2):
        spots[tuple(ws[i : i + 3])].append(i)
    covered = {p for s in spots.values() if len(s) > 1 for i in s for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(docs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    table = quality.ledger(docs).cache()
    assert by_row(table, *names) == Counter((i, *plain_quality(t)) for i, t, *_ in ROWS)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == table.filter("failures = 0").count()
    bits = [r.failures for r in table.collect()]
    for r in quality.ablation(table).collect():
        bit = 1 << list(quality.RULES).index(r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(not b & ~bit for b in bits))
    assert quality.ledger(empty(docs)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "######", "</</turn></turn>\n", "\\\\", "a: b: ", "", "<", "#", "### user: hi</turn>\n### assistant: no", "\n"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("user", nasty[0]), ("assistant", nasty[1])])] + [(2, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)]
    rows += [(3, 0, "odd: role", None), (3, 0, None, "x"), (None, None, "user", "y"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("state", F.lit(0)).withColumn("valid", F.lit(0))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    for conv in (1, 2, 3, None, 4):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and got[2].valid and not got[3].valid and not got[4].valid
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_mixing(docs, spark):
    got = mixing.mix(docs, mixing.Mixture(budget=700, epochs=2, digits=1), F.lit("d"))
    assert got.columns == [*docs.columns, "__mix"]
    size = Counter()
    for r in got.collect():
        size[tuple(r["__mix"][x] for x in mixing.LEVELS)] += len(words(r.text))
        assert r["__mix"].epoch < 2
    for r in mixing.cutoffs(docs, mixing.Mixture(budget=700, epochs=2, digits=1), F.lit("d")).collect():
        assert size[(r.domain, r.lang, r.source)] <= r.budget <= 2 * r.tokens
    assert mixing.mix(empty(docs), mixing.Mixture(), F.lit("d")).count() == 0
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "1", 5), ("b", "x", "1", 1000)], "domain string, lang string, source string, tokens long")
    even = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, mixing.Mixture(budget=400, epochs=1)).collect()}
    # 446 tokens: a's share of 223 exceeds its 115, which all go; b gets the rest. Within a level siblings come first.
    assert even == {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "1"): 5, ("b", "x", "1"): 331}


def test_bpe_round_trip(docs):
    tiktoken = pytest.importorskip("tiktoken")
    plain = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.encode(docs, RANKS, tokenizers_files.PATTERN).cache()
    wanted = Counter((i, tuple(plain.encode_ordinary(t or ""))) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == wanted
    for r in got.collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert by_row(bpe.decode(got, RANKS, tokenizers_files.PATTERN), "doc_id", "text") == Counter((i, t or "") for i, t, *_ in ROWS)
    assert bpe.encode(empty(docs), RANKS, tokenizers_files.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(k).encode() for k in range(3000)]
    made = bpe.PerfectHash(keys)
    assert sorted(map(made.slot, keys)) == list(range(3000)) and made.slot(b"no key") == -1
    assert made.slots(keys) == list(map(made.slot, keys))


def test_token_counts(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    count = lambda t: len(plain.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.token_counts(docs, WORDS)
    assert by_row(got, "doc_id", "n_bytes", "n_tokens") == Counter((i, len((t or "").encode()), count(t)) for i, t, *_ in ROWS)
    assert token_counts.token_counts(empty(docs), WORDS).count() == 0


@pytest.mark.parametrize("text", [PROSE * 3, "a" * 900, PROSE[:300] + "b" * 700 + PROSE, "<|endoftext|> é " * 90, " " * 400 + "x", "x" + "\n" * 300 + "y"])
def test_overlaps_resynchronise(text):
    counter = token_counts.Counter(open(WORDS).read())
    assert token_counts.spliced_count(text, counter.encode, 100, 20) == len(counter.encode(text)[0])


def plain_print(text, n=3):
    ws = words(text, True)
    if not ws:
        return 0
    made = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + n]), 42) for i in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in made) > len(made))


def plain_roots(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash(docs):
    prints = [(i, plain_print(t)) for i, t, *_ in ROWS]
    roots = plain_roots({p for _, p in prints})
    least = {r: min((i for i, p in prints if roots[p] == r and i is not None), default=None) for r in roots.values()}
    got = by_row(simhash.near_groups(docs), "doc_id", "print", "component_id")
    assert got == Counter((i, int(np.uint64(p).astype(np.int64)), least[roots[p]]) for i, p in prints)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))
    assert simhash.near_groups(empty(docs)).count() == 0


@pytest.mark.parametrize("many", [simhash.MANY, 8])
def test_links_join_long_chains_and_large_clusters(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)
    chain = [0]
    for k in range(60):
        chain.append(chain[-1] ^ (0b111 << k))
    cluster = {0xABCDEF << 40 ^ sum(1 << random.randrange(64) for _ in range(1)) for _ in range(200)}
    values = sorted({v & (1 << 64) - 1 for v in (*chain, *cluster, *(random.getrandbits(64) for _ in range(200)))})
    roots = plain_roots(values)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "print long")
    scratch = simhash.Scratch(spark, "test")
    found = {r.node: r.root for r in simhash.components(scratch.save(simhash.links(frame), "links"), scratch).collect()}
    groups = defaultdict(set)
    for v in values:
        s = int(np.uint64(v).astype(np.int64))
        groups[found.get(s, s)].add(v)
    wanted = defaultdict(set)
    for v, r in roots.items():
        wanted[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_tallies_and_flips_equal_comparison():
    same = 0xABCDEF0123 << 24
    few = np.sort(np.array([same ^ x for x in random.sample(range(1 << 24), 3000)], np.uint64))
    many = np.sort(np.array([same ^ x for x in random.sample(range(1 << 14), 2000)], np.uint64))
    for values in (few, many):
        for parent, tally in (simhash._tallied(values, 3), simhash._flipped(values, 3, [5, 6, 7])):
            child = np.flatnonzero(parent != np.arange(len(values)))
            for c in child[:200].tolist():
                a, b = int(values[c]), int(values[parent[c]])
                assert (a ^ b).bit_count() <= 3 and tally[c] == sum((a >> 8 * k & 255) == (b >> 8 * k & 255) for k in range(8)) >= 5
            root = np.arange(len(values))
            for _ in range(len(values)):
                if (root == parent[root]).all():
                    break
                root = parent[root]
            for v in random.sample(range(len(values)), 50):
                near = np.bitwise_count(values ^ values[v]) <= 3
                assert set(root[near]) == {root[v]}


def test_substring_dedup(docs):
    seen, split = Counter(), [(i, words(t)) for i, t, *_ in ROWS]
    for _, ws in split:
        for p in range(len(ws) - 34):
            seen[tuple(ws[p : p + 35])] += 1
    wanted = Counter()
    for i, ws in split:
        keep = [True] * len(ws)
        for p in range(len(ws) - 34):
            if seen[tuple(ws[p : p + 35])] > 1:
                keep[p : p + 35] = [False] * 35
        kept = [w for w, k in zip(ws, keep) if k]
        wanted[i, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    assert by_row(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == wanted
    assert substring_dedup.substring_dedup(empty(docs)).count() == 0


def plain_spans(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits))) or (k == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(docs, spark):
    for _ in range(3000):
        text = "".join(random.choice("a1.@-+ ()b@.1٣é") for _ in range(random.randint(1, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in pii.find(docs).collect())
    assert got == Counter((i, tuple(plain_spans(t or ""))) for i, t, *_ in ROWS)
    assert pii.find(empty(docs)).count() == 0
    taught = [(k, f"please call me on +1 555 010 {1000 + k} today") for k in range(8)] + [(50, "please call me on 5550107777 today"), (51, "lot 5550107777 sold")]
    spans = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(taught, "doc_id long, text string")).collect()}
    assert [(s.start, s.kind, s.end) for s in spans[50]] == [(18, 3, 28)] and spans[51] == []


def plain_ppm(texts, train):
    order = ppm.ORDER
    streams = {k: b"\n" * order + b" ".join(words(t, True)) + b"\n" for k, t in enumerate(texts)}
    trie = defaultdict(Counter)
    for k in train:
        s = streams[k]
        for p in range(order, len(s)):
            trie[s[p - order : p]][s[p]] += 1
    for o in range(order - 1, -1, -1):
        for c in [c for c in trie if len(c) == o + 1]:
            for b in trie[c]:
                trie[c[1:]][b] += 1
    out = []
    for s in streams.values():
        total = 0.0
        for p in range(order, len(s)):
            gone = set()
            for o in range(order, -1, -1):
                left = {b: 2 * n - 1 for b, n in trie.get(s[p - o : p], {}).items() if b not in gone}
                whole = sum(left.values()) + len(left)
                if s[p] in left:
                    total += math.log10(left[s[p]] / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                    gone |= set(left)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("chunk, at_once", [(ppm.CHUNK, ppm.COUNT_BYTES), (3000, 500)])
def test_ppm(docs, monkeypatch, chunk, at_once):
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    monkeypatch.setattr(ppm, "COUNT_BYTES", at_once)
    train = [k for k, r in enumerate(ROWS) if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10]
    scores = plain_ppm([r[1] for r in ROWS], train)
    count = Counter(w for k in train for w in [*words(ROWS[k][1], True), None])
    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(r[1], True), None]) for r in ROWS]
    got = sorted((r.n_tokens, r.score, r.base_score, r.train_tokens) for r in ppm.score(docs).collect())
    wanted = sorted((len(words(r[1])) + 1, s, b, n) for r, s, b in zip(ROWS, scores, base))
    assert np.allclose(np.array(got), np.array(wanted))
    assert ppm.score(empty(docs)).count() == 0


def test_adaptive_score_learns():
    assert ppm.adaptive_score(b"the same words " * 40) > 5 * ppm.adaptive_score(b"the same words " * 4)
