"""The dealt methods themselves: that results come from factors, tallies, splices, rounds and joins."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, exact_dedup, jaccard, mixing, pii, simhash, substring_dedup, token_counts

tokenizers_files = pytest.importorskip("public_tokenizers")
WORDS = tokenizers_files.path("word_bpe_49k.json")


def test_factors_are_the_longest_runs_of_one_source():
    # ordinal, place in the text, words before and after that agree, first and last place in the reference; the document itself begins at place 100
    held = [(0, 4, 4, 20, 10, 100), (1, 9, 4, 20, 11, 101), (2, 14, 4, 20, 50, 102), (4, 24, 4, 20, 52, 104), (5, 29, 4, 20, 70, 105)]
    assert substring_dedup.parsed(held, 100) == [(0, 41, 10), (10, 46, 50), (20, 56, 52), (25, 61, 70)]
    twice = [(0, 4, 4, 20, 10, 30), (1, 9, 4, 20, 31, 90), (2, 14, 4, 20, 32, 91)]
    assert substring_dedup.parsed(twice, 500) == [(0, 46, 30)]


def test_factors_reach_as_far_as_words_agree():
    own = substring_dedup._hashed([b"%d" % k for k in range(58)])
    other = own.copy()
    other[[5, 50]] = 1
    assert substring_dedup.extended(own, 20, own, 20) == (20, 26)
    assert substring_dedup.extended(own, 20, other, 20) == (14, 18)
    assert substring_dedup.extended(own[10:], 10, other, 20) == (10, 18)
    assert substring_dedup.extended(own[:35], 20, other, 20) == (14, 3)


def plain_removed(texts):
    split = [t.split() for t in texts]
    seen = Counter(tuple(ws[p : p + 35]) for ws in split for p in range(len(ws) - 34))
    removed = []
    for ws in split:
        gone = [False] * len(ws)
        for p in range(len(ws) - 34):
            if seen[tuple(ws[p : p + 35])] > 1:
                gone[p : p + 35] = [True] * 35
        removed.append(sum(gone))
    return removed


def passages_cut_anywhere():
    """Texts of pieces of one passage, cut and joined anywhere, so that a block meets many contexts and most factors end inside one."""
    dice = random.Random(5)
    passage = [f"p{dice.randrange(90)}" for _ in range(200)]
    texts = []
    for k in range(150):
        ws = []
        for _ in range(dice.randrange(1, 5)):
            a = dice.randrange(165)
            ws += passage[a : a + dice.randrange(20, 60)] + [f"x{dice.randrange(30)}" for _ in range(dice.randrange(3))]
        texts.append(" ".join(ws))
    return texts + texts[:7] + ["again and again " * 40, " ".join(passage)]


def test_substring_dedup_is_exact_on_passages_cut_anywhere(spark):
    texts = passages_cut_anywhere()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = substring_dedup.substring_dedup(docs).collect()
    assert {r.doc_id: r.n_removed for r in rows} == dict(enumerate(plain_removed(texts)))
    for r in rows:
        words = texts[r.doc_id].split()
        covered = {k for f in r.factors or [] for k in range(f["a"], f["b"])}
        assert len(covered) == r.n_removed and covered <= set(range(len(words)))
        assert all(f["b"] - f["a"] >= 35 for f in r.factors or [])


def test_blocks_of_their_own_are_no_duplicates(spark, monkeypatch):
    """The factors decide: without the words that they reach over, nothing that only they find is removed."""
    dice = random.Random(9)
    whole, edge = ([f"{c}{dice.randrange(10**6)}" for _ in range(90)] for c in "we")
    texts = [" ".join(whole), " ".join(whole), " ".join(edge[:60] + ["one"] * 9), " ".join(["two"] * 9 + edge[20:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = plain_removed(texts)
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()] == wanted and min(wanted) >= 40
    stream = substring_dedup._opened

    def single(held, row):
        return [(x[1], x[1] + substring_dedup.GRAM, x[4]) for x in held]

    # a wrapped function travels to the workers by value, with the parse that it finds here
    def opened(batches):
        yield from stream(batches)

    monkeypatch.setattr(substring_dedup, "parsed", single)
    monkeypatch.setattr(substring_dedup, "_opened", opened)
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()][:2] == [0, 0]


def test_vocabularies_that_cross_white_space_are_encoded_whole(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={c: k for k, c in enumerate(["a", "b", "Ġ", "Ġb"])}, merges=[("Ġ", "b")]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(str(tmp_path / "own.json"))
    assert not token_counts.splits_at_space(made.to_str())
    assert token_counts.splits_at_space(open(WORDS).read())
    texts = ["a b a", "", "ab  b", "b\na " * 9000]
    found = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "own.json"))
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {k: len(made.encode(t).ids) for k, t in enumerate(texts)}


def test_ordinary_long_documents_are_spliced():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    counter = token_counts.Counter(open(WORDS).read())
    random.seed(3)
    texts = [" ".join("".join(random.choice("abcdefé(9") for _ in range(random.randint(1, 12))) for _ in range(n)) for n in (10, 1000, 3000, 9000)]
    assert counter.counts([t.encode() for t in texts]) == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.spliced == sum(len(t) > token_counts.CHUNK for t in texts) == 2


def test_leaves_of_weight_0_are_no_room_and_no_token_is_lost(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 1000), ("a", "en", "y", 10), ("b", "en", "y", 1000)], "domain string, lang string, source string, tokens long")
    mixture = mixing.Mixture(weights={"source": {"x": 0}}, budget=500, epochs=1)
    given = {(r.domain, r.source): r.budget for r in mixing.budgets(leaves, mixture).collect()}
    assert given == {("a", "x"): 0, ("a", "y"): 10, ("b", "y"): 995}
    uneven = spark.createDataFrame([("a", "en", str(k), 100) for k in range(7)], "domain string, lang string, source string, tokens long")
    assert sum(r.budget for r in mixing.budgets(uneven, mixing.Mixture(budget=501, epochs=1)).collect()) == 350


def test_columns_of_any_name_go_through(spark):
    docs = spark.createDataFrame([(k, f"text {k % 2} " * 60, "en", "src1", 1) for k in range(6)], "doc_id long, text string, lang string, source string, `a.b` int").withColumn("`c", F.lit(2))
    mixed = mixing.mix(docs, mixing.Mixture(budget=999, epochs=1), F.lit("d"))
    assert mixed.columns == [*docs.columns, "__mix"] and mixed.count() > 0
    for kept in (exact_dedup.exact_dedup(docs), simhash.near_dedup(docs), jaccard.near_dedup(docs)):
        assert kept.columns == docs.columns and kept.count() == 2


def plain_bootstrap(docs, settings):
    """spans that the method adds, by plain loops over the same mentions."""
    rows = []
    for i, text in docs:
        base = sorted(pii.base_spans(text) + pii.secret_spans(text))
        rows += [(i, s, e, pii.CLASS_OF[k], k, text[s:e], pii.contexts(text, [(s, e)])[0]) for s, k, e in base]
        rows += [(i, s, e, c, None, text[s:e], pii.contexts(text, [(s, e)])[0]) for s, c, e in pii.candidates(text, base)]
    values, known = defaultdict(set), {}
    for _, _, _, c, k, v, patterns in rows:
        for p in patterns:
            values[c, p].add(v)
        if k is not None:
            known[c, v] = min(k, known.get((c, v), k))
    trusted = {}
    for _ in range(settings.rounds):
        trusted = {}
        for (c, p), vs in values.items():
            for kind, own in Counter(known[c, v] for v in vs if (c, v) in known).items():
                if own >= settings.seeds and own / (len(vs) + 1) >= settings.threshold:
                    trusted[c, p, kind] = own / (len(vs) + 1)
        doubt = defaultdict(lambda: 1.0)
        for (c, p, kind), confidence in trusted.items():
            for v in values[c, p]:
                if (c, v) not in known:
                    doubt[c, v, kind] *= 1 - confidence
        new = {}
        for (c, v, kind), d in doubt.items():
            new[c, v] = max(new.get((c, v), (-1, 0)), (1 - d, -kind))
        if not new:
            break
        known |= {key: -kind for key, (_, kind) in new.items()}
    found = set()
    for i, s, e, c, k, _, patterns in rows:
        hits = [(t, -kind) for (c2, p, kind), t in trusted.items() if c2 == c and p in patterns]
        if k is None and hits:
            found.add((i, s, -max(hits)[1], e))
    return found


def planted(n=400):
    """Texts with identifiers that base expressions see and that they don't, in telling and in other contexts, and what
    is to be found."""
    random.seed(11)
    noise = ["stone", "river", "green", "quickly", "under", "market", "seven", "old", "paper", "walk"]
    fill = lambda k: " ".join(random.choice(noise) for _ in range(k))
    docs, hidden = [], set()
    for i in range(n):
        kind = random.choice(["mail", "phone", "card"])
        number = "".join(random.choice("0123456789") for _ in range(10))
        context = {"mail": random.choice(["write to {} please", "contact us at {} today"]), "phone": random.choice(["call me on {} now", "my number is {} thanks"]), "card": "charged to card {} yesterday"}[kind]
        unseen = random.random() < 0.2
        value = {
            "mail": f"jo{number}(at)example.com" if unseen else f"jo{number}@example.com",
            "phone": number if unseen else f"+1 {number}",
            "card": "4" + "1" * 5 + number if unseen else "4539578763621486"[:6] + number,
        }[kind]
        if kind == "card":
            digits = [d for d in range(10) if pii.luhn(value[:-1] + str(d)) != unseen]
            value = value[:-1] + str(digits[0])
        start = fill(5) + " "
        before, after = context.split("{}")
        text = f"{start}{before}{value}{after} {fill(4)}. lot {random.randint(10**9, 10**10 - 1)} sold {fill(3)}"
        docs.append((i, text))
        if unseen:
            at = len(start) + len(before)
            hidden.add((i, at, {"mail": 0, "phone": 3, "card": 2}[kind], at + len(value)))
    return docs, hidden


def test_bootstrapping_equals_plain_loops_and_finds_what_was_planted(spark):
    docs, hidden = planted()
    settings = pii.Bootstrap()
    rows = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), settings).collect()
    found = {(r.doc_id, s.start, s.kind, s.end) for r in rows for s in r.spans if s not in r.base}
    assert found == plain_bootstrap(docs, settings)
    print("planted", len(hidden), "found", len(found), "right", len(found & hidden))
    assert len(found & hidden) >= 0.9 * len(hidden) and len(found & hidden) >= 0.95 * len(found)


def test_secrets_and_long_values():
    text = 'key token = "0123456789abcdef0123" end'
    assert [(text[s:e], k) for s, k, e in pii.secret_spans(text)] == [("0123456789abcdef0123", pii.SECRET)]
    long = "9" * 300
    assert pii.named(long) != pii.named(long + "9") and len(pii.named(long)) == 65
    assert pii.contexts("x" * 100 + " " + long + " y", [(101, 401)])[0][1] == "_ y"


def test_the_pii_query_says_what_its_spans_say(spark, tmp_path):
    rows = [(1, "a@b.example.com and 10.0.0.1 and c@d.example.com, 10.0.0.300"), (2, "+1 555 010 9999 or 4111 1111 1111 1111"), (3, None), (4, 'token = "0123456789abcdef0123" 10.1.1.1')]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op8_pii(spark, str(tmp_path)).collect():
        base = pii.base_spans(dict(rows)[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.spans == said and r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_secret == (r.doc_id == 4)


def plain_contexts(text, start, end):
    """Patterns of a span by walking from it, for texts of ASCII and words of 64 characters at most."""
    plain = lambda w: re.sub("[0-9]+", "0", w.lower())
    left, right = text[:start].split()[::-1], text[end:].split()
    first, second, last = (plain(x[k]) if len(x) > k else None for x, k in ((left, 0), (left, 1), (right, 0)))
    return [p for p, ok in ((f"{first} _", first), (f"_ {last}", last), (f"{first} _ {last}", first and last), (f"{second} {first} _", second), (f"{second} * _", second)) if ok]


def test_contexts_are_those_of_a_walk():
    for _ in range(300):
        text = "".join(random.choice("aB1 2\n:,@") for _ in range(random.randrange(1, 60)))
        spans = [tuple(sorted(random.sample(range(len(text) + 1), 2))) for _ in range(8)]
        assert pii.contexts(text, spans) == [plain_contexts(text, a, b) for a, b in spans]


def test_pieces_of_long_words_have_the_names_of_equal_words():
    word = "".join(random.choice("aB12é") for _ in range(500))
    cuts = sorted(random.sample(range(1, 501), 40))
    assert pii._prefix_names(word, cuts) == {c: pii._prefix_names(word[:c], [c])[c] for c in cuts}


def test_pii_of_a_long_text_without_white_space(spark):
    text = ",".join(f"user{k}@host{k % 997}.example.org" for k in range(330_000))
    assert len(text) > 10_000_000
    began = time.monotonic()
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("size(base)", "size(spans)").first()
    assert tuple(found) == (330_000, 330_000)
    assert time.monotonic() - began < 90


def test_columns_named_like_what_operators_make_keep_their_values(spark):
    names = ["__key", "__first", "__one", "__leaf", "__cut", "__copies", "__epoch", "__mix", "__KEY2"]
    rows = [(k, f"text {k // 2} " + "w " * 30, "en", f"src{k % 2}", *[f"{n}-{k}" for n in names]) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    own = {r[0]: r for r in rows}
    mixture = mixing.Mixture(weights={}, default=1, budget=800, epochs=1)
    mixed = mixing.mix(docs, mixture, F.lit("web"))
    assert mixed.columns == [*docs.columns, "___mix"]
    for kept in (exact_dedup.exact_dedup(docs), simhash.near_dedup(docs), jaccard.near_dedup(docs), mixed.drop("___mix")):
        got = [tuple(r) for r in kept.collect()]
        assert got and all(r == own[r[0]] for r in got)


def test_simhash_broadcasts_no_table(spark, monkeypatch):
    """Small tables too are dealt by key: at 0.5 GB a hash table of postings took 537 MB of the driver."""
    plans, save = [], simhash.Scratch.save

    def saved(self, df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, label)

    monkeypatch.setattr(simhash.Scratch, "save", saved)
    docs = spark.createDataFrame([(k, f"some words of text {k // 2}", "x") for k in range(40)], "doc_id long, text string, lang string")
    groups = simhash.near_groups(docs)
    plans.append(groups._jdf.queryExecution().executedPlan().toString())
    assert simhash.one_each(docs, groups, "doc_id", "text").count() == 20
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_chunks_are_counted_from_remembered_words():
    """Chunks of a long text give the library's count, and a word that was met is not encoded again."""
    from tokenizers import Tokenizer

    dice = random.Random(5)
    pieces = ["Foo", "BAR,", "it's", "é!", "ÉÉ", "中文", "a b.", "<|endoftext|>", "<|EndOfText|>", "x<|endoftext|>Y", "½", "é.", "12ab", "​", "\x01"]
    text = "".join(dice.choice(pieces) + dice.choice([" ", "\n", " \t ", "\x0b", "\x0c"]) for _ in range(4000))
    counter, plain = token_counts.Counter(open(WORDS).read()), Tokenizer.from_file(WORDS)
    wanted = len(plain.encode(text, add_special_tokens=False).ids)
    assert token_counts.spliced_count(text, counter.encode, 300, 40) == wanted
    assert counter.counts([text.encode(), b"", text[:50].encode()])[0] == wanted and counter.spliced == 1
    met, own = [], counter.encoder._ids
    counter.encoder._ids = lambda texts: met.extend(texts) or own(texts)
    assert counter.counts([text.encode()]) == [wanted] and not [w for t in met for w in t.split()]


def test_scratch_tables_leave_no_shuffles(spark):
    """Shuffles of a step that was written would lie on disk until the driver collects garbage."""
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    setting = spark.conf.get(common.FREED, None)
    before, scratch = files(), common.Scratch(spark, "test")
    dealt = spark.range(2000).repartition(3, "id")
    assert scratch.save(dealt, "dealt").count() == 2000
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common.FREED, None) == setting
    assert scratch.save(dealt.groupBy((F.col("id") % 7).alias("k")).count(), "counted").count() == 7 and dealt.count() == 2000
