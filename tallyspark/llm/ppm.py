"""LM scoring by prediction by partial matching over bytes.

Training counts every byte after its ORDER preceding ones over the whole training part of the corpus. The shorter
contexts of the trie are made from the longer ones by Spark, with update exclusion: a shorter context counts a byte
once for each longer context that knows it. A byte is coded in the longest context that knows it. Each context on the
way down charges an escape (method D: a byte seen n times weighs 2n - 1, the escape as much as the context has seen
different bytes) and excludes its bytes from the contexts below. What a context excludes from the next is a sum over its children, so it is stored
with the context, and exclusion costs a subtraction.

Words are lower-cased (A-Z) and joined by one space; a text ends in a line feed and starts after ORDER of them, so its
score is the log10 probability of the whole text with its end. A text can also be scored adaptively, by a trie that
learns from the text alone.

The probability of a byte after its context is a number for each gram of ORDER + 1 bytes, whatever text it stands in,
so the corpus is read in chunks of at most CHUNK bytes and one text more, each with its distinct grams and words. These are counted,
the grams priced by joins with the levels of the trie, and the prices go back to the chunks that asked, where the texts
are summed up. No table of the model is ever whole in one place: driver and tasks hold what one chunk asks for. Words
go the same way, with their counts, for the base score. They are told apart by 62 bits of a hash. A gram lists the
chunks that ask for it, so its row grows with the corpus by a number for each CHUNK bytes. Texts travel compressed.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import Scratch, documents, text_of

ORDER = 5
#: Bytes of text that ask for their grams together, and that are counted and scored at a time, but for one text more.
CHUNK, COUNT_BYTES = 64_000_000, 1_000_000
#: Distinct grams that wait before they are merged into a chunk's.
MERGED = 1_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END_WORD = -1


def word_key(word: bytes) -> int:
    """Below END_WORD, as keys of grams are 0 or more."""
    return -(xxhash.xxh3_64_intdigest(word) >> 2) - 2


def _stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes, each after ORDER line feeds; where the coded bytes are, and where each text's begin among
    these."""
    lines = [b" ".join(words) + b"\n" for words in texts]
    sizes = np.array([len(x) for x in lines], np.int64)
    pad = b"\n" * ORDER
    data = np.frombuffer(b"".join(x for line in lines for x in (pad, line)), np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(sizes) + 1) * ORDER, sizes)
    return data, at, begins


def _grams(data: np.ndarray) -> np.ndarray:
    """For each byte from the ORDER-th on: the bytes before it and itself as one number."""
    wide = data.astype(np.int64)
    out = wide[: len(wide) - ORDER].copy() if len(wide) > ORDER else np.empty(0, np.int64)
    for k in range(1, ORDER + 1):
        out <<= 8
        out |= wide[k : len(wide) - ORDER + k]
    return out


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


class _Chunk:
    """The texts of a chunk as compressed lines, its distinct grams with their training counts, and its words."""

    def __init__(self, at_once: int):
        self.at_once = at_once
        self.waiting, self.portions, self.size, self.waiting_size = [], [], 0, 0
        self.grams, self.more = (np.empty(0, np.int64), np.empty(0, np.int64)), []
        self.words: Counter = Counter()
        self.trained = 0

    def add(self, text: bytes, held_out: bool) -> None:
        self.waiting.append((_words(text), held_out))
        self.size += len(text)
        self.waiting_size += len(text)
        if self.waiting_size > self.at_once:
            self.count()

    def count(self) -> None:
        if not self.waiting:
            return
        data, at, begins = _stream([w for w, _ in self.waiting])
        held = np.array([h for _, h in self.waiting])
        sizes = np.diff(np.concatenate((begins, [len(at)])))
        # the lowest bit tells held-out occurrences, which ask but don't count
        keys, counts = np.unique(_grams(data)[at - ORDER] << 1 | np.repeat(held, sizes), return_counts=True)
        self.more.append((keys >> 1, np.where(keys & 1, 0, counts)))
        if sum(len(k) for k, _ in self.more) > max(MERGED, len(self.grams[0])):
            self.merge()
        for words, held_out in self.waiting:
            self.words.update(dict.fromkeys(words, 0) if held_out else words)
            self.trained += not held_out
        lines = [b" ".join(w) for w, _ in self.waiting]
        self.portions.append((list(map(len, lines)), zstandard.compress(b"".join(lines))))
        self.waiting, self.waiting_size = [], 0

    def merge(self) -> None:
        keys, counts = (np.concatenate([self.grams[k], *(x[k] for x in self.more)]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.grams, self.more = (keys[first], np.add.reduceat(counts, first) if len(first) else counts), []

    def rows(self, chunk: int, ids: pa.Array, held: pa.Array) -> list[pa.RecordBatch]:
        self.count()
        self.merge()
        words = np.fromiter(map(word_key, self.words), np.int64, len(self.words))
        key = np.concatenate((self.grams[0], words, [END_WORD]))
        count = np.concatenate((self.grams[1], np.fromiter(self.words.values(), np.int64, len(words)), [self.trained]))
        n, ends = len(self.portions), np.cumsum([0] + [len(sizes) for sizes, _ in self.portions]).astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
        sizes = pa.array([x for own, _ in self.portions for x in own], pa.int32())
        asked = [pa.array(np.full(len(key), chunk)), pa.array(key), pa.array(count), *(pa.nulls(len(key), pa.list_(t)) for t in (ids.type, held.type, pa.int32())), pa.nulls(len(key), pa.binary())]
        texts = [pa.array(np.full(n, chunk)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), lists(ids), lists(held), lists(sizes), pa.array([x for _, x in self.portions], pa.binary())]
        names = ["chunk", "key", "n", "ids", "held", "sizes", "lines"]
        return [pa.RecordBatch.from_arrays(x, names=names) for x in (texts, asked)]


def _chunked(size: int, at_once: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        chunk, ids, held = _Chunk(at_once), [], []
        for batch in batches:
            done = 0
            for k, (t, h) in enumerate(zip(batch.column("text"), batch.column("held_out").to_pylist())):
                chunk.add(t.as_py(), h)
                if chunk.size > size:
                    ids.append(batch.column("doc_id").slice(done, k + 1 - done))
                    held.append(batch.column("held_out").slice(done, k + 1 - done))
                    yield from chunk.rows(number, pa.concat_arrays(ids), pa.concat_arrays(held))
                    chunk, ids, held, done = _Chunk(at_once), [], [], k + 1
                    number += 1
            ids.append(batch.column("doc_id").slice(done))
            held.append(batch.column("held_out").slice(done))
        if chunk.size or sum(map(len, ids)):
            yield from chunk.rows(number, pa.concat_arrays(ids), pa.concat_arrays(held))

    return run


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def trie(grams: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 0: (key, n) of its grams, n being the weight, and (key, total, kinds, excluded) of its
    contexts, where excluded is what the children of a context weigh in the context one byte shorter."""
    levels = {ORDER: grams.select("key", "n")}
    for order in range(ORDER - 1, -1, -1):
        shorter = levels[order + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("key")).agg(F.count("*").alias("n"))
        levels[order] = scratch.save(shorter, f"grams-{order}")
    levels = {order: counted.withColumn("n", 2 * F.col("n") - 1) for order, counted in levels.items()}
    out = []
    for order in range(ORDER + 1):
        own = levels[order].withColumn("below", F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1)))
        if order:
            own = own.join(levels[order - 1].select(F.col("key").alias("below"), F.col("n").alias("weighs")), "below")
        else:
            own = own.withColumn("weighs", F.lit(0).cast("bigint"))
        contexts = own.groupBy(F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("weighs").alias("excluded"))
        out.append((levels[order], scratch.save(contexts, f"contexts-{order}")))
    return out


class Table:
    """Open addressing over sorted arrays: places of keys, -1 for what is absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.slots[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys)) if len(self.keys) else np.empty(0, np.int64)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found[open_] = self.slots[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


def unknown_prices(grams: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """key, price: log10 probability of grams that training has not seen, down the contexts until one knows the byte."""
    long = lambda x: F.lit(x).cast("long")
    todo = grams.select("key", F.lit(0.0).alias("price"), long(0).alias("weigh"), long(0).alias("gone"), F.lit(False).alias("done"))
    for order in range(ORDER, -1, -1):
        known, contexts = levels[order]
        own = F.col("key").bitwiseAND(long((1 << 8 * (order + 1)) - 1))
        todo = todo.withColumn("own", own).withColumn("context", F.shiftright("own", 8))
        todo = todo.join(contexts.select(F.col("key").alias("context"), "total", "kinds", "excluded"), "context", "left")
        if order < ORDER:
            todo = todo.join(known.select(F.col("key").alias("own"), F.col("n").alias("weight")), "own", "left")
        else:
            todo = todo.withColumn("weight", F.lit(None).cast("long"))
        seen = F.col("total").isNotNull()
        left, kinds = F.when(seen, F.col("total") - F.col("weigh")).otherwise(long(0)), F.when(seen, F.col("kinds") - F.col("gone")).otherwise(long(0))
        whole = F.greatest(left + kinds, long(1))
        coded = F.col("weight").isNotNull()
        step = F.when(coded, F.log10(F.col("weight") / whole)).when(kinds > 0, F.log10(kinds / whole)).otherwise(0.0)
        todo = todo.select(
            "key",
            F.when(F.col("done"), F.col("price")).otherwise(F.col("price") + step).alias("price"),
            F.coalesce("excluded", long(0)).alias("weigh"),
            F.coalesce("kinds", long(0)).alias("gone"),
            (F.col("done") | coded).alias("done"),
        )
    return todo.select("key", F.when(F.col("done"), F.col("price")).otherwise(F.col("price") - F.log10(256 - F.col("gone"))).alias("price"))


def _summed(lines: list[bytes], grams: Table, prices: np.ndarray, words: Table, counts: np.ndarray, end_n: float, whole: float) -> list[pa.Array]:
    """n_tokens, n_known, base_score and score of texts whose grams and words all have prices and counts."""
    texts = [x.split(b" ") if x else [] for x in lines]
    sizes = np.array([len(x) for x in texts], np.int64)
    coded = pa.array([w for x in texts for w in x], pa.binary()).dictionary_encode()
    keys = np.fromiter(map(word_key, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    n = counts[words.find(keys)] if len(keys) else np.empty(0)
    codes, text_no = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    n_known = np.bincount(text_no, (n > 0)[codes], len(texts)).astype(np.int64) + (end_n > 0)
    base = np.bincount(text_no, np.log10((n + 0.1) / whole)[codes], len(texts)) + math.log10((end_n + 0.1) / whole)
    data, places, begins = _stream(texts)
    score = np.add.reduceat(prices[grams.find(_grams(data)[places - ORDER])], begins)
    return [pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(score)]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Learns from the rows where held_out is false; by default ids whose crc32 is divisible by ten are held out, and
    rows without an id are learnt from. Null texts count as empty: their one token is the end. Without any row to
    learn from, every byte has one chance in 256. Repeated rows count as often as they stand there, and nothing ties.
    A very long text is a chunk by itself. An empty table gives an empty one; other columns of docs are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    given = docs.select(
        F.col(id_col).alias("doc_id"), (is_held_out(id_col) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), F.encode(text_of(text_col), "UTF-8").alias("text")
    )
    own = [T.StructField(f.name, f.dataType) for f in (given.schema["doc_id"], given.schema["held_out"])]
    lists = [T.StructField(n, T.ArrayType(t)) for n, t in (("ids", own[0].dataType), ("held", T.BooleanType()), ("sizes", T.IntegerType()))]
    parts = T.StructType([*T._parse_datatype_string("chunk bigint, key bigint, n bigint").fields, *lists, T.StructField("lines", T.BinaryType())])
    chunks = scratch.save(given.mapInArrow(_chunked(CHUNK, COUNT_BYTES), parts), "chunks")
    counted = scratch.save(chunks.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")), "counts")
    words = counted.filter("key < 0").select("key", "n")
    known_words = words.filter("n > 0")
    tokens, distinct, end_n = known_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("key") == END_WORD, F.col("n"))), F.lit(0))).first()
    whole = tokens + 0.1 * (distinct + 1)
    grams = counted.filter("key >= 0").select("key", "n")
    levels = trie(grams.filter("n > 0"), scratch)
    longest = levels[ORDER][1].select(F.col("key").alias("context"), "total", "kinds")
    known = grams.filter("n > 0").withColumn("context", F.shiftright("key", 8)).join(longest, "context").select("key", F.log10((2 * F.col("n") - 1) / (F.col("total") + F.col("kinds"))).alias("price"))
    priced = known.unionByName(unknown_prices(grams.filter("n = 0"), levels)).unionByName(words.select("key", F.col("n").cast("double").alias("price")))
    priced = scratch.save(priced, "prices")
    scratch.keep("chunks", "counts", "prices")
    answers = counted.select("key", "chunks").join(priced, "key").select(F.explode("chunks").alias("asker"), "key", "price")
    schema = T.StructType([*own, *T._parse_datatype_string("n_tokens bigint, n_known bigint, base_score double, score double").fields])

    def summed(texts: pa.Table, found: pa.Table) -> pa.Table:
        key, price = found.column("key").to_numpy(), found.column("price").to_numpy()
        gram_table, prices, word_table, counts = Table(key[key >= 0]), price[key >= 0], Table(key[key < 0]), price[key < 0]
        out: list[list[pa.Array]] = [[] for _ in schema.names]
        for row in range(texts.num_rows):
            data, at, lines = zstandard.decompress(texts.column("lines")[row].as_py()), 0, []
            for size in texts.column("sizes")[row].as_py():
                lines.append(data[at : at + size])
                at += size
            made = _summed(lines, gram_table, prices, word_table, counts, end_n, whole)
            for column, values in zip(out, [texts.column("ids")[row].values, texts.column("held")[row].values, *made]):
                column.append(values)
        return pa.table([pa.chunked_array(c) for c in out], names=schema.names)

    texts = chunks.filter("lines is not null").select("chunk", "ids", "held", "sizes", "lines")
    rows = texts.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(summed, schema)
    return rows.withColumn("train_tokens", F.lit(int(tokens)).cast("bigint")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def adaptive_score(text: bytes) -> float:
    """log10 probability of one text by a trie that learns from the text as it goes."""
    data = b"\n" * ORDER + b" ".join(_words(text)) + b"\n"
    trie: dict[bytes, Counter] = defaultdict(Counter)
    total = 0.0
    for i in range(ORDER, len(data)):
        excluded: set[int] = set()
        coded = -1
        for order in range(ORDER, -1, -1):
            left = {b: 2 * n - 1 for b, n in trie[data[i - order : i]].items() if b not in excluded}
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                total += math.log10(left[data[i]] / whole)
                coded = order
                break
            if left:
                total += math.log10(len(left) / whole)
                excluded |= set(left)
        else:
            total -= math.log10(256 - len(excluded))
        for order in range(max(coded, 0), ORDER + 1):
            trie[data[i - order : i]][data[i]] += 1
    return total


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
