"""Importance resampling towards a target distribution, without replacement.

Features are hashed into a fixed number of buckets. Counts of all texts and of the target's give every bucket a gain,
an array that the number of buckets bounds, and a document's weight is the mean of its features' places in it. With
Gumbel noise from the id a weight becomes a score, and the highest scores are the draw.

Eligible documents are sorted within their partition into runs, and these are cut into blocks. The count of every
score, whose number the logarithms bound, says where the draw ends and cuts the order into ranges of about equal
size; what lies beyond the draw never travels. A range's blocks come to one task in the order of their first rows,
through Spark's own external sort, and a tournament tree merges the runs: a block is opened when the merge reaches it,
so a task holds no more than a block or two of a run. Ranks start at what the ranges before hold, and the merge stops
ranking at the exact draw.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import Scratch, documents, text_of

#: Rows of a block, and drawn rows of a range from which more ranges are made than there are shuffle partitions.
BLOCK, RANGE = 4096, 1 << 20
#: Words whose features are hashed together.
PART = 200_000
_KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Resampling:
    """buckets of features; share of the eligible that is drawn, as a fraction; words that an eligible document has at
    least; seed of the noise."""

    buckets: int = 10_000
    share: tuple[int, int] = (25, 100)
    least_words: int = 20
    seed: str = "7"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def buckets_of(words: list[bytes], buckets: int) -> np.ndarray:
    """The bucket of each run of one and of two words; a long text's words are hashed PART at a time."""
    found = []
    for k in range(0, len(words), PART):
        own = words[k : k + PART + 1]
        single = list(map(zlib.crc32, own))
        double = list(map(zlib.crc32, [b" " + w for w in own[1:]], single))  # a sum goes on where the first word's ended
        found.append(np.array(single[:PART] + double, np.uint32) % np.uint32(buckets))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def feature_counts(docs: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. A task adds its texts up, so what is shuffled is a row per
    task and bucket."""
    given = docs.select(F.encode(text_of(text_col), "UTF-8").alias("text"))

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                total += np.bincount(buckets_of(words_of(t.as_py()), buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in given.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket adds to a weight, in thousandths of a natural logarithm."""
    n = len(corpus)
    all_, wanted = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_ + n) / ((s + 1) * (wanted + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(name: str, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = [(n, T.LongType()) for n in ("n_words", "n_features", "weight", "score")]


def scores(docs: DataFrame, gain: np.ndarray, settings: Resampling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row per row of docs."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    schema = T.StructType([given.schema["doc_id"], *[T.StructField(n, t) for n, t in _SCORED]])
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = sent.value
        for batch in batches:
            rows = []
            for name, t in zip(batch.column("name").to_pylist(), batch.column("text")):
                words = words_of(t.as_py())
                found = buckets_of(words, len(gain))
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((len(words), len(found), weight, weight + noise(name, settings.seed)))
            columns = zip(*rows) if rows else repeat([], len(_SCORED))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=schema.names)

    return given.mapInArrow(run, schema)


class Tournament:
    """A tree of matches between runs: the winner, the run with the smallest head, is at the top, and when it moves on
    only the matches on its path are played again. Runs join as they come; the tree doubles when its leaves are full."""

    def __init__(self):
        self.heads: list = []
        self.size = 1
        self.winners = [-1, -1]

    def _better(self, a: int, b: int) -> int:
        if a < 0 or self.heads[a] is None:
            return b if b >= 0 and self.heads[b] is not None else -1
        if b < 0 or self.heads[b] is None:
            return a
        return a if self.heads[a] <= self.heads[b] else b

    def _play(self, leaf: int) -> None:
        at = (self.size + leaf) // 2
        while at:
            self.winners[at] = self._better(self.winners[2 * at], self.winners[2 * at + 1])
            at //= 2

    def add(self) -> int:
        self.heads.append(None)
        if len(self.heads) > self.size:
            self.size *= 2
            self.winners = [-1] * self.size + list(range(len(self.heads))) + [-1] * (self.size - len(self.heads))
            for at in range(self.size - 1, 0, -1):
                self.winners[at] = self._better(self.winners[2 * at], self.winners[2 * at + 1])
        else:
            self.winners[self.size + len(self.heads) - 1] = len(self.heads) - 1
        return len(self.heads) - 1

    def put(self, leaf: int, head) -> None:
        self.heads[leaf] = head
        self._play(leaf)

    def winner(self) -> int:
        top = self.winners[1]
        return top if top >= 0 and self.heads[top] is not None else -1


def _key(score: int, name) -> tuple:
    return -score, name is not None, name if name is not None else 0


def merged(blocks):
    """Rows of the blocks of one range in order. blocks: (run, keys, rows), in the order of their first keys; a run's
    blocks follow each other. A row is yielded when no block that is still to come can begin before it."""
    tree, leaf_of, open_ = Tournament(), {}, {}

    def advance(leaf):
        queue = open_[leaf]
        keys, _, at = queue[0]
        if at + 1 < len(keys):
            queue[0][2] = at + 1
        else:
            queue.pop(0)
        tree.put(leaf, queue[0][0][queue[0][2]] if queue else None)

    def drained(bound):
        while (leaf := tree.winner()) >= 0 and (bound is None or tree.heads[leaf] < bound):
            keys, rows, at = open_[leaf][0]
            yield rows[at]
            advance(leaf)

    for run, keys, rows in blocks:
        yield from drained(keys[0])
        if run not in leaf_of:
            leaf_of[run] = tree.add()
            open_[leaf_of[run]] = []
        leaf = leaf_of[run]
        open_[leaf].append([keys, rows, 0])
        if len(open_[leaf]) == 1:
            tree.put(leaf, keys[0])
    yield from drained(None)


def _ranges(counts: list[tuple[int, int]], drawn: int, parts: int) -> list[tuple[int, int, int]]:
    """(lowest score, rows before, rows) of each range that the draw reaches, highest scores first."""
    per, found, before, held = max(1, math.ceil(drawn / parts)), [], 0, 0
    for score, n in sorted(counts, reverse=True):
        if before >= drawn:
            break
        held += n
        if held >= per or before + held >= drawn:
            found.append((score, before, held))
            before, held = before + held, 0
    return found


def resampled(docs: DataFrame, target: DataFrame, settings: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs; rank is 1, 2, 3... for the drawn ones, by
    falling score, ties to the smaller id, and null for the others.

    A null text has no features and weight 0. A null id takes its noise from an empty name and comes before others of
    its score; rows that share score and id are ranked one after the other in any order. Very long texts are hashed in
    portions; an empty table gives an empty one, and an empty target is one without features. Other columns are not
    read. All rows of one score are one range at least, so a score that a great part of the rows share is merged by one
    task, a block of a run at a time; scores are that equal only where ids repeat.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    gain = gains(feature_counts(docs, settings.buckets, text_col), feature_counts(target, settings.buckets, target_text))
    rows = scratch.save(scores(docs, gain, settings, id_col, text_col), "scored")
    able = F.col("n_words") >= settings.least_words
    counts = [(r.score, r.n) for r in rows.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()]
    over, under = settings.share
    drawn = over * sum(n for _, n in counts) // under
    ranges = _ranges(counts, drawn, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(drawn / RANGE)))
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not ranges:
        return rows.select(*names, none)
    cut = F.lit(ranges[-1][0])
    beyond = rows.filter(~able | (F.col("score") < cut)).select(*names, none)
    floors = np.array([-low for low, _, _ in ranges])
    field = rows.schema["doc_id"]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in names[1:]]
    made = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("head", T.LongType()), T.StructField("least", field.dataType), T.StructField("ids", T.ArrayType(field.dataType)), *lists])
    sorted_ = rows.filter(able & (F.col("score") >= cut)).select(*names).sortWithinPartitions(F.desc("score"), F.col("doc_id").asc_nulls_first())

    def runs(batches):
        """Blocks of this partition's run; none reaches from one range into the next."""
        run, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            score = batch.column("score").to_numpy()
            own = np.searchsorted(floors, -score)
            ends = np.flatnonzero(own[1:] != own[:-1]) + 1
            edges = sorted({0, len(own), *ends.tolist(), *range(0, len(own), block)})
            spans = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
            offsets = pa.array(edges if spans else [0], pa.int32())
            listed = [pa.ListArray.from_arrays(offsets, batch.column(n)) for n in names]
            first = pa.array([a for a, _ in spans], pa.int64())
            columns = [pa.array(own[first.to_numpy()].astype(np.int32)), pa.array([run] * len(spans), pa.int32()), pa.array(range(seq, seq + len(spans)), pa.int64()), pa.array(score[first.to_numpy()]), batch.column("doc_id").take(first), *listed]
            seq += len(spans)
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    before = [b for _, b, _ in ranges]
    # a null head is smaller than any, as in the order of the rows
    dealt = sorted_.mapInArrow(runs, made).repartitionById(len(ranges), F.col("range")).sortWithinPartitions("range", F.desc("head"), F.col("least").asc_nulls_first(), "run", "seq")
    out = T.StructType([field, *[T.StructField(n, T.LongType()) for n in (*names[1:], "rank")]])

    def ranked(batches):
        def blocks():
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, *numbers = (batch.column(n)[k].as_py() for n in ("ids", *names[1:]))
                    yield batch.column("range")[k].as_py(), batch.column("run")[k].as_py(), list(zip(ids, *numbers))

        def chunks(rows, at):
            held = []
            for row in rows:
                at += 1
                held.append((*row, at if at <= drawn else None))
                if len(held) == block:
                    yield held
                    held = []
            if held:
                yield held

        for where, some in _grouped(blocks()):
            keyed = ((run, [_key(r[3], r[0]) for r in rows], rows) for run, rows in some)
            for held in chunks(merged(keyed), before[where]):
                columns = list(zip(*held))
                types = [batch_type, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=out.names)

    batch_type = _arrow_type(field.dataType)
    return beyond.unionByName(dealt.mapInArrow(ranked, out))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _grouped(blocks):
    """(range, its blocks) for blocks that come sorted by range, one range's blocks being read before the next."""
    held = next(blocks, None)
    while held is not None:
        where = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == where:
                yield held[1], held[2]
                held = next(blocks, None)

        yield where, own()


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
