"""Packing of token streams into windows by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window is filled in rounds: each active queue's deficit grows by
its share of the window, it sends as many whole tokens as its deficit holds, and the rest is carried to the next
window; the heaviest queue comes last and sends what the window still lacks, so its deficit is what the others carry.
Documents are cut where a share ends, so every window holds the target proportions to within a token a queue. When a
queue can't send its share any more, it sends what it has, the others fill that window, and they go on with the
window divided anew among them. Queues whose target is 0 are drained after the others.

What a queue has sent by a window is a function of the window alone: the whole part of its summed shares. So deficits
needn't be handed from task to task: each computes those that the window before its first one carries, whichever
partition that window is in. The driver plans phases, two at most for each of at most QUEUES queues; a document's place
in its queue comes from sums by partition, and its ids are cut where they lie.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import Scratch, documents, text_of
from tallyspark.llm.words import REMEMBERED as REMEMBERED
from tallyspark.llm.words import Encoder, id_type

#: Tokens of a window, the id that ends a document, and queues at most. With more queues than the root of WINDOW, the
#: heaviest may be asked for less than nothing, so the sources with the fewest documents share the last queue.
WINDOW, END, QUEUES = 4096, 2, 64
#: Characters of text encoded together.
BATCH_CHARS = 1_000_000


@dataclass(frozen=True)
class Phase:
    """windows windows from first on. sent: what each queue has sent before; shares: each active queue's weight, the
    heaviest one last; takes: for a phase of one window, what each queue sends instead, (queue, tokens)."""

    first: int
    windows: int
    sent: tuple[int, ...]
    shares: tuple[tuple[int, int], ...] = ()
    takes: tuple[tuple[int, int], ...] = ()

    def through(self, k: int, window: int) -> list[tuple[int, int]]:
        """(queue, tokens) that each queue has sent in this phase by the end of its k-th window."""
        if self.takes:
            return list(self.takes) if k else [(q, 0) for q, _ in self.takes]
        whole = sum(w for _, w in self.shares)
        found = [(q, k * window * w // whole) for q, w in self.shares[:-1]]
        return [*found, (self.shares[-1][0], k * window - sum(t for _, t in found))]


def _lasting(shares: list[tuple[int, int]], left: list[int], window: int) -> int:
    """How many windows the queues can send their whole shares."""
    whole = sum(w for _, w in shares)
    most = min(((left[q] + 1) * whole - 1) // (window * w) for q, w in shares[:-1]) if len(shares) > 1 else left[shares[0][0]] // window
    last = lambda k: k * window - sum(k * window * w // whole for _, w in shares[:-1])
    low, high = 0, max(most, 0)
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if last(k) <= left[shares[-1][0]] else (low, k - 1)
    return low


def plan(tokens: list[int], weights: list[int], window: int = WINDOW) -> list[Phase]:
    """The phases in which queues of so many tokens are drained in proportion to weights."""
    phases, at, sent, left = [], 0, [0] * len(tokens), list(tokens)

    def add(phase: Phase, moved) -> None:
        phases.append(phase)
        for q, t in moved:
            sent[q] += t
            left[q] -= t

    while any(left):
        active = [q for q in range(len(tokens)) if left[q] and weights[q] > 0]
        weight = {q: weights[q] for q in active} or {q: tokens[q] for q in range(len(tokens)) if left[q]}
        shares = sorted(weight.items(), key=lambda x: (x[1], -x[0]))
        n = _lasting(shares, left, window)
        if n:
            phase = Phase(at, n, tuple(sent), tuple(shares))
            add(phase, phase.through(n, window))
            at += n
        # a window in which some queue falls short: what it lacks is divided among those that have more, by weight
        takes, room = {}, window
        while room and any(left[q] > takes.get(q, 0) for q in range(len(tokens))):
            open_ = [q for q in weight if left[q] > takes.get(q, 0)]
            if not open_:
                weight = {q: tokens[q] for q in range(len(tokens)) if left[q] > takes.get(q, 0)}
                open_ = list(weight)
            open_.sort(key=lambda q: (weight[q], -q))
            whole, asked = sum(weight[q] for q in open_), room
            for q in open_:
                share = asked * weight[q] // whole if q != open_[-1] else room
                given = min(share, left[q] - takes.get(q, 0), room)
                takes[q] = takes.get(q, 0) + given
                room -= given
        moved = tuple((q, t) for q, t in takes.items() if t)
        if moved:
            add(Phase(at, 1, tuple(sent), takes=moved), moved)
            at += 1
    return phases


class Layout:
    """Where each token of each queue lies: sequence and offset."""

    def __init__(self, phases: list[Phase], queues: int, window: int = WINDOW):
        self.phases, self.window = phases, window
        # for each queue the phases in which it sends, by where in the queue they begin
        self.begins: list[list[int]] = [[] for _ in range(queues)]
        self.phase_of: list[list[int]] = [[] for _ in range(queues)]
        for k, phase in enumerate(phases):
            for q, _ in phase.takes or phase.shares:
                self.begins[q].append(phase.sent[q])
                self.phase_of[q].append(k)
        self.known: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
        last = phases[-1] if phases else None
        held = sum(t for _, t in last.takes) if last and last.takes else 0
        # a last window that isn't full is dealt to sequences whose sizes are powers of two
        self.short = last.first if 0 < held < window else -1
        sizes = [1 << b for b in reversed(range(held.bit_length())) if held >> b & 1]
        self.edges = [sum(sizes[:k]) for k in range(len(sizes) + 1)]

    def _slots(self, p: int, k: int) -> dict[int, tuple[int, int, int]]:
        """Of the k-th window of a phase: where each queue's share begins and ends in the queue, and its offset."""
        if (p, k) not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            phase, offset, found = self.phases[p], 0, {}
            for (q, a), (_, b) in zip(phase.through(k, self.window), phase.through(k + 1, self.window), strict=True):
                found[q] = (phase.sent[q] + a, phase.sent[q] + b, offset)
                offset += b - a
            self.known[p, k] = found
        return self.known[p, k]

    def _window_of(self, q: int, x: int) -> tuple[int, int]:
        """The phase and its window that token x of a queue lies in."""
        p = self.phase_of[q][bisect_right(self.begins[q], x) - 1]
        phase = self.phases[p]
        x -= phase.sent[q]
        if phase.takes:
            return p, 0
        whole, last = sum(w for _, w in phase.shares), phase.shares[-1][0]
        if q != last:
            return p, ((x + 1) * whole - 1) // (self.window * dict(phase.shares)[q])
        low, high = 0, phase.windows - 1
        while low < high:  # the last window before which no more than x tokens are sent
            k = (low + high + 1) // 2
            low, high = (k, high) if dict(phase.through(k, self.window))[q] <= x else (low, k - 1)
        return p, low

    def pieces(self, q: int, start: int, n: int):
        """(first token of the document, length, sequence, offset) of a document that begins at start in its queue."""
        done = 0
        p, k = self._window_of(q, start) if n else (0, 0)
        while done < n:
            begins, ends, offset = self._slots(p, k).get(q, (0, 0, 0))
            if ends <= start + done:
                if k + 1 < self.phases[p].windows:
                    k += 1
                else:
                    p, k = self._window_of(q, start + done)
                continue
            length = min(ends - start - done, n - done)
            window, at = self.phases[p].first + k, offset + start + done - begins
            if window != self.short:
                yield done, length, window, at
            else:
                cuts = [at, *(e for e in self.edges if at < e < at + length), at + length]
                for a, b in pairwise(cuts):
                    s = bisect_right(self.edges, a) - 1
                    yield done + a - at, b - a, window + s, a - self.edges[s]
            done += length


_kept: dict[str, Encoder] = {}


def _encoder(call: str, vocabulary) -> Encoder:
    if call not in _kept:
        _kept.clear()
        _kept[call] = Encoder(vocabulary.value)
    return _kept[call]


def queues_of(docs: DataFrame, source_col: str, weights: dict[str, float] | None) -> list[str]:
    """The sources with a queue of their own: those with a target, then those with the most rows, QUEUES - 1 at most.
    All others, and null ones, share the last queue."""
    named = list(weights or {})
    if len(named) >= QUEUES:
        raise ValueError(f"targets for at most {QUEUES - 1} sources")
    counts = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).filter(F.col("s").isNotNull() & ~F.col("s").isin(named))
    return named + [r.s for r in counts.orderBy(F.desc("n"), "s").limit(QUEUES - 1 - len(named)).collect()]


_DOC = [("doc_id", None), ("part", T.IntegerType()), ("queue", T.IntegerType()), ("before", T.LongType()), ("n", T.LongType()), ("ids", T.BinaryType())]
_PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("queue", T.IntegerType()), ("ids", T.ArrayType(T.LongType()))]


def pack(docs: DataFrame, path: str, weights: dict[str, float] | None = None, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, ids: one row per piece of a document.

    weights: target proportions of tokens by source; None stands for the proportions that the corpus has, which last to
    the end. path: a vocabulary of the tokenizers library; every document's ids are followed by end. All sequences hold
    window tokens, but for what the last window would lack: its tokens are dealt to sequences of powers of two, so none
    is padded. ids are left out (null) if not asked for.

    A null text counts as empty and packs end alone; a null id stays null; null sources share the last queue. Repeated
    rows are packed each. Very long texts are cut like any other, an empty table gives an empty one, and other columns
    are not read. Documents of a queue keep the table's order, so there is no tie.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    with open(path) as file:
        text = file.read()
    kind, vocabulary, call = id_type(text), spark.sparkContext.broadcast(text), uuid.uuid4().hex
    names = queues_of(docs, source_col, weights)
    place = F.array_position(F.lit(names), F.col(source_col).cast("string")) if names else F.lit(0)
    queue = F.coalesce(F.when(place > 0, place - 1), F.lit(len(names))).cast("int")
    given = docs.select(F.col(id_col).alias("doc_id"), queue.alias("queue"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    id_field = given.schema["doc_id"]
    schema = T.StructType([id_field, *[T.StructField(n, t) for n, t in _DOC[1:]]])

    def encoded(batches):
        encoder, part, before = _encoder(call, vocabulary), TaskContext.get().partitionId(), [0] * (len(names) + 1)
        last = np.array([end], kind).tobytes()
        for batch in batches:
            start, texts, chars = 0, [], 0

            def made(stop):
                own = batch.slice(start, stop - start)
                found = [i + last for i in encoder.encode(texts)]
                counts, queues, places = [len(i) // len(last) for i in found], own.column("queue").to_pylist(), []
                for q, n in zip(queues, counts):
                    places.append(before[q])
                    before[q] += n
                columns = [own.column("doc_id"), pa.array([part] * len(found), pa.int32()), own.column("queue"), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for k, t in enumerate(batch.column("text")):
                texts.append(t.as_py())
                chars += len(texts[-1])
                if chars > BATCH_CHARS:
                    yield made(k + 1)
                    start, texts, chars = k + 1, [], 0
            if texts:
                yield made(batch.num_rows)

    rows = scratch.save(given.mapInArrow(encoded, schema), "rows")
    by_part = rows.groupBy("part", "queue").agg(F.sum("n").alias("tokens"))
    starts = by_part.withColumn("base", F.coalesce(F.sum("tokens").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = scratch.save(starts, "starts")
    totals = {r.queue: r.tokens for r in starts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    tokens = [totals.get(q, 0) for q in range(len(names) + 1)]
    asked = [round((weights or {}).get(s, 0) * 1_000_000) for s in names] + [0]
    phases = plan(tokens, tokens if weights is None else asked, window)
    placed = rows.join(starts.select("part", "queue", "base"), ["part", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "ids")
    out = T.StructType([id_field, *[T.StructField(n, t) for n, t in _PIECE]])

    def cut(batches):
        layout = Layout(phases, len(tokens), window)
        for batch in batches:
            found: dict[str, list] = {name: [] for name, _ in _PIECE}
            which = []
            for k, (q, at, raw) in enumerate(zip(batch.column("queue").to_pylist(), batch.column("at").to_pylist(), batch.column("ids"))):
                own = np.frombuffer(raw.as_py(), kind).astype("<u4")
                wide = own.tobytes()
                for start, length, sequence, offset in layout.pieces(q, at, len(own)):
                    which.append(k)
                    crc = zlib.crc32(wide[4 * start : 4 * (start + length)])
                    for name, value in zip(found, (start, length, crc, len(own), sequence, offset, q, own[start : start + length].astype(np.int64) if ids else None)):
                        found[name].append(value)
                if len(which) >= 10_000:
                    yield pieces(batch, which, found)
                    found, which = {name: [] for name in found}, []
            if which:
                yield pieces(batch, which, found)

    def pieces(batch, which, found):
        arrow = {"queue": pa.int32(), "ids": pa.list_(pa.int64())}
        columns = [batch.column("doc_id").take(pa.array(which, pa.int64()))] + [pa.array(v, arrow.get(name, pa.int64())) for name, v in found.items()]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    return placed.mapInArrow(cut, out)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), ids=False).drop("ids", "queue")
