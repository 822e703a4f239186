"""Token counts by overlap resynchronisation.

A document of more than CHUNK characters is encoded in overlapping chunks with offsets. Where two chunks overlap, a
position counts as a stable common boundary if both start a token there, white space stands before it, and both give
the same tokens from there to the end of the overlap. White space is what makes it a proof and not a guess: the
vocabulary's normaliser and its splitting pattern carry nothing across it, and no special token holds any. The left
chunk counts up to the boundary and the right one from it on. Where an overlap holds no boundary, it is widened until
one is found or the text ends.

A shorter document is one chunk. Chunks are encoded word by word, which the same proof allows; a task remembers words
up to a bound of bytes, as most of its time would else go to words it has seen. Whether the proof holds is read from the
vocabulary's file; for one that carries anything across white space, documents are encoded whole by the library.
Texts stay in their task and nothing is shuffled.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import documents, text_of
from tallyspark.llm.words import WHITE, Encoder
from tallyspark.llm.words import splits_at_space as splits_at_space

#: Characters of a chunk and of an overlap, and tokens that are no more than a model takes.
CHUNK, OVERLAP, LIMIT = 8192, 256, 2048
#: Characters of text counted together.
BATCH_CHARS = 1_000_000
#: Which bytes are white space.
BLANK = np.isin(np.arange(256), [ord(c) for c in WHITE])

Encode = Callable[[str], tuple[list[int], list[int]]]


def _boundary(text: str, left, left_at: int, right, right_at: int, end: int) -> int:
    """First stable common boundary in text[right_at:end], -1 if there is none. left, right: ids and sorted starts."""
    first = bisect_left(left[1], right_at - left_at)
    starts = {s + left_at: k for k, s in reversed(list(enumerate(left[1][first:], first)))}
    for k, s in enumerate(right[1]):
        p = s + right_at
        if p >= end:
            break
        if p <= right_at or text[p - 1] not in WHITE or text[p] in WHITE or p not in starts:
            continue
        # the last word of the overlap may be cut short on the left, so it is not compared
        stop = next((x for x in range(end - 1, p, -1) if text[x] in WHITE), p)
        until = bisect_left(right[1], stop - right_at, k)
        own = [(i, x + left_at) for i, x in zip(left[0][starts[p] :], left[1][starts[p] :], strict=True) if x + left_at < stop]
        other = [(i, x + right_at) for i, x in zip(right[0][k:until], right[1][k:until], strict=True)]
        if own == other:
            return p
    return -1


def spliced_count(text: str, encode: Encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, from chunks. encode: a text's ids and the
    character that each token or its word starts at, in order."""
    n, total, counted_to = len(text), 0, 0
    at, end = 0, min(n, chunk + overlap)
    left = encode(text[at:end])
    while end < n:
        next_at = end - overlap
        next_end = min(n, next_at + chunk + overlap)
        right, wider = encode(text[next_at:next_end]), overlap
        while (p := _boundary(text, left, at, right, next_at, end)) < 0:
            wider *= 2
            end = min(n, end + wider)
            left = encode(text[at:end])
            if end == n:
                return total + len(left[1]) - bisect_left(left[1], counted_to - at)
            if end >= next_end:
                next_end = min(n, end + chunk)
                right = encode(text[next_at:next_end])
        total += bisect_left(left[1], p - at) - bisect_left(left[1], counted_to - at)
        left, at, end, counted_to = right, next_at, next_end, p
    return total + len(left[1]) - bisect_left(left[1], counted_to - at)


class Counter:
    """vocabulary: the text of a tokenizers file. spliced: documents that went through chunks so far."""

    def __init__(self, vocabulary: str):
        self.encoder = Encoder(vocabulary)
        self.size = np.dtype(self.encoder.kind).itemsize
        self.spliced = 0

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """ids, and for each the character that its word starts at: a boundary has white space before it, so no other
        place is asked for."""
        raw = text.encode()
        [own] = self.encoder.by_word([raw])
        letters = np.frombuffer(raw, np.uint8)
        blank = BLANK[letters]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        if len(raw) > len(text):  # from bytes to characters
            starts = (np.cumsum(letters & 0xC0 != 0x80) - 1)[starts]
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // self.size
        return np.frombuffer(b"".join(own), self.encoder.kind).tolist(), np.repeat(starts, lengths).tolist()

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.encoder.by_words:
            return [len(ids) // self.size for ids in self.encoder.encode(texts)]
        whole = [t.decode() if len(t) > CHUNK else "" for t in texts]
        long = [len(s) > CHUNK for s in whole]
        short = iter(self.encoder.by_word([t for x, t in zip(long, texts, strict=True) if not x]))
        self.spliced += sum(long)
        return [spliced_count(s, self.encode) if x else sum(map(len, next(short))) // self.size for x, s in zip(long, whole, strict=True)]


_kept: dict[str, Counter] = {}


def _counter(call: str, vocabulary) -> Counter:
    """The worker's own, kept from task to task for the words it remembers."""
    if call not in _kept:
        _kept.clear()
        _kept[call] = Counter(vocabulary.value)
    return _kept[call]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs, any order.

    A null text counts as empty, a null id stays null, and an empty table gives an empty one. Repeated rows get a row
    each; other columns of docs are not read. Very long texts are read in chunks; there is no order to tie in. The
    vocabulary is read from its file by the driver and sent to the tasks, as executors need not hold it.
    """
    with open(path) as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    call = uuid.uuid4().hex
    given = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    longs = [T.StructField(name, T.LongType()) for name in ("n_bytes", "n_tokens")]
    schema = T.StructType([given.schema["doc_id"], *longs, T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = _counter(call, vocabulary)
        for batch in batches:
            texts, sizes, counts, chars = [], [], [], 0
            for t in batch.column("text"):
                t = t.as_py()
                texts.append(t)
                sizes.append(len(t))
                chars += len(t)
                if chars > BATCH_CHARS:
                    counts += counter.counts(texts)
                    texts, chars = [], 0
            counts += counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=schema.names,
            )

    return given.mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
