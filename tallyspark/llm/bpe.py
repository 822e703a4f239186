"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a token as a whole costs one probe and one
comparison. Tier two merges the rest by a heap over linked bytes; which pairs of tokens make another, and its rank, is
looked up in the same hash once, for all ways to cut a token in two.
Each task splits whole texts by the pattern, looks distinct pre-tokens up once a batch, and spreads the ids over the
text with array operations; nothing is shuffled. What is broadcast is the vocabulary, whose size its file fixes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import documents, text_of

#: Characters of text looked up together, and pre-tokens of one text held together.
BATCH_CHARS, BATCH_PIECES = 500_000, 200_000
#: Distinct pre-tokens that a worker remembers, and ids of theirs, each standing for a few bytes of pre-token.
REMEMBERED, REMEMBERED_IDS = 600_000, 3_000_000
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PerfectHash:
    """A minimal perfect hash by displacement: keys fall into as many groups as there are keys; groups of two and
    more, largest first, get the first displacement that sends all of theirs to free slots, and single keys are given
    the slots that are left (stored as -slot - 1)."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        groups: list[list[int]] = [[] for _ in range(n)]
        for k, g in enumerate((hashes % np.uint64(max(n, 1))).tolist()):
            groups[g].append(k)
        self.displaced = np.zeros(n, np.int64)
        self.keys: list[bytes | None] = [None] * n
        whole = hashes.tolist()
        for g in sorted(range(n), key=lambda g: -len(groups[g])):
            if len(groups[g]) < 2:
                break
            d = 1
            while True:
                slots = [self._slot(whole[k], d) for k in groups[g]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displaced[g] = d
            for k, s in zip(groups[g], slots, strict=True):
                self.keys[s] = keys[k]
        free = iter([s for s in range(n) if self.keys[s] is None])
        for g in range(n):
            if len(groups[g]) == 1:
                s = next(free)
                self.displaced[g] = -s - 1
                self.keys[s] = keys[groups[g][0]]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * ODD[0] & 0xFFFFFFFFFFFFFFFF)) * ODD[1] & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot, -1 for what is not a key."""
        h = xxhash.xxh3_64_intdigest(key)
        d = int(self.displaced[h % self.n])
        s = -d - 1 if d < 0 else self._slot(h, d)
        return s if self.keys[s] == key else -1

    def slots(self, keys: list[bytes]) -> list[int]:
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        d = self.displaced[(h % np.uint64(self.n)).astype(np.int64)]
        mixed = (((h ^ (d.astype(np.uint64) * np.uint64(ODD[0]))) * np.uint64(ODD[1])) >> np.uint64(32)) % np.uint64(self.n)
        found = np.where(d < 0, -d - 1, mixed.astype(np.int64)).tolist()
        own = self.keys
        return [s if own[s] == k else -1 for s, k in zip(found, keys, strict=True)]


class Vocabulary:
    """What is broadcast: the hash, each slot's rank, which is also the token's id, and the pairs of tokens that make
    another, as left << 32 | right, with its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks))
        self.ids = [ranks[k] for k in self.hash.keys]
        self.bytes_of = {ranks[k]: k for k in ranks}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        halves = [(token[:k], token[k:], rank) for token, rank in ranks.items() for k in range(1, len(token))]
        left, right = (np.array(self.hash.slots([h[side] for h in halves]), np.int64) for side in (0, 1))
        both, ids = (left >= 0) & (right >= 0), np.array(self.ids, np.int64)
        self.pair_keys = ids[left[both]] << 32 | ids[right[both]]
        self.pair_ranks = np.array([h[2] for h in halves], np.int64)[both]


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern)
        self.pairs = dict(zip(vocabulary.pair_keys.tolist(), vocabulary.pair_ranks.tolist(), strict=True))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = array("I")
        self.starts = array("q", [0])

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: of all neighbours the pair of the lowest rank merges first, the leftmost of equals. The heap holds
        rank << 32 | place; rank_at tells which entries still stand for a pair."""
        ids = list(map(self.v.byte_ids.__getitem__, piece))
        n = len(ids)
        rank = self.pairs.get
        rank_at = [rank(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        heap = [r << 32 | i for i, r in enumerate(rank_at) if r >= 0]
        if not heap:
            return ids
        heapify(heap)
        rank_at.append(-1)  # nothing follows the last
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if rank_at[i] != r:
                continue  # one of the two has merged with another since
            j = after[i]
            k = after[j]
            ids[i], ids[j], rank_at[j] = r, -1, -1
            after[i] = k
            if k < n:
                before[k] = i
                rank_at[i] = x = rank(r << 32 | ids[k], -1)
                if x >= 0:
                    heappush(heap, x << 32 | i)
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                rank_at[h] = x = rank(ids[h] << 32 | r, -1)
                if x >= 0:
                    heappush(heap, x << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each piece has."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self._forget()
        new = [p for p in distinct if p not in self.known]
        raw = [p.encode() for p in new]
        for p, b, s in zip(new, raw, self.v.hash.slots(raw) if raw else [], strict=True):
            self.known[p] = len(self.starts) - 1
            if s >= 0:
                self.flat.append(self.v.ids[s])
            else:
                self.flat.extend(self.merged(b))
            self.starts.append(len(self.flat))
        at = np.array([self.known[p] for p in distinct], np.int64)
        starts = np.frombuffer(self.starts, np.int64)
        begin, count = starts[at], starts[at + 1] - starts[at]
        order = coded.indices.to_numpy()
        begin, count = begin[order], count[order]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) - np.repeat(ends - count, count) + np.repeat(begin, count)
        return np.frombuffer(self.flat, np.uint32)[places], count

    def texts(self, texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        """The ids of each text, in one part or, for long texts, several."""
        pieces, sizes = [], []

        def flush():
            ids, count = self.encode(pieces)
            token_ends = np.concatenate(([0], np.cumsum(count)))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for a, b in zip(ends, ends[1:]):
                yield [ids[token_ends[a] : token_ends[b]]]

        chars = 0
        for text in texts:
            text = text or ""
            if len(text) > BATCH_CHARS:
                yield from flush()
                pieces, sizes, chars = [], [], 0
                found = (m.group() for m in self.find.finditer(text))
                parts = []
                while part := list(islice(found, BATCH_PIECES)):
                    parts.append(self.encode(part)[0])
                yield parts
                continue
            own = self.find.findall(text)
            pieces += own
            sizes.append(len(own))
            chars += len(text)
            if chars > BATCH_CHARS:
                yield from flush()
                pieces, sizes, chars = [], [], 0
        yield from flush()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids.tolist()))


_kept: dict[str, Codec] = {}


def _codec(call: str, vocabulary) -> Codec:
    """The worker's own, kept from task to task for the pre-tokens it remembers."""
    if call not in _kept:
        _kept.clear()
        _kept[call] = Codec(vocabulary.value)
    return _kept[call]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of BATCH_CHARS bytes of text, or one row of more, so that no more is held as objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > BATCH_CHARS:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    yield batch.slice(start)


def _prepared(spark: SparkSession, path: str, pattern: str):
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: one row per row of docs, any order.

    A null text counts as empty and has no ids; a null id stays null; an empty table gives an empty one. Repeated rows
    get a row each and nothing ties; very long texts are encoded in parts of whole pre-tokens. Other columns of docs
    are not read.
    """
    vocabulary, call = _prepared(docs.sparkSession, path, pattern), uuid.uuid4().hex
    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    fields = [given.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids

    def run(batches):
        codec = _codec(call, vocabulary)
        for batch in (part for whole in batches for part in _portions(whole)):
            counts, id_digests, byte_digests, lists = [], [], [], []
            for parts in codec.texts(batch.column("text").to_pylist()):
                of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    of_ids.update(part.astype("<u4").tobytes())
                    of_bytes.update(codec.decode(part))
                counts.append(sum(map(len, parts)))
                id_digests.append(of_ids.hexdigest())
                byte_digests.append(of_bytes.hexdigest())
                if ids:
                    lists.append(np.concatenate(parts) if parts else np.empty(0, np.uint32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(byte_digests, pa.string())]
            if ids:
                offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
                values = np.concatenate(lists) if lists else np.empty(0, np.uint32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return given.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts that id lists stand for; null lists give null. Bytes that are not UTF-8 become U+FFFD."""
    vocabulary, call = _prepared(encoded.sparkSession, path, pattern), uuid.uuid4().hex
    given = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        codec = _codec(call, vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return given.mapInArrow(run, T.StructType([given.schema["doc_id"], T.StructField("text", T.StringType())]))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
