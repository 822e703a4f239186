"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Every window of WINDOW words picks the smallest of its GRAM-word hashes. The picked runs of GRAM words are the blocks of
the reference; they are chosen by content alone, so a passage is cut alike wherever it stands. A block's context is what
the windows that picked it span. A block alone is too short to be a duplicate: what is removed depends on how far its
factor reaches.

A document is parsed left to right over its blocks. The source of a block's factor is the first place that the index
has for it elsewhere, and the factor reaches as far to both sides as the words agree, within the context. Contexts of one
name agree to their ends; others are compared word by word with the source's context. Factors of blocks that follow each
other in the source too are one factor. Factors of WINDOW words and more are duplicate spans, and so is what they are
copied from. A window that crosses a factor's end cannot equal one of that source, but can equal one of another place:
these windows, and no others, are looked up by their hashes.

This is exact. If a window stands twice, both have the same block at the same offset. If its source has that window, both
factors hold it (the source's by being copied from); if not, it crosses the ends of both and both are looked up.

A block costs one index entry, some 25 words' worth, not one per window. Entries are counted before they travel; of
equal contexts one is compared for all, so a passage that a third of all documents hold costs its rows and no pairs.
Texts travel once, and those that lose words a second time. Words, windows and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import Scratch, documents, text_of

WINDOW, GRAM = 35, 12
#: Words hashed together; the cut between two parts of a long text only makes blocks that go to the boundary check.
PART = 200_000
ODD = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(ODD, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _sequences(hashed: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of length words, from runs of powers of two."""
    runs, size = hashed, 1
    out, done, rest = None, 0, length
    n = len(hashed) - length + 1
    while rest:
        if rest & 1:
            part = runs[done : done + n]
            out = part.copy() if out is None else out + part * _power(done)
            done += size
        rest >>= 1
        if rest:
            runs = runs[: len(runs) - size] + runs[size:] * _power(size)
            size *= 2
    return _mixed(out)


def _hashed(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def windows_of(words: list[bytes]) -> np.ndarray:
    return _sequences(_hashed(words), WINDOW)


def blocks_of(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """anchor, context (hashes of the block and of what its windows span), first window, number of windows, and the
    block's distance from the first window, of each block of a text."""
    parts = []
    for at in range(0, max(1, len(words) - WINDOW + 1), PART):
        own = _hashed(words[at : at + PART + WINDOW - 1])
        if len(own) < WINDOW:
            continue
        grams, windows = _sequences(own, GRAM), _sequences(own, WINDOW)
        picked = sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1) + np.arange(len(windows))
        first = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
        count = np.diff(np.concatenate((first, [len(windows)])))
        context = _mixed(windows[first] + windows[first + count - 1] * np.uint64(ODD) + count.astype(np.uint64))
        parts.append((grams[picked[first]].view(np.int64), context.view(np.int64), first + at, count, picked[first] - first))
    if not parts:
        return (np.empty(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def without(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """How many words the factors cover, and the words left. Spans that touch are one factor."""
    edge = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    keep = (np.cumsum(edge[:-1]) == 0).tolist()
    kept = list(compress(words, keep))
    return len(words) - len(kept), kept


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_BLOCK = [("anchor", pa.int64()), ("context", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("shift", pa.int32())]
_ROWS = "row bigint, rid string, n_words bigint, sha string, blocks array<struct<anchor:bigint,context:bigint,first:int,count:int,shift:int>>"
#: Places that a task may give to its blocks.
PLACES = 1 << 40


def _indexed(batches):
    """row is the place of a document's first block; one place is left free between documents, so no run of places
    leads from one into the next."""
    place = TaskContext.get().partitionId() * PLACES
    for batch in batches:
        rows, counts, digests, sizes, found = [], [], [], [0], []
        for t in batch.column("text"):
            words = t.as_py().split()
            counts.append(len(words))
            digests.append(_digest(words))
            own = blocks_of(words)
            rows.append(place)
            place += len(own[0]) + 1
            sizes.append(sizes[-1] + len(own[0]))
            found.append(own)
        columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(5)]
        structs = pa.StructArray.from_arrays([pa.array(c.astype(kind.to_pandas_dtype())) for c, (_, kind) in zip(columns, _BLOCK, strict=True)], names=[n for n, _ in _BLOCK])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), batch.column("rid"), batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)],
            names=["row", "rid", "id", "n_words", "sha", "blocks"],
        )


def extended(own: np.ndarray, shift: int, source: np.ndarray, source_shift: int) -> tuple[int, int]:
    """How many words before a block and after it agree with the source's, both given by the hashes of their contexts'
    words and the block's distance from the context's beginning."""
    n = min(shift, source_shift)
    differs = np.flatnonzero(own[shift - n : shift][::-1] != source[source_shift - n : source_shift][::-1])
    left = int(differs[0]) if len(differs) else n
    own, source = own[shift + GRAM :], source[source_shift + GRAM :]
    n = min(len(own), len(source))
    differs = np.flatnonzero(own[:n] != source[:n])
    return left, int(differs[0]) if len(differs) else n


def parsed(held: list[tuple[int, int, int, int, int, int]], row: int) -> list[tuple[int, int, int]]:
    """The factors of a document: first word, end, place of the first block in the reference. held: ordinal, place in
    the text, words that agree before and after it, first and last place with that context, of each block that has
    one elsewhere, by ordinal. row: the place of the document's own first block."""
    factors, k = [], 0
    while k < len(held):
        longest, source = 0, -1
        for place in held[k][4:6]:
            if place == row + held[k][0]:
                continue
            n = 1
            while k + n < len(held) and held[k + n][0] == held[k][0] + n and place + n in held[k + n][4:6]:
                n += 1
            if n > longest:
                longest, source = n, place
        last = held[k + longest - 1]
        factors.append((held[k][1] - held[k][2], last[1] + GRAM + last[3], source))
        k += longest
    return factors


_FACTORS = "array<struct<a:int,b:int,source:bigint>>"
_PASSAGES = "array<struct<anchor:bigint,n:bigint,ord:int,first:int,shift:int,reference:boolean,words:binary>>"
_OPENED = f"rid string, row bigint, text binary, factors {_FACTORS}, passages {_PASSAGES}"
FACTORS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("source", pa.int64())]))
PASSAGES = pa.list_(pa.struct([("anchor", pa.int64()), ("n", pa.int64()), ("ord", pa.int32()), ("first", pa.int32()), ("shift", pa.int32()), ("reference", pa.bool_()), ("words", pa.binary())]))


#: Blocks that a task looks at together, but for one document more.
AT_ONCE = 20_000


def _opened(batches):
    """The factors of whole contexts, and the words of contexts that have to be compared."""
    fields = ("ord", "first", "count", "shift", "lo", "hi", "anchor", "n")

    def made(part: pa.RecordBatch, sizes: list[int]) -> pa.RecordBatch:
        todos = part.column("todo").flatten()
        todo = list(zip(*(todos.field(name).to_pylist() for name in fields)))
        factors, passages, at = [], [], 0
        for t, row, size in zip(part.column("text"), part.column("row").to_pylist(), sizes):
            own = todo[at : at + size]
            at += size
            held = sorted((o, first + shift, shift, count + WINDOW - 1 - shift - GRAM, lo, hi) for o, first, count, shift, lo, hi, anchor, _ in own if anchor is None)
            factors.append([{"a": a, "b": b, "source": source} for a, b, source in parsed(held, row)])
            compared = [x for x in own if x[6] is not None]
            words = t.as_py().split() if compared else []
            passages.append(
                [
                    {"anchor": anchor, "n": n, "ord": o, "first": first, "shift": shift, "reference": lo == row + o, "words": _hashed(words[first : first + count + WINDOW - 1]).tobytes()}
                    for o, first, count, shift, lo, _, anchor, n in compared
                ]
            )
        return pa.RecordBatch.from_arrays([part.column("rid"), part.column("row"), part.column("text"), pa.array(factors, FACTORS), pa.array(passages, PASSAGES)], names=["rid", "row", "text", "factors", "passages"])

    for batch in batches:
        sizes = pc.list_value_length(batch.column("todo")).to_pylist()
        start = held = 0
        for k, size in enumerate(sizes):
            held += size
            if held > AT_ONCE or k == len(sizes) - 1:
                yield made(batch.slice(start, k + 1 - start), sizes[start : k + 1])
                start, held = k + 1, 0


_COMPARED = "rid string, anchor bigint, n bigint, place bigint, a int, b int, left int, right int, source bigint, windows array<struct<window:bigint,at:int>>"
WINDOWS = pa.list_(pa.struct([("window", pa.int64()), ("at", pa.int32())]))


def _compared(batches):
    """The factor of each context and its source's, and the hashes of the context's windows that cross its ends."""
    kinds = {"rid": pa.string(), "anchor": pa.int64(), "n": pa.int64(), "place": pa.int64(), "a": pa.int32(), "b": pa.int32(), "left": pa.int32(), "right": pa.int32(), "source": pa.int64(), "windows": WINDOWS}
    for batch in batches:
        rows = batch.to_pydict()
        made = [rows["rid"], rows["anchor"], rows["n"], rows["place"], *([] for _ in range(6))]
        for first, shift, words, source, source_shift, source_words in zip(*(rows[k] for k in ("first", "shift", "words", "source", "source_shift", "source_words"))):
            own = np.frombuffer(words, np.uint64)
            left, right = extended(own, shift, np.frombuffer(source_words, np.uint64), source_shift)
            a, b = shift - left, shift + GRAM + right
            crossing = np.arange(len(own) - WINDOW + 1)
            crossing = crossing[(crossing < a) | (crossing + WINDOW > b)]
            hashes = _sequences(own, WINDOW)[crossing].view(np.int64).tolist() if len(crossing) else []
            for column, value in zip(made[4:], (first + a, first + b, left, right, source, [{"window": h, "at": first + c} for h, c in zip(hashes, crossing.tolist())])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, kinds.values(), strict=True)], names=list(kinds))


def _cut(batches):
    for batch in batches:
        removed, digests, texts, spans = [], [], [], []
        for t, *parts in zip(batch.column("text"), batch.column("factors"), batch.column("found")):
            factors = [(x["a"], x["b"], x["source"]) for part in parts for x in part.as_py() or []]
            factors = sorted(f for f in factors if f[1] - f[0] >= WINDOW)
            words = t.as_py().split()
            n, kept = without(words, [f[:2] for f in factors])
            removed.append(n)
            digests.append(_digest(kept))
            texts.append(b" ".join(kept).decode())
            spans.append([{"a": a, "b": b, "source": source} for a, b, source in factors])
        columns = [batch.column("rid"), pa.array(spans, FACTORS), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "factors", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors (first word, end, place they are copied from: -1 where a look-up
    found the window, and for a source the first place that copies it), kept_text (the last two only of documents that lose words, else null): one row per row of docs.

    Words covered by a window of WINDOW words that also starts anywhere else, in the same document or another, are
    removed, every occurrence. Null texts have no words; an empty table gives an empty one. Repeated rows are
    occurrences of each other's windows and get a row each. Very long texts are hashed PART words at a time and are
    otherwise like any other. Ties do not arise: a factor's source is the first place, whichever row holds it. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    text = text_of(text_col)
    # rows that share an id are told apart by their texts; equal rows share their spans
    rid = F.sha2(F.concat_ws("\n", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), text), 256)
    given = docs.select(rid.alias("rid"), F.col(id_col).alias("id"), F.encode(text, "UTF-8").alias("text"))
    fields = T._parse_datatype_string(_ROWS).fields
    schema = T.StructType([*fields[:2], given.schema["id"], *fields[2:]])
    rows = scratch.save(given.mapInArrow(_indexed, schema), "rows")
    blocks = rows.select("row", F.posexplode("blocks").alias("ord", "b")).select("row", "ord", (F.col("row") + F.col("ord")).alias("place"), "b.*")
    counted = blocks.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("same"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    anchors = scratch.save(counted.filter("n > 1").drop("n"), "anchors")
    shared = scratch.save(blocks.join(anchors, "anchor"), "shared")
    differing = shared.filter("not same").drop("hi")
    one = F.min(F.struct("place", "row", "ord", "first", "count", "shift")).alias("one")
    split = scratch.save(differing.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), one, F.max("place").alias("hi")), "split")
    repeated = differing.drop("lo").join(split.filter("n > 1").select("anchor", "context", F.col("one.place").alias("lo"), "hi"), ["anchor", "context"])
    nothing = F.lit(None).cast("bigint")
    kept = ["ord", "first", "count", "shift"]
    held = shared.filter("same").unionByName(repeated, allowMissingColumns=True).select("row", *kept, "lo", "hi", nothing.alias("anchor"), nothing.alias("n"))
    compared = split.select("one.row", *[f"one.{c}" for c in kept], "lo", nothing.alias("hi"), "anchor", "n")
    todo = held.unionByName(compared).groupBy("row").agg(F.collect_list(F.struct(*kept, "lo", "hi", "anchor", "n")).alias("todo"))
    # of equal rows the first is parsed for all; a context's first place is never in another
    first = rows.groupBy("rid").agg(F.min("row").alias("row"))
    opened = scratch.save(given.drop("id").join(todo.join(first, "row"), "rid").select("rid", "text", "row", "todo").mapInArrow(_opened, _OPENED), "opened")
    passages = opened.select("rid", "row", F.explode("passages").alias("p")).select("rid", (F.col("row") + F.col("p.ord")).alias("place"), "p.*")
    # a source is one row of its anchor, whatever number of contexts is compared with it
    sources = passages.filter("reference").select("anchor", F.col("place").alias("source"), F.col("shift").alias("source_shift"), F.col("words").alias("source_words"))
    compared = scratch.save(passages.filter("not reference").drop("reference", "ord").join(sources, "anchor").mapInArrow(_compared, _COMPARED), "compared")
    long = compared.filter(F.col("b") - F.col("a") >= WINDOW)
    copied = long.groupBy("anchor", "left", "right").agg(F.min("place").alias("source")).join(passages.filter("reference and n = 1").select("rid", "anchor", (F.col("first") + F.col("shift")).alias("at")), "anchor")
    windows = compared.select("rid", "anchor", "n", F.explode("windows").alias("w")).select("rid", "anchor", "n", "w.*")
    known = scratch.save(windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "window"), "windows")
    looked_up = windows.filter("n = 1").join(known, ["anchor", "window"]).select("rid", F.col("at").alias("a"), (F.col("at") + WINDOW).alias("b"), F.lit(-1).cast("bigint").alias("source"))
    marks = long.filter("n = 1").select("rid", "a", "b", "source").unionByName(copied.select("rid", (F.col("at") - F.col("left")).alias("a"), (F.col("at") + GRAM + F.col("right")).alias("b"), "source")).unionByName(looked_up)
    found = marks.groupBy("rid").agg(F.collect_list(F.struct("a", "b", "source")).alias("found"))
    cut = opened.select("rid", "text", "factors").join(found, "rid", "left")
    cut = scratch.save(cut.mapInArrow(_cut, f"rid string, factors {_FACTORS}, n_removed bigint, kept_sha256 string, kept_text string").filter("n_removed > 0").dropDuplicates(["rid"]), "cut")
    scratch.keep("rows", "cut")
    out = rows.select("rid", "id", "n_words", "sha").join(cut, "rid", "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "factors", "kept_text"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).drop("factors", "kept_text")
