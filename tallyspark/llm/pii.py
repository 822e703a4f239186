"""Personal data by bootstrapped contextual extraction.

Base expressions find the seeds. What stands around a seed is generalised into lexical patterns: the word before it,
the word after it, both, the two before it, and the second before it with the next one skipped; words are taken whole,
case folded, with runs of digits as one class. Around an identifier-like string that no base expression accepts the
same patterns make it a candidate. Patterns and values form a graph. In each round Spark scores the patterns, by the
share of their values that are of one kind, and then the values, by the patterns they stand in; values that the
trusted patterns vouch for become seeds of the next round, whose contexts support further patterns. When a round finds
no value, candidates that stand in a trusted pattern are findings.

Beside the four base kinds the seeds may hold secrets: quoted strings that are assigned to a name such as token or
password. They have no base expression of their own in the contract and are a kind by themselves.

Texts are read once. What leaves them is a row per document with its spans and candidates, written to the shared
folder; the graph holds a row per pattern and value, already counted, and is joined at rest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import Scratch, documents, text_of

KINDS = ("email", "ip", "card", "phone")
#: Kind of secrets, and the classes of strings that can stand for one another: of the kinds in order, and by name.
SECRET = len(KINDS)
ADDRESS, NUMBER, TOKEN = 0, 1, 2
CLASS_OF = (ADDRESS, NUMBER, NUMBER, NUMBER, TOKEN)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match can't begin inside a run of digits that it did not begin with, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
# likewise inside a word: a word is tried once
_MAIL_LIKE = re.compile(r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]+(?:@|\(at\)|\[at\])[^\x20\x09-\x0D@]+")
_SECRET = re.compile(r"""(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)['"]?[\x20]?[=:][\x20]?["']([^"'\x20\x09-\x0D]{16,})["']""")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of every base match that holds, by start, then kind."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(1), SECRET, m.end(1)) for m in _SECRET.finditer(text)]


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]+")
#: Characters from which a text is named by a hash.
LONG = 64


def named(text: str) -> str:
    """A text as it is, or, if it is long, by its SHA-256: equal for equal texts."""
    return text if len(text) <= LONG else "#" + hashlib.sha256(text.encode()).hexdigest()


def _plain(text: str) -> str:
    """Case folded, which looks at single characters, and runs of digits as one class."""
    return _DIGITS.sub("0", text.casefold())


def _prefix_names(word: str, cuts: list[int]) -> dict[int, str]:
    """The name of word[:cut] for each of the sorted cuts, in one pass over the word."""
    digest, head, n, last, in_digits, found = hashlib.sha256(), "", 0, 0, False, {}
    for cut in cuts:
        part = word[last:cut]
        plain = _plain(part)
        if in_digits and "0" <= part[:1] <= "9":  # a run goes on
            plain = plain[1:]
        if part:
            in_digits, last = "0" <= part[-1] <= "9", cut
        digest.update(plain.encode())
        n += len(plain)
        head = (head + plain)[: LONG + 1]
        found[cut] = head if n <= LONG else "#" + digest.copy().hexdigest()[:32]
    return found


def contexts(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The lexical patterns of each span (start, end). A word that touches a span counts as far as it lies off it, so
    in a text without white space all that stands before a span does; words are found once and every piece of a word is
    named in one pass over it, whatever the number of spans."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in places], [b for _, b in places]
    lefts = [(k, min(ends[k], s)) if (k := bisect_left(starts, s) - 1) >= 0 else None for s, _ in spans]
    rights = [(k, max(starts[k], e)) if (k := bisect_right(ends, e)) < len(ends) else None for _, e in spans]
    cuts: dict[int, set[int]] = {}
    for found in lefts:
        if found:
            cuts.setdefault(found[0], set()).add(found[1] - starts[found[0]])
            if found[0]:
                cuts.setdefault(found[0] - 1, set()).add(ends[found[0] - 1] - starts[found[0] - 1])
    before = {k: _prefix_names(text[starts[k] : ends[k]], sorted(c)) for k, c in cuts.items()}
    cuts = {}
    for found in rights:
        if found:
            cuts.setdefault(found[0], set()).add(ends[found[0]] - found[1])
    after = {k: _prefix_names(text[starts[k] : ends[k]][::-1], sorted(c)) for k, c in cuts.items()}
    out = []
    for left, right in zip(lefts, rights):
        first = before[left[0]][left[1] - starts[left[0]]] if left else None
        second = before[left[0] - 1][ends[left[0] - 1] - starts[left[0] - 1]] if left and left[0] else None
        last = after[right[0]][ends[right[0]] - right[1]] if right else None
        if last and last[0] != "#":
            last = last[::-1]
        found = [f"{first} _"] if first else []
        if last:
            found.append(f"_ {last}")
        if first and last:
            found.append(f"{first} _ {last}")
        if second:
            found += [f"{second} {first} _", f"{second} * _"]
        out.append(found)
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, class, end) of identifier-like strings off the seeds: addresses, then numbers off these, then tokens of
    letters and digits off both."""
    taken, out = sorted((s, e) for s, _, e in base), []
    for kind, pattern in ((ADDRESS, _MAIL_LIKE), (NUMBER, _NUMBER), (TOKEN, _TOKEN)):
        if kind or "@" in text or "at)" in text or "at]" in text:
            starts, ends = [s for s, _ in taken], [0]
            for _, e in taken:
                ends.append(max(ends[-1], e))
            for m in pattern.finditer(text):
                if ends[bisect_right(starts, m.end() - 1)] > m.start():
                    continue
                if kind == TOKEN and not (re.search("[A-Za-z]", m.group()) and len(re.findall("[0-9]", m.group())) >= 4):
                    continue
                out.append((m.start(), kind, m.end()))
            taken = sorted(taken + [(s, e) for s, k, e in out if k == kind])
    return out


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring at most; threshold and seeds (different seed values) that a pattern must reach; secrets:
    whether these are looked for."""

    rounds: int = 4
    threshold: float = 0.7
    seeds: int = 5
    secrets: bool = True


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])
_MENTION = T.StructType([*_SPAN.fields, T.StructField("seed", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secrets: bool = True) -> DataFrame:
    """doc_id, base (spans), mentions (base spans, secrets and candidates, with value and patterns): one row per row of
    docs."""
    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType([given.schema["doc_id"], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("mentions", T.ArrayType(_MENTION))])

    def run(batches):
        for batch in batches:
            bases, found = [], []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                seeds = sorted(base + secret_spans(text)) if secrets else base
                own = [(s, k, e, True) for s, k, e in seeds] + [(s, k, e, False) for s, k, e in candidates(text, seeds)]
                patterns = contexts(text, [(s, e) for s, _, e, _ in own])
                found.append([{"start": s, "kind": k, "end": e, "seed": is_seed, "value": named(text[s:e]), "patterns": p} for (s, k, e, is_seed), p in zip(own, patterns)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bases, pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))), pa.array(found, _arrow_mentions())],
                names=schema.names,
            )

    return given.mapInArrow(run, schema)


def _arrow_mentions() -> pa.DataType:
    return pa.list_(pa.struct([*((n, pa.int32()) for n in ("start", "kind", "end")), ("seed", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def trusted_patterns(edges: DataFrame, seeds: DataFrame, settings: Bootstrap, scratch: Scratch) -> DataFrame:
    """class, pattern, kind, confidence: the patterns that the rounds end up trusting.

    edges: class, pattern, value, distinct. seeds: class, value, kind. A pattern's confidence in a kind is
    own / (all + 1), own being its values of that kind and all its values of whatever kind or none, so what is another
    kind's seed speaks against it; it is trusted from settings.threshold on if own reaches settings.seeds. A value that
    is no seed takes the kind with the largest 1 - product of (1 - confidence) over its trusted patterns, the first as
    listed on a tie, and is a seed from the next round on.
    """
    whole = scratch.save(edges.groupBy("class", "pattern").agg(F.count("*").alias("all")).filter(F.col("all") >= settings.seeds), "whole")
    able = scratch.save(edges.join(whole.select("class", "pattern"), ["class", "pattern"], "left_semi"), "able")
    known = scratch.save(seeds.groupBy("class", "value").agg(F.min("kind").alias("kind")), "known-0")
    for turn in range(1, settings.rounds + 1):
        own = able.join(known, ["class", "value"]).groupBy("class", "pattern", "kind").agg(F.count("*").alias("own")).filter(F.col("own") >= settings.seeds)
        scored = own.join(whole, ["class", "pattern"]).withColumn("confidence", F.col("own") / (F.col("all") + 1))
        patterns = scratch.save(scored.filter(F.col("confidence") >= settings.threshold).select("class", "pattern", "kind", "confidence"), f"patterns-{turn}")
        vouched = able.join(known, ["class", "value"], "left_anti").join(patterns, ["class", "pattern"])
        trust = vouched.groupBy("class", "value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("trust"))
        new = trust.groupBy("class", "value").agg((-F.max(F.struct("trust", -F.col("kind")))["col2"]).alias("kind"))
        new = scratch.save(new, f"new-{turn}")
        if new.isEmpty():
            break
        known = scratch.save(known.unionByName(new), f"known-{turn}")
    return patterns


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, settings: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind's place, end; base ones included): one row per row of docs.

    A null text counts as empty, a null id stays null, and an empty table gives an empty one. Repeated rows get a row
    each and count once as evidence; very long texts are read whole; other columns of docs are not read. Offsets are
    code points. A candidate in trusted patterns of several kinds takes that of the most confident one, the first kind
    as listed on a tie. Spans of kind SECRET are seeds and findings alike, and never base ones.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save(mentions(docs, id_col, text_col, settings.secrets).withColumn("row_id", F.monotonically_increasing_id()), "rows")
    each = rows.select("row_id", F.explode("mentions").alias("m")).select("row_id", "m.*")
    of_kind = F.get(F.array(*map(F.lit, CLASS_OF)), F.col("kind"))
    spread = each.withColumn("pattern", F.explode("patterns")).withColumn("class", F.when(F.col("seed"), of_kind).otherwise(F.col("kind")))
    edges = scratch.save(spread.select("class", "pattern", "value").distinct(), "edges")
    seeds = each.filter("seed").select(of_kind.alias("class"), "value", "kind").distinct()
    trusted = trusted_patterns(edges, seeds, settings, scratch)
    new = spread.filter("not seed").drop("kind").join(trusted, ["class", "pattern"])
    new = new.groupBy("row_id", "start", "end").agg((-F.max(F.struct("confidence", -F.col("kind")))["col2"]).alias("kind"))
    secret = each.filter((F.col("kind") == SECRET) & F.col("seed")).select("row_id", "start", "end", "kind")
    new = new.unionByName(secret).groupBy("row_id").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    new = scratch.save(new, "new")
    scratch.keep("rows", "new")
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(T.ArrayType(_SPAN)))))
    return rows.join(new, "row_id", "left").select("doc_id", "base", spans.alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans has all spans of the four kinds; what has no kind in the contract, secrets, is in columns of its own."""
    found = find(documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    listed, secret = F.filter("spans", lambda s: s["kind"] < SECRET), F.filter("spans", lambda s: s["kind"] == SECRET)
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(listed).alias("spans"),
        F.size("spans").cast("long").alias("n_found"),
        F.size(secret).cast("long").alias("n_secret"),
        _joined(secret).alias("secret_spans"),
    )
