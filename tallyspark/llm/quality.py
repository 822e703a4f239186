"""Quality rules as a bitmask ledger: every rule is evaluated once per document and leaves a bit beside its
measurements; a policy is a mask over those bits, and what each rule costs is read off the masks alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE_CHARS, documents, let, text_of, words_of

SYMBOLS = "#*$%&|<>"

#: name: condition on the measurements m(name) under which a document fails; a rule's bit is its place. New rules go
#: to the end, so that stored ledgers stay readable.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 50,
    "repeated_windows": lambda m: m("n_repeat_words") * 100 > m("n_words") * 50,
    "symbols": lambda m: m("n_symbols") * 100 > m("word_chars") * 30,
    "repeated_lines": lambda m: (m("n_lines") >= 4) & (m("n_dup_lines") * 100 > m("n_lines") * 80),
    "long_words": lambda m: m("word_chars") > m("n_words") * 40,
}

#: Versioned policies: the rules that reject. What a version means never changes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"),
}


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(name) for name in POLICIES[policy])


def _covered(windows: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Equal windows become neighbours by sorting; the sort is
    skipped where all windows differ."""

    def by_sorting(keys):
        marked = let(
            F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
            lambda s: F.filter(
                F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]), x["i"])), lambda i: i.isNotNull()
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda i: F.array(i, i + 1, i + 2)))))

    return let(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(by_sorting(k)))


def _windows(words: Column) -> Column:
    return F.when(
        F.size(words) >= 3,
        F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<string>"))


def _measured(text: Column) -> Column:
    has_word = lambda line: F.translate(line, SPACE_CHARS, "") != ""
    words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(_windows(w)).cast("long").alias("n_repeat_words")))
    lines = let(
        F.filter(F.split(text, "\n", -1), has_word),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    chars = F.struct(
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols")
    )
    return F.struct(words.alias("w"), lines.alias("l"), chars.alias("c"))


def _failures(m: Callable[[str], Column]) -> Column:
    bits = [F.when(rule(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return reduce(Column.bitwiseOR, bits).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failures (a bit per rule), one row per row of docs; the text is read once and
    nothing is shuffled. A null or empty text has no words; a null id stays null; an empty table gives an empty one.
    Repeated rows get a row each, there is nothing to tie in, and very long texts are measured whole; other columns
    are not read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), _measured(text_of(text_col)).alias("m")).select("doc_id", "m.w.*", "m.l.*", "m.c.*")
    return read.withColumn("failures", _failures(F.col))


def passes(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(table: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, n_failed, n_only (documents that this rule alone rejects), n_kept_without: from a ledger's bits.

    Documents are first counted by mask, at most 2 ** rules of them, and only those counts are spread over the rules.
    """
    counts = table.groupBy("failures").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    spread = counts.withColumn("r", F.explode(rules)).select("n", "r.rule", "r.bit", F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("hit"))
    some = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return spread.groupBy("rule").agg(
        some(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        some(F.col("hit") == F.col("bit")).alias("n_only"),
        some(F.col("hit").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def quality_filter(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass a policy, with all their columns. Null, empty and very long texts, repeated rows and
    empty tables are as in ledger; ids are not read and names of columns don't matter."""
    parts = {"n_words": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l", "word_chars": "c", "n_symbols": "c"}
    failures = let(_measured(text_of(text_col)), lambda m: _failures(lambda name: m[parts[name]][name]))
    return docs.filter(failures.bitwiseAND(F.lit(mask(policy))) == 0)


def op9_quality_rules(spark, sf_dir):
    base = (1 << list(RULES).index("few_words")) | (1 << list(RULES).index("repeated_windows"))
    return ledger(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        passes("v1").alias("kept"),
        "n_lines",
        "failures",
    )


SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), spots AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n FROM spots
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), measured AS (
  SELECT split.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered ON covered.doc_id = split.doc_id
), judged AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * word_chars)::BIGINT
         + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 80 * n_lines)::BIGINT + 16 * (word_chars > 40 * n_words)::BIGINT)::BIGINT AS failures
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, n_lines, failures
FROM judged
"""
