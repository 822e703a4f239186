"""Mixing sources to target weights: hierarchical budgeting over domain, language and source.

The budget goes down the tree by weight. A node that holds fewer tokens than its share takes what it has, and the
shortage goes to its siblings; only when all of them are full does it reach the next level up. That is water-filling
from the root with the capacity of whole subtrees, and each level is one window over its nodes. A subtree's capacity
counts the leaves that weights let it give to, so what a leaf of weight 0 holds is no room for anybody's shortage.
Shares are rounded along their running sum, so siblings take a budget to the last token.

Each leaf then takes a prefix of its documents in a seeded order: whole epochs first, and of the next epoch as many
documents as fit. The prefix is found as one cutoff key per leaf, from a histogram over the key's leading digits, read in
two steps, and one bucket of documents; no leaf is ever sorted as a whole, so a source with a third of all rows costs what its rows
cost. Only the cutoffs, a row per leaf, meet the documents again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, columns_of, documents, text_of, words_of, unused

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mixture:
    """weights: integer weights by level and node name; what is not named weighs default. budget: share of the
    corpus' tokens, in thousandths. epochs: how often a document may be taken at most. digits: hexadecimal digits of
    the key that the histogram tells apart, so a bucket holds a leaf's documents / 16 ** digits."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default: int = 1
    budget: int = 500
    epochs: int = 2
    seed: int = 42
    digits: int = 4

    def weight(self, level: str) -> Column:
        named = F.lit(self.default)
        for name, w in self.weights.get(level, {}).items():
            named = F.when(F.col(level) == name, F.lit(w)).otherwise(named)
        return named.cast("long")


def key(mixture: Mixture, epoch: Column, id_col: Column) -> Column:
    """Order of a document within an epoch; rows that share an id share it and go in or out together."""
    return F.md5(F.concat_ws("-", F.lit(str(mixture.seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def _fill(nodes: DataFrame, level: str, parents: list[str], mixture: Mixture) -> DataFrame:
    """Splits each parent's budget over its children: a child whose capacity is below its share is full; children
    are tried in the order in which they fill up as the water rises."""
    of = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("w")).asc_nulls_last(), level)
    group = Window.partitionBy(*parents)
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    tried = (
        nodes.withColumn("w", mixture.weight(level))
        .withColumn("w", F.when(F.col("w") > 0, F.col("w")))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("capacity"))).over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("capacity").cast("double") * F.col("w_left") <= F.col("w").cast("double") * F.col("left"))
    )
    last = tried.withColumn("open_left", F.min(F.when(~F.col("full"), F.struct(-F.col("w_left"), F.col("left").alias("left"), F.col("w_left").alias("w")))).over(group))
    last = last.withColumn("w_upto", F.sum(F.when(~F.col("full"), F.col("w"))).over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    share = F.expr("(w_upto * open_left.left) div open_left.w - ((w_upto - w) * open_left.left) div open_left.w")
    return last.withColumn("budget", F.when(F.col("w").isNull(), 0).when(F.col("full"), F.col("capacity")).otherwise(share)).drop("w", "left", "w_left", "full", "open_left", "w_upto")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """domain, lang, source, tokens, budget: what each leaf gets. leaves: domain, lang, source, tokens, a row each and
    at rest, as every level reads them. Nodes that fill up at the same level of water are taken by name."""
    weighs = mixture.weight(LEVELS[0]) > 0
    for level in LEVELS[1:]:
        weighs = weighs & (mixture.weight(level) > 0)
    held = leaves.withColumn("leaf_capacity", F.when(weighs, F.col("tokens") * mixture.epochs).otherwise(F.lit(0).cast("long")))
    out = held.crossJoin(F.broadcast(leaves.agg(F.floor(F.sum("tokens") * mixture.budget / 1000).cast("long").alias("budget"))))  # one row
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = out.groupBy(*parents, level).agg(F.sum("leaf_capacity").alias("capacity"), F.first("budget").alias("budget"))
        root = nodes if parents else nodes.withColumn("__root", F.lit(0))
        filled = _fill(root, level, parents or ["__root"], mixture).select(*parents, level, "budget")
        out = out.drop("budget").join(filled, [*parents, level])
    return out.drop("leaf_capacity")


def _crossing(scratch: Scratch, buckets: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Per leaf, the largest key (cutoff) of the buckets that fit into rest after base, and the bucket in which rest
    ends with the tokens before it (base). buckets: the levels, rest, bucket, n, last, base."""
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = scratch.save(buckets.withColumn("upto", F.col("base") + F.sum("n").over(upto)), label)
    full = summed.filter("upto <= rest").groupBy(*LEVELS).agg(F.max("last").alias("cutoff"))
    crossed = summed.filter("upto > rest and upto - n <= rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("b"))
    return full, crossed.select(*LEVELS, "b.*")


def cutoffs(docs: DataFrame, mixture: Mixture, domain: Column, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """domain, lang, source, tokens, budget, whole (epochs taken whole), cutoff (largest key of the next epoch that
    is taken, empty if none): a row per leaf."""
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = scratch.save(
        docs.select(*_leaf(domain, lang_col, source_col), F.col(id_col).alias("id"), F.size(words_of(text_of(text_col))).cast("long").alias("n")), "counted"
    )
    tokens = scratch.save(counted.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "tokens")
    leaves = scratch.save(budgets(tokens, mixture), "leaves")
    leaves = leaves.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")).cast("long")).otherwise(F.lit(0).cast("long")))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    keyed = counted.join(leaves.select(*LEVELS, "whole", "rest"), list(LEVELS)).withColumn("key", key(mixture, F.col("whole"), F.col("id")))
    keyed = scratch.save(keyed.select(*LEVELS, "rest", "key", F.substring("key", 1, mixture.digits).alias("bucket"), "n"), "keyed")
    buckets = scratch.save(keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n").alias("n"), F.max("key").alias("last")), "buckets")
    half = F.substring("bucket", 1, max(1, mixture.digits // 2))
    coarse = buckets.groupBy(*LEVELS, "rest", half.alias("bucket")).agg(F.sum("n").alias("n"), F.max("last").alias("last")).withColumn("base", F.lit(0).cast("long"))
    full, crossed = _crossing(scratch, coarse, "coarse")
    fine = buckets.withColumn("half", half).join(crossed.withColumnRenamed("bucket", "half"), [*LEVELS, "half"]).drop("half")
    more, crossed = _crossing(scratch, fine, "fine")
    full = full.unionByName(more)
    within = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    partial = keyed.join(crossed, [*LEVELS, "bucket"]).withColumn("upto", F.col("base") + F.sum("n").over(within))
    partial = partial.filter("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("cutoff"))
    cut = full.unionByName(partial).groupBy(*LEVELS).agg(F.max("cutoff").alias("cutoff"))
    out = leaves.drop("rest").join(cut, list(LEVELS), "left").withColumn("cutoff", F.coalesce("cutoff", F.lit("")))
    out = scratch.save(out, "cutoffs")
    scratch.keep("cutoffs")
    return out


def _leaf(domain: Column, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("(none)")).alias(name) for name, c in zip(LEVELS, (domain, F.col(lang_col), F.col(source_col)), strict=True)]


def mix(docs: DataFrame, mixture: Mixture, domain: Column, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """The rows of docs that the mixture takes, once for each epoch that takes them, with all their columns and a
    struct __mix (domain, lang, source, budget, epoch), or what unused() makes of that name.

    Null domains, languages and sources are a node "(none)"; null ids share one key; null and empty texts hold no token
    and go with whoever stands beside them in the order. Rows that share an id, repeated ones too, tie in the order and
    go in or out together. A text longer than what is left of its leaf's budget ends that leaf's prefix before it. A
    node of weight 0 gives nothing. An empty table gives an empty one. Columns of docs named like a level, or with dots
    in their names, are left as they are.
    """
    cut = cutoffs(docs, mixture, domain, id_col, text_col, lang_col, source_col)
    leaf = F.struct(*_leaf(domain, lang_col, source_col))
    of_leaf, of_cut, of_copies, of_epoch = (unused(docs, f"__{n}") for n in ("leaf", "cut", "copies", "epoch"))
    cut = cut.select(F.struct(*LEVELS).alias(of_leaf), F.struct("budget", "whole", "cutoff").alias(of_cut))
    joined = docs.withColumn(of_leaf, leaf).join(cut, of_leaf)
    whole = F.col(f"{of_cut}.whole")
    partial = (whole < mixture.epochs) & (key(mixture, whole, F.col(id_col)) <= F.col(f"{of_cut}.cutoff"))
    copies = (whole + F.when(partial, 1).otherwise(0)).cast("int")
    taken = joined.withColumn(of_copies, copies).filter(F.col(of_copies) > 0).withColumn(of_epoch, F.explode(F.sequence(F.lit(0), F.col(of_copies) - 1)))
    return taken.select(*columns_of(docs), F.struct(f"{of_leaf}.*", f"{of_cut}.budget", F.col(of_epoch).alias("epoch")).alias(unused(docs, "__mix")))


def domain_of_source(source: Column) -> Column:
    """The domain of a driver source: by its number, as the tables name none."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)"), F.lit(-1))
    return F.when(number < 0, "other").when(number < 5, "web").when(number < 12, "books").otherwise("code")


#: The production mixture of the driver's tables.
PRODUCTION = Mixture(
    weights={"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}}, default=1, budget=500, epochs=2, seed=42
)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    taken = mix(docs.select("doc_id", "text", "lang", "source"), PRODUCTION, domain_of_source(F.col("source")))
    return taken.select(
        "doc_id", F.col("__mix.epoch").alias("epoch"), F.col("__mix.domain").alias("domain"), F.col("__mix.lang").alias("lang"), F.col("__mix.source").alias("source"), F.col("__mix.budget").alias("leaf_budget")
    )


def _fill_sql(name: str, level: str, parents: tuple[str, ...], weight: str, above: str) -> str:
    by = ", ".join(parents) or "1"
    keys = ", ".join((*parents, level))
    budget = f"(SELECT {above}.budget FROM {above} WHERE " + " AND ".join(f"{above}.{p} = n.{p}" for p in parents) + ")" if parents else f"(SELECT budget FROM {above})"
    return f"""
{name}_nodes AS (SELECT {keys}, sum(tokens) * 2 AS capacity, {weight} AS w FROM leaves GROUP BY {keys}),
{name}_tried AS (
  SELECT *, budget - coalesce(sum(capacity) OVER before, 0) AS rest, sum(w) OVER (PARTITION BY {by}) - coalesce(sum(w) OVER before, 0) AS w_rest
  FROM (SELECT n.*, {budget} AS budget FROM {name}_nodes AS n) AS n
  WINDOW before AS (PARTITION BY {by} ORDER BY capacity::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
{name}_full AS (SELECT *, capacity::DOUBLE * w_rest <= w::DOUBLE * rest AS is_full FROM {name}_tried),
{name}_open AS (
  SELECT *, sum(w) FILTER (NOT is_full) OVER (PARTITION BY {by} ORDER BY capacity::DOUBLE / w, {level} ROWS UNBOUNDED PRECEDING) AS w_upto,
    arg_max(rest, w_rest) FILTER (NOT is_full) OVER (PARTITION BY {by}) AS open_rest, max(w_rest) FILTER (NOT is_full) OVER (PARTITION BY {by}) AS open_w
  FROM {name}_full
),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN capacity ELSE (w_upto * open_rest) // open_w - ((w_upto - w) * open_rest) // open_w END::BIGINT AS budget FROM {name}_open)"""


SQL = rf"""
WITH numbered AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), -1) AS number
  FROM documents
), docs AS (
  SELECT *, CASE WHEN number < 0 THEN 'other' WHEN number < 5 THEN 'web' WHEN number < 12 THEN 'books' ELSE 'code' END AS domain FROM numbered
), leaves AS (
  SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM docs GROUP BY ALL
), root AS (SELECT floor(sum(tokens) * 500 / 1000)::BIGINT AS budget FROM leaves),
{_fill_sql("d", "domain", (), "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END", "root")},
{_fill_sql("l", "lang", ("domain",), "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END", "d")},
{_fill_sql("s", "source", ("domain", "lang"), "CASE source WHEN 'src0' THEN 3 ELSE 1 END", "l")},
leaf AS (
  SELECT s.*, CASE WHEN tokens > 0 THEN floor(budget / tokens)::BIGINT ELSE 0 END AS whole, tokens FROM s JOIN leaves USING (domain, lang, source)
), ordered AS (
  SELECT docs.doc_id, docs.domain, docs.lang, docs.source, budget, whole, budget - whole * tokens AS rest,
         sum(n) OVER (PARTITION BY docs.domain, docs.lang, docs.source ORDER BY md5('42-' || whole || '-' || docs.doc_id)) AS upto
  FROM docs JOIN leaf ON leaf.domain = docs.domain AND leaf.lang = docs.lang AND leaf.source = docs.source
)
SELECT doc_id, unnest(range(0, whole + (upto <= rest AND whole < 2)::BIGINT))::INTEGER AS epoch, domain, lang, source, budget AS leaf_budget FROM ordered
"""
