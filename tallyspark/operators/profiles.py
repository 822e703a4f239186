"""Player profiles and retrieval over them: position scores, strengths, named players, metrics a question asks for."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import scalars as S
from tallyspark.functions.names import fold
from tallyspark.operators import windows as W
from tallyspark.operators.peers import ranked
from tallyspark.operators.search import centroid, shared_tokens

#: What counts for whom, each group's weights adding up to 1.
WEIGHTS = {
    "FWD": {"xg": 0.22, "goals": 0.18, "shots": 0.10, "assists": 0.12, "dribbles_completed": 0.10, "progressive_carries": 0.10, "progressive_passes": 0.08, "passes_completed": 0.05, "ball_recoveries": 0.05},
    "MID": {"progressive_passes": 0.18, "passes_completed": 0.12, "assists": 0.10, "xg": 0.08, "progressive_carries": 0.10, "dribbles_completed": 0.08, "ball_recoveries": 0.12, "tackles": 0.10, "interceptions": 0.12},
    "DEF": {"tackles": 0.16, "interceptions": 0.16, "clearances": 0.14, "blocks": 0.10, "ball_recoveries": 0.14, "progressive_passes": 0.14, "passes_completed": 0.10, "progressive_carries": 0.06},
    "GK": {"passes_completed": 0.35, "progressive_passes": 0.30, "clearances": 0.20, "ball_recoveries": 0.15},
}


def position_scores(frame: DataFrame, keys: list[str], group: str = "position_group") -> DataFrame:
    """frame with score: the weighted percentiles of a row within its position group, by that group's weights. Metrics
    (<name>_per90) that the frame lacks and unknown groups give 0. keys tell rows apart."""
    names = [n for n in dict.fromkeys(n for w in WEIGHTS.values() for n in w) if f"{n}_per90" in frame.columns]
    held = ranked(frame, keys, {f"__{n}": f"{n}_per90" for n in names}, [group])
    score = F.lit(0.0)
    for g, weights in WEIGHTS.items():
        own = {n: w for n, w in weights.items() if n in names}
        score = F.when(F.col(group) == g, W.weighted_score({n: F.col(f"__{n}") for n in own}, own)).otherwise(score)
    return held.withColumn("score", score).drop(*[f"__{n}" for n in names])


def ranked_metrics(percentiles: dict[str, Column]) -> Column:
    """name, percentile of a row's metrics, best first, equal ones by name; unknown ones drop out."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), p.alias("percentile")) for n, p in percentiles.items()])
    keyed = F.transform(F.filter(each, lambda m: m["percentile"].isNotNull()), lambda m: F.struct((-m["percentile"]).alias("down"), m["name"].alias("name"), m["percentile"].alias("percentile")))
    return F.transform(F.array_sort(keyed), lambda m: F.struct(m["name"].alias("name"), m["percentile"].alias("percentile")))


def strengths(metrics: Column, top: int = 5) -> Column:
    return F.slice(metrics, 1, top)


def weaknesses(metrics: Column, last: int = 4) -> Column:
    """The last metrics, worst first."""
    return F.slice(F.reverse(metrics), 1, last)


def biography(nationality: Column, age: Column, foot: Column, height_cm: Column) -> Column:
    """What is known of a player, each part after a comma; empty where nothing is."""
    parts = [
        F.concat(F.lit("from "), F.nullif(nationality, F.lit(""))),
        F.concat(F.bround(F.when(~F.isnan(age.cast("double")), age), 0).cast("int").cast("string"), F.lit(" years old")),
        F.when(foot == "both", "two-footed").when(foot != "", F.concat(foot, F.lit("-footed"))),
        F.format_string("%.2fm tall", height_cm.cast("double") / 100),
    ]
    parts[-1] = F.when(height_cm.isNotNull(), parts[-1])
    said = F.concat_ws(", ", *parts)
    return F.when(said == "", "").otherwise(F.concat(F.lit(", "), said))


#: Words of a question that are surnames too and must name nobody.
COMMON_WORDS = frozenset(
    """
    young older elder best good great strong quick fast pace power powerful
    back backs wing wings wide side sides ball balls foot feet left right
    play plays player players playing style forward forwards striker
    winger wingers defender defenders midfield midfielder keeper goalkeeper
    find give need want show tell like similar compare best most more less than
    that this they them with from what which have take takes make makes
    someone somebody anyone scoring passing tackling dribbling pressing
    creative defensive attacking complete season minutes team teams club
    """.split()
)


def mentioned(names: DataFrame, name: str, question: str, most: int = 3) -> DataFrame:
    """Rows that a question names by a word of four letters or more which stands in at most `most` rows. Only rows
    that hold a word of the question reach the count, so nothing but those is shuffled."""
    asked = sorted({w for w in re.findall("[a-z0-9]+", fold(question)) if len(w) >= 4} - COMMON_WORDS)
    wanted = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
    hits = names.withColumn("__asked", F.array_intersect(F.array_distinct(S.words(F.col(name))), wanted)).filter(F.size("__asked") > 0)
    common = shared_tokens(hits.select(name), name, most).filter(F.col("token").isin(asked)).agg(F.collect_set("token").alias("__common"))  # at most the question's words
    return hits.crossJoin(F.broadcast(common)).filter(F.size(F.array_except("__asked", "__common")) > 0).drop("__asked", "__common")  # one row


def retrieved(pool: DataFrame, vector: str, pinned: Column, top: int, keys: list[str]) -> DataFrame:
    """pool with pinned and similarity to the centroid of the pinned rows: these first, then the nearest."""
    one = centroid(pool.filter(pinned), vector).withColumnRenamed("centroid", "__query")
    scored = pool.crossJoin(F.broadcast(one)).withColumns({"pinned": F.coalesce(pinned, F.lit(False)), "similarity": S.cosine(F.col(vector), F.col("__query"))})  # one row
    return scored.drop("__query").orderBy(F.desc("pinned"), F.desc("similarity"), *keys).limit(top)


def leaders(pool: DataFrame, metric: str, player: str, keys: list[str], top: int) -> DataFrame:
    """The filtered pool by a metric, missing ones last, one place a player."""
    best = W.first_by(pool, [player], [F.col(metric).desc_nulls_last(), *map(F.col, keys)])
    return best.orderBy(F.col(metric).desc_nulls_last(), *keys).limit(top)


#: What questions call the metrics.
METRIC_PHRASES = {
    "goals": ("goals", "goalscoring", "golos", "gols", "scores", "score", "marcam"),
    "xg": ("xg", "expected goals", "golos esperados", "gols esperados"),
    "shots": ("shots", "shooting", "shoot", "shoots", "remates", "rematam", "remata", "chutes"),
    "assists": ("assists", "assistencias"),
    "passes_completed": ("completed passes", "complete the most passes", "complete passes", "pass completion", "passes completos", "passes certos"),
    "progressive_passes": ("progressive passes", "passes progressivos"),
    "passes": ("passes", "passing", "passe"),
    "dribbles_completed": ("completed dribbles", "successful dribbles", "dribles completos", "dribles ganhos"),
    "dribbles": ("dribbles", "dribbling", "dribles", "driblar"),
    "progressive_carries": ("progressive carries", "conducoes progressivas"),
    "carries": ("carries", "conducoes", "conducao", "conduzem", "conduz a bola"),
    "tackles": ("tackles", "tackling", "desarmes", "desarme"),
    "interceptions": ("interceptions", "intercecoes", "intercetacoes"),
    "blocks": ("blocks", "bloqueios"),
    "clearances": ("clearances", "alivios", "cortes"),
    "ball_recoveries": ("ball recoveries", "recoveries", "recuperacoes", "bolas recuperadas", "recuperam bolas", "recupera bolas", "recuperar bolas"),
    "pressures": ("pressures", "pressing", "press", "presses", "pressoes", "pressionam", "pressiona", "pressionar"),
}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _metrics(folded: pd.Series) -> pd.Series:
    longest = sorted(((p, m, re.compile(rf"\b{p}\b")) for m, ps in METRIC_PHRASES.items() for p in ps), key=lambda x: -len(x[0]))

    def named(text: str) -> list[str]:
        spots: dict[str, int] = {}
        for phrase, metric, whole in longest:
            if phrase in text and (hit := whole.search(text)):  # most phrases are in no question
                spots.setdefault(metric, hit.start())
                text = text[: hit.start()] + "\0" * len(phrase) + text[hit.end() :]  # ground taken by the longer phrase
        return sorted(spots, key=spots.get)[:3]

    return folded.fillna("").map(named)


def metrics_in(question: Column) -> Column:
    """At most three metrics that a question names, in order of mention; a long phrase hides the short ones in it."""
    return _metrics(S.folded(question))


def filled(players: DataFrame, known: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """players with the columns of checks filled from known where they are null and the known value passes its check;
    what is there already stays. known has a row per key."""
    right = known.select(F.col(key).alias("__key"), *[F.when(ok, F.col(c)).alias(f"__{c}") for c, ok in checks.items()])
    joined = players.join(right, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in checks else F.col(c) for c in players.columns])


def retrieve(index: DataFrame, question: str, top: int, countries: list[str] | None = None) -> DataFrame:
    """The rows of an index that answer a question, with place. index: player, name, vector, foot, position_group, role,
    age, nationality and metrics (<name>_per90), as far as it has them.

    What the question requires filters first. Players that it names are pinned, unless it requires something; the rest
    follows by similarity to them, or to the whole pool where nobody is named. A question that asks for leaders of a
    metric and names nobody orders the whole filtered pool by that metric instead. The question is one text, read
    before the plan is made."""
    from tallyspark.operators.search import asks_for_leaders, matching, parse_constraints

    asked = index.sparkSession.createDataFrame([(question,)], "q string")
    columns = {n: c.alias(n) for n, c in parse_constraints("q", countries).items()} | {"metrics": metrics_in(F.col("q")).alias("metrics"), "leaders": asks_for_leaders(F.col("q")).alias("leaders")}
    said = asked.select(*columns.values()).first()  # one row
    required: dict[str, Column] = {n: F.col(n) == said[n] for n in ("foot", "role", "position_group", "nationality") if said[n] is not None and n in index.columns}
    ages = [c for c in (None if said.max_age is None else F.col("age") <= said.max_age, None if said.min_age is None else F.col("age") >= said.min_age) if c is not None]
    if ages and "age" in index.columns:
        required["age"] = ages[0] if len(ages) == 1 else ages[0] & ages[1]
    pool = matching(index, required)
    named = mentioned(index.select("player", "name"), "name", question).select("player")
    metric = next((f"{m}_per90" for m in said.metrics if f"{m}_per90" in index.columns), None)
    if metric and said.leaders and named.isEmpty():
        found = leaders(pool, metric, "player", ["player"], top)
        order = [F.col(metric).desc_nulls_last(), F.col("player")]
    else:
        marked = pool.join(named.distinct().withColumn("__named", F.lit(True)), "player", "left")
        basis = marked.filter("__named") if not named.isEmpty() else marked
        one = centroid(basis, "vector").withColumnRenamed("centroid", "__query")
        scored = marked.crossJoin(F.broadcast(one)).withColumn("similarity", S.cosine(F.col("vector"), F.col("__query")))  # one row
        pins = F.coalesce("__named", F.lit(False)) if not required else F.lit(False)
        found = scored.withColumn("__pinned", pins)
        order = [F.desc("__pinned"), F.desc("similarity"), F.col("player")]
        found = found.orderBy(*order).limit(top)
    place = F.row_number().over(Window.orderBy(*order))  # of the rows that are shown
    return found.withColumn("place", place).drop("__named", "__query", "__pinned")
