"""Validated structured search, vector search, constraint parsing and entity matching."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import scalars as S
from tallyspark.functions.names import fold, weighted_ratio
from tallyspark.operators.windows import first_by

OPERATORS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__, "eq": Column.__eq__}


@dataclass(frozen=True)
class Query:
    """conditions: (field, operator, number); equals and contains: text fields; checked before any plan is made."""

    fields: tuple[str, ...]
    conditions: tuple[tuple[str, str, float], ...] = ()
    equals: tuple[tuple[str, str], ...] = ()
    contains: tuple[tuple[str, str], ...] = ()
    order: str | None = None
    descending: bool = True
    limit: int = 20

    def __post_init__(self):
        for field, op, _ in self.conditions:
            if field not in self.fields or op not in OPERATORS:
                raise ValueError(f"unknown condition {field} {op}")
        if self.order is not None and self.order not in self.fields:
            raise ValueError(f"unknown order {self.order}")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be from 1 to 100")


def execute(df: DataFrame, query: Query, keys: list[str]) -> DataFrame:
    """NaN and null match nothing and come last in either direction; keys settle ties."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    for field, op, value in query.conditions:
        df = df.filter(OPERATORS[op](known(field), F.lit(value)))
    for field, value in query.equals:
        df = df.filter(F.lower(field) == value.lower())
    for field, value in query.contains:
        df = df.filter(F.contains(F.lower(field), F.lit(value.lower())))
    if query.order:
        df = df.orderBy(known(query.order).desc_nulls_last() if query.descending else known(query.order).asc_nulls_last(), *keys)
    else:
        df = df.orderBy(*keys)
    return df.limit(query.limit)


def projected(df: DataFrame, query: Query, identity: list[str], digits: int = 3) -> DataFrame:
    """Who the rows are, and every number that the query names, rounded."""
    named = sorted({f for f, _, _ in query.conditions} | ({query.order} if query.order else set()))
    return df.select(*identity, *[F.bround(F.col(f).cast("double"), digits).alias(f) for f in named if f not in identity])


def matching(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """Rows that meet all constraints; a missing attribute fails, one that no row has is no filter."""
    if not constraints:
        return df
    known = df.agg(*[F.max(F.col(name).isNotNull()).alias(f"__{name}") for name in constraints])
    marked = df.crossJoin(F.broadcast(known))  # one row
    for name, condition in constraints.items():
        marked = marked.filter(~F.coalesce(F.col(f"__{name}"), F.lit(False)) | F.coalesce(condition, F.lit(False)))
    return marked.drop(*[f"__{name}" for name in constraints])


def nearest(df: DataFrame, vector: str, query: list[float], top: int, keys: list[str]) -> DataFrame:
    """Exact search by cosine; filter df first. One pass and a top-k per task."""
    similarity = S.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return df.withColumn("similarity", similarity).orderBy(F.desc("similarity"), *keys).limit(top)


def centroid(df: DataFrame, vector: str) -> DataFrame:
    """One row: the mean of the unit vectors, as a unit vector."""
    each = df.select(F.posexplode(S.unit(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return each.groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(S.unit(F.transform("v", lambda s: s["x"])).alias("centroid"))


def shared_tokens(names: DataFrame, name: str, most: int = 3) -> DataFrame:
    """Words that stand in more than `most` rows and so point to nobody."""
    return names.select(F.explode(S.distinct_words(F.col(name))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > most)


def unique_lookup(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with value by key; keys that right has twice or more match nothing."""
    once = right.withColumn("__n", F.count("*").over(Window.partitionBy(key))).filter("__n = 1").select(key, value)
    return left.join(once, key, "left")


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def match_names(left: DataFrame, right: DataFrame, least: float = 90.0) -> DataFrame:
    """left_id, right_id, common (words), score: rows that name the same one: equal names, or names of at least that
    score with two words in common or one that each side has in a single row. left, right: id, name. The best score
    wins, then the smallest right_id.

    Each distinct name meets others once, on its words that both sides have: those in a single row of each, and all
    but its commonest. Two names with two words in common share one that is not the commonest of either, so no pair is
    missed and the commonest word of all names makes none.
    """
    named = lambda df: df.select("id", F.trim(S.folded(F.col("name"))).alias("name")).filter("name <> ''")
    a, b = named(left), named(right)
    held = lambda df, n: df.select(F.explode(S.name_tokens(F.col("name"))).alias("token")).groupBy("token").agg(F.count("*").alias(n))
    both = held(a, "l").join(held(b, "r"), "token").select("token", (F.col("l") * F.col("r")).alias("weight"))
    ids = b.groupBy("name").agg(F.min("id").alias("right_id"))

    def keyed(df, side):
        rows = df.select("name").distinct().select("name", S.name_tokens(F.col("name")).alias("words")).withColumn("token", F.explode("words")).join(both, "token")
        place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("weight"), F.desc("token")))
        kept = rows.withColumn("place", place).filter("place > 1 OR weight = 1")
        return kept.select("token", (F.col("weight") == 1).alias(f"{side}_alone"), F.col("name").alias(f"{side}_name"), F.col("words").alias(f"{side}_words"))

    common = F.size(F.array_intersect("left_words", "right_words"))
    met = keyed(a, "left").join(keyed(b, "right"), "token").withColumn("common", common).filter("common >= 2 OR left_alone").select("left_name", "right_name", "common").distinct()
    alike = met.filter("left_name <> right_name").withColumn("score", _likeness("left_name", "right_name")).filter(F.col("score") >= least)
    equal = a.select("name").distinct().join(ids, "name").select(F.col("name").alias("left_name"), F.size(S.name_tokens(F.col("name"))).alias("common"), F.lit(100.0).alias("score"), "right_id")
    found = alike.join(ids.withColumnRenamed("name", "right_name"), "right_name").select("left_name", "common", "score", "right_id").unionByName(equal)
    best = first_by(found, ["left_name"], [F.desc("score"), F.col("right_id")])
    return a.select(F.col("id").alias("left_id"), F.col("name").alias("left_name")).join(best, "left_name").select("left_id", "right_id", "common", "score")


#: What questions say, in order of precedence.
FOOT_WORDS = (
    ("left", r"\b(left[\s-]?footed|left foot|canhot[oa]|esquerdin[oa]|pe esquerdo)s?\b"),
    ("right", r"\b(right[\s-]?footed|right foot|destr[oa]|pe direito)s?\b"),
    ("both", r"\b(two[\s-]?footed|both feet|ambidextrous|ambidestr[oa]|ambidextr[oa])s?\b"),
)
GROUP_WORDS = (
    ("GK", r"\b(goalkeeper|keeper|goalie|guarda[\s-]?redes|guardiao|goleiro)s?\b"),
    ("DEF", r"\b(wing[\s-]?back|full[\s-]?back|centre[\s-]?back|center[\s-]?back|defender|defence|defense|defesa|defensor(?:es)?|centra(?:l|is)|latera(?:l|is)|ala)s?\b"),
    ("MID", r"\b(midfield(?:er)?|playmaker|holding|regista|medio|meio[\s-]?campo|meia|trinco)s?\b"),
    ("FWD", r"\b(winger|striker|forward|attacker|centre[\s-]?forward|extremo|ponta de lanca|avancad[oa]|atacante)s?\b"),
)
ROLE_WORDS = (
    ("Goalkeeper", r"\b(goalkeeper|keeper|goalie|guarda[\s-]?redes|guardiao|goleiro)s?\b", "GK"),
    ("Wing Back", r"\b(wing[\s-]?backs?|alas?)\b", "DEF"),
    ("Full Back", r"\b(full[\s-]?backs?|latera(?:l|is))\b", "DEF"),
    ("Centre Back", r"\b(cent(?:re|er)[\s-]?backs?|defesas? centra(?:l|is)|centra(?:l|is))\b", "DEF"),
    ("Defensive Midfield", r"\b(defensive midfield(?:er)?s?|holding midfield(?:er)?s?|trincos?|medios? defensivos?|volantes?)\b", "MID"),
    ("Attacking Midfield", r"\b(attacking midfield(?:er)?s?|playmakers?|medios? ofensivos?|meias?)\b", "MID"),
    ("Centre Forward", r"\b(cent(?:re|er)[\s-]?forwards?|strikers?|pontas? de lanca)\b", "FWD"),
    ("Winger", r"\b(wingers?|extremos?)\b", "FWD"),
)
OLDEST = r"\b(?:under|younger than|below|u|sub|menos de|abaixo de|ate aos?)[\s-]?(\d{2})\b"
YOUNGEST = r"\b(?:over|older than|above|mais de|acima de|a partir dos?)[\s-]?(\d{2})\b"
YOUNG, YOUNG_MOST = r"\b(young|youngster|prospect|teenager|jovem|jovens|promessa)s?\b", 23
VETERAN, VETERAN_LEAST = r"\b(veteran|experienced|older|veteran[oa]|experiente)s?\b", 32
#: What people of a country are called, and the country's folded name.
DEMONYMS = {
    r"spanish|espanho(?:l|is|la|las)|espanha": "spain",
    r"italians?|italian[oa]s?|italia": "italy",
    r"french|frances(?:a|es|as)?|franca": "france",
    r"english|ingles(?:a|es|as)?|inglaterra": "england",
    r"americans?|american[oa]s?|estados unidos|eua|usa": "united states of america",
    r"germans?|alemao|alema|alemaes|alemas|alemanha": "germany",
    r"brazilians?|brasileir[oa]s?|brasil": "brazil",
    r"argentin(?:e|ian)s?|argentin[oa]s?": "argentina",
    r"senegalese|senegales(?:a|es|as)?": "senegal",
    r"swedish|suec[oa]s?|suecia": "sweden",
    r"dutch|holandes(?:a|es|as)?|neerlandes(?:a|es|as)?|holanda": "netherlands",
    r"portuguese|portugues(?:a|es|as)?": "portugal",
    r"ivorian|marfinenses?|ivory coast|costa do marfim": "cote d'ivoire",
    r"serbians?|servi[oa]s?|servia": "serbia",
    r"scottish|escoces(?:a|es|as)?|escocia": "scotland",
    r"belgians?|belgas?|belgica": "belgium",
    r"danish|dinamarques(?:a|es|as)?|dinamarca": "denmark",
    r"swiss|suic[oa]s?|suica": "switzerland",
    r"welsh|gales(?:a|es|as)?|pais de gales": "wales",
    r"norwegians?|noruegues(?:a|es|as)?|noruega": "norway",
    r"austrians?|austriac[oa]s?": "austria",
    r"irish|irlandes(?:a|es|as)?|irlanda": "ireland",
    r"polish|polac[oa]s?|polones(?:a|es|as)?|polonia": "poland",
    r"uruguayans?|uruguai[oa]s?|uruguai": "uruguay",
    r"japanese|japones(?:a|es|as)?|japao": "japan",
    r"moroccans?|marroquin[oa]s?|marrocos": "morocco",
    r"colombians?|colombian[oa]s?": "colombia",
    r"croatians?|croatas?|croacia": "croatia",
    r"algerians?|argelin[oa]s?|argelia": "algeria",
    r"slovenians?|esloven[oa]s?|eslovenia": "slovenia",
    r"canadians?|canadian[oa]s?|canadenses?": "canada",
    r"nigerians?|nigerian[oa]s?": "nigeria",
    r"chileans?|chilen[oa]s?": "chile",
    r"cameroonians?|camaroneses?|camaroes": "cameroon",
    r"australians?|australian[oa]s?": "australia",
    r"ghanaians?|ganes(?:a|es|as)?|gana": "ghana",
    r"malians?|malian[oa]s?": "mali",
    r"mexicans?|mexican[oa]s?": "mexico",
    r"venezuelans?|venezuelan[oa]s?": "venezuela",
    r"icelandic|islandes(?:a|es|as)?|islandia": "iceland",
}
LEADERS = r"\b(most|highest|lead|leads|leading|leader|leaders|top|more|mais|maior|maiores|lidera|lideram)\b"


def country_vocabulary(rows: DataFrame, column: str) -> list[str]:
    """The different countries of a table, sorted: as many as there are countries, for the plan of a question."""
    return [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def _folded_country(name: str) -> str:
    return " ".join(fold(name.split("(")[0]).split())


def _nationality(text: Column, countries: list[str]) -> Column:
    """A country of the vocabulary, by its people's name in the order of the table, else by its own."""
    known = {_folded_country(c): c for c in countries}
    out = F.lit(None).cast("string")
    rules = [(p, known[c]) for p, c in DEMONYMS.items() if c in known] + [(re.escape(f), c) for f, c in known.items() if f]
    for pattern, country in reversed(rules):
        out = F.when(text.rlike(rf"\b(?:{pattern})\b"), country).otherwise(out)
    return out


def parse_constraints(question: str, countries: list[str] | None = None) -> dict[str, Column]:
    """foot, role, position_group, max_age, min_age and nationality of a question's column; null where it says nothing.

    Of feet the first rule decides, of positions the earliest word. A role stands if no position word comes before
    it and brings its group. Ages in numbers go before young and veteran words. Without countries no nationality is
    read."""
    text = S.folded(F.col(question))
    foot = F.lit(None).cast("string")
    for name, pattern in reversed(FOOT_WORDS):
        foot = F.when(text.rlike(pattern), name).otherwise(foot)

    def first(rules):
        at = [F.struct(F.nullif(F.regexp_instr(text, F.lit(r[1])), F.lit(0)).alias("at"), F.lit(r[0]).alias("v"), F.lit(r[-1]).alias("group")) for r in rules]
        return F.get(F.array_sort(F.filter(F.array(*at), lambda s: s["at"].isNotNull())), F.lit(0))

    group, role = first([(v, p, v) for v, p in GROUP_WORDS]), first(ROLE_WORDS)
    stands = role.isNotNull() & (group.isNull() | (role["at"] <= group["at"]))
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    return {
        "foot": foot,
        "role": F.when(stands, role["v"]),
        "position_group": F.when(stands, role["group"]).otherwise(group["v"]),
        "max_age": F.coalesce(number(OLDEST), F.when(text.rlike(YOUNG), YOUNG_MOST)),
        "min_age": F.coalesce(number(YOUNGEST), F.when(text.rlike(VETERAN), VETERAN_LEAST)),
        "nationality": _nationality(text, countries or []),
    }


def asks_for_leaders(text: Column) -> Column:
    return S.folded(text).rlike(LEADERS)
