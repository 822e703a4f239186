"""Scalar expressions of entity-performance data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import names

#: The goal's place on a 120 x 80 pitch, progress that counts, the grid.
GOAL_X, GOAL_Y = 120.0, 40.0
PASS_PROGRESS, CARRY_PROGRESS = 10.0, 5.0
COLUMNS, ROWS = 12, 8

#: Rules in order, the first that the lower-cased position holds wins.
GROUP_RULES = (("goalkeeper", "GK"), ("back", "DEF"), ("midfield", "MID"), ("wing", "FWD"), ("forward", "FWD"), ("striker", "FWD"))


def per90(total: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, total * (F.lit(90.0) / minutes)).otherwise(F.lit(0.0))


def position_group(position: Column) -> Column:
    out = F.when(F.coalesce(position, F.lit("")) == "", "Unknown")
    for word, group in GROUP_RULES:
        out = out.when(F.lower(position).contains(word), group)
    return out.otherwise("MID")


#: Playing roles without sides, in order, the first that the lower-cased position holds wins.
ROLE_RULES = (
    ("goalkeeper", "Goalkeeper"), ("wing back", "Wing Back"), ("center back", "Centre Back"), ("back", "Full Back"), ("defensive midfield", "Defensive Midfield"),
    ("attacking midfield", "Attacking Midfield"), ("center midfield", "Central Midfield"), ("midfield", "Wide Midfield"), ("wing", "Winger"), ("forward", "Centre Forward"), ("striker", "Centre Forward"),
)


def position_role(position: Column) -> Column:
    out = F.when(position.isNull(), "Unknown")
    for word, role in ROLE_RULES:
        out = out.when(F.lower(position).contains(word), role)
    return out.otherwise("Unknown")


def peer_group(gender: Column, group: Column) -> Column:
    return F.concat_ws(":", F.upper(F.substring(F.coalesce(gender, F.lit("unknown")), 1, 1)), group)


def one_hot(value: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """Null where the value is unknown, not 0."""
    return {n: F.when(value.isNotNull(), (value == n).cast("int")) for n in names}


def years_between(later: Column, earlier: Column, year_days: float = 365.25) -> Column:
    return F.bround(F.datediff(later, earlier) / F.lit(year_days), 1)


def distance_to_goal(x: Column, y: Column) -> Column:
    return F.hypot(F.lit(GOAL_X) - x, F.lit(GOAL_Y) - y)


def progress(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return distance_to_goal(x0, y0) - distance_to_goal(x1, y1)


def cell(x: Column, y: Column) -> Column:
    """Row-major cell of the grid, clamped at its edges."""
    at = lambda v, n: F.least(F.greatest((v / 10).cast("int"), F.lit(0)), F.lit(n - 1))
    return at(y, ROWS) * COLUMNS + at(x, COLUMNS)


def value_in_euros(raw: Column) -> Column:
    """Amounts like a sign, a number and K or M; 0 where there is no number."""
    plain = F.upper(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    number = F.coalesce(F.regexp_extract(plain, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    return number * F.when(plain.endswith("M"), 1e6).when(plain.endswith("K"), 1e3).otherwise(1.0)


def day_of(value: Column) -> Column:
    return F.substring(value, 1, 10).try_cast("date")


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def label(column: Column) -> Column:
    name = F.regexp_replace(column, "_per90$", "")
    return F.when(name == "xg", "xG").otherwise(F.regexp_replace(name, "_", " "))


#: What shot outcomes and body parts are called, and the passes that restart play.
SHOT_OUTCOMES = {
    "Goal": "goal", "Saved": "saved", "Saved Off Target": "saved", "Saved to Post": "saved", "Blocked": "blocked",
    "Off T": "off-target", "Wayward": "off-target", "Post": "hit-woodwork",
}
BODY_PARTS = {"Right Foot": "right-foot", "Left Foot": "left-foot", "Head": "head"}
RESTARTS = ("Corner", "Free Kick", "Kick Off", "Goal Kick")


def recoded(value: Column, names: dict[str, str], default: str = "other") -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == value)), F.lit(0)), F.lit(default))


def open_play_move(kind: Column, pass_type: Column, pass_outcome: Column, pass_end: Column, carry_end: Column) -> Column:
    """Where an open-play pass or a carry ends and whether it gets there; null for everything else."""
    passed = (kind == "Pass") & ~F.coalesce(pass_type.isin(*RESTARTS), F.lit(False))
    return F.when(passed, F.struct(pass_end.alias("end"), pass_outcome.isNull().alias("completed"))).when(kind == "Carry", F.struct(carry_end.alias("end"), F.lit(True).alias("completed")))


def last_sentence(text: Column) -> Column:
    """The text up to its last full stop; the whole text where it has none."""
    cut = F.regexp_extract(text, r"(?s)^(.+\.)", 1)
    return F.when(cut == "", text).otherwise(F.regexp_replace(cut, r"^\s+|\s+$", ""))


def first_json(text: Column) -> Column:
    """From the first opening to the last closing brace; null without them."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


#: Words that name a gender.
FEMALE = r"(?i)\b(female|women|woman|mulher|mulheres|jogadora|jogadoras|feminin[oa]s?)\b"
MALE = r"(?i)\b(male|men|man|homem|homens|masculin[oa]s?)\b"


def asked_gender(text: Column) -> Column:
    """Null where neither or both are named."""
    female, male = text.rlike(FEMALE), text.rlike(MALE)
    return F.when(female & ~male, "female").when(male & ~female, "male")


@F.pandas_udf(T.StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(names.fold, na_action="ignore")


def folded(text: Column) -> Column:
    """Lower case without accents: decomposed (NFKD), combining marks dropped; letters that decompose into nothing stay."""
    return _fold(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), 0)


def distinct_words(text: Column) -> Column:
    """The different words of a text. Only what holds other letters than ASCII goes through Python to be folded, each
    piece of a text once; folding works by letter, so pieces between other ASCII fold like the whole."""
    pieces = F.array_distinct(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    other = r"[^\x00-\x7F]"
    plain = F.transform(F.filter(pieces, lambda w: (w != "") & ~w.rlike(other)), F.lower)
    accented = F.array_join(F.filter(pieces, lambda w: w.rlike(other)), " ")
    return F.array_distinct(F.concat(plain, words(F.coalesce(accented, F.lit("")))))


def name_tokens(name: Column) -> Column:
    """Different words of a name with more than two letters; dots, hyphens and apostrophes separate."""
    split = F.split(F.trim(F.translate(folded(name), ".-'", "   ")), r"\s+")
    return F.array_distinct(F.filter(split, lambda w: F.length(w) > 2))


def half_up(value: Column, digits: int) -> Column:
    """Rounding of values from 0 up by floor, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + 0.5) / F.lit(scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def goal_distribution(chances: Column, cap: int = 10) -> Column:
    """Chances of 0 to cap goals from independent chances in 0..1; what exceeds cap is lost."""
    start = F.array(F.lit(1.0), *[F.lit(0.0)] * cap)
    clamped = F.transform(chances, lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    step = lambda dist, p: F.transform(dist, lambda d, k: d * (1 - p) + F.coalesce(F.get(dist, k - 1), F.lit(0.0)) * p)
    return F.aggregate(clamped, start, step)


def win_draw(home: Column, away: Column) -> tuple[Column, Column]:
    """Chances that the first distribution ends above the second, and level with it."""
    below = lambda k: F.aggregate(F.slice(away, F.lit(1), k), F.lit(0.0), lambda s, x: s + x)
    win = F.aggregate(F.transform(home, lambda h, k: h * below(k)), F.lit(0.0), lambda s, x: s + x)
    return win, dot(home, away)


def poisson_grid(rate: Column, most: int = 10) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(-rate) * F.pow(rate, k) / F.factorial(k))


def outcome_probabilities(home: Column, away: Column, most: int = 10) -> Column:
    """win, draw and lose of the first side from two scoring rates, over up to `most` goals each, adding up to 1."""
    h, a = poisson_grid(home, most), poisson_grid(away, most)
    win, draw = win_draw(h, a)
    lose = win_draw(a, h)[0]
    whole = win + draw + lose
    return F.struct((win / whole).alias("win"), (draw / whole).alias("draw"), (lose / whole).alias("lose"))
