"""Texts made of rows: cleaned names, notes, profiles and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S

_SPACE = r"[\x20\x09-\x0D]+"


def ascii_name(name: Column) -> Column:
    """Lower case without accents and without what ASCII lacks, words one space apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(S.folded(name), r"[^\x00-\x7F]", ""), _SPACE, " "))


def country_key(name: Column) -> Column:
    """What countries are compared by: folded, up to the first bracket."""
    return F.trim(F.regexp_replace(S.folded(F.substring_index(name, "(", 1)), _SPACE + r"| ", " "))


def name_variants(name: Column) -> Column:
    """A name as it is and, of more than two words, its first with its last and its first with its second."""
    clean = F.trim(name)
    words = F.split(clean, _SPACE)
    first = lambda k: F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, k))
    return F.array_distinct(F.when(F.size(words) > 2, F.array(clean, first(-1), first(2))).otherwise(F.array(clean)))


def described(foot: Column, role: Column, group: Column, nationality: Column, oldest: Column, youngest: Column) -> Column:
    """What a question asked for, each part after a comma; a role hides its group."""
    whole = lambda x: F.bround(x, 0).cast("int").cast("string")
    return F.concat_ws(
        ", ",
        F.when(foot == "both", "two-footed").when(foot != "", F.concat(foot, F.lit("-footed"))),
        F.coalesce(F.concat(F.lower(role), F.lit("s")), group),
        F.concat(F.lit("from "), nationality),
        F.concat(F.lit("aged "), whole(oldest), F.lit(" or under")),
        F.concat(F.lit("aged "), whole(youngest), F.lit(" or over")),
    )


def metric_note(name: Column, values: dict[str, Column]) -> Column:
    """The asked metrics of a player that are known; null where none is."""
    parts = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(S.label(F.lit(n)), F.lit(" "), F.format_string("%.2f", F.bround(v.cast("double"), 2)), F.lit(" per 90"))) for n, v in values.items()]))
    return F.when(F.size(parts) > 0, F.concat(name, F.lit(": "), F.array_join(parts, ", "), F.lit(".")))


def prose(lead: Column, life: Column, best: Column, worst: Column) -> Column:
    """A profile: who it is, what is known of their life, what they are best and weakest at."""
    said = lambda metrics: F.array_join(F.transform(metrics, lambda m: F.concat(S.label(m["name"]), F.lit(" ("), S.ordinal(F.bround(m["percentile"], 0).cast("int")), F.lit(" percentile)"))), " and ")
    return F.concat(lead, life, F.lit(". Best at "), said(best), F.lit(". Weakest at "), said(worst), F.lit("."))


def prompt(hits: DataFrame, question: Column, only: Column, line: Column, order: list[str]) -> DataFrame:
    """One row: the question, what was filtered on and a line per hit. hits are a search's, as many as its limit."""
    lines = hits.agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    text = F.concat(F.lit("Question: "), question, F.lit("\nOnly players: "), only, F.lit(".\nPlayers:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return lines.select(text.alias("prompt"))
