"""What boosted models say: positions at three grains, mismatches, values with bounds, bargains, importance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import boosting as M
from tallyspark.operators.evaluation import split_by_key
from tallyspark.plans.catalog import query
from tallyspark.plans.registry import _RATES, _grid, _peers
from tallyspark.sources.tables import saved, table

#: Grains of position, from broad to exact; features of all of them; where a player acts, without a side and with one.
TARGETS = ("position_group", "position_role", "primary_position")
PER90 = [f"{c}_per90" for c in _RATES]
SIDELESS = ["mean_x", "spread_x", "spread_y", "final_third", "own_third", "wide_share"]
SIDED = ["mean_y", "left_share", "right_share"]
FOOT = ["foot_left", "foot_right"]
#: Rounds and depth of the queries' trees, rows of a class at least, and the confidence from which a mismatch is told.
ROUNDS, DEPTH, CLASS, CONFIDENT = 3, 2, 10, 0.25


def features_of(columns: list[str], target: str) -> list[str]:
    """What a target is predicted from: what tells left from right goes in only where a side is predicted, and only what
    the frame has."""
    exact = target == "primary_position"
    return PER90 + [c for c in SIDELESS + (SIDED + FOOT if exact else []) if c in columns]


def frame(spark, sf) -> DataFrame:
    """Player-seasons with rates, zone shares (null without actions), foot, and a position at each grain."""
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("player"), F.col("c_nationkey").alias("nation"))
    zones = A.zone_features(_grid(spark, sf), "player").drop("actions")
    both = _peers(spark, sf).join(nation, "player").join(zones, "player", "left")
    foot = {name: F.when(F.col("player") % 5 > 0, (F.col("player") % 5 == k).cast("double")) for name, k in zip(FOOT, (2, 3))}
    return both.withColumns({**foot, "position_group": F.col("grp"), "position_role": F.concat(F.lit("role-"), F.col("nation") % 10), "primary_position": F.concat(F.lit("position-"), F.col("nation"))})


def _split(rows: DataFrame, target: str) -> DataFrame:
    common = rows.groupBy(target).agg(F.count("*").alias("n")).filter(F.col("n") >= CLASS).select(target)
    return M.stratified(rows.join(common, target, "left_semi"), target, ["player", "season"])


def _fitted(rows: DataFrame, target: str) -> tuple[DataFrame, M.Classifier]:
    """The split is written once, so that every pass over it holds out the same rows and none computes them again."""
    split = saved(_split(rows, target), "split")
    return split, M.classifier(split.filter("not is_test"), features_of(split.columns, target), target, ["player", "season"], rounds=ROUNDS, depth=DEPTH)


@query()
def position_report(spark, sf):
    """For each grain, on rows that no model has seen: accuracy, its mean over classes, and how often the right class is
    among the first three (always, where there are no more than three)."""
    out, rows = None, saved(frame(spark, sf), "frame")
    for target in TARGETS:
        split, found = _fitted(rows, target)
        judged = M.classified(split.filter("is_test"), found).withColumn("label", F.col(target))
        place = F.array_position(F.lit(found.classes), F.col("label")).cast("int") - 1
        above = F.size(F.filter("p", lambda q: q > F.get("p", place)))
        by_class = judged.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("label")).cast("int")).alias("hits"), F.sum((above < 3).cast("int")).alias("top"), F.avg("confidence").alias("confidence"))
        top = F.lit(1.0) if len(found.classes) <= 3 else F.sum("top") / F.sum("n")
        one = by_class.agg(F.lit(target).alias("target"), F.count("*").alias("classes"), F.sum("n").alias("n_test"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"), top.alias("top3"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def style_profiles(spark, sf):
    """The calibrated probability of every group for every player-season, in order of the groups' names."""
    split, found = _fitted(saved(frame(spark, sf), "frame"), "position_group")
    return M.classified(split, found).select("player", "season", "is_test", F.map_from_arrays(F.lit(found.classes), F.transform("p", lambda x: F.round(x, 3))).alias("style"))


@query()
def model_mismatches(spark, sf):
    """Players that the model confidently takes for another group than they are listed in."""
    split, found = _fitted(saved(frame(spark, sf), "frame"), "position_group")
    other = M.classified(split, found).filter((F.col("predicted") != F.col("position_group")) & (F.col("confidence") >= CONFIDENT))
    return other.select("player", "season", F.col("position_group").alias("listed"), F.col("predicted").alias("plays_like"), F.round("confidence", 3).alias("confidence")).orderBy(F.desc("confidence"), "player", "season").limit(15)


@query()
def shap_importance(spark, sf):
    """Mean size of the features' Shapley values for the group model, over all rows."""
    split, found = _fitted(saved(frame(spark, sf), "frame"), "position_group")
    return M.importance(split, found.model, 10)


def _valued(spark, sf) -> tuple[DataFrame, list[M.Model]]:
    """Rows of players with a value, its logarithm and whether the player is held out, and models of its bounds."""
    worth = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("player"), F.col("c_acctbal").alias("value"))
    rows = _peers(spark, sf).join(worth, "player").withColumns({"log_value": F.log1p("value"), "is_test": split_by_key(F.col("player"), 0.25)})
    return rows, M.bounds(rows.filter("not is_test"), PER90, "log_value", rounds=ROUNDS, depth=DEPTH)


def _priced(rows: DataFrame, models) -> DataFrame:
    banded = M.banded(rows, models)
    return banded.withColumns({c: F.round(F.expm1(c), 0) for c in ("low", "predicted", "high")})


@query()
def value_bounds(spark, sf):
    """How wide and how right the bounds are on players that no model has seen, and how the middle compares with always
    naming the median."""
    rows, models = _valued(spark, sf)
    priced = _priced(rows.filter("is_test"), models)
    median = rows.filter("not is_test").agg(F.percentile_approx("value", 0.5, 10_000).alias("median"))  # one row
    inside = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    error = lambda c: F.avg(F.abs(F.col("value") - F.col(c)))
    return priced.crossJoin(F.broadcast(median)).agg(F.count("*").alias("n"), F.avg(inside.cast("int")).alias("coverage"), error("predicted").alias("mae"), error("median").alias("mae_of_median"), F.avg(F.col("high") - F.col("low")).alias("width"))


@query()
def model_bargains(spark, sf):
    """Players worth less than the lower bound of what their seasons are predicted to be worth, most underpriced first."""
    rows, models = _valued(spark, sf)
    under = _priced(rows, models).filter("value < low").withColumn("upside", F.col("predicted") - F.col("value"))
    return under.select("player", "season", "value", "low", "predicted", "high", "upside").orderBy(F.desc("upside"), "player", "season").limit(15)
