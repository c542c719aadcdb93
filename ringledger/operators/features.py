"""Feature sets of a contest from the profiles of both sides: one expression builder for training and for prediction.

A profile is a struct column with the fields of PROFILE; nulls stay nulls, so that a missing value makes the features
that need it null and nothing else. Training takes both orientations of every decided contest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions import ratings as R

PROFILE = ("elo", "age", "height", "reach", "slpm", "stracc", "tdavg", "subavg", "kd_rate", "win_rate", "recent_form", "finish_rate", "fights", "wins", "losses", "avg_fight_time", "opp_elo_last3", "elo_velocity", "win_streak", "finish_trending", "opp_quality_trending", "stance")

# The differences that are taken field by field, as feature and profile field.
DIFFERENCES = {
    "elo_diff": "elo", "age_diff": "age", "height_diff": "height", "reach_diff": "reach", "slpm_diff": "slpm",
    "stracc_diff": "stracc", "tdavg_diff": "tdavg", "subavg_diff": "subavg", "kd_rate_diff": "kd_rate", "win_rate_diff": "win_rate",
    "recent_form_diff": "recent_form", "finish_rate_diff": "finish_rate", "experience_diff": "fights",
    "avg_fight_time_diff": "avg_fight_time", "opp_elo_last3_diff": "opp_elo_last3", "elo_velocity_diff": "elo_velocity",
    "win_streak_diff": "win_streak", "finish_trending_diff": "finish_trending", "opp_quality_trending_diff": "opp_quality_trending",
}
# The named feature lists, oldest first.
V1 = ("elo_diff", "height_diff", "reach_diff", "age_diff", "slpm_diff", "tdavg_diff", "subavg_diff", "kd_rate_diff", "win_rate_diff", "recent_form_diff", "finish_rate_diff", "experience_diff", "southpaw_advantage", "is_title_fight")
V2 = (
    "elo_diff", "age_diff", "height_diff", "reach_diff", "slpm_diff", "tdavg_diff", "subavg_diff", "kd_rate_diff", "win_rate_diff",
    "recent_form_diff", "finish_rate_diff", "experience_diff", "style_advantage", "southpaw_advantage", "elo_diff_sq", "age_diff_sq",
    "elo_prime_interaction", "reach_striking_interaction", "is_title_fight", "debut_diff",
)
V3 = (
    *DIFFERENCES, "avg_elo_level", "opponent_elo", "opponent_recent_form", "opponent_finish_rate", "style_advantage", "southpaw_advantage",
    "undefeated_prospect_diff", "rising_prospect_diff", "declining_veteran_diff", "striker_vs_grappler", "finisher_vs_decision",
    "form_velocity_diff", "offensive_pressure_diff", "elo_diff_sq", "age_diff_sq", "elo_prime_interaction",
    "reach_striking_interaction", "is_title_fight", "debut_diff",
)


def flag(condition: Column) -> Column:
    """1 where it holds, 0 where it doesn't or can't be told."""
    return F.when(condition, 1).otherwise(0)


def signed(for_a: Column, for_b: Column) -> Column:
    """1 for the first side, -1 for the second, else 0; the first condition is asked first."""
    return F.when(for_a, 1).when(for_b, -1).otherwise(0)


def with_sign(x: Column) -> Column:
    """The square with the sign of x."""
    return x * F.abs(x)


def features(a: Column, b: Column, title: Column) -> dict[str, Column]:
    """Every feature of the contest of profile a with profile b, by name."""
    elo_a, elo_b = (F.coalesce(side["elo"], F.lit(R.BASE)) for side in (a, b))
    diff = {name: a[field] - b[field] for name, field in DIFFERENCES.items()} | {"elo_diff": elo_a - elo_b}
    style_a, style_b = (R.style(side["slpm"], side["tdavg"], side["subavg"]) for side in (a, b))

    def each(f) -> Column:
        return f(a) - f(b)

    def undefeated(x: Column) -> Column:
        return flag(x["fights"].between(5, 12) & (x["losses"] == 0) & (x["wins"] >= 5))

    def rising(x: Column) -> Column:
        return flag((x["fights"] <= 10) & (x["recent_form"] >= 0.67) & (x["win_rate"] >= 0.65))

    def declining(x: Column) -> Column:
        return flag((x["fights"] >= 12) & (x["recent_form"] <= 0.40))

    def pressure(x: Column) -> Column:
        return F.when(x["stracc"].isNotNull(), x["slpm"] * F.greatest(x["stracc"], F.lit(0.0)))

    def prime(x: Column) -> Column:
        return F.when(x["age"].isNotNull(), F.when(x["age"].between(25, 32), 1.0).otherwise(0.8))

    def southpaw(x: Column, y: Column) -> Column:
        return (x["stance"] == "Southpaw") & ~F.coalesce(y["stance"], F.lit("Orthodox")).isin("Southpaw", "Switch")

    more = {
        "avg_elo_level": (elo_a + elo_b) / 2, "opponent_elo": elo_b,
        "opponent_recent_form": b["recent_form"], "opponent_finish_rate": b["finish_rate"],
        "style_advantage": R.style_advantage(style_a, style_b), "southpaw_advantage": signed(southpaw(a, b), southpaw(b, a)),
        "undefeated_prospect_diff": each(undefeated), "rising_prospect_diff": each(rising), "declining_veteran_diff": each(declining),
        "striker_vs_grappler": signed((style_a == "striker") & (style_b == "grappler"), (style_a == "grappler") & (style_b == "striker")),
        "finisher_vs_decision": signed((a["finish_rate"] >= 0.60) & (b["finish_rate"] <= 0.35), (a["finish_rate"] <= 0.35) & (b["finish_rate"] >= 0.60)),
        "form_velocity_diff": each(lambda x: x["recent_form"] - x["win_rate"]), "offensive_pressure_diff": each(pressure),
        "elo_diff_sq": with_sign(diff["elo_diff"]), "age_diff_sq": with_sign(diff["age_diff"]),
        "elo_prime_interaction": diff["elo_diff"] * each(prime), "reach_striking_interaction": F.abs(diff["reach_diff"]) * diff["slpm_diff"] / 10,
        "is_title_fight": flag(title), "debut_diff": each(lambda x: flag(x["fights"] == 0)),
    }
    return diff | more


def training(contests: DataFrame, names: tuple[str, ...] = V3, keep: tuple[str, ...] = ("id", "d")) -> DataFrame:
    """Both orientations of each decided contest: keep, swapped, target and the named features.

    contests: a, b, winner (null: not decided, left out), title, and the profiles pa and pb.
    """
    turned = contests.filter("winner is not null").withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    pick = lambda x, y: F.when(F.col("swapped"), F.col(y)).otherwise(F.col(x))
    sides = turned.select(*keep, "swapped", "title", (F.col("winner") == pick("a", "b")).cast("int").alias("target"), pick("pa", "pb").alias("x"), pick("pb", "pa").alias("y"))
    made = features(F.col("x"), F.col("y"), F.col("title"))
    return sides.select(*keep, "swapped", "target", *(made[n].alias(n) for n in names))


def at_prediction(contests: DataFrame, names: tuple[str, ...] = V3, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The same features for contests without a result, in the given orientation."""
    made = features(F.col("pa"), F.col("pb"), F.col("title"))
    return contests.select(*keep, *(made[n].alias(n) for n in names))
