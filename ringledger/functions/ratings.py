"""Rating formulas as Column expressions; None stands for nothing, so that null in is null out unless a default is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 1500.0

# K factors by importance, by kind of finish, by round.
K_BASE = 32.0
IMPORTANCE = {"title": 1.5, "main": 1.25, "regular": 1.0}
FINISH = (("KO", 1.3), ("SUB", 1.25), ("DEC", 1.0))
ROUND = {1: 1.2, 2: 1.1, 3: 1.05, 4: 1.02, 5: 1.0}
# Inactivity brackets (up to days, share lost a year, flat loss) after 180 days; the last is open.
INACTIVITY = ((365, 0.08, 10), (540, 0.12, 20), (730, 0.18, 30), (None, 0.25, 40))
# Injury penalties and how they fade (up to days, factor).
INJURY = {"major": 55, "minor": 25}
INJURY_FADES = ((60, 1.5), (120, 1.2), (180, 1.0), (365, 0.7), (540, 0.3))
# Bonuses of the prior estimate.
WIN_RATE_BONUS = ((0.95, 60), (0.90, 45), (0.85, 35), (0.80, 25), (0.75, 15), (0.70, 8))
ACTIVITY_BONUS = ((4.0, 10), (2.5, 5), (1.5, 0), (0.5, -10), (0.0, -20))
FINISH_BONUS = ((0.80, 20), (0.60, 10), (0.40, 5))


def lookup(value: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(float(v))).otherwise(out)
    return out


def at_least(value: Column, steps: tuple, default: float) -> Column:
    """The entry of the first step (largest first) that the value reaches."""
    out = F.lit(float(default))
    for least, entry in reversed(steps):
        out = F.when(value >= least, F.lit(float(entry))).otherwise(out)
    return out


def expected(rating: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - rating) / 400))


def expected_saturating(difference: Column) -> Column:
    """As expected(), but .99 and .01 beyond 800 points."""
    return F.when(difference > 800, 0.99).when(difference < -800, 0.01).otherwise(1 / (1 + F.pow(F.lit(10.0), -difference / 400)))


def k_factor(kind: Column, method: Column, round_: Column) -> Column:
    m = F.upper(F.coalesce(method, F.lit("")))
    finish = F.lit(1.0)
    for name, factor in reversed(FINISH):
        finish = F.when(m.contains(name), F.lit(factor)).otherwise(finish)
    return F.lit(K_BASE) * lookup(kind, IMPORTANCE, 1.0) * finish * lookup(round_, ROUND, 1.0)


def reverted(rating: Column, days: Column) -> Column:
    """Drift to the base of a tenth a year, after half a year without a contest."""
    years = days / 365
    return F.when(years > 0.5, rating - (rating - BASE) * 0.1 * years).otherwise(rating)


def inactivity_penalty(days: Column, rating: Column) -> Column:
    """Bracketed penalty; below the base only the flat part."""
    rate, flat = F.lit(INACTIVITY[-1][1]), F.lit(INACTIVITY[-1][2])
    for most, r, f in reversed(INACTIVITY[:-1]):
        rate, flat = F.when(days <= most, F.lit(r)).otherwise(rate), F.when(days <= most, F.lit(f)).otherwise(flat)
    share = F.least(rate * (days / 365), F.lit(0.35))
    part = ((rating - BASE) * share).cast("int")
    return F.when(days <= 180, F.lit(0)).otherwise(F.greatest(part + flat, flat)).cast("int")


def inactivity_live(days: Column, rating: Column) -> Column:
    """Five percent a year up to a quarter, of what lies above the base only."""
    share = F.least(0.05 * (days / 365), F.lit(0.25))
    return F.when(days > 180, (F.greatest(rating - BASE, F.lit(0.0)) * share).cast("int")).otherwise(0)


def inactivity_signed(days: Column, rating: Column) -> Column:
    """As inactivity_live(), but below the base the penalty is negative."""
    share = F.least(0.05 * (days / 365), F.lit(0.25))
    return F.when(days > 180, ((rating - BASE) * share).cast("int")).otherwise(0)


def injury_penalty(severity: Column, days: Column) -> Column:
    factor = F.lit(None).cast("double")
    for most, f in reversed(INJURY_FADES):
        factor = F.when(days <= most, F.lit(f)).otherwise(factor)
    return F.coalesce((lookup(severity, INJURY, 0.0) * factor).cast("int"), F.lit(0))


def prior_estimate(wins: Column, losses: Column, draws: Column, age: Column, days: Column, years: Column, finish_rate: Column) -> Column:
    """A struct with the rating of an entity without rated contests, from its record, and what it is made of."""
    total = wins + losses + draws
    record = 15 * F.ln(wins + 1) - 20 * F.ln(losses + 1) + 3 * F.ln(draws + 1)
    rate_bonus = at_least(wins / F.nullif(total, F.lit(0)), WIN_RATE_BONUS, 0)
    span = F.coalesce(years, F.greatest(F.lit(1.0), age - 21))
    activity = F.when(span > 0, at_least(total / span, ACTIVITY_BONUS, 0)).otherwise(0.0)
    finish = at_least(F.coalesce(finish_rate, F.lit(0.0)), FINISH_BONUS, 0)
    recency = F.when(days <= 365, 15.0).when(days <= 730, 5.0).when(days >= 1095, -15.0).otherwise(0.0)
    by_age = F.when((age >= 25) & (age <= 32), 10.0).when(age > 38, -15.0).when(age > 35, -5.0).when(age < 23, 5.0).otherwise(0.0)
    change = F.greatest(F.lit(-180.0), F.least(F.lit(220.0), record + rate_bonus + activity + finish + recency + by_age))
    rating = F.when(total == 0, F.lit(BASE)).otherwise(BASE + change)
    return F.struct(rating.alias("rating"), record.alias("record"), rate_bonus.alias("rate_bonus"), activity.alias("activity"), finish.alias("finish"), recency.alias("recency"), by_age.alias("age"))


def style(strikes: Column, takedowns: Column, submissions: Column) -> Column:
    s, t, u = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (strikes, takedowns, submissions))
    return F.when(t > 2.5, "wrestler").when(u > 1.0, "grappler").when((s > 4.0) & (t < 2.0), "striker").otherwise("balanced")


# Years of the peak, and what each year before and after it costs; what an inch of reach is worth.
PEAK, BEFORE_PEAK, AFTER_PEAK, INCH = (27, 32), 0.01, 0.02, 0.005


def enhanced_shift(age: Column, reach: Column, other_reach: Column, style_edge: Column) -> Column:
    """What age, reach and style add to an expectation; what isn't known adds nothing."""
    by_age = F.when(age < PEAK[0], (age - PEAK[0]) * BEFORE_PEAK).when(age > PEAK[1], (PEAK[1] - age) * AFTER_PEAK).otherwise(0.0)
    return by_age + F.coalesce((reach - other_reach) * INCH, F.lit(0.0)) + F.coalesce(style_edge, F.lit(0.0))


def style_advantage(a: Column, b: Column) -> Column:
    """1 if a's style beats b's, -1 if b's beats a's, else 0."""
    x, y = F.lower(F.coalesce(a, F.lit("balanced"))), F.lower(F.coalesce(b, F.lit("balanced")))

    def beats(p: Column, q: Column) -> Column:
        return ((p == "wrestler") & (q == "striker")) | ((p == "grappler") & (q == "wrestler")) | ((p == "striker") & (q == "grappler"))

    return F.when(beats(x, y), 1).when(beats(y, x), -1).otherwise(0)
