"""Odds, probabilities and stakes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringledger.functions.ratings import expected_saturating


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def american_to_decimal(odds: Column) -> Column:
    """Null for odds of 0, which are no odds."""
    return F.when(odds > 0, 1 + odds / 100).when(odds < 0, 1 + 100 / F.abs(odds))


def parse_american(text: Column) -> Column:
    """Decimal odds of texts like +150 or -200; null for anything else."""
    plain = F.regexp_replace(F.trim(text), "[−–]", "-")
    return american_to_decimal(F.regexp_extract(plain, r"^([+-]?\d+)$", 1).try_cast("int"))


def implied(decimal: Column) -> Column:
    return F.try_divide(F.lit(1.0), decimal)


def probability_to_american(p: Column) -> Column:
    """Rounded American odds, null at 0 and 1 and beyond; probabilities count as .01 to .99."""
    q = clamp(p, 0.01, 0.99)
    favourite, underdog = -100 * q / (1 - q), 100 * (1 - q) / q
    return F.when((p > 0) & (p < 1), F.bround(F.when(q >= 0.5, favourite).otherwise(underdog), 0).cast("int"))


def with_vig(p: Column, vig: float = 0.045) -> tuple[Column, Column]:
    """Implied probabilities of both sides with the margin on top, within .04 and .96."""
    return clamp(p * (1 + vig / 2), 0.04, 0.96), clamp((1 - p) * (1 + vig / 2), 0.04, 0.96)


def simulated_odds(difference: Column, vig: float = 0.05) -> tuple[Column, Column]:
    """Decimal odds of both sides from a rating difference alone."""
    p = 1 / (1 + F.pow(F.lit(10.0), -difference / 400))
    return 1 / clamp(p * (1 + vig / 2), 0.05, 0.95), 1 / clamp((1 - p) * (1 + vig / 2), 0.05, 0.95)


def market_probability(difference: Column, popular: Column, form_a: Column, form_b: Column) -> Column:
    """What a market thinks: the public moves two points to a popular side (and from any other), form moves up to one."""
    moved = expected_saturating(difference) + F.when(popular, 0.02).otherwise(-0.02) + 0.01 * (form_a - form_b)
    return clamp(moved, 0.05, 0.95)


def expected_value(p: Column, decimal: Column) -> Column:
    return p * (decimal - 1) - (1 - p)


def profit(won: Column, decimal: Column) -> Column:
    """Of a bet of one unit."""
    return F.when(won, decimal - 1).otherwise(-1.0)


def tempered(p: Column, temperature: float = 0.62, low: float = 0.10, high: float = 0.90) -> Column:
    """Logit scaled by 1 / temperature, then clamped."""
    q = clamp(p, 1e-6, 1 - 1e-6)
    return clamp(1 / (1 + F.exp(-F.ln(q / (1 - q)) / temperature)), low, high)


def blend(model: Column, rating: Column, asymmetry: Column, missing: Column) -> Column:
    """Model and rating probabilities by a weight that falls with missing features and with asymmetry between sides."""
    weight = clamp(0.50 - 0.08 * missing - 0.60 * F.greatest(asymmetry - 0.20, F.lit(0.0)), 0.15, 0.50)
    weight = F.when((asymmetry <= 0.60) & (missing <= 6), weight).otherwise(0.0)
    return clamp(weight * model + (1 - weight) * rating, 0.10, 0.90)


def penalty_shifted(p: Column, penalty_a: Column, penalty_b: Column) -> Column:
    """A probability after both sides' penalties: an eighth of a percent a point, ten points of percent at most."""
    a, b = (F.least(x / 400 * 0.5, F.lit(0.10)) for x in (penalty_a, penalty_b))
    return clamp(p - a + b, 0.10, 0.90)


def value_bet(p: Column, implied_a: Column, implied_b: Column, least: float = 0.05) -> Column:
    """Struct of side and edge: the first side if its edge is large enough, else the second; null for no bet."""
    a, b = p - implied_a, 1 - p - implied_b
    bet = lambda side, edge: F.struct(F.lit(side).alias("side"), edge.alias("edge"))
    return F.when(a > least, bet("a", a)).when(b > least, bet("b", b))


def kelly(edge: Column, decimal: Column, fraction: float = 0.25, most: float = 0.05, discount: float = 0.30, least: float = 0.03) -> Column:
    """Share of the bankroll to stake: a fraction of Kelly on a discounted edge, capped; 0 for no bet."""
    e = edge * (1 - discount)
    b, p = decimal - 1, 1 / decimal + e
    full = (b * p - (1 - p)) / b
    return F.when((e >= least) & (b > 0) & (full > 0), F.least(full * fraction, F.lit(most))).otherwise(0.0)


def share_of_two(a: Column, b: Column) -> Column:
    """a of a + b; one half if both are 0."""
    return F.when(a + b == 0, 0.5).otherwise(a / (a + b))


def method_split(power: Column, threat: Column, decision_rate: Column) -> Column:
    """How a side wins if it wins: struct of ko, sub, dec that sums to 1. decision_rate in percent, 0 or null counts as 50."""
    base = F.when(F.coalesce(decision_rate, F.lit(0.0)) == 0, 0.5).otherwise(decision_rate / 100)
    ko, sub = power * (1 - base), threat * (1 - base)
    total = ko + sub + base
    part = lambda x, none: F.when(total == 0, F.lit(none)).otherwise(x / total)
    return F.struct(part(ko, 0.0).alias("ko"), part(sub, 0.0).alias("sub"), part(base, 1.0).alias("dec"))
