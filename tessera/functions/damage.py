"""The closed-form damage model as column arithmetic."""

from pyspark.sql import functions as F


def clamp2(c):
    return F.greatest(F.lit(-2.0), F.least(F.lit(2.0), c))


def power_range(base, power, coins):
    """Least and greatest coin power."""
    return F.least(base, base + power * coins), F.greatest(base, base + power * coins)


def level_bonus(attack, defense):
    """d / (|d| + 25) of the level difference."""
    d = attack - defense
    return d / (F.abs(d) + 25)


def resistance(base, mult, add, chaos):
    """(chaos - 1) / 2 + add from chaos 2 on, otherwise base * (1 + mult) + add within -2 and 2."""
    return F.when(chaos >= 2, (chaos - 1) * 0.5 + add).otherwise(clamp2(base * (1 + mult) + add))


def resistance_bonus(v):
    return F.when(v > 1, v - 1).when(v > 0, (v - 1) / 2).otherwise(-0.5)


def type1(wins, crit, crit_mult, attack, defense, observation, physical, sin):
    """1 + clash wins + critical + levels + observation + resistances."""
    return 1 + 0.03 * wins + F.when(crit, F.lit(crit_mult) - 1).otherwise(0.0) + level_bonus(attack, defense) + 0.03 * observation + resistance_bonus(physical) + resistance_bonus(sin)


def coin_damage(value, t1, t2, a1, a2):
    """round half even of value * t1 * t2 + a1 + a2, at least 5 % of value and 1."""
    return F.greatest(F.lit(1.0), F.floor(0.05 * value).cast("double"), F.bround(value * t1 * t2 + a1 + a2, 0))
