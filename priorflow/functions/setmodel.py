"""Exact expectation of a set from both sides' hold probabilities, and of a match from it.

A set is a Markov chain over the score of games, side A serving at even totals. The chain is
a fold over the number of games: level ``n`` is an array of the probabilities of reaching x
games to ``n - x``; what ends at a level is added up as it goes. Matches of independent sets
are closed forms.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _held(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), p).otherwise(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)))


def set_expectation(p_hold_a: Column | str, p_hold_b: Column | str, bounded: bool = True) -> Column:
    """Struct p_set, games_a, games_b, p_tiebreak: the set's win probability for A, mean games
    and the probability of a tie-break. NULL in, NULL out. Unless ``bounded``, rates that are no
    probabilities go through the chain as they are."""
    a, b = (F.col(p) if isinstance(p, str) else p for p in (p_hold_a, p_hold_b))
    zero = F.lit(0.0)
    start = F.struct(F.array(F.lit(1.0), *[zero] * 7).alias("level"), zero.alias("won"), zero.alias("games_a"), zero.alias("games_b"))

    def step(t: Column, acc: Column, p: Column) -> Column:
        level = acc["level"]
        going = lambda x, y: F.when((x >= 0) & (y >= 0) & ~((F.greatest(x, y) >= 6) & (F.abs(x - y) >= 2)), F.get(level, x)).otherwise(0.0)
        following = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: going(x - 1, t - x + 1) * p + F.when(x <= t, going(x, t - x)).otherwise(0.0) * (1 - p))
        return F.get(F.transform(F.array(following), lambda made: ended(t + 1, acc, made)), F.lit(0))

    def ended(n: Column, acc: Column, level: Column) -> Column:
        # sets end at 6 to 4 or less, and at 7 to 5
        early, late = (n >= 6) & (n <= 10), n == 12
        wins = F.when(early, F.get(level, F.lit(6))).when(late, F.get(level, F.lit(7))).otherwise(0.0)
        loses = F.when(early, F.get(level, n - 6)).when(late, F.get(level, F.lit(5))).otherwise(0.0)
        most = F.when(late, 7).otherwise(6)
        least = n - most
        return F.struct(level.alias("level"), (acc["won"] + wins).alias("won"), (acc["games_a"] + wins * most + loses * least).alias("games_a"), (acc["games_b"] + wins * least + loses * most).alias("games_b"))

    def whole(held: Column) -> Column:
        walk = F.aggregate(F.sequence(F.lit(0), F.lit(11)), start, lambda acc, t: step(t, acc, F.when(t % 2 == 0, held["a"]).otherwise(1 - held["b"])), lambda acc: acc)
        share = held["a"] / (held["a"] + held["b"])

        def done(s: Column) -> Column:
            tie = F.get(s["level"], F.lit(6))
            return F.struct((s["won"] + tie * share).alias("p_set"), (s["games_a"] + tie * (6 + share)).alias("games_a"), (s["games_b"] + tie * (7 - share)).alias("games_b"), tie.alias("p_tiebreak"))

        return F.get(F.transform(F.array(walk), done), F.lit(0))

    held = _held if bounded else (lambda p: p)
    both = F.array(F.struct(held(a).alias("a"), held(b).alias("b")))
    return F.when(a.isNotNull() & b.isNotNull(), F.get(F.transform(both, whole), F.lit(0)))


def with_set(df: DataFrame, p_hold_a: str, p_hold_b: str, out: str = "set", bounded: bool = True) -> DataFrame:
    """``df`` with the set's struct, walked in its own row: means that are worked out twice need
    not be equal to the last bit, so distinct pairs can't be joined back."""
    return df.withColumn(out, set_expectation(p_hold_a, p_hold_b, bounded))


def match_expectation(s: Column, best_of: Column | int) -> Column:
    """Struct p_match, sets, games, game_diff, p_any_tiebreak, p_full_distance of a set struct.

    A column gives each row's own length: 5, or else 3, also where it isn't known; then the
    probability of the full distance is NULL.
    """
    if not isinstance(best_of, int):
        three, five = match_expectation(s, 3), match_expectation(s, 5)
        fields = ("p_match", "sets", "games", "game_diff", "p_any_tiebreak", "p_full_distance")
        full = F.when(best_of == 5, five["p_full_distance"]).when(best_of == 3, three["p_full_distance"])
        return F.struct(*[(full if f == "p_full_distance" else F.when(best_of == 5, five[f]).otherwise(three[f])).alias(f) for f in fields])
    need, p, q = (best_of + 1) // 2, s["p_set"], 1 - s["p_set"]
    p_match, sets, last = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for lost in range(need):
        ways = comb(need + lost - 1, lost)
        a, b = ways * F.pow(p, F.lit(need)) * F.pow(q, F.lit(lost)), ways * F.pow(q, F.lit(need)) * F.pow(p, F.lit(lost))
        p_match, sets, last = p_match + a, sets + (need + lost) * (a + b), a + b
    return F.struct(
        p_match.alias("p_match"),
        sets.alias("sets"),
        (sets * (s["games_a"] + s["games_b"])).alias("games"),
        (sets * (s["games_a"] - s["games_b"])).alias("game_diff"),
        (1 - F.pow(1 - s["p_tiebreak"], sets)).alias("p_any_tiebreak"),
        last.alias("p_full_distance"),
    )


def hold_pair(own: Column, other: Column, own_break: Column, other_break: Column, hold_residual: Column, break_residual: Column) -> dict[str, tuple[Column, Column]]:
    """Hold probabilities of both sides by variant: isolated, matchup, oppadj."""
    from .numeric import nan_mean

    a, b = nan_mean(own, 1 - other_break), nan_mean(other, 1 - own_break)
    return {"isolated": (own, other), "matchup": (a, b), "oppadj": (a + hold_residual, b - break_residual)}
