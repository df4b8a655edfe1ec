"""Set scores such as ``7-6(4) 6-4`` parsed by higher-order functions.

A finished set has a winner with 6 or more games and 2 more than the other, or 7 and 1 more;
a match breaker in brackets has 10 or more points and 2 more. Only finished sets count. The
last status word wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAYED = r"^(\[)?(\d+)-(\d+)(?:\((\d+)\))?(\])?$"
#: Status words (fixed values).
_STATUS = [("walkover", r"^(W/O|WALKOVER)$"), ("abandoned", r"^ABD\.?$"), ("defaulted", r"^DEF\.?$"), ("retired", r"^RET.*$")]


def _read(token: Column) -> Column:
    """A token's parts: one look at the pattern for each."""
    part = lambda k: F.regexp_extract(token, _PLAYED, k)
    return F.struct(F.upper(token).alias("up"), (part(1) != "").alias("left"), part(2).try_cast("int").alias("a"), part(3).try_cast("int").alias("b"), (part(4) != "").alias("points"), (part(5) != "").alias("right"), (part(3) != "").alias("played"))


def _token(t: Column) -> Column:
    """(kind, a, b, tie, done) of a token's parts; kind is NULL where it is none known."""
    breaker = t["left"] & t["right"] & ~t["points"]
    kind = F.when(t["played"] & breaker, "breaker").when(t["played"] & ~t["left"] & ~t["right"], "set")
    for name, pattern in _STATUS:
        kind = kind.when(t["up"].rlike(pattern), name)
    high, low = F.greatest(t["a"], t["b"]), F.least(t["a"], t["b"])
    seven = (high == 7) & (high - low == 1)
    done = F.when(breaker, (high >= 10) & (high - low >= 2)).otherwise(((high >= 6) & (high - low >= 2)) | seven)
    return F.struct(kind.alias("kind"), t["a"].alias("a"), t["b"].alias("b"), F.coalesce(seven | t["points"], F.lit(False)).alias("tie"), F.coalesce(done, F.lit(False)).alias("done"))


#: What a pass over the tokens adds up, all from 0.
_SUMS = ("unknown", "sets", "breakers", "finished", "partial", "won_a", "won_b", "games_a", "games_b", "ties", "breakers_done")


def _add(acc: Column, t: Column) -> Column:
    is_set, is_breaker = F.coalesce(t["kind"] == "set", F.lit(False)), F.coalesce(t["kind"] == "breaker", F.lit(False))
    played = is_set | is_breaker
    full_set, full = is_set & t["done"], played & t["done"]
    steps = {
        "unknown": t["kind"].isNull(), "sets": is_set, "breakers": is_breaker, "finished": full, "partial": played & ~t["done"], "won_a": full & (t["a"] > t["b"]), "won_b": full & (t["a"] < t["b"]),
        "games_a": F.when(full_set, t["a"]).otherwise(0), "games_b": F.when(full_set, t["b"]).otherwise(0), "ties": full_set & t["tie"], "breakers_done": is_breaker & t["done"],
    }
    word = F.when(t["kind"].isNotNull() & ~played, t["kind"]).otherwise(acc["word"])
    return F.struct(*[(acc[k] + F.coalesce(steps[k].cast("int"), F.lit(0))).alias(k) for k in _SUMS], word.alias("word"))


def parse_score(score: Column) -> Column:
    """Struct of 16 fields; winner's side first. Games are those of finished sets.

    Tokens are read once each and added up in one pass, so that nothing is evaluated anew for
    every field.
    """
    words = F.filter(F.split(F.coalesce(F.trim(score), F.lit("")), r"\s+"), lambda t: t != "")
    tokens = F.transform(F.transform(words, _read), _token)
    start = F.struct(*[F.lit(0).alias(k) for k in _SUMS], F.lit(None).cast("string").alias("word"))
    raw = F.trim(score)

    def fields(s: Column) -> Column:
        missing = raw.isNull() | (raw == "")
        status = F.when(missing, "missing").when((s["unknown"] > 0) & (s["sets"] + s["breakers"] == 0), "unparseable").otherwise(F.coalesce(s["word"], F.lit("completed")))
        games = lambda c: F.when(s["sets"] > 0, c)
        return F.struct(
            raw.alias("raw"),
            status.alias("status"),
            ((status == "completed") & (s["unknown"] == 0) & (s["partial"] == 0) & (s["finished"] > 0)).alias("complete"),
            s["finished"].alias("n_sets_completed"),
            s["won_a"].alias("sets_won_winner"),
            s["won_b"].alias("sets_won_loser"),
            games(s["games_a"] + s["games_b"]).alias("total_games"),
            games(s["games_a"]).alias("winner_games"),
            games(s["games_b"]).alias("loser_games"),
            games(s["games_a"] - s["games_b"]).alias("game_diff"),
            (s["ties"] > 0).alias("has_tiebreak"),
            s["ties"].alias("n_tiebreaks"),
            (s["breakers"] > 0).alias("has_match_tiebreak"),
            s["breakers_done"].alias("n_match_tiebreaks_completed"),
            (s["partial"] > 0).alias("has_partial_trailing_set"),
            (~missing & (s["unknown"] == 0)).alias("parse_ok"),
        )

    return F.aggregate(tokens, start, _add, fields)
