"""The sports pipeline as a composition of the generic operators.

raw wide matches -> two rows per match -> prior rates -> opponent, adjustment -> targets and
predictions -> lines and probabilities -> prices -> minimum prices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions.numeric import EDGE_LEVELS, fair_odds, minimum_odds, nan_mean, safe_ratio
from ..functions.scores import parse_score
from ..functions.text import canonical_id, parse_day
from ..operators.joins import mirror, opponent_pair, opponent_sent, with_pair
from ..operators.windows import DEFAULT_WINDOWS, Prior, Timeline

#: Statistics of a side in the raw table: suffix and name (fixed values).
STATS = {"ace": "aces", "df": "double_faults", "svpt": "service_points", "1stIn": "first_serves_in", "1stWon": "first_serve_points_won", "2ndWon": "second_serve_points_won", "SvGms": "service_games", "bpSaved": "break_points_saved", "bpFaced": "break_points_faced"}
#: Rates: numerator and denominator (fixed values).
SERVE = {
    "ace_rate": ("aces", "service_points"),
    "double_fault_rate": ("double_faults", "service_points"),
    "first_serve_in_pct": ("first_serves_in", "service_points"),
    "first_serve_points_won_pct": ("first_serve_points_won", "first_serves_in"),
    "second_serve_points_won_pct": ("second_serve_points_won", "second_serves_in"),
    "service_points_won_pct": ("service_points_won", "service_points"),
    "break_points_saved_pct": ("break_points_saved", "break_points_faced"),
    "hold_pct": ("service_games_held", "service_games"),
}
RETURN = {
    "ace_allowed_rate": ("opponent_aces", "return_points"),
    "return_points_won_pct": ("return_points_won", "return_points"),
    "first_serve_return_points_won_pct": ("first_serve_return_points_won", "opponent_first_serves_in"),
    "second_serve_return_points_won_pct": ("second_serve_return_points_won", "opponent_second_serves_in"),
    "break_points_created_per_return_game": ("break_points_created", "opponent_service_games"),
    "break_conversion_pct": ("break_points_converted", "break_points_created"),
    "break_pct": ("break_points_converted", "opponent_service_games"),
}
HEADLINE = ("career", "surface_career", "last50")
ADJUSTED = ("career", "last50")
#: Adjustments: name, own rate, opponents' strength, whether its complement is expected, whether own is subtracted (fixed values).
ADJUSTMENTS = [
    ("opponent_adjusted_ace_rate", "player_serve_ace_rate", "opponent_return_ace_allowed_rate", False, False),
    ("ace_suppression", "player_return_ace_allowed_rate", "opponent_serve_ace_rate", False, True),
    ("opponent_adjusted_hold_pct", "player_serve_hold_pct", "opponent_return_break_pct", True, False),
    ("opponent_adjusted_break_pct", "player_return_break_pct", "opponent_serve_hold_pct", True, False),
]


def player_matches(raw: DataFrame, tour: str) -> DataFrame:
    """Two rows per match in one scan; matches without both ids are left out."""
    clean = raw.filter(F.col("winner_id").isNotNull() & F.col("loser_id").isNotNull()).select(
        *[c for c in raw.columns if c not in ("surface", "round")],
        F.col("tourney_name").alias("tournament"),
        F.concat(F.lit(f"{tour}:"), F.col("tourney_id"), F.lit(":"), F.col("match_num").cast("string")).alias("match_id"),
        F.lit(tour).alias("tour"),
        parse_day(F.col("tourney_date")).alias("tournament_date"),
        F.nullif(F.initcap(F.trim("surface")), F.lit("")).alias("surface"),
        F.trim("round").alias("round"),
    )

    def side(me: str, you: str, m: str, y: str, result: str) -> dict:
        cols = {"player_id": canonical_id(F.lit(tour), F.col(f"{me}_id")), "opponent_id": canonical_id(F.lit(tour), F.col(f"{you}_id")), "result": F.lit(result)}
        for f in ("name", "hand", "rank", "rank_points"):
            cols |= {f"player_{f}": F.col(f"{me}_{f}"), f"opponent_{f}": F.col(f"{you}_{f}")}
        for k, n in STATS.items():
            cols |= {n: F.col(f"{m}_{k}").cast("long"), f"opponent_{n}": F.col(f"{y}_{k}").cast("long")}
        return cols | {"return_points": F.col(f"{y}_svpt").cast("long"), "break_points_created": F.col(f"{y}_bpFaced").cast("long"), "break_points_converted": (F.col(f"{y}_bpFaced") - F.col(f"{y}_bpSaved")).cast("long")}

    shared = ["match_id", "tour", "tournament", "tourney_id", "tournament_date", "round", "surface", "tourney_level", "best_of", "minutes", "score"]
    sides = {"w": side("winner", "loser", "w", "l", "W"), "l": side("loser", "winner", "l", "w", "L")}
    return mirror(clean, shared, sides).drop("side")


def write_player_matches(raw: DataFrame, tour: str, path: str) -> dict[str, int]:
    """Write :func:`player_matches` to ``path`` and return its diagnostics.

    What is counted is counted by the job that writes: matches read, left out for a missing id,
    rows and missing values of every statistic. Match ids that repeat are counted from the one
    column of the table written.
    """
    taken, made = Observation("matches"), Observation("rows")
    missing = F.col("winner_id").isNull() | F.col("loser_id").isNull()
    seen = raw.observe(taken, F.count(F.lit(1)).alias("n_raw_matches"), F.count_if(missing).alias("n_matches_missing_player_id"))
    rows = player_matches(seen, tour)
    counted = rows.observe(made, F.count(F.lit(1)).alias("n_player_match_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in STATS.values()])
    counted.write.mode("errorifexists").parquet(path)
    out = taken.get | made.get
    used = out["n_raw_matches"] - out["n_matches_missing_player_id"]
    ids = raw.sparkSession.read.parquet(path).groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    repeated = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 2
    return out | {"n_matches_used": used, "expected_rows": 2 * used, "rows_match_expected": int(out["n_player_match_rows"] == 2 * used), "n_duplicate_match_ids": repeated}


def derived(df: DataFrame) -> DataFrame:
    """Counts that follow from others; NULL where a part is."""
    c = F.col
    return df.select(
        "*",
        (c("service_points") - c("first_serves_in")).alias("second_serves_in"),
        (c("first_serve_points_won") + c("second_serve_points_won")).alias("service_points_won"),
        (c("service_games") - (c("break_points_faced") - c("break_points_saved"))).alias("service_games_held"),
        (c("return_points") - c("opponent_first_serves_in")).alias("opponent_second_serves_in"),
        (c("opponent_first_serves_in") - c("opponent_first_serve_points_won")).alias("first_serve_return_points_won"),
        (c("return_points") - c("opponent_first_serves_in") - c("opponent_second_serve_points_won")).alias("second_serve_return_points_won"),
        (c("return_points") - c("opponent_first_serve_points_won") - c("opponent_second_serve_points_won")).alias("return_points_won"),
    )


def value_columns() -> list[str]:
    """All numerators and denominators, once each."""
    return sorted({c for metrics in (SERVE, RETURN) for pair in metrics.values() for c in pair})


def timeline() -> Timeline:
    return Timeline(["player_id"], "tournament_date", ["tourney_id", "match_id", "result"], "surface")


#: Rows with all windows that one task sorts, at most about (fixed value).
TASK_ROWS = 100_000


def parts(df: DataFrame, rows: int) -> int:
    """As many parts as about ``rows`` rows need."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` by its keys in as many parts as about ``rows`` rows need; as it is if they aren't known."""
    return df if rows is None else df.repartition(parts(df, rows), *keys)


def profile(df: DataFrame, windows: Sequence[Prior] = tuple(DEFAULT_WINDOWS), rows: int | None = None) -> DataFrame:
    """Rates before each match over all windows, and counts of matches and points.

    ``rows``, about how many there are, keeps what a task sorts from growing with the table.
    """
    t, df = timeline(), dealt(df, rows, "player_id")
    out = t.rates(t.rates(df, SERVE, windows, "player_serve_"), RETURN, windows, "player_return_")
    return t.sums(out, ["service_points", "return_points"], windows)


def matchup(df: DataFrame, rows: int | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Opponents' rates, differences, and adjustment by the strength of opponents faced.

    With ``rows`` the table is one that :func:`dealt` has put by player: opponents' values are
    sent there. ``also`` names columns that are wanted of opponents as they are, with _o_ before.
    """
    own = [f"player_{k}_{m}_{w}" for w in HEADLINE for k, ms in (("serve", SERVE), ("return", RETURN)) for m in ms]
    of = (df, ["match_id"], "player_id", "opponent_id", "result", [*own, *also])
    renamed = opponent_pair(*of, prefix="_o_") if rows is None else opponent_sent(*of, "prior_matches_career", parts(df, rows), prefix="_o_")
    out = renamed.select(*df.columns, *[F.col(f"_o_{c}").alias(c.replace("player_", "opponent_", 1)) for c in own], *[f"_o_{c}" for c in also])
    c = F.col
    diffs = []
    for w in HEADLINE:
        diffs += [
            (c(f"player_serve_ace_rate_{w}") - c(f"opponent_return_ace_allowed_rate_{w}")).alias(f"matchup_ace_rate_vs_allowed_{w}"),
            (c(f"player_serve_hold_pct_{w}") - c(f"opponent_return_break_pct_{w}")).alias(f"matchup_hold_vs_break_{w}"),
            (c(f"opponent_serve_ace_rate_{w}") - c(f"player_return_ace_allowed_rate_{w}")).alias(f"matchup_opp_ace_vs_player_allowed_{w}"),
            (c(f"opponent_serve_hold_pct_{w}") - c(f"player_return_break_pct_{w}")).alias(f"matchup_opp_hold_vs_player_break_{w}"),
        ]
    out = out.select("*", *diffs)
    t, kinds = timeline(), {w.name: w for w in DEFAULT_WINDOWS}
    faced = {f"avg_{s}_faced_{w}": t.mean_of_present(c(f"{s}_{w}"), kinds[w]) for w in ADJUSTED for _, _, s, _, _ in ADJUSTMENTS}
    out = out.select("*", *[v.alias(k) for k, v in faced.items()])
    made = []
    for w in ADJUSTED:
        for name, rate, strength, complement, inverted in ADJUSTMENTS:
            expected = c(f"avg_{strength}_faced_{w}")
            expected = 1 - expected if complement else expected
            made.append(((expected - c(f"{rate}_{w}")) if inverted else (c(f"{rate}_{w}") - expected)).alias(f"{name}_{w}"))
    return out.select("*", *made)


def with_targets(df: DataFrame) -> DataFrame:
    """Parsed score columns and targets; a loser's game difference changes sign."""
    s = parse_score(F.col("score"))
    won = F.col("result") == "W"
    out = df.withColumn("_s", s).select(
        *df.columns, F.col("_s.status").alias("score_status"), F.col("_s.complete").alias("score_complete"), F.col("_s.total_games").alias("target_total_games"), F.col("_s.n_sets_completed").alias("target_total_sets"),
        F.when(won, F.col("_s.game_diff")).otherwise(-F.col("_s.game_diff")).alias("target_game_diff"), F.col("_s.has_tiebreak").alias("target_has_tiebreak"), F.col("aces").alias("target_aces"), F.col("double_faults").alias("target_double_faults"),
    )
    return out


def _service(window: str):
    return safe_ratio(F.col(f"prior_service_points_{window}"), F.col(f"prior_matches_{window}"))


def isolated_predictions(df: DataFrame, windows: Sequence[str]) -> DataFrame:
    """Predicted aces and double faults of a side alone: rates times service points per match."""
    made = []
    for w in windows:
        made += [(F.col(f"player_serve_{rate}_{w}") * _service(w)).alias(f"pred_{name}_isolated_{w}") for name, rate in (("aces", "ace_rate"), ("double_faults", "double_fault_rate"))]
    return df.select("*", *made)


def adjusted_predictions(df: DataFrame, windows: Sequence[str]) -> DataFrame:
    """Predicted aces with what the opponent allows, and with the strength of those faced before."""
    made = []
    for w in [w for w in windows if w in HEADLINE]:
        both = nan_mean(F.col(f"player_serve_ace_rate_{w}"), F.col(f"opponent_return_ace_allowed_rate_{w}")) * _service(w)
        made.append(both.alias(f"pred_aces_matchup_{w}"))
        if w in ADJUSTED:
            made.append((both + F.col(f"opponent_adjusted_ace_rate_{w}") * _service(w)).alias(f"pred_aces_oppadj_{w}"))
    return df.select("*", *made)


def rate_predictions(df: DataFrame, windows: Sequence[str]) -> DataFrame:
    """All variants of predictions from rates."""
    return adjusted_predictions(isolated_predictions(df, windows), windows)


def total_predictions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides' predictions added; NULL if either is missing."""
    out = opponent_pair(df, ["match_id"], "player_id", "opponent_id", "result", columns, prefix="_o_")
    return out.select(*df.columns, *[(F.col(x) + F.col(f"_o_{x}")).alias(f"total_{x}") for x in columns])


def chain(facts: DataFrame, windows: Sequence[str] = ADJUSTED, rows: int | None = None) -> DataFrame:
    """From player matches to features, predictions and targets.

    Three shuffles: by player for all windows, by match for opponents and totals, and by player
    again, as averages over opponents faced need what those had before their matches. Where the
    number of ``rows`` is known there are two: facts by player, and of the windows only what
    opponents need, which is sent to them. Own windows are worked out again from the first shuffle
    then, as they are wider than the facts; a score is sent along so that both sides read the same.
    """
    base = isolated_predictions(profile(derived(facts), rows=rows), windows)
    alone = [f"pred_aces_isolated_{w}" for w in windows]
    if rows is None:
        base = matchup(total_predictions(with_pair(base, "player_id", "opponent_id"), alone)).drop("_pair_a", "_pair_b")
    else:
        faced = matchup(base, rows, [*alone, "score"])
        totals = [(F.col(c) + F.col(f"_o_{c}")).alias(f"total_{c}") for c in alone]
        base = faced.withColumn("score", F.coalesce("score", "_o_score")).select("*", *totals).drop("_o_score", *[f"_o_{c}" for c in alone])
    return with_targets(adjusted_predictions(base, windows))


def with_grids(groups: DataFrame, r: str, mean: str, out: str = "grid") -> DataFrame:
    """Groups that have a dispersion, with their lines."""
    return groups.filter(F.col(r).isNotNull()).withColumn(out, dist.line_grid(F.col(mean), F.col(r)))


def lines(df: DataFrame, lam: str, r: str, mean: str, grid: str | None = None) -> DataFrame:
    """A row per line of each group's grid: (…, line, p_poisson, p_negbin, difficulty).

    ``grid`` names a column of lines that :func:`with_grids` made once per group; without it
    each row makes its own. Nothing is joined on mean or dispersion, as a table that is worked
    out twice may differ in their last bits. Groups without a dispersion give no rows.
    """
    ready = df.filter(F.col(r).isNotNull()) if grid else with_grids(df, r, mean, "_lines")
    out = ready.select("*", F.explode(grid or "_lines").alias("line")).drop(grid or "_lines")
    return out.select("*", dist.over_probability(F.col(lam), None, F.col("line")).alias("p_poisson"), dist.over_probability(F.col(lam), F.col(r), F.col("line")).alias("p_negbin"), dist.line_difficulty(F.col("line"), F.col(lam), F.col(r)).alias("difficulty"))


def prices(df: DataFrame, p: str, cold: str | None = None) -> DataFrame:
    """A row per side with its probability and fair price; cold starts have no price."""
    sides = F.array(F.struct(F.lit("over").alias("side"), F.col(p).alias("operational_probability")), F.struct(F.lit("under").alias("side"), (1 - F.col(p)).alias("operational_probability")))
    out = df.select("*", F.explode(sides).alias("_s")).select(*df.columns, "_s.*")
    fair = fair_odds(F.col("operational_probability"))
    return out.withColumn("fair_odds", fair if cold is None else F.when(~F.col(cold), fair))


def minimum_prices(df: DataFrame) -> DataFrame:
    """A row per required edge with the least acceptable price."""
    levels = F.array(*[F.struct(F.lit(n).alias("edge_label"), F.lit(e).alias("required_edge")) for n, e, _ in EDGE_LEVELS])
    out = df.select("*", F.explode(levels).alias("_e")).select(*df.columns, "_e.*")
    return out.withColumn("minimum_odds", minimum_odds(F.col("operational_probability"), F.col("required_edge")))


def future_rows(upcoming: DataFrame, history: DataFrame) -> DataFrame:
    """Two rows without statistics per resolved match, in the schema of ``history``."""
    both = mirror(
        upcoming,
        ["match_id", "tour", "tournament", "tournament_date", "round", "surface"],
        {"a": {"player_id": "player_id_a", "opponent_id": "player_id_b"}, "b": {"player_id": "player_id_b", "opponent_id": "player_id_a"}},
    ).drop("side")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in history.schema.fields if f.name not in both.columns]
    return both.select("*", *rest).select(*history.columns)


def future_features(upcoming: DataFrame, history: DataFrame) -> DataFrame:
    """Features of coming matches: windows over history and them together, then only them."""
    ids = upcoming.select("match_id").distinct()
    return profile(derived(history.unionByName(future_rows(upcoming, history)))).join(ids, "match_id", "left_semi")
