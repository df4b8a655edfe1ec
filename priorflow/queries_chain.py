"""The match pipeline end to end on paired events, with SQL of the whole chain.

A match is an order with two lines or more: its dearest line is the winner's side, its
cheapest the loser's; suppliers are players. Orders of one supplier have no loser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import distributions as dist
from .operators import joins
from .operators.carried import Carried, CarriedStore
from .operators.windows import DEFAULT_WINDOWS, long_equity_curve
from .plans import matches
from .registry import query, rounded, table
from .session import work_path
from .streaming.indexed import IndexedLedger
from .streaming.outcomes import follow_outcomes, read_changes

#: Scores that orders get in turn: text, status, whole, games, sets, difference, tie-break.
_SCORES = [
    ("6-4 6-3", "completed", True, 19, 2, 5, False), ("7-6(4) 6-4", "completed", True, 23, 2, 3, True), ("4-6 6-3 2-1 RET", "retired", False, 19, 2, 1, False),
    ("W/O", "walkover", False, None, 0, None, False), ("6-7(3) 6-1 6-0", "completed", True, 26, 3, 10, True), (None, "missing", False, None, 0, None, False),
]
_SURFACES = [" hard", "Clay", None, "GRASS "]
_STAT = {
    "ace": "(p + q) % 15", "df": "p % 7", "svpt": "50 + q", "1stIn": "30 + q % 15", "1stWon": "20 + p % 10", "2ndWon": "5 + q % 8", "SvGms": "9 + p % 6", "bpSaved": "p % 4", "bpFaced": "p % 4 + q % 4",
}


def raw_matches(spark, sf):
    """Wide raw rows, a match each."""
    line = F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    ends = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(line).alias("w"), F.min(line).alias("l"))
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    k = F.col("o_orderkey")
    stats = []
    for side in "wl":
        for name, how in _STAT.items():
            value = F.expr(how.replace("p", f"{side}.l_partkey").replace("q", f"cast({side}.l_quantity as int)")) if name != "svpt" else 50 + F.col(f"{side}.l_quantity").cast("int")
            stats.append(F.when(F.col(f"{side}.l_quantity").cast("int") % 17 != 0, value).cast("int").alias(f"{side}_{name}"))
    who = []
    for side, name in (("w", "winner"), ("l", "loser")):
        there = F.lit(True) if side == "w" else F.col("w.l_suppkey") != F.col("l.l_suppkey")
        of = lambda c: F.when(there, c)  # noqa: E731,B023
        who += [of(F.col(f"{side}.l_suppkey")).alias(f"{name}_id"), of(F.concat(F.lit("P"), F.col(f"{side}.l_suppkey").cast("string"))).alias(f"{name}_name"), of(F.lit("R")).alias(f"{name}_hand"), of(F.col(f"{side}.l_partkey").cast("int")).alias(f"{name}_rank"), of(F.lit(100)).alias(f"{name}_rank_points")]
    rows = table(spark, sf, "orders").join(ends, k == F.col("l_orderkey"))
    return rows.select(
        F.concat(F.lit("T"), F.expr("o_orderkey div 8").cast("string")).alias("tourney_id"), F.lit("Open").alias("tourney_name"), pick(_SURFACES, k).alias("surface"), F.lit("A").alias("tourney_level"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("tourney_date"), (k % 8).alias("match_num"), F.lit("F ").alias("round"), F.lit(3).alias("best_of"), F.lit(90).alias("minutes"), pick([s[0] for s in _SCORES], k).alias("score"), *who, *stats,
    )


def _sides(spark, sf) -> int:
    """At most so many sides of matches; read from footers."""
    return 2 * table(spark, sf, "orders").count()


def _sql_stat(side: str, name: str) -> str:
    how = _STAT[name].replace("p", "X").replace("q", f"{side}.q::INT").replace("X", f"{side}.p")
    return f"CASE WHEN {side}.q::INT % 17 <> 0 THEN {how} END"


def _sql_side(me: str, you: str, result: str) -> str:
    own = ", ".join(f"{_sql_stat(me, k)} AS {n}" for k, n in matches.STATS.items())
    other = ", ".join(f"{_sql_stat(you, k)} AS opponent_{n}" for k, n in matches.STATS.items())
    return f"SELECT match_id, tid, d, surface, k, 'ATP-' || {me}.s::VARCHAR AS player_id, 'ATP-' || {you}.s::VARCHAR AS opponent_id, '{result}' AS result, {own}, {other} FROM ends WHERE n > 1"


#: Player matches with derived counts: two rows for each match, ``k`` the order.
_FACTS = f"""
ends AS (
  SELECT o_orderkey AS k, 'ATP:T' || (o_orderkey // 8)::VARCHAR || ':' || (o_orderkey % 8)::VARCHAR AS match_id, 'T' || (o_orderkey // 8)::VARCHAR AS tid, o_orderdate::DATE AS d,
         [{", ".join("NULL" if s is None else repr(s.strip().capitalize()) for s in _SURFACES)}][1 + o_orderkey % {len(_SURFACES)}] AS surface, w, l, CASE WHEN w.s <> l.s THEN n ELSE 1 END AS n
  FROM orders JOIN (
    SELECT l_orderkey, max({{'e': l_extendedprice, 'p': l_partkey, 's': l_suppkey, 'q': l_quantity}}) AS w, min({{'e': l_extendedprice, 'p': l_partkey, 's': l_suppkey, 'q': l_quantity}}) AS l, count(*) AS n FROM lineitem GROUP BY 1
  ) ON l_orderkey = o_orderkey
),
facts AS ({_sql_side("w", "l", "W")} UNION ALL {_sql_side("l", "w", "L")}),
dv AS (
  SELECT *, opponent_service_points AS return_points, opponent_break_points_faced AS break_points_created, opponent_break_points_faced - opponent_break_points_saved AS break_points_converted,
         service_games - (break_points_faced - break_points_saved) AS service_games_held, opponent_service_points - opponent_first_serve_points_won - opponent_second_serve_points_won AS return_points_won,
         date_diff('day', DATE '1970-01-01', d) AS day, (date_diff('day', DATE '1970-01-01', d) - max(date_diff('day', DATE '1970-01-01', d)) OVER (PARTITION BY player_id)) / 90.0 AS age
  FROM facts
)"""
_ORDER = "ORDER BY d, tid, match_id, result"


def _sql_sum(value: str, window: str) -> str:
    """A windowed sum over earlier rows of the player, as the library defines it."""
    v, career = f"coalesce({value}, 0)::DOUBLE", f"(PARTITION BY player_id {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    if window == "career":
        return f"sum({v}) OVER {career}"
    if window == "surface_career":
        return f"CASE WHEN surface IS NOT NULL THEN sum({v}) OVER (PARTITION BY player_id, surface {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END"
    if window == "last365d":
        return f"(sum({v}) OVER (PARTITION BY player_id ORDER BY day RANGE BETWEEN 364 PRECEDING AND CURRENT ROW) - sum({v}) OVER (PARTITION BY player_id, day {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    if window == "decay90d":
        return f"coalesce(pow(2, -age) * sum({v} * pow(2, age)) OVER {career}, 0)"
    return f"sum({v}) OVER (PARTITION BY player_id {_ORDER} ROWS BETWEEN {window.removeprefix('last')} PRECEDING AND 1 PRECEDING)"


def _sql_rate(num: str, den: str, window: str) -> str:
    return f"CASE WHEN {_sql_sum(den, window)} > 0 THEN {_sql_sum(num, window)} / {_sql_sum(den, window)} END"


_RATES = {"serve_ace_rate": ("aces", "service_points"), "serve_hold_pct": ("service_games_held", "service_games"), "return_ace_allowed_rate": ("opponent_aces", "return_points"), "return_break_pct": ("break_points_converted", "opponent_service_games")}
_WINDOWS = [w.name for w in DEFAULT_WINDOWS]


@query(f"""WITH {_FACTS}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE n = 1) AS alone FROM ends)
SELECT 'n_raw_matches' AS metric, n AS value FROM c UNION ALL SELECT 'n_matches_missing_player_id', alone FROM c UNION ALL SELECT 'n_matches_used', n - alone FROM c
UNION ALL SELECT 'expected_rows', 2 * (n - alone) FROM c UNION ALL SELECT 'rows_match_expected', 1 UNION ALL SELECT 'n_player_match_rows', count(*) FROM facts
UNION ALL SELECT 'n_duplicate_match_ids', coalesce(sum(m), 0)::BIGINT FROM (SELECT count(*) AS m FROM ends WHERE n > 1 GROUP BY match_id HAVING count(*) > 1)
{' '.join(f"UNION ALL SELECT 'null_{n}', count(*) FILTER (WHERE {n} IS NULL) FROM facts" for n in matches.STATS.values())}
UNION ALL SELECT 'rows_' || result, count(*) FROM facts GROUP BY result""")
def match_diagnostics(spark, sf):
    """The two perspectives written, what the writing job counted, and rows read back per result."""
    path = work_path(spark, "player-matches")
    counts = matches.write_player_matches(raw_matches(spark, sf), "ATP", path)
    sides = spark.read.parquet(path).groupBy("result").agg(F.count(F.lit(1)).alias("value"))
    told = F.explode(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]))
    return sides.select(F.concat(F.lit("rows_"), "result").alias("metric"), "value").unionByName(spark.range(1).select(told.alias("metric", "value")).select("metric", F.col("value").cast("long")))


@query(f"""WITH {_FACTS}
SELECT match_id, player_id, result, {", ".join(f"round({_sql_rate(*_RATES[m], w)}, 8) AS player_{m}_{w}" for m in _RATES for w in _WINDOWS)},
 {", ".join(f"coalesce({_sql_sum('1', 'career' if w == 'decay90d' else w)}, 0)::BIGINT AS prior_matches_{w}" for w in _WINDOWS)}, round({_sql_sum("service_points", "last50")}, 4) AS prior_service_points_last50 FROM dv""")
def player_profile(spark, sf):
    """Rates before each match over all windows."""
    out = matches.profile(matches.derived(matches.player_matches(raw_matches(spark, sf), "ATP")), rows=_sides(spark, sf))
    wanted = [f"player_{m}_{w}" for m in _RATES for w in _WINDOWS] + [f"prior_matches_{w}" for w in _WINDOWS]
    return rounded(out.select("match_id", "player_id", "result", *wanted, F.round("prior_service_points_last50", 4).alias("prior_service_points_last50")), 8)


_CHAIN = f"""{_FACTS},
pf AS (
  SELECT dv.*, {", ".join(f"{_sql_rate(*_RATES[m], w)} AS {m}_{w}" for m in _RATES for w in matches.HEADLINE)},
         {", ".join(f"{_sql_sum('service_points', w)} / nullif(coalesce({_sql_sum('1', w)}, 0), 0) AS service_{w}" for w in matches.ADJUSTED)}
  FROM dv
),
mu AS (
  SELECT a.*, {", ".join(f"b.{m}_{w} AS o_{m}_{w}" for m in _RATES for w in matches.HEADLINE)}, {", ".join(f"b.serve_ace_rate_{w} * b.service_{w} AS o_iso_{w}" for w in matches.ADJUSTED)}
  FROM pf a LEFT JOIN pf b ON a.match_id = b.match_id AND a.opponent_id = b.player_id AND a.result <> b.result
),
fa AS (
  SELECT *, {", ".join(f"{_sql_sum(f'o_{m}_{w}', w)} / nullif({_sql_sum(f'(o_{m}_{w} IS NOT NULL)::INT', w)}, 0) AS f_{m}_{w}" for m in _RATES for w in matches.ADJUSTED)}
  FROM mu
),
sc AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join([str(i), *["NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in s[1:]]]) + ")" for i, s in enumerate(_SCORES))}) t(i, status, whole, games, sets, diff, tie))"""


def _sql_pred(w: str) -> str:
    both = f"coalesce((serve_ace_rate_{w} + o_return_ace_allowed_rate_{w}) / 2, serve_ace_rate_{w}, o_return_ace_allowed_rate_{w}) * service_{w}"
    return f"""round(serve_ace_rate_{w} * service_{w}, 8) AS pred_aces_isolated_{w}, round(serve_ace_rate_{w} * service_{w} + o_iso_{w}, 8) AS total_pred_aces_isolated_{w},
 round({both}, 8) AS pred_aces_matchup_{w}, round({both} + (serve_ace_rate_{w} - f_return_ace_allowed_rate_{w}) * service_{w}, 8) AS pred_aces_oppadj_{w},
 round(f_serve_ace_rate_{w} - return_ace_allowed_rate_{w}, 8) AS ace_suppression_{w}, round(serve_hold_pct_{w} - (1 - f_return_break_pct_{w}), 8) AS opponent_adjusted_hold_pct_{w}, round(return_break_pct_{w} - (1 - f_serve_hold_pct_{w}), 8) AS opponent_adjusted_break_pct_{w}"""


@query(f"""WITH {_CHAIN}
SELECT match_id, player_id, result, {", ".join(_sql_pred(w) for w in matches.ADJUSTED)}, {", ".join(f"round(serve_hold_pct_{w} - o_return_break_pct_{w}, 8) AS matchup_hold_vs_break_{w}" for w in matches.HEADLINE)},
 status AS score_status, whole AS score_complete, games::INT AS target_total_games, sets::INT AS target_total_sets, (CASE WHEN result = 'W' THEN diff ELSE -diff END)::INT AS target_game_diff, tie AS target_has_tiebreak, aces::BIGINT AS target_aces
FROM fa JOIN sc ON k % {len(_SCORES)} = i""")
def match_chain(spark, sf):
    """Raw wide rows to profile, opponents, adjustment, predictions, totals and targets."""
    out = matches.chain(matches.player_matches(raw_matches(spark, sf), "ATP"), rows=_sides(spark, sf))
    names = ["pred_aces_isolated", "total_pred_aces_isolated", "pred_aces_matchup", "pred_aces_oppadj", "ace_suppression", "opponent_adjusted_hold_pct", "opponent_adjusted_break_pct"]
    wanted = [f"{n}_{w}" for w in matches.ADJUSTED for n in names] + [f"matchup_hold_vs_break_{w}" for w in matches.HEADLINE]
    targets = ["score_status", "score_complete", "target_total_games", "target_total_sets", "target_game_diff", "target_has_tiebreak", "target_aces"]
    return rounded(out.select("match_id", "player_id", "result", *wanted, *targets), 8)


@query(f"""WITH {_FACTS}, pf AS (SELECT dv.*, {_sql_rate("aces", "service_points", "career")} * {_sql_sum("service_points", "career")} / {_sql_sum("1", "career")} AS lam FROM dv),
g AS (SELECT surface, avg(aces) AS mean, avg(aces) * avg(aces) / (var_pop(aces) - avg(aces)) AS r FROM dv WHERE surface IS NOT NULL GROUP BY 1 HAVING var_pop(aces) > avg(aces)),
t AS (SELECT surface, mean, r, i, exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * ln(r / (r + mean)) + i * ln(mean / (r + mean))) AS p FROM g, range(0, 200) q(i)),
c AS (SELECT *, sum(p) OVER (PARTITION BY surface ORDER BY i ROWS UNBOUNDED PRECEDING) AS f FROM t),
b AS (SELECT surface, mean, r, greatest(min(i) FILTER (WHERE f >= 0.01) - 1, 0) AS lo, min(i) FILTER (WHERE f >= 0.99) + 1 AS hi FROM c GROUP BY ALL),
n AS (SELECT *, lo + greatest(hi - lo - 14, 0) // 2 AS first, least(hi - lo, 14) AS many FROM b),
l AS (SELECT match_id, player_id, result, lam, r, unnest(range(first, first + many)) AS floor FROM pf JOIN n USING (surface)),
s AS (SELECT match_id, player_id, result, floor + 0.5 AS line, lam, r, CASE WHEN lam > 0 THEN (SELECT sum(exp(-lam + i * ln(lam) - lgamma(i + 1))) FROM range(0, 200) q(i) WHERE i <= floor) END AS cp,
 CASE WHEN lam > 0 THEN (SELECT sum(exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * ln(r / (r + lam)) + i * ln(lam / (r + lam)))) FROM range(0, 200) q(i) WHERE i <= floor) END AS cn FROM l)
SELECT match_id, player_id, result, line::DOUBLE AS line, round(CASE WHEN lam > 0 THEN greatest(1 - cp, 0) END, 8) AS p_poisson, round(CASE WHEN lam > 0 THEN greatest(1 - least(cn, 1), 0) END, 8) AS p_negbin,
 CASE WHEN (line - lam) / sqrt(greatest(lam + lam * lam / r, 1e-9)) < -1 THEN 'muito_abaixo_da_media' WHEN (line - lam) / sqrt(greatest(lam + lam * lam / r, 1e-9)) < 1 THEN 'proxima_da_media' WHEN lam IS NOT NULL THEN 'muito_acima_da_media' END AS difficulty FROM s""")
def fact_lines(spark, sf):
    """Every line of each surface's grid for every side of every match, with its probabilities."""
    facts = matches.isolated_predictions(matches.profile(matches.derived(matches.player_matches(raw_matches(spark, sf), "ATP"))), ["career"])
    groups = facts.groupBy("surface").agg(F.avg("aces").alias("mean"), dist.moments_r(F.avg("aces"), F.var_pop("aces")).alias("r"))
    groups = matches.with_grids(groups, "r", "mean")
    rows = facts.select("match_id", "player_id", "result", "surface", F.col("pred_aces_isolated_career").alias("lam")).join(groups, "surface")
    return rounded(matches.lines(rows, "lam", "r", "mean", "grid").select("match_id", "player_id", "result", "line", "p_poisson", "p_negbin", "difficulty"), 8)


_CUTS = ("1996-06-01", "1997-06-01")


@query(f"""WITH {_FACTS.replace("FROM ends WHERE n > 1", "FROM ends WHERE n > 1 AND d < DATE '" + _CUTS[1] + "'")},
coming AS (SELECT match_id, tid, d, surface, k, 'ATP-' || w.s::VARCHAR AS a, 'ATP-' || l.s::VARCHAR AS b FROM ends WHERE n > 1 AND d >= DATE '{_CUTS[1]}'),
rows AS (
  SELECT match_id, NULL AS tid, d, surface, player_id, NULL AS result, NULL::INT AS aces, NULL::INT AS service_points, NULL::INT AS service_games, NULL::INT AS service_games_held FROM (SELECT *, a AS player_id FROM coming UNION ALL SELECT *, b FROM coming)
  UNION ALL SELECT match_id, tid, d, surface, player_id, result, aces, service_points, service_games, service_games_held FROM dv
),
al AS (SELECT *, date_diff('day', DATE '1970-01-01', d) AS day, (date_diff('day', DATE '1970-01-01', d) - max(date_diff('day', DATE '1970-01-01', d)) OVER (PARTITION BY player_id)) / 90.0 AS age FROM rows),
w AS (SELECT match_id, player_id, result, {", ".join(f"round({_sql_rate(*_RATES[m], w)}, 8) AS {m}_{w}" for m in ("serve_ace_rate", "serve_hold_pct") for w in _WINDOWS)},
 {", ".join(f"coalesce({_sql_sum('1', 'career' if w == 'decay90d' else w)}, 0)::BIGINT AS prior_matches_{w}" for w in _WINDOWS)} FROM al)
SELECT * EXCLUDE (result) FROM w WHERE result IS NULL""".replace(_ORDER, "ORDER BY d, tid NULLS FIRST, match_id, result NULLS FIRST"))
def future_profile(spark, sf):
    """Features of coming matches from stored states, advanced by two batches, without their history."""
    path = work_path(spark, "facts")
    matches.derived(matches.player_matches(raw_matches(spark, sf), "ATP")).write.parquet(path)
    facts, day = spark.read.parquet(path), F.col("tournament_date")
    cuts = [F.lit(c).cast("date") for c in _CUTS]
    carried = Carried(matches.timeline(), ["aces", "service_points", "service_games_held", "service_games"], DEFAULT_WINDOWS)
    store = CarriedStore(spark, work_path(spark, "player-states"), carried)
    store.advance(facts.filter(day < cuts[0]))
    store.advance(facts.filter((day >= cuts[0]) & (day < cuts[1])))
    after = facts.filter((day >= cuts[1]) & (F.col("result") == "W"))
    upcoming = after.select("match_id", "tour", "tournament", "tournament_date", "round", "surface", F.col("player_id").alias("player_id_a"), F.col("opponent_id").alias("player_id_b"))
    coming = matches.future_rows(upcoming, facts)
    rates = {"serve_ace_rate": ("aces", "service_points"), "serve_hold_pct": ("service_games_held", "service_games")}
    out = store.answer(coming, rates)
    return rounded(out.select("match_id", "player_id", *[f"{m}_{w}" for m in rates for w in _WINDOWS], *[f"prior_matches_{w}" for w in _WINDOWS]), 8)


@query(f"""WITH {_FACTS}, v AS (SELECT *, opponent_service_points - opponent_first_serves_in AS opponent_second_serves_in, service_points - first_serves_in AS second_serves_in, first_serve_points_won + second_serve_points_won AS service_points_won,
 opponent_first_serves_in - opponent_first_serve_points_won AS first_serve_return_points_won, opponent_service_points - opponent_first_serves_in - opponent_second_serve_points_won AS second_serve_return_points_won FROM dv)
{' UNION ALL '.join(f"SELECT '{c}' AS name, count({c}) AS n_present, coalesce(sum({c}), 0)::BIGINT AS total FROM v" for c in matches.value_columns())}""")
def value_columns(spark, sf):
    """Every numerator and denominator of the rates, once each, over all sides of all matches."""
    facts = matches.derived(matches.player_matches(raw_matches(spark, sf), "ATP"))
    long = facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("v")) for c in matches.value_columns()])).alias("x"))
    return long.groupBy("x.name").agg(F.count("x.v").alias("n_present"), F.coalesce(F.sum("x.v"), F.lit(0)).alias("total"))


_CURVE = "SELECT *, CASE WHEN value > 250 THEN 1.5 WHEN value < 200 THEN -1.0 ELSE 0.0 END AS pnl FROM events"


def _curve_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""
WITH a AS ({_CURVE}), b AS (SELECT *, sum(pnl) OVER w AS cumulative, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER w AS run FROM a WINDOW w AS ({part} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, cumulative, max(cumulative) OVER w AS peak, cumulative - max(cumulative) OVER w AS drawdown,
 CASE WHEN pnl < 0 THEN sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {by + ', ' if by else ''}run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS loss_streak
FROM b WINDOW w AS ({part} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


def _with_pnl(spark, sf):
    pnl = F.when(F.col("value") > 250, 1.5).when(F.col("value") < 200, -1.0).otherwise(0.0)
    return table(spark, sf, "events").select("event_id", "ts", "event_type", pnl.alias("pnl"))


@query(_curve_sql(""))
def total_equity_curve(spark, sf):
    """One curve over all events, dealt to ranges of time."""
    out = long_equity_curve(_with_pnl(spark, sf), "pnl", ["ts", "event_id"])
    return out.select("event_id", "cumulative", "peak", "drawdown", "loss_streak")


@query(_curve_sql("event_type"))
def hot_equity_curves(spark, sf):
    """A curve for each of a few types of events, each dealt to ranges."""
    out = long_equity_curve(_with_pnl(spark, sf), "pnl", ["ts", "event_id"], by=["event_type"])
    return out.select("event_id", "cumulative", "peak", "drawdown", "loss_streak")


@query("""
WITH k AS (SELECT user_id, event_type, ts::DATE AS day, min_by(event_id, (event_id % 3, event_id)) AS event_id FROM events GROUP BY ALL)
SELECT k.user_id, k.event_type, k.day, k.event_id, value FROM k JOIN events USING (event_id)""")
def indexed_ledger(spark, sf):
    """Three batches and one that comes twice, into a ledger with filters: the first row of each key stays."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value")
    ledger = IndexedLedger(spark, work_path(spark, "ledger"), e.schema, ["user_id", "event_type", "day"], ["event_id"], buckets=16)
    for k in (0, 1, 1, 2):
        ledger.append(e.filter(F.col("event_id") % 3 == k))
    return ledger.read().select("user_id", "event_type", "day", "event_id", "value")


@query("""
WITH e AS (SELECT user_id::VARCHAR || ':' || event_type AS key, event_id AS event, event_id % 2 AS load, CASE WHEN value > 250 THEN 'WIN' WHEN value < 200 THEN 'LOSS' END AS settlement FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY load, event) AS nth, first_value(settlement IGNORE NULLS) OVER (PARTITION BY key ORDER BY load, event ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
 count(settlement) OVER (PARTITION BY key ORDER BY load, event ROWS UNBOUNDED PRECEDING) AS decided FROM e)
SELECT key, event, 'registered' AS change, settlement, NULL AS previous FROM t WHERE nth = 1
UNION ALL SELECT key, event, 'settled', settlement, NULL FROM t WHERE settlement IS NOT NULL AND decided = 1
UNION ALL SELECT key, event, 'rejected', settlement, final FROM t WHERE decided > 1 AND settlement <> final""")
def streamed_outcomes(spark, sf):
    """A stream over two loads of events, one of them delivered again, with state per key."""
    folder, sink, checkpoint = (work_path(spark, name) for name in ("event-loads", "outcome-changes", "outcome-checkpoint"))
    k, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), (k % 2).cast("long").alias("load"), k.alias("event"), F.when(v > 250, "WIN").when(v < 200, "LOSS").alias("settlement")
    )
    for load in (0, 1, 0):
        rows.filter(F.col("load") == load).write.mode("append").parquet(folder)
        follow_outcomes(spark.readStream.schema(rows.schema).parquet(folder), sink, checkpoint).awaitTermination()
    return read_changes(spark, sink)


@query("""
WITH b AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0),
a AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate) FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'before_only' WHEN b.o_orderkey IS NULL THEN 'after_only' ELSE 'both' END AS presence, b.o_totalprice AS p_before, a.o_totalprice AS p_after,
 [coalesce(abs(b.o_totalprice - a.o_totalprice) > 1e-9, false), b.o_custkey IS DISTINCT FROM a.o_custkey, b.o_orderstatus IS DISTINCT FROM a.o_orderstatus, b.o_orderdate IS DISTINCT FROM a.o_orderdate, b.o_orderpriority IS DISTINCT FROM a.o_orderpriority] AS f
 FROM b FULL OUTER JOIN a ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, presence, presence <> 'both' OR list_contains(f, true) AS changed, CASE WHEN presence <> 'both' THEN 'o_totalprice,o_custkey,o_orderstatus,o_orderdate,o_orderpriority'
 ELSE concat_ws(',', CASE WHEN f[1] THEN 'o_totalprice' END, CASE WHEN f[2] THEN 'o_custkey' END, CASE WHEN f[3] THEN 'o_orderstatus' END, CASE WHEN f[4] THEN 'o_orderdate' END, CASE WHEN f[5] THEN 'o_orderpriority' END) END AS differing,
 CASE WHEN presence <> 'both' OR list_contains(f, true) OR p_before IS DISTINCT FROM p_after THEN p_before END AS p_before, CASE WHEN presence <> 'both' OR list_contains(f, true) OR p_before IS DISTINCT FROM p_after THEN p_after END AS p_after FROM j""")
def wide_diff(spark, sf):
    """All columns of two states of orders; rows are compared whole only where digests differ."""
    k, o = F.col("o_orderkey"), table(spark, sf, "orders")
    changed = {"o_totalprice": F.when(k % 7 == 0, F.col("o_totalprice") + 1).when(k % 11 == 0, None).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderdate": F.when(k % 13 != 0, F.col("o_orderdate"))}
    out = joins.diff_digests(o.filter(k % 3 != 0), o.filter(k % 4 != 0).withColumns(changed), ["o_orderkey"], ["o_totalprice"], ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    return out.select("o_orderkey", "presence", "changed", F.array_join("differing", ",").alias("differing"), F.col("before.o_totalprice").alias("p_before"), F.col("after.o_totalprice").alias("p_after"))


@query("""
WITH p AS (SELECT item_id, substr(text, 1, 40) AS part FROM benchmark UNION ALL SELECT -1, 'th' UNION ALL SELECT -2, '' UNION ALL SELECT -3, 'no such text'),
d AS (SELECT doc_id, lang, text FROM documents), l AS (SELECT DISTINCT lang FROM d)
SELECT d.lang, doc_id, item_id FROM d JOIN (SELECT * FROM p, l) r ON d.lang = r.lang AND contains(d.text, r.part)""")
def passages_within(spark, sf):
    """Documents that hold a passage, by language."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    p = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.substring("text", 1, 40).alias("part"))
    p = p.unionByName(spark.createDataFrame([(-1, "th"), (-2, ""), (-3, "no such text")], "item_id long, part string"))
    each = joins.expand(p, [(x,) for x in sorted(r.lang for r in d.select("lang").distinct().collect())], ["language"])  # four languages
    return joins.contains_join(d, each, [("lang", "language")], "text", "part").select("lang", "doc_id", "item_id")
