"""Queries of rules, reports, identity and selection that have one family each."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import numeric as num
from .functions import setmodel, text
from .operators import evaluation as ev
from .operators import identity, joins, quality, rules, selection
from .plans import calibrate
from .registry import query, r, rounded, table

_LI = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 51.0 AS p, l_returnflag AS f, l_linestatus AS s FROM lineitem"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 51.0).alias("p"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))


@query("""SELECT 'pred_' || v || '_' || w AS name, v AS variant, w AS "window", o_orderkey FROM orders, (SELECT unnest(['isolated', 'history_mean']) AS v), (SELECT unnest(['career', 'last10']) AS w)""")
def approach_names(spark, sf):
    """Column names of all variants and windows, and both read back from the name."""
    names = ev.prediction_columns("pred", {"isolated": ["career", "last10"], "history_mean": ["career", "last10"]})
    o = joins.expand(table(spark, sf, "orders").select("o_orderkey"), [(n,) for n in names], ["name"])
    parts = ev.split_approach(F.regexp_replace("name", "^pred_", ""), ["history", "isolated", "history_mean"])
    return o.select("name", parts["variant"].alias("variant"), parts["window"].alias("window"), "o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice > 100000 END""")
def nullable_filter(spark, sf):
    ok = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") > 100000)
    return table(spark, sf, "orders").filter(rules.yes(ok)).select("o_orderkey")


@query(f"""
WITH a AS ({_LI}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, f = 'N' AS cold_start, f IN ('N', 'A') AS insufficient_history, l_partkey % 3 > 0 AND l_suppkey % 1000 < 500 AS calibrator_insufficient_sample, p >= 0.9 AS extreme_probability, f = 'R' AND s = 'O' OR f = 'A' AS restricted,
 CASE WHEN f = 'R' AND s = 'O' THEN 'first' WHEN f = 'A' THEN 'second' END AS restricted_reason FROM a""")
def quality_flags(spark, sf):
    df = _lines(spark, sf)
    bucket = F.when(F.col("f") == "N", "cold_start").when(F.col("f") == "A", "small_1_9").otherwise("large_50_plus")
    method = F.when(F.col("l_partkey") % 3 > 0, "platt").otherwise("raw")
    flags = num.quality_flags(bucket, method, F.col("l_suppkey") % 1000, F.col("p"))
    closed = num.restricted_flag([{"flag": "R", "status": "O", "reason": "first"}, {"flag": "A", "reason": "second"}], {"flag": F.col("f"), "status": F.col("s")})
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *flags, *closed)


@query("""
WITH a AS (SELECT event_id, 'p' || user_id::VARCHAR AS n, CASE WHEN event_id % 3 = 0 THEN 'exact' WHEN event_id % 3 = 1 THEN 'fuzzy_review' ELSE 'unresolved' END AS m FROM events)
SELECT event_id, 'a' AS side, n AS raw_name, m AS method FROM a WHERE m <> 'exact' UNION ALL SELECT event_id, 'b', 'q', 'unresolved' FROM a WHERE event_id % 2 = 0""")
def unresolved_log(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("player_a_raw"), F.lit("q").alias("player_b_raw"), F.when(k % 3 == 0, "exact").when(k % 3 == 1, "fuzzy_review").otherwise("unresolved").alias("method_a"), F.when(k % 2 == 0, "unresolved").otherwise("alias").alias("method_b"))
    return selection.unresolved_sides(e, ["event_id"])


@query("""SELECT o_orderkey, o_orderstatus, count(*) OVER () AS total FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderkey DESC LIMIT 40 OFFSET 10""")
def listed_page(spark, sf):
    return selection.listing(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 40, 10, o_orderstatus=("F", "P"))


@query(f"""WITH a AS ({_LI}) SELECT l_orderkey, l_linenumber FROM a WHERE f = 'A'""")
def rejected_rows(spark, sf):
    df = _lines(spark, sf).withColumn("classification", F.when(F.col("f") == "A", "DESCARTAR").otherwise("OBSERVAR"))
    return selection.rejected(df, ["l_orderkey", "not_there", "l_linenumber"])


@query("""SELECT l_linestatus, round(avg(l_quantity), 6) AS poisson_mean, count(*) AS poisson_n, round(max(l_tax), 6) AS negbin_mean, count(l_tax) AS negbin_n FROM lineitem GROUP BY 1""")
def flattened(spark, sf):
    df = table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.struct(r(F.avg("l_quantity")).alias("mean"), F.count(F.lit(1)).alias("n")).alias("poisson"), F.struct(r(F.max("l_tax")).alias("mean"), F.count("l_tax").alias("n")).alias("negbin"))
    return ev.flatten(df, ["poisson", "negbin"])


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN value + 2 WHEN 1 THEN value + 3 END AS odds, CASE WHEN event_id % 5 > 0 THEN value END AS no_nan FROM events""")
def labelled_odds(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    label = F.when(k % 3 == 0, "2pct").when(k % 3 == 1, "3pct").otherwise("none")
    return table(spark, sf, "events").select("event_id", num.label_odds(label, [("2pct", v + 2), ("3pct", v + 3)]).alias("odds"), num.no_nan(F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(v)).alias("no_nan"))


# --- joins --------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_totalprice, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def unique_merge(spark, sf):
    """A one-to-one merge that fails where a key isn't unique."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return joins.unique_merge(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), n, ["o_orderkey"])


@query("""
WITH a AS (SELECT o_custkey AS c, min(o_orderstatus) AS st FROM orders GROUP BY 1) SELECT c_custkey, c_name, n_name AS n_name_ctx, st AS o_orderstatus_o FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN a ON c = c_custkey""")
def enriched(spark, sf):
    """Chained left joins with context; rows never multiply and unmatched ones stay."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    out = joins.enrich(c, [(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "_ctx"), (o, ["c_custkey"], "_o")])
    return out.select("c_custkey", "c_name", "n_name_ctx", "o_orderstatus_o")


@query("""
WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT c_custkey, k AS o_orderkey, o_orderstatus FROM customer LEFT JOIN f ON c_custkey = o_custkey LEFT JOIN orders ON o_orderkey = k""")
def first_context(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return joins.distinct_right_join(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"], ["o_orderkey"])


@query("""
WITH k AS (SELECT c_custkey, 'atp:' || lower(replace(c_name, '#', '-')) AS match_key FROM customer) SELECT c_custkey, match_key, c_custkey % 4 = 0 AS found FROM k""")
def calendar_join(spark, sf):
    """Rows meet by a key of slugs, whatever their spelling."""
    name = F.col("c_name")
    c = table(spark, sf, "customer").select("c_custkey", text.match_key(F.lit("ATP"), name).alias("match_key"))
    other = table(spark, sf, "customer").filter("c_custkey % 4 = 0").select(text.match_key(F.lit(" atp "), F.upper(F.translate(name, "o", "ó"))).alias("match_key"), F.lit(True).alias("hit"))
    return c.join(other, "match_key", "left").select("c_custkey", "match_key", F.coalesce("hit", F.lit(False)).alias("found"))


@query("""SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey AND contains('x ' || c_name || ' ' || (c_custkey % 3)::VARCHAR, c_mktsegment || '') OR c_nationkey = n_nationkey AND contains(c_name, '1')""")
def contained_names(spark, sf):
    """Equal keys, and one text within the other."""
    n = table(spark, sf, "nation").select("n_nationkey").withColumn("part", F.lit("1"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    return joins.contains_join(c, n, [("c_nationkey", "n_nationkey")], "c_name", "part").select("n_nationkey", "c_custkey")


# --- reports ------------------------------------------------------------------------------


@query("""SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) <> 2""")
def group_sizes(spark, sf):
    return quality.group_size_check(table(spark, sf, "lineitem"), ["l_orderkey"])


@query("""
WITH w AS (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) > 1) SELECT count(*) FILTER (WHERE l_partkey % 7 = 0) AS null_k, (SELECT count(*) FROM w) AS multiple_winners FROM lineitem""")
def id_check(spark, sf):
    df = _lines(spark, sf).withColumn("k", F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey")))
    return quality.id_check(df, ["k"], ["l_orderkey"], "f", win="R")


@query("""SELECT unnest(['quality', 'toxic']) AS "column", unnest([round(avg((quality IS NOT NULL)::INT), 8), round(avg((toxic IS NOT NULL)::INT), 8)]) AS share FROM documents LEFT JOIN labels USING (doc_id)""")
def filled_report(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(quality.filled_report(d, ["quality", "toxic"]), 8)


@query(f"""WITH a AS ({_LI}) SELECT s, CASE WHEN f = 'N' THEN NULL ELSE f END AS classification, count(*) AS n FROM a GROUP BY ALL""")
def classification_summary(spark, sf):
    return selection.classification_summary(_lines(spark, sf).withColumn("classification", F.when(F.col("f") != "N", F.col("f"))), ["s"])


@query(f"""
WITH m AS ({_LI}), p AS (SELECT l_orderkey, s, count(*) AS n, count(*) FILTER (WHERE f = 'R') AS k FROM m GROUP BY ALL)
SELECT l_orderkey, sum(n)::BIGINT AS n_lines, sum(k)::BIGINT AS n_candidates, count(*) FILTER (WHERE k > 0) AS n_markets, sum(k) > 0 AS has_candidates FROM p GROUP BY 1""")
def daily_summary(spark, sf):
    return quality.daily_summary(_lines(spark, sf).withColumn("flag", F.col("f") == "R"), ["l_orderkey"], "s", "flag")


@query("""SELECT o_custkey, n, cp AS checkpoint, n >= cp AS reached FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), (SELECT unnest([25, 50, 100, 250, 500]) AS cp)""")
def sample_checkpoints(spark, sf):
    return ev.checkpoints(table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n")


@query("""
WITH g AS (SELECT l_returnflag, avg(l_tax) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, round(a, 8) AS a, round(b, 8) AS b, round((b - a) / b, 8) AS relative_gain, CASE WHEN (b - a) / b >= 0.03 THEN 'independent' ELSE 'empirical' END AS decision FROM g""")
def dependency_decision(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_tax").alias("brier_independent"), F.col("l_discount").alias("brier_empirical"))
    return rounded(selection.dependency_decision(df, ["l_returnflag"]), 8)


@query(f"""WITH a AS ({_LI}) SELECT s, count(*) AS n, count(*) FILTER (WHERE f = 'R') AS n_returned, count(*) FILTER (WHERE p >= 0.9) AS n_extreme FROM a GROUP BY 1""")
def flag_summary(spark, sf):
    df = _lines(spark, sf).withColumn("returned", F.col("f") == "R").withColumn("extreme", F.col("p") >= 0.9)
    return quality.flag_summary(df, ["s"], ["returned", "extreme"])


@query("""SELECT o_orderkey, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderdate, o_orderkey) - 1 AS n_before FROM orders""")
def ordered_days(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    return selection.ordered_before(o, ["day"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "day", F.col("n_before").cast("long").alias("n_before"))


# --- text, dates, models ------------------------------------------------------------------


@query("""SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') AS file_slug, CASE WHEN c_custkey % 4 = 0 THEN 'N/A' WHEN c_custkey % 4 = 1 THEN 'Vencida' ELSE 'Not Known' END AS label,
 CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE printf('%+.1f%%', (c_custkey % 5) * 12.5) END AS pct, CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE printf('%+.1f p.p.', (c_custkey % 5) * 12.5) END AS points, printf('%.2f', c_custkey % 5 + 0.25) AS number,
 CASE WHEN c_custkey % 2 = 0 THEN 'N/A' ELSE 'x' END AS shown, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'a,b' ELSE 'c' END AS parts FROM customer""")
def labels_and_formats(spark, sf):
    k = F.col("c_custkey")
    share = F.when(k % 5 > 0, (k % 5) / 8.0)
    key = F.when(k % 4 == 1, "WIN").when(k % 4 > 1, "not_known")
    parts = text.split_list(F.when(k % 3 == 1, "a, ,b,").when(k % 3 == 2, " c"), ",")
    return table(spark, sf, "customer").select(
        "c_custkey", text.safe_slug(F.col("c_name")).alias("file_slug"), text.bilingual(key, {"WIN": "Vencida"}).alias("label"), text.format_percent(share, 1, True).alias("pct"), text.format_points(share).alias("points"),
        text.format_number(k % 5 + 0.25).alias("number"), text.format_text(F.when(k % 2 == 0, " ").otherwise("x")).alias("shown"), F.array_join(parts, ",").alias("parts"),
    )


@query(f"""
WITH a AS ({_LI}) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f = 'N' THEN 'SEM_LINHA' WHEN f = 'R' THEN 'CANDIDATO' ELSE 'OBSERVAR' END AS category, CASE WHEN s = 'O' THEN 'gate one' END AS reason FROM a""")
def report_categories(spark, sf):
    df, f, s = _lines(spark, sf), F.col("f"), F.col("s")
    state = F.when(f == "R", "CANDIDATO_FORTE").otherwise("OBSERVAR")
    reasons = F.when(s == "O", F.array(F.lit("gate one: because"), F.lit("gate two"))).otherwise(F.array().cast("array<string>"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", selection.problem_category(state, F.when(f != "N", F.lit(True))).alias("category"), selection.discard_reason(reasons).alias("reason"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 3 HOUR WHEN 2 THEN date_trunc('minute', ts) END AS utc FROM events""")
def mixed_instants(spark, sf):
    """ISO times with and without zones, local forms, and what isn't a time."""
    ts, k = F.col("ts"), F.col("event_id") % 4
    raw = F.when(k == 0, ts.cast("string")).when(k == 1, F.concat(F.regexp_replace(ts.cast("string"), " ", "T"), F.lit("+03:00"))).when(k == 2, F.date_format(ts, "dd/MM/yyyy HH:mm")).otherwise("soon")
    return table(spark, sf, "events").select("event_id", text.parse_instant(raw).cast("timestamp_ntz").alias("utc"))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 51.0 AS own, l_discount * 5 AS other, l_tax AS ob, l_tax * 2 AS hb FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(own, 8) AS a_isolated, round((own + 1 - hb) / 2, 8) AS a_matchup, round((own + 1 - hb) / 2 + 0.01, 8) AS a_oppadj, round((other + 1 - ob) / 2 - 0.02, 8) AS b_oppadj FROM h""")
def hold_pairs(spark, sf):
    t = F.col("l_tax")
    pairs = setmodel.hold_pair(F.col("l_quantity") / 51.0, F.col("l_discount") * 5, t, t * 2, F.lit(0.01), F.lit(0.02))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(pairs["isolated"][0], 8).alias("a_isolated"), r(pairs["matchup"][0], 8).alias("a_matchup"), r(pairs["oppadj"][0], 8).alias("a_oppadj"), r(pairs["oppadj"][1], 8).alias("b_oppadj"))


@query("""
WITH s AS (SELECT event_id, 0.2 + (event_id % 60) / 100.0 AS p, 6.0 AS g, 4.5 AS h, 0.1 AS t, CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN NULL ELSE 4 END AS bo FROM events),
m AS (SELECT *, 1 - p AS q FROM s), e AS (SELECT *, CASE WHEN bo = 5 THEN p ** 3 * (1 + 3 * q + 6 * q * q) ELSE p * p * (1 + 2 * q) END AS pm, CASE WHEN bo = 5 THEN 3 * (p ** 3 + q ** 3) + 4 * 3 * (p ** 3 * q + q ** 3 * p) + 5 * 6 * (p ** 3 * q * q + q ** 3 * p * p) ELSE 2 * (p * p + q * q) + 3 * 2 * p * q END AS n FROM m)
SELECT event_id, round(pm, 8) AS p_match, round(n, 8) AS sets, round(n * (g + h), 6) AS games, round(1 - (1 - t) ** n, 8) AS p_any_tiebreak, round(CASE bo WHEN 5 THEN 6 * (p ** 3 * q * q + q ** 3 * p * p) WHEN 3 THEN 2 * p * q END, 8) AS p_full_distance FROM e""")
def match_lengths(spark, sf):
    """Matches of each row's own length; others count as best of 3."""
    k = F.col("event_id")
    s = F.struct((0.2 + (k % 60) / 100.0).alias("p_set"), F.lit(6.0).alias("games_a"), F.lit(4.5).alias("games_b"), F.lit(0.1).alias("p_tiebreak"))
    best = F.when(k % 4 == 0, 5).when(k % 4 == 1, 3).when(k % 4 == 3, 4)
    m = setmodel.match_expectation(s, best)
    return table(spark, sf, "events").select("event_id", r(m["p_match"], 8).alias("p_match"), r(m["sets"], 8).alias("sets"), r(m["games"]).alias("games"), r(m["p_any_tiebreak"], 8).alias("p_any_tiebreak"), r(m["p_full_distance"], 8).alias("p_full_distance"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN round(1 / (1 + exp(-(2 * ln(p / (1 - p)) + 0.5))), 8) WHEN l_returnflag = 'R' THEN round(CASE WHEN p <= 0.2 THEN 0.1 WHEN p >= 0.8 THEN 0.9 ELSE 0.1 + (p - 0.2) / 0.6 * 0.8 END, 8) END AS operational_p, CASE l_returnflag WHEN 'N' THEN 'unavailable' ELSE 'ok' END AS calibration_status FROM (SELECT *, l_quantity / 51.0 AS p FROM lineitem)""")
def applied_calibration(spark, sf):
    """Stored curves applied to new rows by key; keys without one are unavailable."""
    curves = {("A",): calibrate.Calibrator("platt", "ok", 900, slope=2.0, intercept=0.5), ("R",): calibrate.Calibrator("isotonic", "ok", 900, xs=[0.2, 0.8], ys=[0.1, 0.9])}
    out = calibrate.apply_to_new(_lines(spark, sf), curves, ["f"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r("operational_p", 8).alias("operational_p"), "calibration_status")


# --- identity and rules -------------------------------------------------------------------


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 'P' || c_custkey::VARCHAR END AS resolved_id_a, CASE WHEN c_custkey % 5 > 0 THEN 'P' || (c_custkey + 1)::VARCHAR END AS resolved_id_b, c_custkey % 5 > 0 AS usable FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)""")
def resolved_matches(spark, sf):
    """Both names of a match resolved; one id on both sides resolves neither."""
    c = table(spark, sf, "customer")
    players = c.select(F.lit("g").alias("g"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("id"), "c_name")
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next_name"))
    m = c.join(nxt, "c_custkey").select("c_custkey", F.lit("g").alias("g"), F.col("c_name").alias("a"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.upper("next_name")).alias("b"))
    return identity.resolve_matches(m, players, "g", "a", "b", "id", "c_name").select("c_custkey", "resolved_id_a", "resolved_id_b", "usable")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'P' || c_custkey::VARCHAR ELSE 'NEW-' || upper(replace(md5(c_custkey::VARCHAR), ' ', '-')) END AS resolved_id, c_custkey % 2 = 1 AS is_new FROM customer""")
def minted_players(spark, sf):
    """An existing id, or a new one made from the name."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    players = c.select(F.lit("g").alias("g"), F.concat(F.lit("P"), k.cast("string")).alias("id"), "c_name")
    asked = c.select("c_custkey", F.lit("g").alias("g"), F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.md5(k.cast("string"))).alias("raw"))
    return identity.resolve_or_mint(asked, players, "g", "raw", "id", "c_name").select("c_custkey", "resolved_id", "is_new")


@query("""
WITH g AS (SELECT DISTINCT o_custkey FROM orders) SELECT o_custkey, CASE o_custkey % 4 WHEN 0 THEN 'platt' WHEN 1 THEN 'isotonic' ELSE 'raw' END AS method_selected FROM g""")
def selected_methods(spark, sf):
    """The calibrator that gains in every fold without a worse error, else raw."""
    k = F.col("o_custkey") % 4
    g = table(spark, sf, "orders").select("o_custkey").distinct()
    rows = joins.expand(g, [(m, f) for m in ("raw", "platt", "isotonic") for f in (1, 2)], ["method", "fold"])
    m, f = F.col("method"), F.col("fold")
    brier = F.when(m == "raw", 0.2).when(k == 0, F.when(m == "platt", 0.15).otherwise(0.19)).when(k == 1, F.when(m == "platt", F.when(f == 1, 0.1).otherwise(0.1995)).otherwise(0.19)).otherwise(0.1)
    ece = F.when((k == 2) & (m != "raw") & (f == 2), 0.06).when((k == 3) & (m != "raw"), 0.051).otherwise(0.05)
    return rules.select_method(rows.select("o_custkey", "method", "fold", brier.alias("brier"), ece.alias("ece")), ["o_custkey"])


@query("""
WITH e AS (SELECT event_id, event_id % 11 = 0 AS bad_player, event_id % 2 = 0 AS has_over, event_id % 3 = 0 AS has_under FROM events),
s AS (SELECT event_id, bad_player, has_over OR has_under AS priced, CASE WHEN has_over THEN 1.9 END AS o, CASE WHEN has_under THEN CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 2.1 END END AS u FROM e)
SELECT event_id, array_to_string(list_filter([CASE WHEN bad_player THEN 'player' END, CASE WHEN NOT priced THEN 'side' END, CASE WHEN u <= 1 THEN 'under_odds' END], lambda x: x IS NOT NULL), ',') AS errors, side, odds::DOUBLE AS decimal_odds
FROM (SELECT *, unnest(['over', 'under']) AS side, unnest([o, u]) AS odds FROM s) WHERE odds IS NOT NULL""")
def price_entries(spark, sf):
    """What is wrong with each observed price, and a row per priced side."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.lit("ATP").alias("tour"), F.lit("aces_player").alias("market"), F.when(k % 11 == 0, " ").otherwise("p").alias("player"), F.lit(5.5).alias("line"), F.when(k % 2 == 0, 1.9).alias("over_odds"), F.when(k % 3 == 0, F.when(k % 5 == 0, 1.0).otherwise(2.1)).alias("under_odds"))
    out = rules.entry_sides(rules.validate_entries(e, ["ATP", "WTA"], ["aces_player"]))
    return out.select("event_id", F.array_join("errors", ",").alias("errors"), "side", "decimal_odds")


_READ = """(SELECT l_orderkey AS u, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_quantity::INT AS n, l_linenumber % 4 = 0 AS bad, l_discount = 0 AS cheap FROM lineitem)"""


def _readings(spark, sf):
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = table(spark, sf, "lineitem").withColumn("pos", pos)
    shown = F.when(F.col("l_linenumber") % 4 == 0, "?").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("+")))
    return li.select(F.col("l_orderkey").alias("u"), "pos", F.lit("aces").alias("market"), F.lit("p").alias("player"), shown.alias("display"), F.when(F.col("l_discount") == 0, 1.0).otherwise(2.0).alias("odds"))


@query(f"""
WITH a AS (SELECT u, pos, CASE WHEN NOT bad AND n > 0 THEN n - 0.5 END AS line, cheap, CASE WHEN cheap THEN 1.0 ELSE 2.0 END AS odds FROM {_READ}),
w AS (SELECT *, lag(line) OVER (PARTITION BY u ORDER BY pos) AS pl, lag(odds) OVER (PARTITION BY u ORDER BY pos) AS po, count(*) OVER (PARTITION BY u, line) AS same FROM a)
SELECT u, pos, line::DOUBLE AS model_line, array_to_string(list_filter([CASE WHEN line IS NULL THEN 'format' END, CASE WHEN cheap THEN 'odds' END, CASE WHEN same > 1 THEN 'duplicate' END, CASE WHEN line <= pl THEN 'line_order' END, CASE WHEN line > pl AND odds < po THEN 'odds_order' END], lambda x: x IS NOT NULL), ',') AS warnings FROM w""")
def checked_readings(spark, sf):
    """Readings of an upload with all their warnings; none is dropped."""
    out = rules.validate_readings(_readings(spark, sf), "u", "pos", "market", "player", "display", "odds", ["p"])
    return out.select("u", F.col("pos").cast("long").alias("pos"), "model_line", F.array_join("warnings", ",").alias("warnings"))


@query(f"""
WITH a AS (SELECT u, bool_or(bad OR n <= 0 OR cheap) AS bad, count(*) AS n FROM {_READ} GROUP BY 1) SELECT u, CASE WHEN bad THEN 'BLOCKED' ELSE 'CONFIRMED' END AS confirmation, CASE WHEN NOT bad THEN u % 3 = 0 END AS corrected FROM a""")
def confirmed_uploads(spark, sf):
    """Edited readings against the raw ones, in any order; structural errors block."""
    edited = rules.validate_readings(_readings(spark, sf), "u", "pos", "market", "player", "display", "odds", ["p"])
    raw = edited.withColumn("odds", F.when(F.col("u") % 3 == 0, F.col("odds") + 1).otherwise(F.col("odds")))
    return rules.confirm_readings(raw.orderBy(F.desc("pos")), edited, "u", ["market", "player", "display", "odds"])


@query("""
WITH p AS (SELECT c_custkey, c_custkey % 3 > 0 AS there FROM customer) SELECT c_custkey, there AS matched, CASE WHEN NOT there THEN 'SEM_AVALIACAO' WHEN c_custkey % 2 = 0 THEN 'PASSOU' ELSE 'OBSERVAR' END AS label FROM p""")
def evaluated_uploads(spark, sf):
    """Confirmed readings through lines, rules and labels."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    readings = c.select("c_custkey", F.lit("ATP").alias("tour"), F.concat(F.lit("ATP-"), k.cast("string")).alias("player"), F.lit(5.5).alias("line"), F.lit("over").alias("side"), F.lit(3.0).alias("decimal_odds"), F.lit("aces_player").alias("market"))
    priced = c.filter(k % 3 > 0).select(F.lit("ATP").alias("tour"), F.concat(F.lit("ATP-"), k.cast("string")).alias("player_id"), F.lit("n").alias("player"), F.concat(F.lit("M"), k.cast("string")).alias("match_id"), F.lit(5.5).alias("line"), F.lit("over").alias("side"))
    lit = {"restricted": False, "restricted_motivo": None, "resolution_method_player": "exact", "resolution_method_opponent": "exact", "operational_probability": 0.6, "prior_matches_career": 100, "prior_service_points_career": 500, "prior_return_points_career": 500, "surface_prior_matches": 20, "cold_start": False, "insufficient_history": False, "calibrator_insufficient_sample": False, "data_staleness_days": 10, "historical_data_cutoff": "2026-01-01", "extreme_probability": False, "model_edge": 0.1, "method_selected": "platt", "surface_ctx": "Hard"}
    context = c.select(F.concat(F.lit("M"), k.cast("string")).alias("matched_id"), F.when(k % 2 == 0, "ATINGE_EDGE_10").otherwise("ABAIXO_DO_LIMITE").alias("status"), *[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(n) for n, v in lit.items()])
    return rules.evaluate_confirmed(readings, priced, context, ["tour"]).select("c_custkey", "matched", "label")


@query("""SELECT c_custkey % 3 AS grp, count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 1) AS n_changed FROM customer GROUP BY 1""")
def floor_sensitivity(spark, sf):
    """How many states change under one floor for all markets."""
    k = F.col("c_custkey")
    lit = {"matched": True, "match_reason": None, "restricted": False, "restricted_motivo": None, "resolution_method_player": "exact", "resolution_method_opponent": "alias", "operational_probability": 0.6, "decimal_odds": 2.0, "prior_matches_career": 100, "prior_service_points_career": 500, "prior_return_points_career": 500, "surface_prior_matches": 20, "cold_start": False, "insufficient_history": False, "calibrator_insufficient_sample": False, "data_staleness_days": 10, "historical_data_cutoff": "2026-01-01", "extreme_probability": False, "model_edge": 0.1, "method_selected": "platt", "surface_ctx": "Hard"}
    market = F.element_at(F.array(*[F.lit(m) for m in ("double_faults_player", "aces_player", "double_faults_player")]), (k % 3 + 1).cast("int"))
    df = table(spark, sf, "customer").select((k % 3).alias("grp"), market.alias("market"), F.when(k % 2 == 0, "ATINGE_EDGE_3").otherwise("ABAIXO_DO_LIMITE").alias("status"), *[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(n) for n, v in lit.items()])
    return rules.sensitivity(df, ["grp"])
