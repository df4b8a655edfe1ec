"""What larger tables and odd values showed: zero prices, values worked out twice, wide rows, long texts."""

import math

from pyspark.sql import functions as F

from priorflow.functions import numeric as num
from priorflow.streaming import ledgers


def test_prices_of_zero_divide_as_floats(spark):
    """closing_values; as the SQL has it, by 0 infinite, and 0 by 0 no number."""
    rows = [(1, "a", 2.0), (2, "b", 0.0), (3, "a", 0.0), (4, "c", None), (5, "d", 2.0)]
    moves = [("a", 0.0), ("b", 4.0), ("c", 1.0), ("d", 4.0)]
    out = ledgers.clv(spark.createDataFrame(rows, "i int, k string, decimal_odds double"), spark.createDataFrame(moves, "k string, closing_odds double"), ["k"])
    got = {r.i: r for r in out.collect()}
    assert got[1].clv_pct == math.inf and got[1].prob_diff == math.inf and got[1].beat_close is True
    assert got[2].clv_pct == -100 and got[2].prob_diff == -math.inf
    assert math.isnan(got[3].clv_pct) and math.isnan(got[3].prob_diff) and got[3].beat_close is False
    assert got[4].clv_pct is None and got[4].prob_diff is None
    assert got[5].clv_pct == -50 and got[5].prob_diff == -0.25


def test_movement_that_closes_at_zero(spark):
    """odds_movement; first and closing prices of 0."""
    rows = [("a", 1, 2.0), ("a", 2, 0.0), ("b", 1, 0.0), ("b", 2, 4.0), ("b", 9, 5.0), ("c", 9, 3.0)]
    m = ledgers.odds_movement(spark.createDataFrame(rows, "k string, collected_at int, decimal_odds double").withColumn("cut", F.lit(5)), ["k"], "cut")
    v = num.closing_line_value(F.col("first_odds"), F.col("closing_odds"))
    got = {r.k: r for r in m.select("k", "closing_odds", v["clv_pct"].alias("clv"), v["prob_diff"].alias("diff")).collect()}
    assert (got["a"].closing_odds, got["a"].clv, got["a"].diff) == (0.0, math.inf, math.inf)
    assert (got["b"].closing_odds, got["b"].clv, got["b"].diff) == (4.0, -100.0, -math.inf)
    assert (got["c"].closing_odds, got["c"].clv, got["c"].diff) == (None, None, None)


def _set_sql(spark, sf, tmp_path, values):
    import duckdb

    from priorflow import queries as q

    rows = [(i, 0, f"{k}", v) for i, (k, v) in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts long, u string, value double").selectExpr("event_id", "cast(u as long) as user_id", "value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(q.SQL["set_model"])
    names = [d[0] for d in found.description]
    ours = {r.user_id: r.asDict() for r in q.QUERIES["set_model"](spark, str(tmp_path)).collect()}
    return ours, {r[0]: dict(zip(names, r)) for r in found.fetchall()}


def test_rates_above_one_as_in_the_sql(spark, sf, tmp_path):
    """set_model; events above 600 make a rate above 1."""
    ours, theirs = _set_sql(spark, sf, tmp_path, [(1, 650.0), (1, 30.0), (2, 40.0), (2, 10.0), (3, 700.0)])
    assert set(ours) == set(theirs)
    for k, row in theirs.items():
        for name, v in row.items():
            assert math.isclose(ours[k][name], v, rel_tol=1e-6, abs_tol=1e-6), (k, name)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_join_nothing_on_doubles(spark):
    """fact_lines; means worked out twice may differ in their last bits, and rows were lost."""
    from priorflow.plans import matches

    df = spark.createDataFrame([(1, 5.0, 3.0, 5.2), (2, 5.0, 3.0, 4.0), (3, 5.0, None, 4.0)], "k int, mean double, r double, lam double")
    own = matches.lines(df, "lam", "r", "mean")
    given = matches.lines(df.join(matches.with_grids(df.select("mean", "r").distinct(), "r", "mean"), ["mean", "r"]), "lam", "r", "mean", "grid")
    assert "Join" not in _plan(own)
    assert sorted(tuple(r) for r in own.select("k", "line", "p_negbin", "difficulty").collect()) == sorted(tuple(r) for r in given.select("k", "line", "p_negbin", "difficulty").collect())
    assert {r.k for r in own.collect()} == {1, 2}


def test_tails_once_for_each_distinct_row(spark):
    """independence_comparison, count_market; rows that are alike count with their number."""
    from priorflow.operators import selection

    rows = [("g", float(i % 7), 2.0 + i % 3) for i in range(300)] + [("h", 3.0, 4.0)] * 20
    df = spark.createDataFrame(rows, "g string, y double, lam double")
    out = selection.count_market(df, df, ["g"], "y", "lam")
    assert "_n" in _plan(out)
    got = {r.g: r for r in out.collect()}
    mine = [x for x in rows if x[0] == "g"]
    over = lambda lam, k: 1 - sum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(int(k) + 1))
    ps = [(over(lam, 3.0), float(y > 3.0)) for _, y, lam in mine]
    mean = sum(y for _, y, _ in mine) / 300
    assert got["g"].threshold == 3.0 and got["g"].n == 300 and got["h"].n == 20 and got["h"].var_actual == 0
    assert math.isclose(got["g"].brier_poisson, sum((p - h) ** 2 for p, h in ps) / 300, rel_tol=1e-9)
    assert math.isclose(got["g"].log_loss_poisson, sum(-(h * math.log(p) + (1 - h) * math.log(1 - p)) for p, h in ps) / 300, rel_tol=1e-9)
    assert math.isclose(got["g"].var_actual, sum((y - mean) ** 2 for _, y, _ in mine) / 300, rel_tol=1e-9) and math.isclose(got["g"].mean_actual, mean)
    t = spark.createDataFrame([(1.5, 2.0, 4.0), (1.5, 2.0, 4.0), (1.5, 2.0, 9.0), (3.0, 1.0, 2.0)], "la double, lb double, y double").withColumn("lt", F.col("la") + F.col("lb"))
    out = selection.independence_comparison(t, [], "la", "lb", "lt", "y", F.lit(3.0), F.lit(2.5), F.lit(6.0))
    assert "Join" not in _plan(out)
    assert all(r.n == 4 and 0 < r.brier_empirical < 1 for r in out.collect())
    again = selection.independence_comparison(t.unionAll(t), [], "la", "lb", "lt", "y", F.lit(3.0), F.lit(2.5), F.lit(6.0)).collect()
    twice = {r.line: r for r in again}
    assert all(twice[r.line].n == 8 and math.isclose(twice[r.line].brier_independent, r.brier_independent) for r in out.collect())


def test_a_section_is_worked_out_once(spark):
    """line_sections; each use of the lines split and cleaned the text again."""
    from priorflow.sources import readers

    text = F.concat(F.col("id").cast("string"), F.lit("\nAces\n6+\n1,85\nmais de 7,5\n2\nGames\n9+\n3"))
    out = spark.range(2).select(readers.plus_pairs(readers.section(readers.normal_lines(text), "Aces", ["Games"])).alias("p"))
    assert [[(p.display, p.odds) for p in r.p] for r in out.collect()] == [[("6+", 1.85), ("mais de 7,5", 2.0)]] * 2
    assert _plan(out).count("split(") == 1
    none = spark.range(1).select(readers.section(readers.normal_lines(F.lit("a\nb")), "c", ["b"]).alias("none"), readers.section(readers.normal_lines(F.lit("a\nb\nd")), "b", ["x"]).alias("rest")).first()
    assert none.none == [] and none.rest == ["d"]


def test_close_names_lose_none(spark):
    """identity_fuzzy, minted_players; lengths without a partner take no part, and no join of names is a broadcast."""
    import difflib
    import random

    from priorflow.operators import identity

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef 01") for _ in range(rng.randint(1, 30))).strip() or "x" for _ in range(120)]
    edit = lambda x: "".join(c for c in x if rng.random() > 0.06) + rng.choice(["", "q", "a"])
    asked = sorted({edit(x) or "y" for x in base} | {"z" * 60})
    known = sorted(set(base))
    a, b = spark.createDataFrame([("g", x) for x in asked], "g string, norm string"), spark.createDataFrame([("g", x) for x in known], "g string, close string")
    out = identity.close_candidates(a, b, "g", 0.87)
    got = {(r.norm, r.close) for r in out.collect()}
    close = {(x, y) for x in asked for y in known if x != y and difflib.SequenceMatcher(None, y, x).ratio() >= 0.87}
    assert len(close) > 30 and close <= got and len(got) < len(asked) * len(known) / 20
    hinted = out._jdf.queryExecution().analyzed().toString()
    assert hinted.count("strategy=merge") >= 2


def test_states_meet_no_window(spark):
    """future_profile; windows sorted rows that each held a whole state."""
    from priorflow.operators.carried import Carried
    from priorflow.operators.windows import DEFAULT_WINDOWS
    from priorflow.plans import matches

    rows = spark.createDataFrame([("a", 1, "t", "m", "W", "Hard", 2.0)], "player_id string, d int, tourney_id string, match_id string, result string, surface string, x double").withColumn("tournament_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    carried = Carried(matches.timeline(), ["x"], DEFAULT_WINDOWS)
    plan = _plan(carried.features(carried.summarize(rows), rows.withColumn("tournament_date", F.date_add("tournament_date", 9))))
    above = plan[: plan.index("Join")]
    assert "Window [" not in above


def test_parts_grow_with_rows(spark):
    """F8, F10: player_profile, match_chain; what a task sorts doesn't grow with the table."""
    from priorflow.plans import matches

    df = spark.range(10).select(F.col("id").cast("string").alias("player_id"))
    assert matches.dealt(df, 12 * matches.TASK_ROWS + 1, "player_id").rdd.getNumPartitions() == 13
    assert matches.dealt(df, 5, "player_id").rdd.getNumPartitions() == 4 and matches.dealt(df, None, "player_id") is df


def test_movement_of_null_and_signed_zero_prices(spark, sf, tmp_path):
    """odds_movement equals its SQL where prices are NULL, 0 or -0."""
    from compare import TABLES, assert_equal_rows

    from priorflow import queries as q

    prices = [[None, 2.0], [2.0, None], [4.0, -0.0], [-0.0, 4.0], [0.0, 3.0], [None], [5.0, 2.0]]
    rows = [(3 * user + i, user, "a", v) for user, values in enumerate(prices) for i, v in enumerate(values)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(event_id % 3 AS int))")
    e.withColumn("ts", ts).coalesce(1).write.parquet(str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("*.parquet")
    part.rename(tmp_path / "events.parquet")
    for name in set(TABLES) - {"events"}:  # the comparison opens every table
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    assert_equal_rows(q.QUERIES["odds_movement"](spark, str(tmp_path)), q.SQL["odds_movement"], str(tmp_path))


def test_outcomes_of_events_without_user(spark, sf, tmp_path):
    """streamed_outcomes; events of no user have the NULL key, as in the SQL."""
    from compare import TABLES, assert_equal_rows

    from priorflow import queries as q

    rows = [(i, None if i % 3 == 0 else i % 2, "ab"[i % 2], float(v)) for i, v in enumerate((300, 100, 220, 150, 260, 199, 251, 90, 210, 400, 10, 255))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("*.parquet")
    part.rename(tmp_path / "events.parquet")
    for name in set(TABLES) - {"events"}:  # the comparison opens every table
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    assert_equal_rows(q.QUERIES["streamed_outcomes"](spark, str(tmp_path)), q.SQL["streamed_outcomes"], str(tmp_path))


def test_outcomes_keep_state_over_many_batches(spark, tmp_path, monkeypatch):
    """states are native rows, written whole now and then; keys not met for long keep theirs."""
    from priorflow.streaming import outcomes

    monkeypatch.setattr(outcomes, "WHOLE", 2)
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "key string, load long, event long, settlement string"
    loads = [[("a", 0, 1, "WIN"), (None, 0, 1, None)], [("b", 1, 2, None)], [("b", 2, 3, "LOSS")], [("b", 3, 4, "WIN")], [("a", 4, 5, "LOSS"), (None, 4, 2, "VOID"), ("b", 2, 9, "WIN")]]
    for rows in loads:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        outcomes.follow_outcomes(spark.readStream.schema(schema).parquet(folder), sink, checkpoint).awaitTermination()
    got = {(r.key, r.event, r.change, r.previous) for r in outcomes.read_changes(spark, sink).collect()}
    assert got == {
        ("a", 1, "registered", None), ("a", 1, "settled", None), (None, 1, "registered", None), ("b", 2, "registered", None), ("b", 3, "settled", None),
        ("b", 4, "rejected", "LOSS"), ("a", 5, "rejected", "WIN"), (None, 2, "settled", None),
    }


def test_containment_by_byte_windows(spark):
    """passages_within; of a text only the windows looked for are kept, across bytes of 1 to 4 and texts in one batch."""
    from priorflow.operators import joins

    texts = [(1, "the naïve fox 😀 jumps over"), (2, "over the naïve fox 😀"), (3, "fox 😀 jumps over it"), (4, None), (5, ""), (6, "th"), (7, "the naïve fox 😀 jumps over")]
    parts = ["naïve fox 😀", "fox 😀 jumps over", "th", "", "😀", "jumps over the naïve", "x 😀 jum", "ver itt", None]
    left, right = spark.createDataFrame(texts, "i int, t string").coalesce(1), spark.createDataFrame([(p,) for p in parts], "p string")
    got = sorted((r.i, r.p) for r in joins.contains_join(left, right, [], "t", "p").collect())
    assert got == sorted((i, p) for i, t in texts for p in parts if t is not None and p is not None and p in t)
    named = left.filter("t IS NOT NULL").selectExpr("CAST(i AS long) AS a", "0L AS b", "t")
    wanted = spark.createDataFrame([(8, int.from_bytes("fox 😀".encode(), "big"))], "size int, gram long")
    kept = joins._windows(named, [], "t", [2, 8], joins._wanted_bits(wanted))
    assert sorted(r.a for r in kept.filter("size = 8").collect()) == [1, 2, 3, 7] and kept.count() < 10


def test_coder_adds_counts_late_and_alike():
    """op4_token_files: bins met are added up when they are needed, and images stay as they were, to the byte."""
    import zlib

    import numpy as np

    from priorflow.llm import id_coder

    k = np.arange(20_000, dtype=np.int64)
    ids = ((k * k // 7 + k // 3) % 997 * (k % 3 > 0)).astype("<u4")
    image = id_coder.encode(ids, 1000, 512)
    assert (id_coder.decode(image) == ids).all() and zlib.crc32(image) == 306382922
    model = id_coder._Model(1, id_coder._Ranks.of(ids, 1000))
    model.met = [np.array([0, 0, len(model.seen)])]
    before = model.seen.copy()
    model.count(64)
    assert (model.seen - before).tolist() == [32] + [0] * (len(before) - 1) and not model.met


def test_coder_looks_contexts_up_ahead(monkeypatch):
    """op4_token_files: the encoder looks contexts up for many ids at once, and finds what going id by id does."""
    import numpy as np

    from priorflow.llm import id_coder

    rng = np.random.default_rng(3)
    for slots, ranks in ((5, 2), (1024, 300), (1, 1)):
        slot, now = (rng.integers(0, n, (3, 400)).astype(np.int32) for n in (slots, ranks))
        now[0, :200] = 1 << 17
        got = id_coder._held(slot, now)
        for lane in range(3):
            packed = {}
            for s, rank, found in zip(slot[lane].tolist(), now[lane].tolist(), got[lane].tolist()):
                assert found == packed.get(s, -1)
                packed[s] = rank << 4 | (min((found & 15) + 1, 14) if found >> 4 == rank else 0)

    calls = []
    guess = id_coder._Model.guess
    monkeypatch.setattr(id_coder._Model, "guess", lambda self, *a: calls.append(1) or guess(self, *a))
    ids = (rng.pareto(0.7, 5000) * 3).clip(0, 999).astype("<u4")
    image = id_coder.encode(ids, 1000, 512)
    assert len(calls) == 512 // 64
    assert (id_coder.decode(image) == ids).all()


def test_coder_last_lane_ends_alone():
    """op4_token_files: a last lane that ends anywhere in its block leaves the others alone."""
    import numpy as np

    from priorflow.llm import id_coder

    ids = (np.random.default_rng(4).pareto(0.6, 700) * 4).clip(0, 4999).astype("<u4")
    for n in (*range(1, 140), 255, 256, 257, 511, 512, 513, 700):
        assert (id_coder.decode(id_coder.encode(ids[:n], 5000, 64)) == ids[:n]).all()
    for n in (257, 300, 511, 700):
        assert (id_coder.decode(id_coder.encode(ids[:n], 5000, 256)) == ids[:n]).all()


def _events_as(rows, spark, sf, tmp_path):
    """A folder of tables whose events are ``rows``."""
    from compare import TABLES

    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    e.coalesce(1).write.parquet(str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("*.parquet")
    part.rename(tmp_path / "events.parquet")
    for name in set(TABLES) - {"events"}:  # the comparison opens every table
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    return str(tmp_path)


def test_closing_values_of_null_prices_and_halves(spark, sf, tmp_path):
    """Round 4, F2: closing_values equals its SQL where prices are NULL, and where a product ends in a half by its last bit."""
    from compare import assert_equal_rows

    from priorflow import queries as q

    prices = [[2.0, None], [None, 2.0], [None], [4.0, 3.0, None], [183.69, 160.0], [202.03, 160.0], [202.73, 160.0], [205.81, 160.0], [1e300, 1e-8]]
    rows = [(9 * user + i, user, "a", v) for user, values in enumerate(prices) for i, v in enumerate(values)]
    assert_equal_rows(q.QUERIES["closing_values"](spark, folder := _events_as(rows, spark, sf, tmp_path)), q.SQL["closing_values"], folder)


def test_rounding_by_scale(spark):
    """Round 4, F2: signs of zero, infinite values and what can't be scaled stay."""
    values = [-0.00001, 0.00005, -0.00005, 14.80625, math.inf, -math.inf, 1e306, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(num.round_scaled(F.col("x"), 4)).collect()]
    assert got == [-0.0, 0.0001, -0.0001, 14.8063, math.inf, -math.inf, 1e306, None] and math.copysign(1, got[0]) == -1


def test_chain_sends_what_opponents_need(spark):
    """Round 4, F3: match_chain; with a number of rows, facts are shuffled once, and only what is used goes to opponents."""
    from test_pipeline import COLUMNS, raw_matches

    from priorflow.plans import matches

    rows = raw_matches()
    facts = matches.player_matches(spark.createDataFrame(rows, COLUMNS), "ATP").localCheckpoint()
    facts = facts.unionAll(facts.filter("match_id = 'ATP:T1:9' AND result = 'L'").withColumns({"match_id": F.lit("lone"), "opponent_id": F.lit("ATP-9")}))
    wide, sent = matches.chain(facts), matches.chain(facts, rows=80)
    assert sorted(wide.columns) == sorted(sent.columns)
    key = lambda r: (r.match_id, r.player_id)
    want, got = ({key(r): r.asDict() for r in df.collect()} for df in (wide, sent))
    assert len(want) == 81 and set(want) == set(got)
    for k, row in want.items():
        for c, v in row.items():
            assert math.isclose(got[k][c], v, rel_tol=1e-9, abs_tol=1e-12) if isinstance(v, float) else got[k][c] == v, (k, c)


def test_chain_shuffles_facts_once(spark, sf):
    """Round 4, F3: match_chain; both sides of the meeting read one shuffle of facts, and nothing else goes to opponents."""
    from priorflow import queries as q

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = q.QUERIES["match_chain"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    by_player = [x for x in plan.splitlines() if "Exchange hashpartitioning(player_id" in x]
    assert len(by_player) == 3 and sum("ReusedExchange" in x for x in by_player) == 1
    assert "_pair_a" not in plan and "second_serves_in" not in plan


def test_match_delivered_twice_is_seen_once(spark):
    """Round 4, F3: match_chain; rows don't multiply, and the least row is seen."""
    from priorflow.operators import joins

    rows = [("m", "a", "b", "W", 1, 0.1), ("m", "b", "a", "L", 1, 0.2), ("m", "b", "a", "L", 2, 0.3), ("n", "a", "b", "W", 2, None), ("n", "b", "a", "W", 3, 0.4), (None, "a", "b", "W", 3, 0.5)]
    df = spark.createDataFrame(rows, "m string, me string, you string, side string, nth long, x double").repartition(3, "me")
    out = joins.opponent_sent(df, ["m"], "me", "you", "side", ["x"], "nth", 3, "_o_")
    assert sorted((str(r.m), r.me, r.nth, r._o_x) for r in out.collect()) == [("None", "a", 3, None), ("m", "a", 1, 0.2), ("m", "b", 1, 0.1), ("m", "b", 2, 0.1), ("n", "a", 2, None), ("n", "b", 3, None)]


def test_counted_names_lose_none(monkeypatch):
    """Round 4, F1: identity_fuzzy; counting by gram and place finds every pair that is close, over several indexes and letters of one side only."""
    import difflib
    import random

    import numpy as np

    from priorflow.operators import identity

    monkeypatch.setattr(identity, "INDEX", 50)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdef 01é") for _ in range(rng.randint(1, 40))).strip() or "x" for _ in range(150)] + ["player " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(100)]
    edit = lambda x: "".join(c for c in x if rng.random() > 0.08) + rng.choice(["", "q", "a"])
    asked, known = np.array(sorted({edit(x) or "y" for x in base} | {"z" * 60})), np.array(sorted(set(base)))
    for cutoff in (0.87, 0.95):
        i, j = identity.count_met(asked, known, cutoff)
        got = set(zip(asked[i].tolist(), known[j].tolist()))
        close = {(x, y) for x in asked.tolist() for y in known.tolist() if x != y and difflib.SequenceMatcher(None, y, x).ratio() >= cutoff}
        assert len(close) > 60 and close <= got and len(got) < len(asked) * len(known) / 50
    assert all(len(x) == 0 for x in identity.count_met(asked, np.empty(0, "<U1"), 0.87))


def test_names_that_meet_many_are_counted(spark, monkeypatch):
    """Round 4, F1: identity_fuzzy; such names make no row for each name that has one of their grams, and find the same."""
    from priorflow.operators import identity

    names = spark.range(300).select(F.when(F.col("id") % 3 == 0, "g").otherwise("h").alias("g"), F.concat(F.lit("player "), F.sha1(F.col("id").cast("string"))).alias("close"))
    asked = names.select("g", F.regexp_replace("close", ".$", "z").alias("norm"))
    asked = asked.unionAll(spark.createDataFrame([("none", "player x"), ("g", "ab")], "g string, norm string"))
    joined = [tuple(r) for r in identity.close_candidates(asked, names, "g", 0.87).collect()]
    for name, n in (("HEAVY", 0), ("ASKED", 40), ("KNOWN", 70)):
        monkeypatch.setattr(identity, name, n)
    counted = identity.close_candidates(asked, names, "g", 0.87, crowded=True)
    assert "FlatMapCoGroupsInArrow" in counted._jdf.queryExecution().optimizedPlan().toString()
    wanted = {(r.g, r.norm, r.close) for r in names.select("g", F.regexp_replace("close", ".$", "z").alias("norm"), "close").collect()}
    assert wanted <= set(joined) and sorted(tuple(r) for r in counted.collect()) == sorted(wanted)
