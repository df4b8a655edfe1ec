"""Carried states against full recomputes, the match chain's plan, long curves, calibration of all folds."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorflow.operators import windows as win
from priorflow.operators.carried import Carried, CarriedStore
from priorflow.plans import calibrate, matches
from priorflow.sources.manifest import CommitConflict, Manifest
from test_pipeline import COLUMNS, raw_matches

SCHEMA = "e string, d date, s int, g string, x double, y double"


def rows_by_day(seed, n=400):
    rng = random.Random(seed)
    day = dt.date(2022, 1, 1)
    rows = []
    for i in range(n):
        day += dt.timedelta(days=rng.choice([0, 0, 1, 2, 9]))
        rows.append((rng.choice("abcdefg") if i % 3 else "hot", day, i, rng.choice(["u", "v", None]), rng.choice([None, 1.5, -2.0, 3.0]), float(rng.randint(0, 5))))
    return rows


def windows():
    return [*win.DEFAULT_WINDOWS, win.Prior("last3", "last_n", 3), win.Prior("days7", "days", 7), win.Prior("decay10", "decay", 10)]


@pytest.mark.parametrize("cuts", [(100, 101, 250), (0, 200, 390)])
def test_states_equal_a_full_recompute(spark, tmp_path, cuts):
    rows, t = rows_by_day(sum(cuts)), win.Timeline(["e"], "d", ["s"], "g")
    carried = Carried(t, ["x", "y"], windows())
    store = CarriedStore(spark, str(tmp_path / "states"), carried, buckets=4)
    for a, b in zip((0, *cuts), cuts):
        store.advance(spark.createDataFrame(rows[a:b], SCHEMA))
    coming = rows[cuts[-1] :] + [("new", dt.date(2030, 1, 1), 999, "u", 1.0, 2.0)]
    got = store.answer(spark.createDataFrame(coming, SCHEMA), {"ratio": ("x", "y")})
    full = t.rates(t.sums(spark.createDataFrame(rows[: cuts[-1]] + coming, SCHEMA), ["x", "y"], windows()), {"ratio": ("x", "y")}, windows())
    want = {r.s: r.asDict() for r in full.filter(F.col("s") >= rows[cuts[-1]][2]).collect()}
    got = {r.s: r.asDict() for r in got.collect()}
    assert got.keys() == want.keys()
    for s, r in want.items():
        for name, v in r.items():
            assert got[s][name] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (s, name)


def test_states_read_touched_buckets_only(spark, tmp_path):
    rows, t = rows_by_day(9), win.Timeline(["e"], "d", ["s"], "g")
    store = CarriedStore(spark, str(tmp_path / "states"), Carried(t, ["x"], win.DEFAULT_WINDOWS), buckets=32)
    store.advance(spark.createDataFrame(rows, SCHEMA))
    _, entries = store.manifest.read()
    one = spark.createDataFrame([("a", dt.date(2030, 1, 1), 1000, "u", None, None)], SCHEMA)
    assert len(store.state(entries, store._touched(one)).inputFiles()) < len(store.state(entries).inputFiles())
    before = {e["bucket"]: e["path"] for e in entries}
    store.advance(one)
    after = {e["bucket"]: e["path"] for e in store.manifest.read()[1]}
    assert sum(before[b] != after[b] for b in before) == 1
    with pytest.raises(Exception, match="before the state's end"):
        store.answer(spark.createDataFrame([("a", dt.date(2020, 1, 1), 0, "u", 1.0, 1.0)], SCHEMA)).collect()
    with pytest.raises(Exception, match="before the state's end"):
        store.advance(spark.createDataFrame([("a", dt.date(2020, 1, 1), 0, "u", 1.0, 1.0)], SCHEMA))


def test_two_writers_meet_in_the_manifest(spark, tmp_path):
    a, b = Manifest(spark, str(tmp_path / "m")), Manifest(spark, str(tmp_path / "m"))
    assert a.read() == (0, []) and a.commit(0, [{"k": "é"}]) == 1
    with pytest.raises(CommitConflict):
        b.commit(0, [])
    assert b.read() == (1, [{"k": "é"}])


def test_chain_shuffles(spark):
    """By player, by match, by player again; nothing is joined with itself."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = matches.chain(matches.player_matches(spark.createDataFrame(raw_matches(), COLUMNS), "ATP"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan


def test_diagnostics(spark, tmp_path):
    rows = raw_matches(10)
    rows[3] = rows[3][:15] + (None,) + rows[3][16:]
    rows.append(rows[0])
    got = matches.write_player_matches(spark.createDataFrame(rows, COLUMNS), "ATP", str(tmp_path / "facts"))
    assert (got["n_raw_matches"], got["n_matches_missing_player_id"], got["n_matches_used"], got["n_player_match_rows"], got["rows_match_expected"], got["n_duplicate_match_ids"]) == (11, 1, 10, 20, 1, 2)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_long_curves(spark, by):
    rng = random.Random(len(by))
    rows = [(i, rng.choice("ab"), -1.0 if i in range(100, 300) else rng.choice([-1.0, 2.0, 0.0, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, g string, pnl double")
    got = {r.k: r for r in win.long_equity_curve(df, "pnl", ["k"], by, parts=16).collect()}
    state = {}
    for k, g, pnl in rows:
        total, peak, streak = state.get(g if by else 0, (0.0, -np.inf, 0))
        total += pnl or 0.0
        peak, streak = max(peak, total), streak + 1 if pnl is not None and pnl < 0 else 0
        state[g if by else 0] = (total, peak, streak)
        assert (got[k].cumulative, got[k].peak, got[k].drawdown, got[k].loss_streak) == (total, peak, total - peak, streak)
    assert win.long_equity_curve(df.limit(0), "pnl", ["k"], by).count() == 0


def test_walk_forward_equals_single_fits(spark):
    rng = np.random.default_rng(8)
    rows = [(f"f{i % 4}", float(p), int(rng.random() < p**1.5)) for i, p in enumerate(rng.uniform(0.02, 0.98, 4000).round(3))] + [("f1", None, 1), ("f2", 0.5, None), ("f9", 0.5, 1)]
    df = spark.createDataFrame(rows, "fold string, p double, y int")
    folds = ["f0", "f1", "f2", "f3"]
    out = calibrate.walk_forward(df, folds)
    assert out.count() == 4002
    for k, f in enumerate(folds):
        own = out.filter(F.col("fold") == f)
        if not k:
            assert own.filter("p_platt <> p OR p_isotonic <> p OR status_platt <> 'raw_sem_periodo_anterior'").count() == 0
            continue
        train = df.filter(F.col("fold").isin(*folds[:k]))
        single = own
        for m in ("platt", "isotonic"):
            single = single.withColumn(f"one_{m}", calibrate.fit_calibrator(train, m).apply(F.col("p")))
        worst = single.agg(F.max(F.abs(F.col("p_platt") - F.col("one_platt"))), F.max(F.abs(F.col("p_isotonic") - F.col("one_isotonic")))).first()
        assert worst[0] < 1e-5 and worst[1] < 1e-9
    few = calibrate.walk_forward(df, folds, min_n=1500)
    assert {r[0] for r in few.filter("fold = 'f1'").select("status_platt").distinct().collect()} == {"raw_amostra_insuficiente (n=1000)"}
