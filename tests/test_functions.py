import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorflow.functions import distributions as dist
from priorflow.functions import numeric as num
from priorflow.functions import scores, setmodel, text
from priorflow.sources import readers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "raw,status,complete,sets,games,partial",
    [
        ("6-4 6-3", "completed", True, (2, 0), 19, False),
        ("7-6(4) 6-4", "completed", True, (2, 0), 23, False),
        ("W/O", "walkover", False, (0, 0), None, False),
        ("4-6 6-3 2-1 RET", "retired", False, (1, 1), 19, True),
        ("7-6(0) 0-2 RET+H61", "retired", False, (1, 0), 13, True),
        ("6-5 Def.", "defaulted", False, (0, 0), 0, True),
        ("3-6 7-6(4) [10-2]", "completed", True, (2, 1), 22, False),
        ("6-2 5-7 [0-1]", "completed", False, (1, 1), 20, True),
        (None, "missing", False, (0, 0), None, False),
        ("garbage text", "unparseable", False, (0, 0), None, False),
    ],
)
def test_scores(spark, raw, status, complete, sets, games, partial):
    s = one(spark, scores.parse_score(F.lit(raw).cast("string")).alias("s")).s
    assert (s.status, s.complete, (s.sets_won_winner, s.sets_won_loser), s.total_games, s.has_partial_trailing_set) == (status, complete, sets, games, partial)


def _pmf(k, lam, r):
    if r is None:
        return math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1))
    return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + lam)) + k * math.log(lam / (r + lam)))


@pytest.mark.parametrize("lam,r", [(0.3, None), (5.0, None), (5.0, 3.0), (30.0, 0.7), (900.0, None)])
def test_tails_and_quantiles(spark, lam, r):
    rr = F.lit(r).cast("double")
    line = math.floor(lam) + 0.5
    row = one(spark, dist.over_probability(F.lit(lam), rr, F.lit(line)).alias("p"), dist.quantile(F.lit(lam), rr, 0.99).alias("q"), dist.line_grid(F.lit(lam), rr).alias("g"))
    assert row.p == pytest.approx(1 - sum(_pmf(k, lam, r) for k in range(int(line) + 1)), abs=1e-9)
    total, k = _pmf(0, lam, r), 0
    while total < 0.99:
        k += 1
        total += _pmf(k, lam, r)
    assert row.q == k and len(row.g) <= 14 and all(x % 1 == 0.5 for x in row.g)


def test_prices(spark):
    row = one(spark, num.fair_odds(F.lit(0.5)).alias("a"), num.fair_odds(F.lit(1.0)).alias("b"), num.minimum_odds(F.lit(0.65), 0.1).alias("c"), num.implied_probability(F.lit(1.0)).alias("d"), num.edge_status(F.lit(0.6), F.lit(1.9)).alias("e"), num.edge_status(F.lit(0.6), F.lit(1.2)).alias("f"))
    assert (row.a, row.b, row.d, row.e, row.f) == (2.0, None, None, "ATINGE_EDGE_5", "ABAIXO_DO_LIMITE") and row.c == pytest.approx(1 / 0.55)


def test_buckets(spark):
    row = one(spark, *[num.probability_bucket(F.lit(p)).alias(n) for n, p in (("a", 0.2), ("b", 0.1999), ("c", 0.9), ("d", 1.0))], num.equal_bin(F.lit(1.0)).alias("e"), num.equal_bin_right(F.lit(0.1)).alias("f"), num.ranking_bucket(F.lit(0)).alias("g"))
    assert tuple(row) == ("20-30%", "<20%", "90%+", "90%+", 9, 0, None)


def test_names(spark):
    row = one(spark, text.normalize_name(F.lit("  José Ñuñez-O'Neil  3")).alias("a"), text.normalize_name(F.lit(None).cast("string")).alias("b"), text.slug(F.lit("Roland Garros (é)")).alias("c"), text.minted_id(F.lit("!!")).alias("d"), text.plus_display(F.lit("6+")).alias("e"), text.total_display(F.lit("mais de 22,5")).alias("f"), text.plus_display(F.lit("0+")).alias("g"))
    assert (row.a, row.b, row.c, row.d, row.e.line, row.f.line, row.f.side, row.g) == ("jose nunez o neil 3", "", "roland-garros-e", "NEW-UNKNOWN", 5.5, 22.5, "Over", None)


def test_zone(spark):
    row = one(spark, text.to_zone(F.lit("2026-09-23 14:00:00").cast("timestamp"), F.lit("Asia/Shanghai"), "America/Sao_Paulo").alias("z"))
    assert (row.z.utc.hour, row.z.shown.hour) == (6, 3)


def test_set_model_against_walk(spark):
    def walk(pa, pb, a=0, b=0):
        if max(a, b) >= 6 and abs(a - b) >= 2:
            return np.array([a > b, a, b, 0.0])
        if (a, b) == (6, 6):
            w = pa / (pa + pb)
            return np.array([w, 6 + w, 7 - w, 1.0])
        p = pa if (a + b) % 2 == 0 else 1 - pb
        return p * walk(pa, pb, a + 1, b) + (1 - p) * walk(pa, pb, a, b + 1)

    pairs = [(0.8, 0.7), (0.5, 0.5), (0.95, 0.6), (1.0, 0.4), (0.0, 0.3), (None, 0.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs * 2)], "k int, a double, b double")
    got = setmodel.with_set(df, "a", "b").collect()
    assert len(got) == 12
    for r in got:
        if r.a is None:
            assert r.set is None
        else:
            inside = 0 < r.a < 1 and 0 < r.b < 1
            held = (r.a, r.b) if inside else tuple(min(max(p, 1e-6), 1 - 1e-6) for p in (r.a, r.b))
            assert np.allclose([r.set.p_set, r.set.games_a, r.set.games_b, r.set.p_tiebreak], walk(*held))
    plan = setmodel.with_set(df, "a", "b")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_extraction(spark):
    html = "<script>var rows = [['a', 1, 'x y'], ['b', 2, 'z']];</script>"
    row = one(spark, F.transform(readers.script_rows(F.lit(html), "rows"), readers.quoted_fields).alias("r"))
    assert row.r == [["a", "1", "x y"], ["b", "2", "z"]]
    lines = readers.normal_lines(F.lit("Head\n\n Aces \n6+\n1,85\n7+\n 2.10\nGames\n x"))
    row = one(spark, readers.plus_pairs(readers.section(lines, "Aces", ["Games"])).alias("p"))
    assert [(p.display, p.odds) for p in row.p] == [("6+", 1.85), ("7+", 2.1)]
    answer = '```json\n[{"market":"aces","player":"P","bookmaker_display":"6+","decimal_odds":1.9},{"market":"aces"},{"market":"other","bookmaker_display":"1+","decimal_odds":2}]\n```'
    row = one(spark, readers.model_readings(F.lit(answer), ["aces"]).alias("r"))
    assert len(row.r) == 1 and row.r[0].decimal_odds == 1.9


def test_fuzzy_level_is_ratcliff(spark):
    from priorflow.operators import identity

    players = spark.createDataFrame([("g", 1, "Jelena Ostapenko"), ("g", 2, "Karolina Muchova"), ("g", 3, "Karolina Pliskova"), ("g", 4, "Kristyna Pliskova")], "g string, id long, name string")
    asked = spark.createDataFrame([("g", n) for n in ("Jelena Ostapenco", "J. Ostapenko", "K Pliskova", "KAROLINA MUCHOVA", "Nobody Known", "")], "g string, asked string")
    got = {r.asked: (r.resolved_id, r.method) for r in identity.resolve_names(asked, players, "g", "asked", "id", "name").collect()}
    assert difflib.SequenceMatcher(None, "jelena ostapenco", "jelena ostapenko").ratio() >= 0.87
    assert got == {"Jelena Ostapenco": (1, "fuzzy_review"), "J. Ostapenko": (1, "alias"), "K Pliskova": (None, "unresolved"), "KAROLINA MUCHOVA": (2, "exact"), "Nobody Known": (None, "unresolved"), "": (None, "unresolved")}


def test_close_candidates_lose_nothing(spark):
    """Every pair that difflib finds similar enough is a candidate, for names of all lengths."""
    import random

    from priorflow.operators import identity

    rng = random.Random(5)
    names = {"".join(rng.choice("abcde ") for _ in range(rng.randint(2, 34))).strip() or "x" for _ in range(150)}
    names |= {n[:k] + rng.choice("abcxyz") + n[k + rng.randint(0, 1) :] for n in list(names) for k in [rng.randrange(len(n))]}
    names = sorted(names)
    want = {(a, b) for a in names for b in names if difflib.SequenceMatcher(None, b, a).ratio() >= identity.CUTOFF}
    left = spark.createDataFrame([("g", n) for n in names], "g string, norm string")
    got = {(r.norm, r.close) for r in identity.close_candidates(left, left.withColumnRenamed("norm", "close"), "g", identity.CUTOFF).collect()}
    assert want - {(n, n) for n in names} <= got and len(got) < len(names) ** 2 / 4
