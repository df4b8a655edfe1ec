"""Ledgers with filters, streamed outcomes, containment and wide differences against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from priorflow.operators import joins
from priorflow.sources.manifest import CommitConflict
from priorflow.streaming.indexed import IndexedLedger
from priorflow.streaming.outcomes import follow_outcomes, read_changes


def test_filters_decide_what_is_opened(spark, tmp_path):
    schema = "k string, day int, at int, v double"
    df = lambda rows: spark.createDataFrame(rows, schema)
    probe = df([]).schema
    ledger = IndexedLedger(spark, str(tmp_path / "ledger"), probe, ["k", "day"], ["at"], buckets=8)
    first = [(f"k{i}", i % 3, i, float(i)) for i in range(200)] + [(None, 1, 0, 1.0), (None, None, 0, 2.0), ("k0", 0, -1, -5.0)]
    assert ledger.append(df(first)) == 202 and ledger.opened == []
    fresh = [(f"new{i}", 0, i, 0.0) for i in range(20)]
    assert ledger.append(df(fresh)) == 20 and len(ledger.opened) <= 2  # filters let few new keys through
    assert ledger.append(df(first)) == 0 and {run for run, _ in ledger.opened} >= {ledger.manifest.read()[1][0]["run"]}
    assert ledger.append(df([("k7", 1, 999, 0.0), (None, 1, 9, 0.0), ("k7", None, 0, 3.0)])) == 1 and 1 <= len(ledger.opened) <= 4
    rows = {(r.k, r.day): r.v for r in ledger.read().collect()}
    assert len(rows) == ledger.read().count() == 223 and rows["k0", 0] == -5.0 and rows["k7", None] == 3.0 and rows[None, 1] == 1.0
    assert ledger.append(df([])) == 0


def test_the_later_writer_plans_anew(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "k int, at int").schema
    a, b = (IndexedLedger(spark, str(tmp_path / "ledger"), schema, ["k"], ["at"], buckets=2) for _ in range(2))
    commit, times = a.manifest.commit, []

    def late(after, entries):
        if not times:  # the other writer commits in between
            b.append(spark.createDataFrame([(1, 0), (2, 0)], schema))
        times.append(after)
        return commit(after, entries)

    monkeypatch.setattr(a.manifest, "commit", late)
    assert a.append(spark.createDataFrame([(2, 5), (3, 5)], schema)) == 1 and times == [0, 1]
    assert sorted((r.k, r.at) for r in a.read().collect()) == [(1, 0), (2, 0), (3, 5)]
    monkeypatch.setattr(a.manifest, "commit", lambda *_: (_ for _ in ()).throw(CommitConflict("again")))
    with pytest.raises(CommitConflict):
        a.append(spark.createDataFrame([(9, 5)], schema), retries=1)


def test_outcomes_over_loads(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "key string, load long, event long, settlement string"
    loads = [
        [("a", 0, 2, None), ("a", 0, 1, "PENDING"), ("b", 0, 3, "WIN")],
        [("a", 1, 4, "LOSS"), ("a", 1, 5, "WIN"), ("b", 1, 6, "WIN"), ("c", 1, 7, None)],
        [("a", 0, 2, None), ("a", 0, 1, "WIN"), ("b", 0, 3, "LOSS")],  # the first load again, and other outcomes
        [("a", 2, 8, "WIN"), ("c", 2, 9, "VOID")],
    ]
    for rows in loads:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        follow_outcomes(spark.readStream.schema(schema).parquet(folder), sink, checkpoint).awaitTermination()
    got = sorted((r.key, r.event, r.change, r.settlement, r.previous) for r in read_changes(spark, sink).collect())
    assert got == [
        ("a", 1, "registered", "PENDING", None), ("a", 4, "settled", "LOSS", None), ("a", 5, "rejected", "WIN", "LOSS"), ("a", 8, "rejected", "WIN", "LOSS"),
        ("b", 3, "registered", "WIN", None), ("b", 3, "settled", "WIN", None), ("c", 7, "registered", None, None), ("c", 9, "settled", "VOID", None),
    ]


def test_containment_brute(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    texts = [(i, rng.choice(["x", "y", None]), rng.choice([word(12), word(3), "", None, "abab"])) for i in range(80)]
    parts = [(100 + i, rng.choice(["x", "y", None]), rng.choice([word(1), word(2), word(3), word(4), "", None])) for i in range(60)]
    left, right = spark.createDataFrame(texts, "i int, g string, t string"), spark.createDataFrame(parts, "j int, h string, p string")
    got = joins.contains_join(left, right, [("g", "h")], "t", "p")
    want = sorted((i, j) for i, g, t in texts for j, h, p in parts if g is not None and g == h and t is not None and p is not None and p in t)
    assert sorted((r.i, r.j) for r in got.collect()) == want and got.columns == ["i", "g", "t", "j", "h", "p"]
    assert joins.contains_join(left, right.limit(0), [("g", "h")], "t", "p").count() == 0


def test_wide_differences(spark):
    rng = random.Random(6)
    row = lambda k: (k, rng.choice([1.0, 1.0 + 1e-12, 2.0, None]), rng.choice(["u", "v", None]), "w" * 50)
    schema = "k int, n double, s string, wide string"
    a, b = spark.createDataFrame([row(k) for k in range(0, 200)], schema), spark.createDataFrame([row(k) for k in range(50, 250)], schema)
    got = {r.k: r for r in joins.diff_digests(a, b, ["k"], ["n"], ["s", "wide"]).collect()}
    want = {r.k: r for r in joins.diff_full_outer(a, b, ["k"], ["n"], ["s", "wide"]).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k].presence, got[k].changed) == (r.presence, r.changed)
        if r.changed:
            assert (got[k].before and got[k].before.n, got[k].after and got[k].after.s) == (r.n_before, r.s_after)
            if r.presence == "both":
                assert set(got[k].differing) == {c for c, differs in (("n", r.n_before is not None and r.n_after is not None and abs(r.n_before - r.n_after) > 1e-9), ("s", r.s_before != r.s_after)) if differs}
