"""Licence scan, decontamination, line dedup, sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import assert_equal_rows
from conftest_docs import words
from priorflow.llm import decontam, license_scan, line_dedup, queries, sharding
from priorflow.sources.manifest import CommitConflict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert_equal_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_agree(text):
    assert [w.decode() for w in decontam.normal_words(text)] == split_words(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=30), st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=6), max_size=4), st.sampled_from([40, 1 << 20]))
def test_scanner_against_windows(doc, items, limit):
    size = 3
    scanner = decontam.Scanner([(i, " ".join(x)) for i, x in enumerate(items)], size, limit)
    hit, found = set(), set()
    for i, item in enumerate(items):
        for k in range(max(1, len(item) - size + 1)) if item else ():
            w = item[k : k + size]
            for at in range(len(doc) - len(w) + 1):
                if doc[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    found.add(i)
    n, n_hit, ids, spans = scanner.scan("  ".join(doc))
    assert (n, n_hit, ids) == (len(doc), len(hit), sorted(found))
    assert sum(len(split_words("  ".join(doc)[a:b])) for a, b in spans) == n_hit


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "straße É x"), (4, "null id")], "item_id long, text string")
    out = decontam.benchmark_hits(odd, bench)
    assert out.columns[-1] == "hits_" and out.count() == odd.count()
    rows = {r.doc_id: r for r in out.select("doc_id", "hits_.*").collect() if r.doc_id is not None or r.n_words}
    assert rows[None].n_hit == 2 and rows[1].n_words == 0
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert out.schema.names[:-1] == odd.columns


def test_benchmarks_beyond_the_bound(spark, odd):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    with pytest.raises(ValueError, match="bytes of benchmark items"):
        decontam.benchmark_hits(odd, bench, max_text_bytes=10)


def test_license_base_and_fuzzy(spark, odd, none):
    f = license_scan.Finder()
    row = f.scan("X. MIT License MIT license! cc-by Apache Licence")
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"], row["score"]) == (3, 1, 5, ["cc-by", "mit"], 1.0)
    text = "Zz. Relased under the MIT-Licence, ok"
    row = f.scan(text)
    assert row["labels"] == ["mit"] and row["n_base"] == 0 and 0 < row["score"] < 1
    span = row["matches"][0]
    assert text[span["start"] : span["end"]] == "Relased under the MIT-Licence"
    assert f.scan(None)["n_words"] == 0 and f.scan("mozilla pablic")["labels"] == []
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(none).count() == 0


def test_license_neighbours():
    """A worse notice just before or after a better one is found too."""
    f = license_scan.Finder()
    worse, better = "the mozila public licence", "the mozilla public license"
    for text in (f"{worse} or {better} now", f"{better} or {worse} now", f"{worse} or {better} or {worse} now"):
        want = [(text.index("mozil", m.start()), m.group()[4:]) for m in re.finditer(f"{worse}|{better}", text)]
        got = [(m["start"], text[m["start"] : m["end"]]) for m in f.scan(text)["matches"] if m["label"] == "mpl"]
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_seeds_lose_no_match(data):
    """Every text within the edits of a notice is found: some piece stays whole."""
    f = license_scan.Finder()
    phrase = data.draw(st.sampled_from(sorted(license_scan.NOTICES)))
    k = max(1, len(phrase) // f.per_edit)
    chars = list(phrase)
    for _ in range(data.draw(st.integers(0, k))):
        i = data.draw(st.integers(1, len(chars) - 2))
        if chars[i] != " ":
            chars[i] = "q"
    edited = "".join(chars)
    f._build()
    assert any(f.fuzzy[i][0] == phrase for i, *_ in f.find_fuzzy(f" xx {edited} yy "))


def brute_lines(rows, min_length=20, min_docs=3):
    keys = [[ln.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for ln in (t or "").split("\n")] for _, t in rows]
    docs, top = Counter(), defaultdict(lambda: -(1 << 62))
    for (i, _), ks in zip(rows, keys):
        for k in set(ks):
            docs[k] += 1
            top[k] = max(top[k], -(1 << 62) if i is None else i)
    out = []
    for (i, t), ks in zip(rows, keys):
        stay = [ln for ln, k in zip((t or "").split("\n"), ks) if len(k) < min_length or docs[k] < min_docs or top[k] == (-(1 << 62) if i is None else i)]
        out.append((i, len(ks), len(ks) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_line_dedup_brute(spark, odd, none):
    long = "this line is long enough to count "
    rows = [(i, f"{long}{i % 3}\nshort\n \t{long.upper()}\x0b\n{long}{i % 7}é") for i in range(30)] + [(5, long), (None, f"{long}\n\n"), (40, None), (41, ""), (42, "\n"), (43, long + "\n" + long), (43, long + "\n" + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == brute_lines(rows)
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns[-2:] == ["n_lines_", "n_dropped"]
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_store_levels(spark):
    store = line_dedup.LineStore(spark, fan_out=2)
    for b in range(5):
        run = store.add(spark.createDataFrame([(k, 0, 10 * b) for k in range(b, b + 3)], "h1 long, h2 long, id long"))
        assert {r.h1 for r in run.filter("is_new").collect()} == ({0, 1, 2} if b == 0 else {b + 2})
    assert [len(level) for level in store.levels] == [1, 0, 1]
    merged = store.merged()
    assert {(r.h1, r.n_docs, r.max_id) for r in merged.collect()} == {(k, min(k + 1, 3, 7 - k), 10 * min(k, 4)) for k in range(7)}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("priorflow_line_run")]


def test_line_store_opened_again(spark, tmp_path):
    """Batches of later jobs meet the runs of earlier ones, through levels, and the texts know all lines."""
    schema, path = "h1 long, h2 long, id long", str(tmp_path / "store")
    want = Counter()
    for job in range(6):
        store = line_dedup.LineStore(spark, fan_out=2, buckets=3 if job == 0 else None, path=path)
        assert store.buckets == 3
        run = store.add(spark.createDataFrame([(k, 0, job) for k in range(job, job + 4)], schema))
        assert {r.h1 for r in run.filter("is_new").collect()} == {k for k in range(job, job + 4) if not want[k]}
        want.update(range(job, job + 4))
        store.close()
    again = line_dedup.LineStore(spark, fan_out=2, path=path)
    assert [len(level) for level in again.levels] == [0, 1, 1] and {r.h1: r.n_docs for r in again.merged().collect()} == want
    assert "Exchange hashpartitioning" not in again.merged()._jdf.queryExecution().executedPlan().toString()
    other = line_dedup.LineStore(spark, fan_out=2, path=path)
    again.add(spark.createDataFrame([(99, 0, 1)], schema))
    with pytest.raises(CommitConflict):
        other.add(spark.createDataFrame([(98, 0, 1)], schema))

    line, days = "a line that is long enough to count", str(tmp_path / "days")
    rows = lambda a, b: spark.createDataFrame([(i, f"{line}\nown text number {i} of all the days") for i in range(a, b)], "doc_id long, text string")
    first = line_dedup.dedup_lines(rows(0, 2), store=line_dedup.LineStore(spark, 4, 2, days)).collect()
    second = line_dedup.dedup_lines(rows(2, 5), store=line_dedup.LineStore(spark, 4, 2, days)).collect()
    assert {r.n_dropped for r in first} == {0} and {r.doc_id: r.n_dropped for r in second} == {2: 1, 3: 1, 4: 0}


def test_hot_lines(spark):
    """A line of all documents is dealt to several tasks; long lists of lost lines are looked through in parts."""
    line = "a line that every document holds"
    rows = [(i, f"{line}\nown text of document {i:09d}") for i in range(300)] + [(300 + i, "\n".join([f"shared line number {k:05d} of many" for k in range(400)] + [f"own {i} line of twenty"] )) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df, part_docs=40).collect())
    assert got == sorted(brute_lines(rows))


def test_sharding(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_records(docs).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    loads = Counter()
    for r in rows:
        assert r.size == len(text[r.id]) + 1 and r.text_crc32 == zlib.crc32(text[r.id])
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    strange = sharding.shard_records(odd, 3, n_slots=16).collect()
    assert len(strange) == odd.count()
    for shard in range(3):
        assert sorted(r.slot for r in strange if r.shard == shard) == list(range(sum(r.shard == shard for r in strange)))
    assert sharding.shard_records(none).count() == 0


def test_sharding_hot_rows(spark, tmp_path):
    """A third of all rows share an id, a third are one repeated row; bytes stay near equal by the edited map."""
    rows = [(1, "hot id " + words(20, i)) for i in range(1000)] + [(2, "one row " + words(20, 0))] * 1000 + [(i, words(20, i)) for i in range(10, 1010)]
    got = sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string"), 8, path=str(tmp_path / "map")).collect()
    loads, counts = Counter(), Counter(r.shard for r in got)
    for r in got:
        loads[r.shard] += r.size
    assert len(got) == 3000 and max(loads.values()) < 1.01 * min(loads.values())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(8))
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    first, second = store.shards(1), store.shards(2)
    assert first == [s % 8 for s in range(sharding.N_SLOTS)] and 0 < sum(a != b for a, b in zip(first, second)) < sharding.N_SLOTS / 4
    chart = dict(enumerate(second))
    assert all(chart[r.vslot] == r.shard for r in got)


def test_slot_map_versions(spark, tmp_path):
    sizes = [((i * 7919) % 101) + 1 for i in range(512)]
    first = [slot % 8 for slot in range(512)]
    grown = sharding.rebalanced(sizes, first, 9)
    assert all(b in (a, 8) for a, b in zip(first, grown)) and grown.count(8) > 0
    loads = [sum(s for s, x in zip(sizes, grown) if x == k) for k in range(9)]
    assert max(loads) - min(loads) < 0.1 * sum(sizes) / 9
    shrunk = sharding.rebalanced(sizes, first, 7)
    assert all(a == b or a == 7 for a, b in zip(first, shrunk)) and 7 not in shrunk
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    store.write(1, first, sizes)
    store.write(2, grown, sizes)
    assert store.shards(1) == first and store.shards() == grown


def test_items_digest(spark, sf):
    row = queries.op8_decontamination(spark, sf).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and not row.contaminated


def test_items_of_any_kind(spark):
    """Text ids, and items without one: their words are hit, but they aren't named."""
    items = spark.createDataFrame([("b", "one two three"), ("a", "two three"), (None, "five six")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "five six")], "doc_id long, text string")
    got = {r.doc_id: (list(r.hits["items"]), r.hits.n_hit) for r in decontam.benchmark_hits(docs, items).collect()}
    assert got == {1: (["a", "b"], 3), 2: ([], 2)}


def test_licences_against_plain_search():
    """Every window of text that is within the edits of a notice is found, as by the regex library on all text."""
    rng = random.Random(8)
    finder = license_scan.Finder()
    finder._build()
    for trial in range(60):
        i = rng.randrange(len(finder.fuzzy))
        phrase, _, k, pattern = finder.fuzzy[i]
        made = []
        for _ in range(3):
            chars = list(phrase)
            for _ in range(rng.randint(0, k)):
                at = rng.randrange(1, len(chars) - 1)
                kind = rng.randrange(3)
                if kind == 0:
                    del chars[at]
                elif kind == 1:
                    chars.insert(at, rng.choice("abcdefg"))
                else:
                    chars[at] = rng.choice("abcdefg")
            made += ["".join(chars), words(rng.randint(0, 3), trial)]
        flat = license_scan.joined(license_scan.normal_words(" ".join(made)))
        covered = [False] * (len(flat) + 1)
        for j, a, b, _ in finder.find_fuzzy(flat):
            if j == i:
                covered[a:b] = [True] * (b - a)
        for a in range(len(flat)):  # every match that begins here overlaps one that was reported
            if flat[a - 1 : a] == " " and (m := pattern.match(flat, a)):
                assert any(covered[m.start() : m.end()]), (phrase, flat)


def test_licence_base_against_sql(spark, sf):
    got = queries.op2_license_scan(spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert_equal_rows(got, queries.OP2_BASE_SQL, sf)


def test_packed_rows_are_whole(spark, odd):
    assert license_scan.scan_licenses(odd.select("doc_id", "text")).filter(F.col("license.n_words") > 50_000).count() == 1
