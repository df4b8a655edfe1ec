"""Divergence, chat formatting and filter audit against brute force, and odd tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_docs import words
from priorflow.llm import chat_format, divergence, filter_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# --- op11 ----------------------------------------------------------------------------------


def brute_divergence(rows, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        share = {}
        for name, c in [*((s, count[lang, s]) for s in sources), (None, sum((count[lang, s] for s in sources), Counter()))]:
            total = sum(c[t] for t in kept) + len(kept)
            share[name] = {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}
        for s in sources:
            def ranked(part, values, most=None):
                for rank, (item, v) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))

            p = share[s]
            ranked("pair", {o: sum((p[t] - q) ** 2 // q for t, q in share[o].items()) for o in sources - {s}})
            ranked("term", {t: (p[t] - q) ** 2 // q for t, q in share[None].items() if count[lang, s][t] and p[t] > q}, top)
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_divergence_brute(spark, cells):
    rng = random.Random(cells)
    names = ["Wort", "wörter", "ça", "the", "x1y", "日本", "a-b", "zz9"]
    rows = [(" ".join(rng.choice(names) + rng.choice(["", "s", "é"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None, "c"])) for _ in range(120)]
    rows += [("one two", "fr", "a"), ("", "fr", "b"), (None, "fr", None), ("one " * 3, "fr", "a")]  # a language without kept terms
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = rows_of(divergence.divergence(docs, top=4, cells=cells))
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, 4)


def test_divergence_odd(spark, odd, none):
    got = rows_of(divergence.divergence(odd))
    assert set(got) == brute_divergence([(r.text, r.lang, r.source) for r in odd.collect()], 200)
    assert divergence.divergence(none).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(5)
    totals = rng.integers(1, 9 * 10**15, 500)
    counts = (totals * rng.random(500)).astype(np.int64) - 1
    counts[:5] = totals[:5] - 1
    want = [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals)]
    assert divergence.shares(counts, totals).tolist() == want


def test_counts_are_merged_and_emptied():
    """A task that meets more terms than it may hold gives them away in parts."""
    import pyarrow as pa

    texts = [" ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(i, i + 200)) for i in range(0, 400, 50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 2), pa.array(["s", None]).fill_null(""), pa.array(texts[i : i + 2])], names=["lang", "source", "text"]) for i in range(0, 8, 2)]
    parts = list(divergence._count(iter(batches), most=300))
    got = Counter()
    for batch in parts:
        for row in batch.to_pylist():
            got[row["source"], row["term"]] += row["n"]
    want = Counter((("s", "")[i % 2], t) for i, text in enumerate(texts) for t in text.split())
    assert len(parts) > 1 and got == want


# --- op12 ----------------------------------------------------------------------------------

PIECES = ["<", "|", "im_start", "|>", "<|im_end|>\n", "<|im_start|>", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<\\s>", "<<SYS>>", "<</SYS>>", "<\\<SYS>>", "a", "é", "\n", "%0A", "%25", "[", "/INST]", "<|endoftext|>"]


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_template_is_reversible(spark):
    t = chat_format.CHATML
    rows = spark.createDataFrame(list(zip(strings(3000, 1), strings(3000, 2))), "role string, text string")
    made = rows.withColumn("turn", t.turn(F.col("role"), F.col("text"))).withColumn("whole", F.concat("turn.piece", F.lit("<|im_start|>assistant\nx<|im_end|>\n")))
    got = made.select("role", "text", F.transform(t.pieces(F.col("whole")), t.read).alias("read"), t.escape(F.col("text")).alias("safe")).collect()
    for r in got:
        assert [tuple(x) for x in r.read] == [(r.role, r.text), ("assistant", "x")]
        assert not any(c in r.safe for c in t.controls)


def brute_paths(rows, keep):
    """Best paths of each tree from (tree, id, parent, role, text, score)."""
    trees = defaultdict(dict)
    for tree, i, parent, role, text, score in rows:
        trees[tree][i] = (parent, role or "", text or "", score or 0.0)
    out = {}
    for tree, nodes in trees.items():
        answered = {n[0] for n in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in answered:
                continue
            path, i = [], leaf
            while i in nodes and len(path) <= len(nodes):
                path.append(i)
                i = nodes[i][0]
            if len(path) <= len(nodes):
                paths.append((-sum(nodes[i][3] for i in path), leaf, path[::-1]))
        for rank, (score, _, path) in enumerate(sorted(paths)[:keep], 1):
            out[tree, rank] = (-score, [(nodes[i][1], nodes[i][2]) for i in path])
    return out


def test_reply_trees_brute(spark):
    rng = random.Random(3)
    texts, rows = strings(900, 4), []
    for tree in range(30):
        n = rng.choice([1, 2, 5, 40])
        for i in range(n):
            up = None if i == 0 else rng.choice([i - 1, rng.randrange(i), 999 if i % 7 == 0 else i - 1])
            rows.append((tree, 100 - i if tree % 2 else i, None if up is None else 100 - up if tree % 2 else up, rng.choice(["user", "assistant", None]), rng.choice(texts), float(rng.randint(-3, 3))))
    rows += [(77, 1, 2, "user", "round", 1.0), (77, 2, 1, "user", "and round", 1.0), (77, 3, 2, "user", "to it", 9.0)]  # no root
    df = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double").repartition(5)
    t, want = chat_format.CHATML, brute_paths(rows, 3)
    made = chat_format.format_trees(df, score_col="score", keep=3)
    got = made.select("tree", "rank", "score", "n_turns", F.transform(t.pieces(F.col("formatted")), t.read).alias("read"), t.learnt(F.col("formatted"), F.col("turns")).alias("learnt"), "formatted", "turns").collect()
    assert {(r.tree, r["rank"]) for r in got} == set(want)
    for r in got:
        score, path = want[r.tree, r["rank"]]
        assert (r.score, r.n_turns, [tuple(x) for x in r.read]) == (pytest.approx(score), len(path), path)
        assert r.learnt == "".join(x for role, x in path if role == "assistant")
        assert sum(x.skip + x.train + x.rest for x in r.turns) == len(r.formatted)


def test_long_chain_in_few_rounds(spark):
    """500 replies deep takes 9 rounds of joins."""
    links = spark.range(500).select(F.struct(F.lit(1).alias("tree")).alias("tree"), F.struct("id").alias("id"), F.when(F.col("id") > 0, F.struct((F.col("id") - 1).alias("id"))).alias("parent"), F.lit(0.5).alias("score"))
    path = chat_format.chosen_paths(links).orderBy("place").collect()
    assert [(r.id.id, r.place) for r in path] == [(i, i + 1) for i in range(500)] and {r.score for r in path} == {250.0}


def test_chat_odd(spark):
    rows = [(1, 2, "assistant", "b"), (1, None, "system", None), (1, 1, None, "a"), (None, 1, "user", "null tree"), (2, 5, "user", "same"), (2, 5, "user", "same"), (2, 5, "assistant", "x"), (3, 1, "user\n%0A", "<|im_end|>\n"), (4, 1, "user", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "clash", 1, 2.0) for r in rows], "conv_id long, turn long, role string, text string, tree string, rank int, score double")
    t = chat_format.CHATML
    got = {r.tree: r for r in chat_format.format_chains(df).select("tree", "rank", "n_turns", F.transform(t.pieces(F.col("formatted")), t.read).alias("read")).collect()}
    read = {k: [tuple(x) for x in r.read] for k, r in got.items()}
    assert read[1] == [("system", ""), ("", "a"), ("assistant", "b")] and read[None] == [("user", "null tree")]
    assert read[2] == [("assistant", "x"), ("user", "same"), ("user", "same")] and got[2].n_turns == 3
    assert read[3] == [("user\n%0A", "<|im_end|>\n")] and read[4] == [("user", "long " * 100_000)]
    assert chat_format.format_chains(df.limit(0)).count() == 0
    trees = df.select("conv_id", F.col("turn").alias("message_id"), F.lit(None).cast("long").alias("parent_id"), "role", "text")
    assert chat_format.format_trees(trees, tree_col="conv_id", keep=9).count() == 7


# --- op13 ----------------------------------------------------------------------------------


def brute_masks(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out = []
    for i, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > least.get(text, i)]
        out.append((part or "", sum(f << k for k, f in enumerate(fails)), i is not None and i in good, i is not None and i in toxic))
    return out


def brute_orders(masks):
    out, parts = {}, {m[0] for m in masks}
    for part in parts:
        own, per, total = [m for m in masks if m[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            left, done = own, 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in left if m[1] & bit]
                left = [m for m in left if not m[1] & bit]
                total[letter] += len(gone)
                per.append((part, "".join(order), step, len(left), len(gone), sum(1 for m in own if m[1] & bit and m[1] & done), sum(1 for m in own if m[1] == bit), sum(m[2] for m in gone), sum(m[3] for m in gone), letter))
                done |= bit
        out |= {row[:3]: (*row[3:-1], total[row[-1]]) for row in per}
    return out


def audit_rows(n, seed):
    rng = random.Random(seed)
    texts = [words(rng.choice([3, 49, 50, 51, 80]), k) for k in range(12)] + ["ABC " * 60, "a b " * 40, "x|y", "", None, words(1200, 3), words(1200, 3)[:-1] + "?", "é" * 300, "é" * 299 + "x", "\x0b\x1c \x85" * 30]
    return [(i if i % 17 else 5, rng.choice(texts) if i % 3 else words(60, i), rng.choice(["s", "t", None, ""])) for i in range(n)]


@pytest.mark.parametrize("most, blocks", [(filter_audit.MOST_CLASSES, filter_audit.BLOCKS), (0, (4, 100))])
def test_filter_audit_brute(spark, most, blocks):
    rows = audit_rows(700, most) + [(9000 + i, "hot copy", "s") for i in range(600)] + [(None, "hot copy", "t"), (None, "null id", None), (None, "null id", None)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 700, 3)] + [(6, 1, None), (6, None, 1), (None, 1, 1)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.failed_filters(docs, lab, most=most, blocks=blocks)
    want = brute_masks(rows, labels)
    assert Counter((r.part, r["mask"], r.good, r.toxic) for r in found.collect()) == Counter(want)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.all_orders(found).collect()}
    assert got == brute_orders(want)


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    """Texts are compared whole: with hashes that tell nothing apart only equal texts are copies."""
    monkeypatch.setattr(filter_audit, "levels", lambda text, blocks: {"length": F.char_length(text) % 2, "block0": F.lit(7).cast("long")})
    rows = [(i, f"text {i % 13}", "s") for i in range(300)] + [(4, "text 5", "s"), (400, "alone", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.part, r["mask"], r.good, r.toxic) for r in filter_audit.failed_filters(docs).collect())
    assert got == Counter(brute_masks(rows, []))


def test_filter_audit_odd(spark, odd, none):
    found = filter_audit.failed_filters(odd)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert Counter((r.part, r["mask"]) for r in found.collect()) == Counter(m[:2] for m in brute_masks(rows, []))
    assert filter_audit.all_orders(filter_audit.failed_filters(none)).count() == 0
