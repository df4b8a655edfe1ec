"""Search, resampling, token files, near duplicates, packing, language, pipeline."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from conftest_docs import odd_docs, words
from priorflow.llm import bytewords, id_coder, lang_crf, near_dup, packing, queries, resample, token_files, tokens, vamana

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def split_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- words ---------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=8))
def test_byte_words(texts):
    w = bytewords.Words(pa.array(texts, pa.string()))
    ours = [[bytes(w.bytes[w.starts[k] : w.ends[k]]).decode() for k in range(a, b)] for a, b in zip(w.first, w.first[1:])]
    assert ours == [split_words(t) for t in texts]
    h = w.hashes()
    flat = [x for ws in ours for x in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


# --- op1 -----------------------------------------------------------------------------------


def brute_nearest(ids, x, queries_, k):
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for q in queries_:
        i = ids.index(q)
        s = x @ x[i] / (norm * norm[i])
        out[q] = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
    return out


def test_vamana_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(3000, 16)), np.repeat(rng.normal(size=(1, 16)), 60, 0)))
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    asked = [i for i in ids if i % 50 == 0]
    want = brute_nearest(ids, x, asked, 5)
    got = defaultdict(list)
    for r in vamana.nearest(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=700).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({v for v, _ in got[q]} & {v for _, v in want[q]}) for q in asked)
    assert hits >= 0.9 * 5 * len(asked)
    assert [v for v, _ in got[3050]] == [3000, 3001, 3002, 3003, 3004] and got[3050][0][1] == pytest.approx(1.0)
    assert [v for v, _ in got[3000]] == [3001, 3002, 3003, 3004, 3005]


def test_vamana_blocks_meet_single_shards(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vamana.scratch.small_batches(spark)
    index = vamana.build_index(df, 3, "vec_id", "embedding", 100)
    found = vamana.search(index, df, 3, "vec_id", "embedding", block=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[dim#\d+, shard#\d+, ", plan)
    want = brute_nearest(list(range(600)), x, list(range(600)), 3)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sum(len(set(got[q]) & {i for _, i in want[q]}) for q in want) >= 0.97 * 1800 and all(len(v) == 3 for v in got.values())


def test_vamana_odd(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (100, [1.0, 2.0, 3.0]), (7, [float("inf"), 1.0]), (8, [2.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in vamana.nearest(df, df.filter("vec_id % 50 = 0"), 5).collect()}
    assert set(got) == {(0, 1), (0, 2), (50, 1), (50, 2)} and got[50, 1] == 8
    assert vamana.nearest(df.limit(0), df.limit(0), 5).count() == 0


def test_vamana_extreme_lengths(spark):
    """Cosines don't depend on lengths, even where squares would overflow or vanish."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    scale = 10.0 ** rng.choice([-200, -160, 0, 160, 200], 300)
    schema = "vec_id long, embedding array<double>"
    plain, far = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], schema) for y in (x, x * scale[:, None]))
    one, two = ({(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in vamana.nearest(d, d.filter("vec_id % 50 = 0"), 5).collect()} for d in (plain, far))
    assert one == two and len(one) == 30


@pytest.mark.parametrize("shard_rows", [64, 4096])
def test_vamana_recall_on_embeddings(spark, sf, shard_rows):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and any(r.embedding)]
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    asked = [i for i in ids if i % 10 == 0]
    want, got = brute_nearest(ids, x, asked, 5), defaultdict(set)
    for r in vamana.nearest(df, df.filter("vec_id % 10 = 0"), 5, shard_rows=shard_rows).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in asked) >= 0.95 * 5 * len(asked)


def test_robust_prune_covers():
    points = vamana.unit(np.array([[1, 0], [1, 0.1], [1, 0.11], [0, 1.0]], np.float64))
    d = 1 - points[0] @ points.T
    kept = vamana.robust_prune(points, np.array([0]), np.array([[1, 2, 3]]), d[None, 1:], 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


# --- op3 -----------------------------------------------------------------------------------


def test_resampling_keeps_clean_and_rejects_junk(spark):
    rows, labels = [], []
    for i in range(600):
        junk = i % 6 == 0
        text = " ".join(f"{w}***" for w in words(60, i).split()) if junk else words(60, i)
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in resample.resample(docs, lab).filter("kept").collect()}
    clean = {i for i in range(600) if i % 6}
    assert len(clean - kept) <= 5 and len(kept - clean) <= 5


def test_resampling_by_length(spark):
    """Short texts with a few bad words go; very long clean texts, with as few a word as the target's own, stay."""
    rng = np.random.default_rng(4)
    clean = lambda n: " ".join("zzbad" if x < 1 else f"w{x}" for x in rng.integers(0, 1000, n))
    toxic = lambda: " ".join("zzbad" if k % 5 == 2 else f"w{x}" for k, x in enumerate(rng.integers(1, 1000, 20)))
    rows = [(i, clean(2000 if i % 10 == 0 else 100)) for i in range(200)] + [(1000 + i, toxic()) for i in range(150)] + [(2000 + i, clean(20_000)) for i in range(3)]
    labels = [(i, 1, 0) for i in range(200)] + [(1000 + i, 1, 1) for i in range(75)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in resample.resample(docs, lab).filter("kept").collect()}
    assert len([i for i in kept if 1000 <= i < 2000]) <= 3 and {2000, 2001, 2002} <= kept and len([i for i in kept if i < 200]) >= 197


def test_resampling_brute(spark):
    """Importances from counts of n-grams as strings, by the definition, and the top k with noise."""
    rng = np.random.default_rng(6)
    vocabulary = ["alpha", "beta", "gamma", "delta", "***", "omega", "bad", "worse"]
    rows = []
    for i in range(240):
        p = np.ones(8)
        p[6:] = 0.01 if i % 3 else 8.0  # words of the bad third
        rows.append((i, " ".join(rng.choice(vocabulary, int(rng.integers(5, 120)), p=p / p.sum()))))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in resample.resample(docs, lab, k=100).collect()}

    def grams(text):
        w = text.split()
        return w + ["repeat" if a == b else (a, b) for a, b in zip(w, w[1:])]

    known = {g for _, text in rows for g in grams(text)}
    buckets, _ = resample.features(pa.array([" ".join(text for _, text in rows)]))
    assert len(set(buckets.tolist())) >= len(known)  # no two n-grams share a bucket here
    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        if i % 2 == 0 and i % 3:
            target.update(grams(text))
    scale = sum(target.values()) / sum(raw.values())
    log_ratio = {}
    for g, n in raw.items():
        x = math.log((target[g] + 0.5) / (n * scale + 0.5))
        log_ratio[g] = x if abs(x) > 1 + 3 / math.sqrt(min(target[g], n * scale) + 1) else 0.0
    evidence = {i: sum(log_ratio[g] for g in grams(text)) for i, text in rows}
    length = {i: len(grams(text)) for i, text in rows}
    good = [i for i, q, _ in labels if q]
    mean = sum(evidence[i] for i in good) / sum(length[i] for i in good)
    for i, r in out.items():
        assert r.importance == pytest.approx((evidence[i] - length[i] * mean) / math.sqrt((length[i] + 64) / 200), abs=1e-6)
    assert any(v != 0 for v in log_ratio.values())
    ranked = sorted(out, key=lambda i: -out[i].gumbel_key)
    assert {i for i in out if out[i].kept} == set(ranked[:100])
    # without k: as many as the sum of weights, in units of the weakest target document's
    least = min(out[i].importance for i in good)
    kept = resample.resample(docs, lab, keep_target=1.0).filter("kept").count()
    assert kept == round(sum(min(1.0, math.exp(out[i].importance - min(least, 0.0))) for i in out))


def test_noise_draws_by_weight(spark):
    """Over many seeds the first drawn follows the weights, and the sets drawn are those of successive draws."""
    weights = [8.0, 4.0, 2.0, 1.0, 1.0]
    seeds = 20_000
    rows = spark.createDataFrame([(i, f"text {i}", math.log(w)) for i, w in enumerate(weights)], "id long, text string, importance double")
    keyed = rows.join(spark.range(seeds).withColumnRenamed("id", "seed")).withColumn("key", F.col("importance") + resample.gumbel_noise(F.col("id"), F.col("text"), F.col("seed")))
    top = keyed.groupBy("seed").agg(F.reverse(F.sort_array(F.collect_list(F.struct("key", "id")))).alias("k")).select(F.col("k")[0]["id"].alias("a"), F.col("k")[1]["id"].alias("b"))
    pairs = Counter((r.a, r.b) for r in top.collect())
    for a, wa in enumerate(weights):
        first = sum(n for (x, _), n in pairs.items() if x == a) / seeds
        assert first == pytest.approx(wa / 16, abs=0.012)
        for b, wb in enumerate(weights):
            if a != b:
                assert pairs[a, b] / seeds == pytest.approx(wa / 16 * wb / (16 - wa), abs=0.012)


def test_resampling_odd(spark):
    odd, lab = odd_docs(spark), spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 1, 0), (5, None, 0), (6, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    out = resample.resample(odd, lab)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "importance", "gumbel_key", "kept_"]
    assert resample.resample(odd, lab.limit(0)).filter("kept_").count() == odd.count()
    assert resample.resample(odd.limit(0), lab).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate((rng.normal(size=2000) * 10.0 ** rng.integers(-3, 4, 2000), np.full(50, 0.25))).tolist()
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 700, 1000, 1030, 2049, 2050):
        assert resample.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


# --- op4 -----------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 999), max_size=700), st.sampled_from([16, 100, 2048]))
def test_coder_round_trip(ids, block):
    ids = np.array(ids, "<u4")
    assert (id_coder.decode(id_coder.encode(ids, 1000, block)) == ids).all()


def test_coder_checks():
    ids = (np.arange(9000) * 7919 % 900).astype("<u4")
    image = bytearray(id_coder.encode(ids, 1000))
    image[-200] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        id_coder.decode(bytes(image))
    assert len(id_coder.encode(np.zeros(50_000, "<u4"), 1000)) < 2000
    with pytest.raises(ValueError):
        id_coder.encode(np.array([1000], "<u4"), 1000)


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.text(max_size=80), max_size=5))
def test_memory_equals_library(path, texts):
    texts = texts + ["it's  a\n\n b's 'll ''t 12３ x", "  ", "İ ﬁ é", "ΑΣ Σ É e\u0301 ǅ", "<|endoftext|>"]
    plain = tokens.load(path)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = tokens.Encoder(path, capacity=40)
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_every_settled_character(path):
    """Each alone, and between other texts; case mappings that leave the settled ones (U+023A) included."""
    every = [chr(c) for a, b in ((0, 0x530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2190, 0x2200)) for c in range(a, b)]
    texts = [t for c in every for t in (c, f"a{c}b 1{c}{c} '{c}s", "next text")] + ["\ue000", "a\ue000b", "Ⱥ Ⱦ", "ꙮ"]
    plain = tokens.load(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    got = tokens.Encoder(path).encode(texts)
    assert len(got) == len(want) and [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_token_files_case_mappings(spark, tmp_path):
    rows = [(1, "first"), (2, "aȾb"), (3, "third Ⱥ"), (4, "İstanbul ΑΣ"), (5, "fifth")]
    token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "ids"), WORD_BPE, 2)
    plain = tokens.load(WORD_BPE)
    got = {r.id: r.tokens for r in token_files.read_files(spark, str(tmp_path / "ids")).collect()}
    assert got == {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}


def test_token_files(spark, tmp_path):
    odd, path = odd_docs(spark), str(tmp_path / "ids")
    token_files.write_files(odd, path, WORD_BPE, 2, file_ids=5000)
    plain = tokens.load(WORD_BPE)
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()), key=lambda r: r[0])
    got = token_files.read_files(spark, path).orderBy("start").collect()
    assert [-1 if r.id is None else r.id for r in got] == [i for i, _ in rows]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens)
        at += r.n_tokens
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert want == Counter((-1 if r.id is None else r.id, tuple(r.tokens)) for r in got)
    empty = str(tmp_path / "none")
    token_files.write_files(odd.limit(0), empty, WORD_BPE, 2)
    assert token_files.read_files(spark, empty).count() == 0


# --- op5 -----------------------------------------------------------------------------------


def brute_classes(rows):
    """Classes by the exact weighted similarity of all pairs, IDF steps from true shares."""
    sets = {}
    shares = Counter()
    for i, t in rows:
        w = split_words(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets[i] = c
        shares.update(c.keys())
    weight = lambda s, n: n.bit_length() * (1 - 0.05 * sum(shares[s] / len(rows) > x for x in near_dup._SHARES))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, sa), (b, sb) in itertools.combinations(sets.items(), 2):
        both = sum(min(weight(s, sa[s]), weight(s, sb[s])) for s in sa.keys() & sb.keys())
        either = sum(weight(s, n) for s, n in sa.items()) + sum(weight(s, n) for s, n in sb.items()) - both
        if both and both / either >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i, _ in rows}


def test_idf_of_long_texts():
    """Shingles of their own keep an IDF of 1.0 however many a text has, once there are documents
    enough that chance loads stay below the first share; shared ones get their share's step."""
    rng, n = np.random.default_rng(3), 100_000
    for length in (300, 1500, 4000):
        cells = rng.poisson(n * length / near_dup._SIZE, (near_dup._DEPTH, near_dup._SIZE))
        shared = rng.choice(near_dup._SIZE, 50, replace=False)
        cells[:, shared] += n // 8
        steps = near_dup.idf_steps(cells, n).min(0)
        own = np.delete(steps, shared)
        assert (own == 0).mean() > 0.99 and (steps[shared] == 4).all()
    assert near_dup.idf_steps(np.zeros((2, 8), np.int64), 1).max() == 0


def test_near_duplicates_brute(spark):
    rows = []
    for i in range(40):
        rows.append((i, words(120, 1000 + i)))
    for i in range(40, 100):  # near copies of ten texts, each with a few words changed
        w = rows[i % 10][1].split()
        for k in range(i % 5):
            w[(7 * i + 31 * k) % len(w)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1].upper() + "!"), (101, "short text"), (102, "Short, TEXT"), (103, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_hot_buckets(spark):
    """Pairs of copies among many classes that share boilerplate, and beside a giant class."""
    rng = np.random.default_rng(5)
    words = lambda tag, n: [f"{tag}{x}" for x in rng.integers(0, 1 << 40, n)]
    shared, giant = words("b", 160), words("g", 24)
    rows = [(i, " ".join(shared + giant + words("v", 3))) for i in range(150)]
    for pair in range(150):
        own = words("o", 24)
        rows += [(1000 + 2 * pair + k, " ".join(shared + own + words("v", 3))) for k in range(2)]
    got = {r.id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert [got[1001 + 2 * p] for p in range(150)] == [1000 + 2 * p for p in range(150)]


def test_near_duplicates_odd(spark):
    odd = odd_docs(spark)
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.id].add(r.class_id)
    assert by[5] == by[11] == {5} and by[1] == {1} and by[8] == {8} and by[6] == {6}
    kept = near_dup.drop_near_duplicates(odd)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and ids[5] == 1 and ids[11] == 0 and ids[6] == 2 and ids[None] == 2 and ids[7] == 1
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0 and near_dup.drop_near_duplicates(odd.limit(0)).count() == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    w = near_dup.Weights(np.zeros((near_dup._DEPTH, near_dup._SIZE), np.uint8))
    pool = np.unique(rng.integers(0, 1 << 63, 12_000, np.uint64))
    same = total = 0
    for k in range(60):
        part = pool[k * 150 : k * 150 + 150]
        a, b = np.sort(part[:125]), np.sort(part[25:])  # Jaccard 100 / 150
        h, begins = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        bands = w.bands(h, w.levels(h, np.ones(len(h), np.int64)), begins)
        same += int((bands[0] == bands[1]).sum())
        total += near_dup.BANDS
    assert abs(same / total - (100 / 150) ** near_dup.ROWS) < 0.05


# --- op6 -----------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 300), max_size=40))
def test_histogram_packing(counts):
    patterns = packing.pack_histogram(counts, 64)
    used = Counter()
    for times, lengths in patterns:
        assert times > 0 and sum(lengths) <= 64
        for length in lengths:
            used[length] += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    ranks = defaultdict(list)
    for length, lo, hi, _, _ in packing.places(patterns):
        ranks[length] += range(lo, hi)
    assert all(sorted(ranks[k]) == list(range(v)) for k, v in counts.items() if v)


def test_packing(spark):
    odd = odd_docs(spark).withColumn("text", F.when(F.col("doc_id") == 3, F.lit(words(1500, 8))).otherwise(F.col("text")))
    pieces = packing.pack_documents(odd, BYTE_BPE, 0, 1024).collect()
    plain = tokens.load(BYTE_BPE)
    want = Counter((r.doc_id, np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in odd.collect())
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.row].append(p)
        sequences[p.sequence_id].append(p)
    whole = Counter()
    for ps in docs.values():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1].tolist()]
        whole[ps[0].id, b"".join(bytes(p.payload) for p in ps)] += 1
    assert whole == want
    for ps in sequences.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1].tolist()] and sum(p.length for p in ps) <= 1024
    assert packing.pack_documents(odd.limit(0), BYTE_BPE).count() == 0


# --- op10 ----------------------------------------------------------------------------------


def test_forward_backward():
    rng = np.random.default_rng(1)
    first = np.array([0, 0, 3, 3, 71, 200, 201])
    e, t = rng.random((201, 3)) + 0.05, rng.random((3, 3)) + 0.1
    got = lang_crf.marginals(e, t, first)
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        forward = [e[a] / e[a].sum()]
        for i in range(a + 1, b):
            x = (forward[-1] @ t) * e[i]
            forward.append(x / x.sum())
        back = [np.ones(3)]
        for i in range(b - 1, a, -1):
            x = t @ (back[0] * e[i])
            back.insert(0, x / x.sum())
        p = np.array(forward) * np.array(back)
        assert np.allclose(p / p.sum(1, keepdims=True), got[a:b])


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.id: r for r in lang_crf.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.9 * len(held)


def test_code_switching_labels_words():
    de, en = ["der hund und die katze schlafen nicht zusammen"] * 30, ["the dog and the cat never sleep together"] * 30
    model = lang_crf.fit(de + en, ["de"] * 30 + ["en"] * 30)
    words_ = bytewords.Words(pa.array(["der hund und die katze the dog and the cat"]), lang_crf._LETTERS)
    best = model.posteriors(model.emissions(words_), words_.first).argmax(1)
    assert best.tolist() == [0] * 5 + [1] * 5


def test_language_predictions_brute(spark, sf):
    """Each document's mean of word posteriors, by a plain forward-backward pass word by word."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    got = {r.id: r for r in lang_crf.identify(docs).collect()}
    model = lang_crf.fit(*lang_crf.training_sample(docs, "doc_id", "text", "lang", 1600, 120))
    for r in docs.collect():
        found = bytewords.Words(pa.array([r.text or ""]), lang_crf._LETTERS)
        if not len(found.starts):
            assert got[r.doc_id].lang_pred == "und"
            continue
        score = np.zeros((len(found.starts), len(model.languages)))
        for i in range(len(found.starts)):  # one word at a time
            _, feature = lang_crf.word_features(found, np.array([i]))
            score[i] = model.weights[feature].sum(0)
        e, t = np.exp(score - score.max(1, keepdims=True)), np.exp(model.transitions)
        forward, back = [e[0] / e[0].sum()], [np.ones(e.shape[1])]
        for i in range(1, len(e)):
            f = (forward[-1] @ t) * e[i]
            forward.append(f / f.sum())
        for i in range(len(e) - 1, 0, -1):
            b = t @ (back[0] * e[i])
            back.insert(0, b / b.sum())
        post = np.array(forward) * np.array(back)
        mean = (post / post.sum(1, keepdims=True)).mean(0)
        assert got[r.doc_id].score == pytest.approx(mean.max(), abs=1e-6) and got[r.doc_id].lang_pred == model.languages[mean.argmax()]


def test_language_word_labels(spark):
    rows = [(i, "der hund und die katze schlafen nicht zusammen", "de") for i in range(0, 60, 2)] + [(i, "the dog and the cat never sleep together", "en") for i in range(1, 61, 2)] + [(100, "die Katze é: the dog!", None), (101, None, None)]
    got = {r.id: r.words for r in lang_crf.identify_words(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    text = rows[-2][1].encode()
    assert [text[w.start : w.end].decode() for w in got[100]] == ["die", "Katze", "é", "the", "dog"]
    assert [w.label for w in got[100] if w.end - w.start > 2] == ["de", "de", "en", "en"] and got[101] == []
    with pytest.raises(ValueError):
        lang_crf.training_sample(spark.createDataFrame([(i, "a b", f"l{i}") for i in range(30)], "doc_id long, text string, lang string"), "doc_id", "text", "lang", 100, 10, max_languages=3)


def test_language_odd(spark):
    odd = odd_docs(spark)
    rows = lang_crf.identify(odd).collect()
    assert len(rows) == odd.count()
    by = {r.id: r for r in rows}
    assert by[1].lang_pred == by[2].lang_pred == by[7].lang_pred == by[8].lang_pred == "und" and by[1].score == 0
    assert by[10].lang_pred != "und" and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in lang_crf.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_crf.identify(odd.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == names and out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert 0.6 * before <= docs.count() <= before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]


def drawn_by_rule(spark, rows, good):
    """The documents that resampling draws, in plain Python but for the buckets of n-grams and the hash behind the noise."""
    grams = {i: resample.features(pa.array([t or ""]))[0].tolist() for i, t in rows.items()}
    raw, target = Counter(), Counter()
    for i, own in grams.items():
        raw.update(own)
        if i in good:
            target.update(own)
    scale, ratio = sum(target.values()) / sum(raw.values()), {}
    for g, n in raw.items():
        x = math.log((target[g] + 0.5) / (n * scale + 0.5))
        ratio[g] = x if abs(x) > 1 + 3 / math.sqrt(min(target[g], n * scale) + 1) else 0.0
    evidence = {i: sum(ratio[g] for g in own) for i, own in grams.items()}
    mean = sum(evidence[i] for i in good) / sum(len(grams[i]) for i in good)
    importance = {i: (evidence[i] - len(own) * mean) / math.sqrt((len(own) + 64) / 200) for i, own in grams.items()}
    least = min(0.0, sorted(importance[i] for i in good)[max(0, math.ceil(len(good) * 0.001) - 1)])
    k = round(sum(min(1.0, math.exp(importance[i] - least)) for i in rows))
    hashes = spark.createDataFrame(list(rows.items()), "i long, t string").select("i", F.xxhash64("i", "t", F.lit(7)).alias("h")).collect()
    noise = {r.i: -math.log(-math.log((((r.h % (1 << 64)) >> 12) + 0.5) / (1 << 52))) for r in hashes}
    return sorted(rows, key=lambda i: -(importance[i] + noise[i]))[:k]


def test_pipeline_brute(spark, sf, tmp_path):
    """Every stage's rows against a plain Python version of its rule, on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    text = {name: {r.doc_id: r.text for r in out[name].collect()} for name in list(out)[:4]}

    marks = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert text["quality"] == {i: rows[i] for i in drawn_by_rule(spark, rows, {i for i in rows if marks.get(i) == (1, 0)})}

    holders = defaultdict(set)
    fold = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, t in text["quality"].items():
        for line in (t or "").split("\n"):
            if len(fold(line)) >= 20:
                holders[fold(line)].add(i)
    for i, t in text["quality"].items():
        want = "\n".join(x for x in (t or "").split("\n") if len(holders.get(fold(x), ())) < 3 or max(holders[fold(x)]) == i)
        assert (text["line_dedup"][i] or "") == want

    classes = brute_classes([(i, t or "") for i, t in text["line_dedup"].items()])
    assert set(text["near_duplicates"]) == set(classes.values()) and all(text["near_duplicates"][i] == text["line_dedup"][i] for i in text["near_duplicates"])

    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = set()
    for i, t in text["near_duplicates"].items():
        w, hit = split(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert set(text["decontamination"]) == clean

    plain = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in out["packing"].collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t in text["decontamination"].items():
        assert [x for _, part in sorted(pieces[i]) for x in part] == plain.encode(t or "", add_special_tokens=False).ids + [0]


def test_pipeline_odd(spark, sf, tmp_path):
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{empty}")
            stage(spark, d, sf).write.parquet(path)
            d = spark.read.parquet(path)
        assert (d.count() == 0) == empty


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
