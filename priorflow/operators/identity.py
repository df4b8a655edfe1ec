"""Names to ids in four levels that never guess: exact, alias, fuzzy, unresolved."""

from __future__ import annotations

import difflib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import minted_id, normalize_name

CUTOFF = 0.87


def name_index(players: DataFrame, group: str, ident: str, name: str) -> DataFrame:
    """(group, ident, norm, first letter, last name) of every named player."""
    norm = normalize_name(F.col(name))
    parts = F.split(norm, " ")
    rows = players.select(group, ident, norm.alias("norm"), F.substring(norm, 1, 1).alias("letter"), F.array_join(F.slice(parts, 2, 1000), " ").alias("surname"), F.try_element_at(parts, F.lit(-1)).alias("last"))
    return rows.filter("norm != ''")


def _grams(name: Column, n: int) -> Column:
    return F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substr(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


_WORDS = [f"w{k}" for k in range(4)]


@F.pandas_udf(T.StructType([T.StructField(w, T.LongType()) for w in _WORDS]))
def _bits(names: pd.Series) -> pd.DataFrame:
    """The set of a name's 2-grams as 256 bits, in four numbers."""
    def one(name: str) -> bytes:
        bits = 0
        for i in range(len(name) - 1):
            bits |= 1 << (zlib.crc32(name[i : i + 2].encode()) & 255)
        return bits.to_bytes(32, "little")

    return pd.DataFrame(np.frombuffer(b"".join(map(one, names)), dtype="<i8").reshape(-1, 4), columns=_WORDS)


def _only_in(a: str, b: str) -> Column:
    """At least so many grams of ``a`` aren't in ``b``: bits of one that the other hasn't."""
    own = [F.bit_count(F.col(f"{a}{w}").bitwiseAND(F.bitwise_not(F.col(f"{b}{w}")))) for w in _WORDS]
    return own[0] + own[1] + own[2] + own[3]


#: A name that meets more names than this by its rare q-grams is counted with all at once (fixed value).
HEAVY = 2_000
#: Names of each side that one task compares, and names of an index in it (fixed values).
ASKED, KNOWN, INDEX = 1 << 16, 1 << 18, 1 << 16


def _letters(names: np.ndarray, n: int) -> np.ndarray:
    return names.astype(f"<U{n}").view("<u4").reshape(-1, n)


def _codes(letters: np.ndarray, alphabet: np.ndarray, q: int) -> np.ndarray:
    """Each place's q-gram as a number."""
    at = np.searchsorted(alphabet, letters)
    width = letters.shape[1] - q + 1
    return sum(at[:, k : k + width] * len(alphabet) ** (q - 1 - k) for k in range(q))


def count_met(asked: np.ndarray, known: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of names that share the q-grams which ``cutoff`` needs, at places that fit.

    Matching blocks keep their order, so a gram at place i of one name, with ``m - matched`` letters
    to spare, stands from ``i - (m - matched)`` to ``i + (n - matched)`` in the other. Lists of names
    by gram and place are laid out in a row; a name's lists are slices of it, counted together. Of
    its places only the rarest are looked up: leaving ``need - t`` out leaves ``t`` of ``need`` to be
    found. What is found so often is held against all places.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    lengths = {"asked": np.char.str_len(asked), "known": np.char.str_len(known)}
    for n in np.unique(lengths["known"]).tolist():
        rows = np.flatnonzero(lengths["known"] == n)
        for part in (rows[k : k + INDEX] for k in range(0, len(rows), INDEX)):
            theirs, made = _letters(known[part], n), {}
            for m in np.unique(lengths["asked"]).tolist():
                matched = int(np.ceil((m + n) * cutoff / 2 - 1e-9))
                q = 2 if min(m, n) < 12 else 3
                places, width = m - q + 1, n - q + 1
                need = max(matched - (q - 1) * (m + n - 2 * matched + 1), 1)
                if matched > min(m, n) or width < 1 or need > places:
                    continue
                if q not in made:
                    alphabet = np.unique(theirs)
                    codes = _codes(theirs, alphabet, q)
                    grams, own = np.unique(codes, return_inverse=True)
                    cell = (own.reshape(codes.shape) * width + np.arange(width)).ravel()
                    ends = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(grams) * width))])
                    made[q] = alphabet, codes, grams, ends, np.argsort(cell) // width
                alphabet, codes, grams, ends, listed = made[q]
                before, after, least = m - matched, n - matched, min(need, 6)
                mine = np.flatnonzero(lengths["asked"] == m)
                for batch in (mine[k : k + 4096] for k in range(0, len(mine), 4096)):
                    letters = _letters(asked[batch], m)
                    strange = ~np.isin(letters, alphabet)
                    sought = _codes(np.where(strange, alphabet[0], letters), alphabet, q)
                    gram = np.minimum(np.searchsorted(grams, sought), len(grams) - 1)
                    there = (grams[gram] == sought) & ~sum(strange[:, k : k + places] for k in range(q)).astype(bool)
                    sought = np.where(there, sought, -1)
                    at = np.arange(places)
                    first = ends[gram * width + np.clip(at - before, 0, width)]
                    last = np.where(there, ends[gram * width + np.clip(at + after + 1, 0, width)], first)
                    rare = np.argsort(last - first, axis=1, kind="stable")[:, : places - need + least]
                    first, last = (np.take_along_axis(x, rare, 1).tolist() for x in (first, last))
                    hits = []
                    for lo, hi in zip(first, last):
                        met = np.concatenate([listed[x:y] for x, y in zip(lo, hi)])
                        met = met[np.bincount(met, minlength=1)[met] >= least]
                        hits.append(np.array(sorted(set(met.tolist())), np.int64))
                    who = np.repeat(np.arange(len(batch)), [len(h) for h in hits])
                    other = np.concatenate(hits)
                    near = (at[:, None] - np.arange(width) <= before) & (np.arange(width) - at[:, None] <= after)
                    for k in range(0, len(who), 2048):
                        w, o = who[k : k + 2048], other[k : k + 2048]
                        good = ((sought[w][:, :, None] == codes[o][:, None, :]) & near).any(2).sum(1) >= need
                        found.append((batch[w[good]], part[o[good]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _counted(heavy: DataFrame, right: DataFrame, group: str, cutoff: float) -> DataFrame:
    """(group, norm, close) of names that meet many: all pairs of blocks of both sides, a block of each in a task."""
    count = lambda df, n: df.groupBy(group).agg(F.count(F.lit(1)).alias(n))
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = count(heavy, "_a").join(count(right, "_k"), group).select(group, cut("_a", ASKED).alias("_as"), cut("_k", KNOWN).alias("_ks"))
    deal = lambda name, own, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int").alias(own)
    every = lambda own, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(own)
    keys, parts = ["_g", "_a", "_k"], 4 * int(heavy.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = heavy.join(F.broadcast(sizes), group).select(F.col(group).alias("_g"), "norm", deal("norm", "_a", "_as"), every("_k", "_ks")).repartition(parts, *keys)
    known = right.join(F.broadcast(sizes), group).select(F.col(group).alias("_g"), "close", deal("close", "_k", "_ks"), every("_a", "_as")).repartition(parts, *keys)
    schema = T.StructType([heavy.schema[group], T.StructField("norm", T.StringType()), T.StructField("close", T.StringType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["norm"].combine_chunks(), right["close"].combine_chunks()
        i, j = count_met(*(np.array(x.to_pylist(), dtype=str) if len(x) else np.empty(0, "<U1") for x in (a, b)), cutoff)
        which = left["_g"].combine_chunks() if left.num_rows else right["_g"].combine_chunks()
        return pa.table({group: which.take(pa.array(np.zeros(len(i), np.int64))), "norm": a.take(pa.array(i)), "close": b.take(pa.array(j))})

    return asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(meet, schema)


def close_candidates(left: DataFrame, right: DataFrame, group: str, cutoff: float, crowded: bool = False) -> DataFrame:
    """(group, norm, close): all pairs whose similarity may reach the cutoff; none of unequal names that does is lost.

    A similarity of ``cutoff`` leaves ``e <= (1 - cutoff) * (m + n)`` letters of both names
    unmatched, so matching blocks are at most ``e + 1``, and names share a number of q-grams
    that follows from their lengths: 3-grams of names from 12 letters on, 2-grams up to 15
    (one of a pair longer than 15 has a partner from 12 on). Names of a length that no name of
    the other side can match take no part. Only as many of a name's rarest q-grams are joined
    as the least number over all partners' lengths needs (prefix filter). What meets is held
    against the number of shared 2-grams by sets of bits, before any name is compared. Joins
    of names are merges, as no table of names is small.

    Names whose rare q-grams are many names' would make a row for each of these; where tables
    are ``crowded`` with such names they are counted in blocks (:func:`count_met`), at the price
    of a plan that reads ``left`` more often. The pairs that are close are in both.
    """
    reach = (2 - cutoff) / cutoff  # longest length a name may have, as a multiple of the other's

    def needed(total: Column, q: int) -> Column:
        """Least number of shared q-grams of names with ``total`` letters together."""
        matched = F.ceil(total * cutoff / 2 - 1e-9)
        return matched - (q - 1) * (total - 2 * matched + 1)

    near = (F.col("n") <= F.col("m") * reach + 1e-9) & (F.col("m") <= F.col("n") * reach + 1e-9)
    names = left.select(group, F.col("norm").alias("name"), F.lit(0).alias("side")).unionByName(right.select(group, F.col("close").alias("name"), F.lit(1).alias("side"))).withColumn("len", F.length("name"))
    lengths = names.groupBy(group, "side", "len").agg(F.count(F.lit(1)).alias("_many"))
    met = lengths.filter("side = 0").select(group, F.col("len").alias("m")).join(lengths.filter("side = 1").select(group, F.col("len").alias("n")), group).filter(near)
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("m").alias("len"), F.col("n").alias("other")), F.struct(F.lit(1).alias("side"), F.col("n").alias("len"), F.col("m").alias("other")))
    total = F.col("len") + F.col("other")
    kind = F.explode(F.array(F.when((F.col("len") <= 15) & (F.col("other") <= 15), F.struct(F.lit(2).alias("q"), needed(total, 2).alias("shared"))), F.when((F.col("len") >= 12) & (F.col("other") >= 12), F.struct(F.lit(3).alias("q"), needed(total, 3).alias("shared")))))
    wanted = met.select(group, F.explode(ends).alias("x")).select(group, "x.*").select(group, "side", "len", kind.alias("k")).filter("k IS NOT NULL").groupBy(group, "side", "len", "k.q").agg(F.min("k.shared").alias("shared"))
    parts = names.join(F.broadcast(wanted), [group, "side", "len"])  # a row for each length there is
    grams = F.when(F.col("q") == 2, _grams(F.col("name"), 2)).otherwise(_grams(F.col("name"), 3))
    parts = parts.select(group, "side", "name", "len", "q", "shared", F.array_distinct(grams).alias("grams"))
    long = parts.select(group, "side", "name", "len", "q", "shared", F.size("grams").alias("kinds"), F.explode("grams").alias("gram"))
    # sets overlap by as many fewer as grams repeat in a name
    long = long.withColumn("repeats", F.col("len") - F.col("q") + 1 - F.col("kinds")).drop("kinds")
    often = long.filter("side = 1").groupBy(group, "q", "gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = long.join(often.hint("merge"), [group, "q", "gram"]).groupBy(group, "side", "name", "len", "q", "shared", "repeats").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("rare"))
    # grams that no name of the other side has would come first, so they use up places
    room = F.size("rare") - F.greatest(F.col("shared") - F.col("repeats"), F.lit(1)) + 1
    ranked = ranked.withColumn("rare", F.slice("rare", 1, F.greatest(room, F.lit(0)).cast("int")))
    if crowded:
        # no row is lost by the filter; the joins below ask for it, and so one shuffle does for both kinds
        ranked = ranked.filter(F.col(group).isNotNull() & F.col("q").isNotNull()).withColumn("heavy", (F.col("side") == 0) & (F.aggregate("rare", F.lit(0).cast("long"), lambda n, x: n + x["often"]) > HEAVY))
        heavy = ranked.filter("heavy").select(group, F.col("name").alias("norm")).distinct()
        ranked = ranked.filter(~F.col("heavy"))
    rare = ranked.withColumn("bits", _bits("name")).select(group, "side", "name", "len", "q", "bits.*", F.explode("rare").alias("_g"))
    side = lambda k, name, n, own: rare.filter(f"side = {k}").select(group, "q", F.col("_g.gram").alias("gram"), F.col("name").alias(name), F.col("len").alias(n), *[F.col(w).alias(own + w) for w in _WORDS])
    total = F.col("m") + F.col("n")
    alike = (_only_in("a", "b") <= F.col("m") - 1 - needed(total, 2)) & (_only_in("b", "a") <= F.col("n") - 1 - needed(total, 2))
    pairs = side(0, "norm", "m", "a").join(side(1, "close", "n", "b").hint("merge"), [group, "q", "gram"]).filter(near & alike)
    pairs = pairs.select(group, "norm", "close")
    return (pairs.unionByName(_counted(heavy, right.select(group, "close"), group, cutoff)) if crowded else pairs).distinct()


def resolve_names(requests: DataFrame, players: DataFrame, group: str, raw: str, ident: str, name: str, cutoff: float = CUTOFF, crowded: bool = False) -> DataFrame:
    """``requests`` with resolved_id, method, matched_name and n_candidates.

    Each level joins on pre-aggregated keys. The fuzzy level compares only what
    :func:`close_candidates` leaves, and accepts only if the three closest names are one id; ``crowded`` is for tables of
    many names that are made of the same few q-grams.
    """
    index = name_index(players, group, ident, name)
    asked = requests.select(group, raw).distinct().withColumn("norm", normalize_name(F.col(raw)))
    exact = index.groupBy(group, "norm").agg(F.collect_set(ident).alias("exact_ids"))
    out = asked.join(exact.hint("merge"), [group, "norm"], "left")

    parts = F.split("norm", " ")
    tails = F.array_distinct(F.filter(F.array(F.when(F.length(parts[0]) <= 2, F.array_join(F.slice(parts, 2, 1000), " ")), F.try_element_at(parts, F.lit(-1))), lambda x: x.isNotNull() & (x != "")))
    tried = asked.filter(F.size(parts) >= 2).select(group, "norm", F.substring("norm", 1, 1).alias("letter"), F.explode(tails).alias("tail"))
    surnames = index.select(group, ident, "letter", F.explode(F.array_distinct(F.array("surname", "last"))).alias("tail"), F.col("norm").alias("full")).filter("tail != ''")
    alias = tried.join(surnames.hint("merge"), [group, "letter", "tail"]).groupBy(group, "norm").agg(F.collect_set(ident).alias("alias_ids"), F.min("full").alias("alias_name"))
    out = out.join(alias.hint("merge"), [group, "norm"], "left")

    left = out.filter(F.col("exact_ids").isNull() & F.col("alias_ids").isNull() & (F.col("norm") != "")).select(group, "norm")
    names = index.groupBy(group, "norm").agg(F.collect_set(ident).alias("ids")).withColumnRenamed("norm", "close")
    pairs = close_candidates(left, names.select(group, "close"), group, cutoff, crowded).join(names.hint("merge"), [group, "close"])

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            m = difflib.SequenceMatcher(None, y, x)
            return m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    close = pairs.withColumn("ratio", ratio("norm", "close")).filter(F.col("ratio") >= cutoff)
    nth = F.row_number().over(W.partitionBy(group, "norm").orderBy(F.desc("ratio"), F.desc("close")))
    first = close.withColumn("nth", nth).filter("nth <= 3")
    top = first.groupBy(group, "norm").agg(F.array_sort(F.collect_list(F.struct("nth", "close", "ids"))).alias("top"))
    fuzzy = top.select(group, "norm", F.array_distinct(F.flatten(F.transform("top", lambda t: t["ids"]))).alias("fuzzy_ids"), F.col("top")[0]["close"].alias("fuzzy_name"))
    out = out.join(fuzzy.hint("merge"), [group, "norm"], "left")

    one = lambda c: F.when(F.size(c) == 1, F.col(c)[0])
    level = F.when(F.col("norm") == "", "none").when(F.col("exact_ids").isNotNull(), "exact").when(F.col("alias_ids").isNotNull(), "alias").when(F.col("fuzzy_ids").isNotNull(), "fuzzy_review").otherwise("none")
    found = F.when(level == "exact", one("exact_ids")).when(level == "alias", one("alias_ids")).when(level == "fuzzy_review", one("fuzzy_ids"))
    n = F.when(level == "exact", F.size("exact_ids")).when(level == "alias", F.size("alias_ids")).when(level == "fuzzy_review", F.size("fuzzy_ids")).otherwise(0)
    shown = F.when(level == "exact", F.col("norm")).when(level == "alias", F.col("alias_name")).when(level == "fuzzy_review", F.col("fuzzy_name"))
    resolved = out.select(group, raw, found.alias("resolved_id"), F.when(found.isNull(), "unresolved").otherwise(level).alias("method"), F.when(found.isNotNull(), shown).alias("matched_name"), n.alias("n_candidates"))
    return requests.join(resolved.withColumnRenamed(raw, "_raw").hint("merge"), (requests[group] == resolved[group]) & requests[raw].eqNullSafe(F.col("_raw")), "left").select(requests["*"], "resolved_id", "method", "matched_name", "n_candidates")


def resolve_matches(matches: DataFrame, players: DataFrame, group: str, a: str, b: str, ident: str, name: str) -> DataFrame:
    """Both sides resolved; one id on both sides resolves neither; usable needs both."""
    fields = ["resolved_id", "method"]
    left = resolve_names(matches, players, group, a, ident, name).drop("matched_name", "n_candidates")
    for f in fields:
        left = left.withColumnRenamed(f, f"{f}_a")
    both = resolve_names(left, players, group, b, ident, name).drop("matched_name", "n_candidates")
    for f in fields:
        both = both.withColumnRenamed(f, f"{f}_b")
    same = F.coalesce(F.col("resolved_id_a") == F.col("resolved_id_b"), F.lit(False))
    for s in ("a", "b"):
        both = both.withColumn(f"_i{s}", F.when(~same, F.col(f"resolved_id_{s}"))).withColumn(f"_m{s}", F.when(same, "unresolved").otherwise(F.col(f"method_{s}")))
    for s in ("a", "b"):
        both = both.drop(f"resolved_id_{s}", f"method_{s}").withColumnRenamed(f"_i{s}", f"resolved_id_{s}").withColumnRenamed(f"_m{s}", f"method_{s}")
    return both.withColumn("usable", F.col("resolved_id_a").isNotNull() & F.col("resolved_id_b").isNotNull())


def resolve_or_mint(requests: DataFrame, players: DataFrame, group: str, raw: str, ident: str, name: str) -> DataFrame:
    """An existing id, or a new one made from the name; ``is_new`` says which."""
    out = resolve_names(requests, players, group, raw, ident, name)
    return out.withColumn("is_new", F.col("resolved_id").isNull()).withColumn("resolved_id", F.coalesce("resolved_id", minted_id(F.col(raw))))
