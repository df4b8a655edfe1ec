"""Joins, mirrors, differences and set operations with the null rules each needs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..llm import bytewords
from ..session import ship_package


def mirror(df: DataFrame, shared: Sequence[str], sides: dict[str, dict[str, str]], label: str = "side") -> DataFrame:
    """One wide row to a row per side in one scan: ``sides[name]`` maps new to old columns."""
    def value(c):
        return F.col(c) if isinstance(c, str) else c

    rows = F.array(*[F.struct(F.lit(name).alias(label), *[value(old).alias(new) for new, old in cols.items()]) for name, cols in sides.items()])
    return df.select(*shared, F.explode(rows).alias("_s")).select(*shared, "_s.*")


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df``, failing at run time if a key has two rows."""
    n = F.count(F.lit(1)).over(W.partitionBy(*key))
    check = F.when(n > 1, F.raise_error(F.lit(f"key {list(key)} isn't unique")).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_ok", check).filter("_ok").drop("_ok")


def unique_merge(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join of two tables in each of which a key has one row."""
    return assert_unique(left, key).join(assert_unique(right, key), list(key))


def enrich(df: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Left joins with one table after another, (table, key, suffix of its other columns); rows never multiply."""
    for right, key, suffix in tables:
        others = [c for c in right.columns if c not in key]
        one = right.groupBy(*key).agg(F.min(F.struct(*others)).alias("_r"))
        df = df.join(one.select(*key, *[F.col(f"_r.{c}").alias(f"{c}{suffix}") for c in others]), list(key), "left")
    return df


def opponent_join(df: DataFrame, match: Sequence[str], own: str, other: str, columns: Sequence[str], prefix: str = "opponent_") -> DataFrame:
    """The ``columns`` of the row of the same match whose ``own`` is this row's ``other``."""
    right = df.select(*[F.col(m).alias(f"_m_{m}") for m in match], F.col(own).alias("_own"), *[F.col(c).alias(prefix + c) for c in columns])
    on = reduce(lambda a, b: a & b, [F.col(m) == F.col(f"_m_{m}") for m in match]) & (F.col(other) == F.col("_own"))
    return df.join(right, on, "left").drop("_own", *[f"_m_{m}" for m in match])


def opponent_values(df: DataFrame, match: Sequence[str], slot: str, columns: Sequence[str], prefix: str = "opponent_") -> DataFrame:
    """As :func:`opponent_join` where a match has exactly two rows: no join, one window."""
    w = W.partitionBy(*match).orderBy(slot)
    return df.select("*", *[F.coalesce(F.lead(c).over(w), F.lag(c).over(w)).alias(prefix + c) for c in columns])


def with_pair(df: DataFrame, own: str, other: str) -> DataFrame:
    """``df`` with the unordered pair of two columns, as _pair_a and _pair_b."""
    return df.withColumns({"_pair_a": F.least(own, other), "_pair_b": F.greatest(own, other)})


def opponent_pair(df: DataFrame, match: Sequence[str], own: str, other: str, side: str, columns: Sequence[str], prefix: str = "opponent_") -> DataFrame:
    """As :func:`opponent_join` where a match is two rows that name each other and whose ``side``
    differs: windows by match in place of a self-join, so nothing above is worked out twice.

    Rows of a match that was delivered twice see the least row of the other side. Tables that
    :func:`with_pair` has been over share its shuffle among calls.
    """
    ready = df if "_pair_a" in df.columns else with_pair(df, own, other)
    w = W.partitionBy(*match, "_pair_a", "_pair_b")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    out = ready.select("*", F.min(side).over(w).alias("_first"), F.max(side).over(w).alias("_last"))
    mine = lambda end: F.min(F.when(F.col(side) == F.col(end), row)).over(w)
    out = out.select("*", mine("_first").alias("_row_first"), mine("_last").alias("_row_last"))
    known = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in match]) & (F.col("_first") != F.col("_last"))
    there = F.when(known, F.when(F.col(side) == F.col("_first"), F.col("_row_last")).otherwise(F.col("_row_first")))
    return out.withColumn("_there", there).select(*df.columns, *[F.col(f"_there.c{i}").alias(prefix + c) for i, c in enumerate(columns)])


def opponent_sent(df: DataFrame, match: Sequence[str], own: str, other: str, side: str, columns: Sequence[str], order: str, parts: int, prefix: str = "opponent_") -> DataFrame:
    """As :func:`opponent_pair` for a table that stands by ``own`` in ``parts`` parts: each row sends
    keys and those ``columns`` that are used to its opponent, and isn't shuffled itself.

    Rows and what was sent to them are one union, whose two sides are dealt alike, and meet by
    windows. Of a match that was delivered twice the row that is least by ``order`` is seen. What
    makes ``columns`` runs for both sides, from one shuffle if both read the same columns of it.
    """
    names, kinds = [prefix + c for c in columns], dict(df.dtypes)
    ends = {own: F.col(other), other: F.col(own), side: F.col(side), **{m: F.col(m) for m in match}}
    sent = df.select(*[ends.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in df.columns], F.lit(True).alias("_sent"), F.col(order).alias("_order"), *[F.col(c).alias(n) for c, n in zip(columns, names)])
    kept = df.select("*", F.lit(False).alias("_sent"), F.lit(None).cast(kinds[order]).alias("_order"), *[F.lit(None).cast(kinds[c]).alias(n) for c, n in zip(columns, names)])
    w = W.partitionBy(own, *match, other)
    both = kept.unionAll(sent.repartition(parts, own)).select("*", F.min(side).over(w).alias("_first"), F.max(side).over(w).alias("_last"))
    # one row at most of each side is least, as the order tells an entity's rows apart
    of = lambda n, end: F.min_by(n, F.when(F.col("_sent") & (F.col(side) == F.col(end)), F.col("_order"))).over(w)
    known = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in match]) & (F.col("_first") != F.col("_last"))
    seen = [F.when(known, F.when(F.col(side) == F.col("_first"), of(n, "_last")).otherwise(of(n, "_first"))).alias(n) for n in names]
    return both.select(*df.columns, "_sent", *seen).filter(~F.col("_sent")).drop("_sent")


def first_match(df: DataFrame, table: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join with the first row of each key in a small parameter table."""
    from .windows import first

    return df.join(first(table, key, order), list(key), "left")


def with_folds(df: DataFrame, date: str, folds: Sequence[dict[str, str]]) -> DataFrame:
    """A row for each fold and role (train up to train_end, test between) a row has a part in."""
    day = F.col(date).cast("date")
    parts = []
    for f in folds:
        parts.append(F.when(day <= F.lit(f["train_end"]).cast("date"), F.struct(F.lit(f["name"]).alias("fold"), F.lit("train").alias("role"))))
        parts.append(F.when(day.between(F.lit(f["test_start"]).cast("date"), F.lit(f["test_end"]).cast("date")), F.struct(F.lit(f["name"]).alias("fold"), F.lit("test").alias("role"))))
    return df.withColumn("_f", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull()))).select("*", "_f.fold", "_f.role").drop("_f")


def expand(df: DataFrame, values: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Cross product with a few constant rows."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in values])
    return df.select("*", F.explode(rows).alias("_c")).select("*", "_c.*").drop("_c")


def diff_full_outer(before: DataFrame, after: DataFrame, key: Sequence[str], numeric: Sequence[str], text: Sequence[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """Presence (both, before_only, after_only), both values and ``changed``, for every key.

    Numbers differ beyond the tolerance, and a number missing on one side of a key that both
    have isn't a change; texts differ null-safely; a key that one side lacks is changed.
    """
    a = before.select(*key, *[F.col(c).alias(f"{c}_before") for c in (*numeric, *text)], F.lit(1).alias("_a"))
    b = after.select(*key, *[F.col(c).alias(f"{c}_after") for c in (*numeric, *text)], F.lit(1).alias("_b"))
    out = a.join(b, list(key), "full_outer")
    one = F.col("_a").isNull() | F.col("_b").isNull()
    changes = [F.coalesce(F.abs(F.col(f"{c}_before") - F.col(f"{c}_after")) > tolerance, F.lit(False)) for c in numeric]
    changes += [~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")) for c in text]
    presence = F.when(F.col("_b").isNull(), "before_only").when(F.col("_a").isNull(), "after_only").otherwise("both")
    return out.select(*key, presence.alias("presence"), *[f"{c}_{s}" for c in (*numeric, *text) for s in ("before", "after")], reduce(lambda x, y: x | y, changes, one).alias("changed"))


def _digest(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The key and 128 bits of all ``columns``, NULLs told from values."""
    parts = [p for c in columns for p in (F.col(c), F.col(c).isNull())]
    return df.select(*key, F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(31), *parts).alias("b")).alias("_digest"))


def diff_digests(before: DataFrame, after: DataFrame, key: Sequence[str], numeric: Sequence[str], text: Sequence[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """As :func:`diff_full_outer` for wide tables: presence, ``changed``, the names that differ,
    and both sides' values as structs ``before`` and ``after`` where something does.

    Both sides' keys and digests are joined first; columns are read for keys whose digests
    differ, and only those rows are shuffled whole.
    """
    key, columns = list(key), [*numeric, *text]
    b = _digest(after, key, columns).withColumnRenamed("_digest", "_other")
    both = _digest(before, key, columns).join(b, key, "full_outer")
    presence = F.when(F.col("_other").isNull(), "before_only").when(F.col("_digest").isNull(), "after_only").otherwise("both")
    both = both.select(*key, presence.alias("presence"), (~F.col("_digest").eqNullSafe(F.col("_other"))).alias("_look"))
    look = both.filter("_look").select(*key)
    wide = lambda df, name: df.join(look, key, "left_semi").select(*key, F.struct(*columns).alias(name))
    rows = both.filter("_look").join(wide(before, "before"), key, "left").join(wide(after, "after"), key, "left")
    here = F.col("presence") == "both"
    tests = [F.when(~here | F.coalesce(F.abs(F.col(f"before.{c}") - F.col(f"after.{c}")) > tolerance, F.lit(False)), F.lit(c)) for c in numeric]
    tests += [F.when(~here | ~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in text]
    rows = rows.select(*key, "presence", F.filter(F.array(*tests), lambda x: x.isNotNull()).alias("differing"), "before", "after")
    rows = rows.select(*key, "presence", (~here | (F.size("differing") > 0)).alias("changed"), "differing", "before", "after")
    alike = both.filter("NOT _look").select(*key, "presence", F.lit(False).alias("changed"), F.array().cast("array<string>").alias("differing"))
    return rows.unionByName(alike, allowMissingColumns=True)


def detect_existing(new: DataFrame, existing: DataFrame, keys: dict[str, Column | str], contexts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Flags ``dup_<name>`` for keys (same name on both sides) and contexts (new, existing expression), and ``is_duplicate``."""
    out = new
    names = []
    for name, key in keys.items():
        column = F.col(key) if isinstance(key, str) else key
        seen = existing.select(column.alias(f"_k_{name}")).where(F.col(f"_k_{name}").isNotNull()).distinct().withColumn(f"_h_{name}", F.lit(True))
        out = out.withColumn(f"_n_{name}", column).join(seen, F.col(f"_n_{name}") == F.col(f"_k_{name}"), "left")
        out = out.withColumn(f"dup_{name}", F.coalesce(F.col(f"_h_{name}"), F.lit(False))).drop(f"_n_{name}", f"_k_{name}", f"_h_{name}")
        names.append(f"dup_{name}")
    for name, (mine, theirs) in contexts.items():
        seen = existing.select(theirs.alias(f"_k_{name}")).where(F.col(f"_k_{name}").isNotNull()).distinct().withColumn(f"_h_{name}", F.lit(True))
        out = out.withColumn(f"_n_{name}", mine).join(seen, F.col(f"_n_{name}") == F.col(f"_k_{name}"), "left")
        out = out.withColumn(f"dup_{name}", F.coalesce(F.col(f"_h_{name}"), F.lit(False))).drop(f"_n_{name}", f"_k_{name}", f"_h_{name}")
        names.append(f"dup_{name}")
    return out.withColumn("is_duplicate", reduce(lambda a, b: a | b, [F.col(n) for n in names]))


def semi(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*key).distinct(), list(key), "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*key).distinct(), list(key), "left_anti")


def distinct_right_join(df: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join with the first right row of each key, so rows never multiply."""
    return first_match(df, right, key, order)


def _windows(rows: DataFrame, keys: Sequence[str], text: str, sizes: Sequence[int], wanted: np.ndarray | None = None) -> DataFrame:
    """(keys, a, b, size, gram): the distinct windows of ``sizes`` (1 to 8) bytes of each text, once.

    A window's bytes are its gram, as a number. ``a`` and ``b`` name the text. With ``wanted``,
    bits by :func:`_places`, only windows whose bit is set are given.
    """
    schema = T.StructType([rows.schema[c] for c in (*keys, "a", "b")] + [T.StructField("size", T.IntegerType()), T.StructField("gram", T.LongType())])

    def found(batches):
        for batch in batches:
            for begin, texts in bytewords.slices(batch.column(text), 1 << 20):
                raw, offsets = bytewords.buffer(texts)
                ends = np.repeat(offsets[1:], np.diff(offsets))
                grams = np.zeros(len(raw), np.uint64)
                for size in range(1, max(sizes) + 1):
                    grams = grams[: max(len(raw) - size + 1, 0)] << np.uint64(8) | raw[size - 1 :]
                    if size not in sizes:
                        continue
                    inside = np.flatnonzero(np.arange(size, len(raw) + 1) <= ends[: len(grams)])
                    if wanted is not None:
                        place = _places(grams[inside], size)
                        inside = inside[(wanted[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    owner, held = np.searchsorted(offsets, inside, "right") - 1, grams[inside]
                    order = np.lexsort((held, owner))
                    owner, held = owner[order], held[order]
                    new = np.ones(len(held), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (held[1:] != held[:-1])
                    owner, held = owner[new], held[new].view(np.int64)
                    kept = batch.select([*keys, "a", "b"]).take(pa.array(begin + owner))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(held), size, np.int32)), pa.array(held)], names=schema.names)

    return rows.select(*keys, "a", "b", text).mapInArrow(found, schema)


#: Bits that stand for all windows looked for, so that a worker drops most others (fixed value).
_BITS = 1 << 22


def _places(grams: np.ndarray, size: int) -> np.ndarray:
    return bytewords.mix(grams + np.uint64(size)) & np.uint64(_BITS - 1)


def _wanted_bits(wanted: DataFrame) -> np.ndarray:
    """The bits of all windows looked for: 512 kB, however many there are."""
    def bits(batches):
        have = np.zeros(_BITS >> 3, np.uint8)
        for batch in batches:
            size, gram = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for n in np.unique(size).tolist():
                place = _places(gram[size == n], n)
                np.bitwise_or.at(have, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        part = np.flatnonzero(have.reshape(-1, 4096).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([have[p * 4096 : p * 4096 + 4096].tobytes() for p in part.tolist()], pa.binary())], names=["part", "bits"])

    parts = wanted.select("size", "gram").coalesce(8).mapInArrow(bits, "part int, bits binary").collect()  # 8 times 512 kB at most
    out = np.zeros(_BITS >> 3, np.uint8)
    for row in parts:
        out[row.part * 4096 : row.part * 4096 + 4096] |= np.frombuffer(row.bits, np.uint8)
    return out


def contains_join(left: DataFrame, right: DataFrame, equal: Sequence[tuple[str, str]], text: str, part: str, q: int = 8) -> DataFrame:
    """Equal keys, and the right's ``part`` within the left's ``text``.

    Only texts that hold the part's rarest ``q`` bytes in a row (at most 8; the whole part, if
    it is shorter) are looked at: names of texts meet parts in a join on the keys and those
    bytes. Where they are the whole part that decides; else ``contains`` does. An empty part is
    in every text; NULLs are in none.
    """
    ship_package(left.sparkSession)
    keys, q = [f"_k{i}" for i in range(len(equal))], min(q, 8)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(x) == F.col(y) for x, y in zip(a, b)], F.lit(True))
    name = lambda df, of: df.select("*", F.xxhash64(of).alias("a"), F.xxhash64(F.lit(31), of).alias("b"))
    parts = right.select(*[F.col(b).alias(k) for k, (_, b) in zip(keys, equal)], F.col(part).alias("_part")).filter("_part IS NOT NULL").distinct()
    length = F.octet_length("_part")
    sizes = sorted(r.n for r in parts.select(F.least(length, F.lit(q)).alias("n")).distinct().collect())  # at most q + 1 numbers
    other = right.select("*", *[F.col(b).alias(f"_r{k}") for k, (_, b) in zip(keys, equal)], F.col(part).alias("_r_part"))
    drop = [f"_r{k}" for k in keys] + ["_r_part"]
    # an empty part needs no search
    out = left.filter(F.col(text).isNotNull()).join(other.filter("_r_part = ''"), same([a for a, _ in equal], drop)).drop(*drop)
    sizes = [n for n in sizes if n]
    if not sizes:
        return out
    long = name(parts.filter(length > 0), "_part")
    mine = _windows(long, [*keys], "_part", sizes).join(long.withColumnsRenamed({k: f"_w{k}" for k in keys}), ["a", "b"]).filter(same(keys, [f"_w{k}" for k in keys]))
    wanted = mine.filter(F.col("size") == F.least(length, F.lit(q))).select(*keys, "_part", "size", "gram")
    rows = name(left.filter(F.col(text).isNotNull()), F.col(text))
    clean = rows.select(*[F.col(a).alias(k) for k, (a, _) in zip(keys, equal)], "a", "b", F.col(text).alias("_text"))
    held = _windows(clean, keys, "_text", sizes, _wanted_bits(wanted.select("size", "gram").distinct()))
    gram = [*keys, "size", "gram"]
    held = held.join(wanted.select(*gram).distinct(), gram, "left_semi").distinct()
    often = held.groupBy(*gram).agg(F.count(F.lit(1)).alias("_n"))
    # a part with bytes that no text has is in none
    rarest = wanted.join(often, gram).groupBy(*keys, "_part").agg(F.min_by(F.struct("size", "gram"), F.struct("_n", "size", "gram")).alias("_g")).select(*keys, "_part", "_g.*")
    pairs = held.join(rarest, gram).select(*keys, F.struct("a", "b").alias("_i"), "_part")
    rows = rows.withColumn("_id", F.struct("a", "b")).drop("a", "b")
    meet = lambda some: rows.join(some, same([a for a, _ in equal], keys) & (F.col("_id") == F.col("_i")))
    found = meet(pairs.filter(length <= q)).unionByName(meet(pairs.filter(length > q)).filter(F.contains(text, "_part")))
    on = same(keys, [f"_r{k}" for k in keys]) & (F.col("_part") == F.col("_r_part"))
    return out.unionByName(found.join(other, on).drop("_id", "_i", *keys, "_part", *drop))


def pivot_map(df: DataFrame, key: Sequence[str], label: str, value: str) -> DataFrame:
    """One row per key with a map of label to value."""
    return df.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, value)))).alias(f"{value}_by_{label}"))


def match_lines(requests: DataFrame, prices: DataFrame, group: Sequence[str], name: str = "player", ident: str = "player_id", match: str = "match_id", line: str = "line", side: str = "side") -> DataFrame:
    """Exact line and side of a player's one match, or the reason there is none.

    A name that looks like an id is one; others compare as normalised names. Several matches
    are ambiguous; a line that isn't there is told with the lines that are.
    """
    from ..functions.text import looks_like_id, normalize_name

    wanted = requests.withColumn("_who", F.when(looks_like_id(F.col(name)), F.col(name)).otherwise(normalize_name(F.col(name))))
    keyed = prices.select("*", F.explode(F.array(F.col(ident), normalize_name(F.col(name)))).alias("_who")).where(F.col("_who").isNotNull())
    who = keyed.groupBy(*group, "_who").agg(F.collect_set(match).alias("_matches"), F.array_sort(F.collect_set(line)).alias("available_lines"))
    exact = keyed.select(*group, "_who", match, F.col(line).alias("_line"), F.col(side).alias("_side"), F.lit(True).alias("_hit")).distinct()
    out = wanted.join(who, [*group, "_who"], "left").withColumn("_m", F.when(F.size("_matches") == 1, F.col("_matches")[0]))
    exact = exact.withColumnRenamed(match, "_m")
    out = out.join(exact.withColumnRenamed("_line", "_l").withColumnRenamed("_side", "_s"), (reduce(lambda a, b: a & b, [out[g] == exact[g] for g in group])) & (out["_who"] == exact["_who"]) & (out["_m"] == exact["_m"]) & (out[line] == F.col("_l")) & (out[side] == F.col("_s")), "left").select(out["*"], "_hit")
    reason = (
        F.when(F.col("_matches").isNull(), "player_not_found")
        .when(F.size("_matches") > 1, "ambiguous_match")
        .when(F.col("_hit").isNull(), F.concat(F.lit("line_not_available: "), F.array_join(F.transform("available_lines", lambda x: x.cast("string")), ", ")))
    )
    return out.select(*requests.columns, F.col("_m").alias("matched_id"), F.coalesce("_hit", F.lit(False)).alias("matched"), reason.alias("match_reason"))
