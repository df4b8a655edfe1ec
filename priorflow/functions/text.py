"""Names, slugs, ids, display strings and labels as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters with marks that decompose to an ASCII letter, and those letters (built by rule).
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFKD", c)[0].isascii() and unicodedata.normalize("NFKD", c)[0].isalpha() and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", c)[1:])]
MARKED, PLAIN = "".join(_MARKED), "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)


def strip_marks(s: Column) -> Column:
    """Latin letters without their marks, and no combining marks."""
    return F.regexp_replace(F.translate(s, MARKED, PLAIN), r"[̀-ͯ]", "")


def normalize_name(s: Column) -> Column:
    """Lower-case ASCII words between single spaces; NULL becomes ''."""
    spaced = F.regexp_replace(strip_marks(F.coalesce(s, F.lit(""))), "[^A-Za-z0-9 ]", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, " +", " ")))


@F.pandas_udf(T.StringType())
def normalize_name_exact(s: pd.Series) -> pd.Series:
    """As :func:`normalize_name`, with full compatibility decomposition of every script."""
    plain = s.fillna("").map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))
    return plain.str.replace("[^A-Za-z0-9 ]", " ", regex=True).str.replace(" +", " ", regex=True).str.strip().str.lower()


def slug(s: Column, separator: str = "-") -> Column:
    dashed = F.regexp_replace(normalize_name(s), "[^a-z0-9]+", separator)
    return F.trim(F.btrim(dashed, F.lit(separator)))


def match_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[slug(p) for p in parts])


def canonical_id(group: Column, raw: Column) -> Column:
    return F.concat(F.upper(group), F.lit("-"), raw.cast("string"))


def minted_id(name: Column) -> Column:
    made = F.upper(slug(name))
    return F.when(made == "", "NEW-UNKNOWN").otherwise(F.concat(F.lit("NEW-"), made))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 16 hex digits of the sha1 of all parts, NULL counting as ''."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 16))


def looks_like_id(s: Column) -> Column:
    return F.coalesce(s.rlike("^(ATP|WTA)-"), F.lit(False))


def pair_key(a: Column, b: Column) -> Column:
    """One key for an unordered pair."""
    return F.array_join(F.array_sort(F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "|")


def parse_decimal(s: Column) -> Column:
    """A number with comma or dot; NULL if it isn't one."""
    return F.regexp_replace(F.trim(s), ",", ".").try_cast("double")


def plus_display(s: Column) -> Column:
    """'6+' becomes (5.5, Over); others have no line."""
    n = F.regexp_extract(F.trim(s), r"^(\d+)\+$", 1).try_cast("double")
    return F.when(n > 0, F.struct((n - 0.5).alias("line"), F.lit("Over").alias("side")))


def total_display(s: Column) -> Column:
    """'Mais de 22,5' / 'Menos de 22,5' becomes (22.5, Over / Under)."""
    pattern = r"(?i)^\s*(mais|menos)\s+de\s+(\d+(?:[.,]\d+)?)\s*$"
    word, n = F.lower(F.regexp_extract(s, pattern, 1)), parse_decimal(F.regexp_extract(s, pattern, 2))
    return F.when(n.isNotNull(), F.struct(n.alias("line"), F.when(word == "mais", "Over").otherwise("Under").alias("side")))


def line_and_side(market: Column, display: Column) -> Column:
    """By market: counts of at least n for players, totals above or below a line."""
    return F.when(market.contains("total_games"), total_display(display)).otherwise(plus_display(display))


def split_list(s: Column, separator: str) -> Column:
    """Parts of a joined list without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def safe_slug(s: Column) -> Column:
    """A slug for file names, with ``_``."""
    return slug(s, "_")


def value_after(lines: Column, label: str) -> Column:
    """What follows ``label:`` in the first line that begins so."""
    found = F.filter(lines, lambda x: F.startswith(F.trim(x), F.lit(f"{label}:")))
    return F.trim(F.substring_index(F.get(found, F.lit(0)), f"{label}:", -1))


def clean_number(s: Column) -> Column:
    """The number in a text with a sign, a comma or dot, and what is around it."""
    return parse_decimal(F.nullif(F.regexp_extract(s, r"([-+]?\d+(?:[.,]\d+)?)", 1), F.lit("")))


def parse_report(text: Column, labels: dict[str, str], start: str) -> Column:
    """Blocks of a text report: a struct for each, of the values after its labels.

    A block begins at a line with ``start``; what comes before the first isn't one.
    """
    blocks = F.filter(F.split(text, f"(?m)^(?={start})"), lambda b: F.startswith(b, F.lit(start)))
    return F.transform(blocks, lambda b: F.struct(*[value_after(F.split(b, "\n"), label).alias(name) for name, label in labels.items()]))


def bilingual(key: Column, labels: dict[str, str]) -> Column:
    """A label by key; unknown keys in title case, NULL as 'N/A'."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    known = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)
    return F.when(key.isNull(), "N/A").otherwise(F.coalesce(known, F.initcap(F.regexp_replace(key, "_", " "))))


def format_percent(x: Column, decimals: int = 1, signed: bool = False) -> Column:
    sign = "+" if signed else ""
    return F.when(x.isNull(), "N/A").otherwise(F.format_string(f"%{sign}.{decimals}f%%", x * 100))


def format_points(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%+.1f p.p.", x * 100))


def format_number(x: Column, decimals: int = 2) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string(f"%.{decimals}f", x))


def format_text(x: Column) -> Column:
    return F.when(x.isNull() | (F.trim(x) == ""), "N/A").otherwise(x)


def parse_day(s: Column) -> Column:
    """yyyyMMdd as a date; NULL if it isn't one."""
    return F.to_date(F.try_to_timestamp(s.cast("string"), F.lit("yyyyMMdd")))


def parse_instant(s: Column) -> Column:
    """An ISO date or time of any usual form as a UTC instant; NULL if it isn't one."""
    return F.coalesce(s.try_cast("timestamp"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(s, F.lit("dd/MM/yyyy HH:mm")))


def to_zone(local: Column, zone: Column, display: str) -> Column:
    """Struct utc, shown: a local time and its IANA zone as UTC and in a display zone."""
    utc = F.to_utc_timestamp(local, zone)
    return F.struct(utc.alias("utc"), F.from_utc_timestamp(utc, display).alias("shown"))


def staleness(days: Column) -> Column:
    """ATUAL up to 30 days, MODERADAMENTE_DEFASADO up to 90, else (and unknown) MUITO_DEFASADO."""
    return F.when(days <= 30, "ATUAL").when(days <= 90, "MODERADAMENTE_DEFASADO").otherwise("MUITO_DEFASADO")


def blocks_strong(bucket: Column) -> Column:
    return bucket == "MUITO_DEFASADO"


def event_status(event: Column, now: Column) -> Column:
    """futuro, proximo (within 2 hours), iniciado (up to 5 hours after), encerrado."""
    return (
        F.when(now < event - F.expr("INTERVAL 2 HOURS"), "futuro")
        .when(now < event, "proximo")
        .when(now < event + F.expr("INTERVAL 5 HOURS"), "iniciado")
        .when(event.isNotNull(), "encerrado")
    )
