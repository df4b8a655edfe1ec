"""Scans with declared schemas, validated text tables, and parsers of embedded data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_id, parse_day, parse_decimal, to_zone


def union_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """All files with one schema, tagged with ``_source_file``."""
    return spark.read.schema(schema).csv(list(paths), header=True).withColumn("_source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text, with the row's place in its file, ``row_seq``.

    Files are split for reading, and places grow in reading order without being gapless, so
    nothing is gathered to count them.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True).withColumn("row_seq", F.monotonically_increasing_id())


def metric_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A report's rows by a declared schema; texts trimmed, blank ones NULL."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*[F.nullif(F.trim(F.col(f.name)), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema])


def history(spark: SparkSession, path: str, override: str | None = None) -> DataFrame:
    """A stage's table, or the one that takes its place."""
    return spark.read.parquet(override or path)


def fold_rows(spark: SparkSession, path: str, tour: str, folds: Sequence[str]) -> DataFrame:
    """Predictions of some folds: only their partitions are read."""
    return spark.read.parquet(path).filter((F.col("tour") == tour) & F.col("fold").isin(*folds))


def validated(df: DataFrame, required: Sequence[str], domains: dict[str, Sequence[str]] | None = None, not_blank: Sequence[str] = ()) -> DataFrame:
    """``df``, failing on missing columns at once and on bad values when read."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    bad = [F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))) for c, v in (domains or {}).items()]
    bad += [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} is blank")) for c in not_blank]
    wrong = F.coalesce(*bad) if bad else F.lit(None).cast("string")
    return df.filter(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_seq") -> DataFrame:
    """Rows numbered from 0 in a stated order; for small manual tables, as one task sorts them."""
    from pyspark.sql import Window as W

    return df.withColumn(out, F.row_number().over(W.orderBy(*order)) - 1)


def schema_evolution_union(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts; columns that a part lacks are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def player_dimension(raw: DataFrame, group: str, ident: str = "player_id", first: str = "name_first", last: str = "name_last", born: str = "dob") -> DataFrame:
    """canonical id, full name and date of birth."""
    return raw.select(canonical_id(F.lit(group), F.col(ident)).alias("player_id"), F.trim(F.concat_ws(" ", first, last)).alias("player_name"), parse_day(F.col(born)).alias("dob"), *[c for c in raw.columns if c not in (ident, first, last, born)])


def duplicate_ids(df: DataFrame, ident: str) -> DataFrame:
    """One row: ids that more than one row has, and how many rows those are."""
    often = df.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return often.agg(F.count(F.lit(1)).alias("n_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def rankings(parts: Sequence[DataFrame], date: str = "ranking_date") -> DataFrame:
    """Rankings of all parts; readers order by date and rank in their windows."""
    return schema_evolution_union(parts).withColumn(date, parse_day(F.col(date)))


def newest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The last by name of a folder's files or tables; only names are listed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return max((f.getPath().toString() for f in found or []), default=None)


def inspect_text(df: DataFrame, line: str = "value", source: str = "source", number: str = "line_no") -> DataFrame:
    """Per source: header, data rows and ragged rows (other number of fields than the header)."""
    head = df.filter(F.col(number) == 0).select(source, F.col(line).alias("header"))
    fields = F.size(F.split(F.regexp_replace(F.col(line), '"[^"]*"', ""), ",", -1))
    rows = df.filter(F.col(number) > 0).join(head, source)
    return rows.groupBy(source, "header").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(fields != F.size(F.split("header", ",", -1))).alias("n_ragged"))


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files that hold a list or one object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def calendar_files(spark: SparkSession, path: str, columns: Sequence[str], domains: dict[str, Sequence[str]], not_blank: Sequence[str], display: str) -> DataFrame:
    """All calendar files of a path: validated text rows with UTC and display times."""
    return calendar(validated(text_csv(spark, path, columns), columns, domains, not_blank), display)


def calendar(df: DataFrame, display: str, local: str = "event_datetime_original", zone: str = "event_timezone") -> DataFrame:
    """UTC and display times of local ones."""
    both = to_zone(F.col(local).try_cast("timestamp_ntz").cast("timestamp"), F.col(zone), display)
    return df.select("*", both["utc"].alias("event_utc"), both["shown"].alias("event_display"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, content read by executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def script_rows(html: Column, name: str) -> Column:
    """Rows of ``var <name> = [[...], ...]`` in a page, each as its text between brackets."""
    body = F.regexp_extract(html, rf"(?s)var\s+{name}\s*=\s*\[(.*?)\]\s*;", 1)
    return F.regexp_extract_all(body, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))


def quoted_fields(row: Column) -> Column:
    """Fields of a comma-separated row, quotes removed."""
    return F.transform(F.regexp_extract_all(row, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,]+)"""), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", ""))


def normal_lines(text: Column) -> Column:
    """Trimmed lines that aren't empty, inner blanks single."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def section(lines: Column, start: str, stop: Sequence[str]) -> Column:
    """Lines after the first equal to ``start`` up to the next that is in ``stop``."""
    def rest(x: Column, begin: Column) -> Column:
        return F.when(begin > 0, _with(F.slice(x, begin + 1, F.greatest(F.size(x) - begin, F.lit(0))), cut)).otherwise(F.array().cast("array<string>"))

    def cut(x: Column) -> Column:
        ends = F.filter(F.transform(x, lambda y, i: F.when(y.isin(*stop), i)), lambda i: i.isNotNull())
        return _with(ends, lambda e: F.when(F.size(e) > 0, F.slice(x, F.lit(1), e[0])).otherwise(x))

    return _with(lines, lambda x: _with(F.array_position(x, start).cast("int"), lambda begin: rest(x, begin)))


def plus_pairs(lines: Column) -> Column:
    """Structs (display, odds) of a line like '6+' followed by a number."""
    def pairs(x: Column) -> Column:
        shown = F.transform(x, lambda y, i: F.when(y.rlike(r"^\d+\+$|(?i)^(mais|menos) de \d+([.,]\d+)?$"), F.struct(y.alias("display"), parse_decimal(F.get(x, i + 1)).alias("odds"))))
        return F.filter(shown, lambda p: p["odds"].isNotNull())

    return _with(lines, pairs)


_READING = "array<struct<market:string,player:string,bookmaker_display:string,decimal_odds:double,source_confidence:double>>"


def model_readings(answer: Column, markets: Sequence[str]) -> Column:
    """Readings in a model's answer, fenced or not; incomplete ones are left out."""
    body = F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    parsed = F.from_json(body, _READING)
    return F.filter(F.coalesce(parsed, F.array().cast(_READING)), lambda r: r["market"].isin(*markets) & r["bookmaker_display"].isNotNull() & r["decimal_odds"].isNotNull())
